"""Secret scans with multipart credential linking.

Strong kinds are reported wherever they match. A credential of several parts is linked: identifiers, secret-looking
strings and endpoints are interval-joined within scopes, and the weak ones among them (a client or user name, a bare
secret string, a bare endpoint) are reported only where complementary parts co-occur. Joins are sweeps over sorted
spans, and every expression is anchored on a literal or of bounded length, so that a text costs time in proportion to
its length (times a logarithm), whatever it holds.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import arrow_fields, carried, column, free_name, map_rows

#: Kinds in the order that breaks ties of equal starts.
KINDS = ("assign", "access", "hex", "linked_identifier", "linked_secret", "linked_endpoint")

# Fixed values of the query's contract.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the maximal runs of 32 characters or more

#: Weak parts. An identifier: a temporary access identifier, or a client's, account's or user's name after its label. A secret
#: string: 40 characters as cloud vendors issue them, also right after "=". An endpoint: a URL or a service host.
_IDENTIFIER = re.compile(
    r"""(?<![A-Za-z0-9])(?:ASIA[A-Z0-9]{12,124}|(?i:access_?key_?id|client_?id|account_?(?:name|id)|user_?(?:name|id)|login)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9@._+-]{3,64})""",
    re.ASCII,
)
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])")
_URL = re.compile(r"(?:https?|s3|postgres|mysql|redis|amqp)://[A-Za-z0-9.-]+(?::[0-9]{1,5})?")
_SERVICE = re.compile(r"\.(?:amazonaws|digitaloceanspaces|wasabisys)\.com")
_LABELS = re.compile(r"[a-z0-9-]++(?:\.[a-z0-9-]++)*+")
_HEAD = re.compile(r"(?<![A-Za-z0-9_])[a-z0-9]")
#: Characters of a host's name up to its service's, at most.
_HOST = 253
_PARAGRAPH = re.compile(r"\n[\x20\t]*\n")

#: Characters on either side of an access identifier or strong secret that its scope takes in, within its paragraph.
SCOPE = 400
#: Bits a character of a secret string, at least.
ENTROPY = 3.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the strong kinds: leftmost non-overlapping matches of each, failing ones dropped."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def _scopes(text: str, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """An anchor's scope: SCOPE characters around it, within the paragraph that holds it."""
    breaks = [m.start() for m in _PARAGRAPH.finditer(text)]
    out = []
    for a, b in anchors:
        k = bisect_left(breaks, a)
        low = breaks[k - 1] if k else 0
        high = breaks[k] if k < len(breaks) else len(text)
        out.append((max(low, a - SCOPE), min(max(high, b), b + SCOPE)))
    return out


def within(spans: list[tuple[int, int]], scopes: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie wholly within some scope: of the scopes that start no later, the furthest end decides."""
    scopes = sorted(scopes)
    starts, reach, furthest = [s for s, _ in scopes], [], -1
    for _, high in scopes:
        furthest = max(furthest, high)
        reach.append(furthest)
    out = []
    for a, b in spans:
        k = bisect_right(starts, a)
        if k and reach[k - 1] >= b:
            out.append((a, b))
    return out


def holding(scopes: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[bool]:
    """Whether each scope holds some span wholly: of the spans that start no earlier, the nearest end decides."""
    spans = sorted(spans)
    starts, nearest = [a for a, _ in spans], []
    for _, b in reversed(spans):
        nearest.append(min(b, nearest[-1]) if nearest else b)
    nearest.reverse()
    at = (bisect_left(starts, low) for low, _ in scopes)
    return [k < len(spans) and nearest[k] <= high for k, (_, high) in zip(at, scopes, strict=True)]


def apart(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that overlap none of ``taken``."""
    merged: list[list[int]] = []
    for a, b in sorted(taken):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    starts = [a for a, _ in merged]
    out = []
    for a, b in spans:
        k = bisect_left(starts, b)  # the last stretch that starts before the span's end
        if not k or merged[k - 1][1] <= a:
            out.append((a, b))
    return out


def endpoints(text: str) -> list[tuple[int, int]]:
    """URLs, and service hosts outside them: lower-case labels, of up to _HOST characters, that end in a service's name
    (the last one of a run of labels)."""
    urls = [m.span() for m in _URL.finditer(text)] if "://" in text else []
    hosts = []
    for run in _LABELS.finditer(text) if _SERVICE.search(text) else ():
        if services := list(_SERVICE.finditer(text, run.start(), run.end())):
            at, end = services[-1].span()
            if head := _HEAD.search(text, max(run.start(), at - _HOST), at):
                hosts.append((head.start(), end))
    return sorted(urls + apart(hosts, urls))


def linked_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Weak parts with complementary parts in scope. A secret string is one near an identifier, strong or weak; a weak
    identifier near a secret, strong or linked; an endpoint near a strong secret, or near an identifier that has a
    secret in its scope."""
    taken = [(a, b) for a, b, _ in base]
    names = apart([m.span() for m in _IDENTIFIER.finditer(text)], taken)
    access = [(a, b) for a, b, k in base if k == "access"] + names
    own = [(a, b) for a, b, k in base if k != "access"]
    if not access and not own:
        return []
    scopes = _scopes(text, access)
    weak = [m.span() for m in _SECRET.finditer(text) if entropy(m[0]) >= ENTROPY] if access else []
    secrets = within(apart(weak, taken + names), scopes)
    paired = holding(scopes, own + secrets)
    first = len(access) - len(names)
    found = [(a, b, "linked_identifier") for (a, b), p in zip(names, paired[first:], strict=True) if p]
    ends = apart(endpoints(text), taken)
    near = [s for s, p in zip(scopes, paired, strict=True) if p] + (_scopes(text, own) if ends else [])
    return found + [(a, b, "linked_secret") for a, b in secrets] + [(a, b, "linked_endpoint") for a, b in within(ends, near)]


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text, both in order."""
    base = base_spans(text or "")
    added = linked_spans(text or "", base)
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]))) if added else base


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_assign``, ``n_access``, ``n_hex``, ``base`` and ``secrets`` (arrays of
    kind, start and end in code points).

    A null text is empty and has no spans. Other columns are carried; one named like an output column gives
    way to it. Repeated rows give repeated results, an empty table an empty one. One scan, no shuffle, one
    text in memory beside the Arrow batch.
    """
    new = ("n_assign", "n_access", "n_hex", "base", "secrets")
    kept = carried(docs, *new, text_col)
    body = free_name(docs, "secret_text")
    source = docs.select(*[column(c) for c in kept], column(text_col).alias(body))

    def rows_of(spans: list[tuple[int, int, str]]) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for a, b, k in spans]

    def make():
        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for *row, text in items:
                base, spans = scan(text)
                n = Counter(k for _, _, k in base)
                yield (*row, n["assign"], n["access"], n["hex"], rows_of(base), rows_of(spans))

        return run

    spans = (pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])), "array<struct<kind:string,start:bigint,end:bigint>>")
    fields = arrow_fields(source, kept)
    fields += [(c, pa.int64(), "bigint") for c in new[:3]] + [("base", *spans), ("secrets", *spans)]
    return map_rows(source, make, fields)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def text_of(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(text_of("base"), 256).alias("base_sha256"), text_of("secrets").alias("spans"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """The query's digest of base spans, for tests."""
    return hashlib.sha256(joined(spans).encode()).hexdigest()
