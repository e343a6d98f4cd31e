"""Token counts by section: offset-mapped attribution.

A document is encoded once, whole (where the tokenizer's definition allows it, by chunks between which no token can
span; see ``encoding``). The tokens' character spans are then interval-joined to the document's section spans, and a
token that crosses a section's end is given to one section by a stated rule, so that the sections' counts add up to
the document's count and no section is ever encoded by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skarn.llm.common import column, default_tokenizer, map_rows
from skarn.llm.encoding import SpanEncoder, encoder

RULES = ("first", "largest")


def line_sections(text: str) -> list[tuple[int, int]]:
    """Sections that tile a text: each line with the line end(s) that follow it. Empty text: one empty section."""
    ends = [i + 1 for i, c in enumerate(text) if c == "\n" and text[i + 1 : i + 2] != "\n"] if "\n" in text else []
    if not ends or ends[-1] != len(text):
        ends.append(len(text))
    return list(zip([0, *ends[:-1]], ends, strict=True))


def attribute(tokens: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section.

    ``sections`` are disjoint (start, end) spans in ascending order; gaps are allowed and a token that touches
    no section counts nowhere. ``first``: a token is its first overlapped section's. ``largest``: it is the
    section's that holds most of its characters, the earlier one on a tie. A crossing token is one that lies
    in several sections or partly in a gap; it is counted where it is allotted.
    """
    n = len(sections)
    counts, crossing = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not len(tokens):
        return counts, crossing
    filled = np.flatnonzero(sections[:, 1] > sections[:, 0])
    if not len(filled):
        return counts, crossing
    s0, s1 = sections[filled, 0], sections[filled, 1]
    t0, t1 = tokens[:, 0], np.maximum(tokens[:, 1], tokens[:, 0] + 1)
    first = np.searchsorted(s1, t0, side="right")
    last = np.searchsorted(s0, t1, side="left") - 1
    inside = first <= last
    t0, t1, first, last = t0[inside], t1[inside], first[inside], last[inside]
    chosen = first.copy()
    crosses = (first != last) | (t0 < s0[first]) | (t1 > s1[last])
    if rule == "largest":
        for i in np.flatnonzero(first != last):
            span = slice(first[i], last[i] + 1)
            chosen[i] = first[i] + int(np.argmax(np.minimum(s1[span], t1[i]) - np.maximum(s0[span], t0[i])))
    counts[filled] = np.bincount(chosen, minlength=len(filled))
    crossing[filled] = np.bincount(chosen[crosses], minlength=len(filled))
    return counts, crossing


def token_counts(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sections_col: str | None = None,
    rule: str = "first",
    tokenizer_path: str | None = None,
) -> DataFrame:
    """One row a section: id, ``section_no``, ``char_start``, ``char_end``, ``n_tokens``, ``n_crossing``.

    ``sections_col`` names an array of structs whose first two fields are a start and an end in code points
    (disjoint, any order; bounds are clipped to the text, and null bounds make an empty section); without it
    a text's lines are its sections. A null text is empty; an empty text has one empty section. A null id
    stays null, a text id stays text, and repeated rows give repeated results. Other columns are neither read nor
    returned.
    Scan-only: no shuffle; memory is one Arrow batch and the chunk memo.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer_path or default_tokenizer("byte_bpe_50k.json")
    own = [column(sections_col)] if sections_col else []
    stated = bool(sections_col)

    def make():
        spans_of = encoder(SpanEncoder, path).spans

        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text, *given in items:
                text = text or ""
                if stated:
                    bounds = [tuple(s.values())[:2] if s else (None, None) for s in given[0] or []]
                    clipped = [(0, 0) if None in s else (max(0, s[0]), min(s[1], len(text))) for s in bounds]
                    spans = sorted(clipped)
                else:
                    spans = line_sections(text)
                table = np.array(spans, np.int64).reshape(-1, 2)
                counts, crossing = attribute(spans_of(text), table, rule)
                for k, (a, b) in enumerate(spans):
                    yield doc_id, k, a, b, int(counts[k]), int(crossing[k])

        return run

    text_id = docs.schema[id_col].dataType.typeName() == "string"
    identity = column(id_col) if text_id else column(id_col).cast("bigint")
    return map_rows(
        docs.select(identity.alias(id_col), column(text_col), *own),
        make,
        [
            (id_col, pa.string() if text_id else pa.int64(), "string" if text_id else "bigint"),
            ("section_no", pa.int64(), "bigint"),
            ("char_start", pa.int64(), "bigint"),
            ("char_end", pa.int64(), "bigint"),
            ("n_tokens", pa.int64(), "bigint"),
            ("n_crossing", pa.int64(), "bigint"),
        ],
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs.select("doc_id", "text"))
