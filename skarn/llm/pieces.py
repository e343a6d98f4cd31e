"""SentencePiece BPE encoding by a prefix table, and decoding.

For every prefix of a text the last token of its encoding is unique. It is the longest vocabulary entry that
ends there (found by an Aho-Corasick automaton) whose own start is the start of the text or whose pair with the
last token of the prefix before it is compatible: the two, put together and encoded, stay as they are. The
table of last tokens is filled left to right, and the ids are read off it backwards. Nothing is merged over
the text itself; merging is used only to test a pair of tokens, once, since results are kept.

Texts are taken apart where no vocabulary entry can span: at characters that the vocabulary lacks (they become
bytes) and before a space mark that follows another character. Pure runs of space marks have tied scores in
some models, which the prefix table cannot order; they are merged plainly, by length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb

from skarn.llm.common import arrow_fields, carried, column, default_tokenizer, free_name, held_by_worker, map_rows

SPACE = "▁"
#: Units kept by a worker for good (the first seen, so the frequent ones) and until the next emptying; pairs.
MEMO_UNITS = 600_000
MEMO_LATER = 100_000
MEMO_PAIRS = 2_000_000
MEMO_LENGTH = 48


class PieceEncoder:
    """Encodes as the library does for a BPE model with byte fallback, without sampling."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = model_pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, trainer = model.normalizer_spec, model.trainer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        if trainer.model_type != trainer.BPE or not plain or trainer.treat_whitespace_as_suffix:
            raise ValueError("the model must be BPE with identity normalisation and space marks before words")
        self.dummy = SPACE if norm.add_dummy_prefix else ""
        kinds = model_pb.ModelProto.SentencePiece
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.bytes = [0] * 256
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        for k, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.bytes[int(p.piece[1:-1], 16)] = k
            elif p.type == kinds.NORMAL:
                self.id[p.piece] = k
                self.score[p.piece] = p.score
        self.unk, self.end = self.library.unk_id(), self.library.eos_id()
        self.fallback = trainer.byte_fallback
        runs = {p for p in self.id if not p.strip(SPACE)}
        scores = [s for p, s in self.score.items() if p not in runs and len(p) > 1]
        spanning = any(SPACE in p[1:] for p in self.id if p not in runs)
        below = min(scores, default=0.0) > max((self.score[p] for p in runs if len(p) > 1), default=float("-inf"))
        if len(set(scores)) < len(scores) or spanning or not below:
            raise ValueError("pieces with tied scores or inner space marks are not supported")
        self.text = {k: p for p, k in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p, k in self.id.items():
            if (p not in runs or p == SPACE) and self.merge(p) == [k]:  # a piece that merging never makes is never last
                self.automaton.add_word(p, (len(p), k))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.later: dict[str, tuple[int, ...]] = {}
        self.runs: dict[int, list[int]] = {}
        self.known = {p for p in self.id if len(p) == 1}
        self.multi = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merge(self, piece: str) -> list[int]:
        """Plain merging, highest score first, leftmost on ties; for single pieces, pairs and runs only."""
        parts: list[str | None] = list(piece)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (joined := parts[i] + parts[j]) in self.score:
                heapq.heappush(heap, (-self.score[joined], i, j, joined))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or parts[i] + parts[j] != joined or after[i] != j:
                continue
            parts[i], parts[j] = joined, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [self.id.get(p, -1) for p in parts if p is not None]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b can follow token a: their texts, encoded together, give just these two."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= MEMO_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merge(self.text[a] + self.text[b]) == [a, b]
        return known

    def by_table(self, text: str) -> list[int]:
        """Ids of a text of known characters without runs of space marks."""
        done = len(text)
        last, size = [-1] * (done + 1), [0] * (done + 1)
        pairs = self.pairs
        for at, (length, token) in self.automaton.iter(text):  # by end, and for one end the longest first
            at += 1
            if size[at]:
                continue
            start = at - length
            if start == 0 or pairs.get(last[start] << 32 | token) or self.compatible(last[start], token):
                last[at], size[at] = token, length
        ids = []
        while done > 0:
            ids.append(last[done])
            done -= size[done]
        return ids[::-1]

    def _run(self, n: int) -> list[int]:
        if n not in self.runs:
            if n > 4096:
                return self.merge(SPACE * n)
            self.runs[n] = self.merge(SPACE * n)
        return self.runs[n]

    def unit(self, unit: str) -> tuple[int, ...]:
        """Ids of space marks followed by other characters."""
        known = self.later.get(unit)
        if known is not None:
            return known
        word = unit.lstrip(SPACE)
        marks = len(unit) - len(word)
        ids: list[int] = []
        segment = SPACE if marks else ""
        first = True
        for c in chain(word, [None]):
            if c is not None and c in self.known:
                segment += c
                continue
            if segment:
                own = self.by_table(segment)
                if first and marks > 1:  # the last mark goes with the word, unless it stays alone
                    alone = self.text[own[0]] == SPACE
                    own = self._run(marks - (not alone)) + own[alone:]
                ids += own
            first, segment = False, ""
            if c is not None:
                ids += [self.bytes[b] for b in c.encode()] if self.fallback else [self.unk]
        found = tuple(ids)
        if len(unit) <= MEMO_LENGTH:
            if len(self.units) < MEMO_UNITS:
                self.units[unit] = found
            else:
                if len(self.later) >= MEMO_LATER:
                    self.later.clear()
                self.later[unit] = found
        return found

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without an end id."""
        if not text:
            return []
        marked = self.dummy + text.replace(" ", SPACE)
        if SPACE * 2 in marked:
            units = self.multi.findall(marked)
        else:
            head, *rest = marked.split(SPACE)
            units = ([head] if head else []) + [SPACE + w for w in rest]
        known = list(map(self.units.get, units))
        if None in known:
            known = [k or self.units.get(u) or self.unit(u) for u, k in zip(units, known, strict=True)]
        return list(chain.from_iterable(known))

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of a model file; a worker that runs several tasks in a row with it keeps it."""
    return held_by_worker(("pieces", path), lambda: PieceEncoder(path))


def encode_pieces(
    docs: DataFrame, text_col: str = "text", model_path: str | None = None, digests_only: bool = False
) -> DataFrame:
    """``docs`` without its text, with ``ids`` (an end id last), ``decoded``, ``n_tokens`` and their digests
    ``ids_sha256`` and ``decoded_sha256``; ``digests_only`` leaves out ``ids`` and ``decoded``.

    A null text is empty: the end id alone, decoded as empty. Other columns are carried; one that bears an
    output column's name gives way to it. Repeated rows give repeated results, an empty table an empty one. One
    scan, no shuffle; a task holds one Arrow batch and its bounded memos.
    """
    path = model_path or default_tokenizer("piece_bpe_32k.model")
    new = ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")
    kept = carried(docs, *new, text_col)
    body = free_name(docs, "piece_text")
    source = docs.select(*[column(c) for c in kept], F.coalesce(column(text_col), F.lit("")).alias(body))

    def make():
        encoder = piece_encoder(path)
        decimal = [str(i) for i in range(encoder.library.get_piece_size())]

        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for *row, text in items:
                ids = encoder.encode(text)
                ids.append(encoder.end)
                decoded = encoder.decode(ids)
                digest = hashlib.sha256(" ".join([decimal[i] for i in ids]).encode()).hexdigest()
                whole = () if digests_only else (ids, decoded)
                yield (*row, *whole, len(ids), digest, hashlib.sha256(decoded.encode()).hexdigest())

        return run

    fields = arrow_fields(source, kept)
    if not digests_only:
        fields += [("ids", pa.list_(pa.int32()), "array<int>"), ("decoded", pa.string(), "string")]
    fields += [("n_tokens", pa.int64(), "bigint"), ("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")]
    return map_rows(source, make, fields)


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token and round-trip digests of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_pieces(docs, digests_only=True)
