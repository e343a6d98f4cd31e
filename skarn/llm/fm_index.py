"""Benchmark decontamination with an FM-index per training shard.

A shard's words become numbers, a suffix array is sorted by prefix doubling, and its Burrows-Wheeler transform
goes into a wavelet matrix. All test phrases are searched backwards together, each step two ranks a phrase;
occurrences are located by walking back to a sampled suffix position, and their word spans are merged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import arrow_fields, carried, column, free_name, map_rows

WINDOW = 10
#: Words of a shard; a document is never cut, so that one document alone may exceed it.
SHARD_WORDS = 1 << 19
#: Every so many-th text position has its suffix marked.
SAMPLE = 8
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20

_WORD_BYTES = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_WORD_BYTES).split()


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of ``text``; each 0 is a separator of its own, smaller than any word and ordered
    by position, so that no comparison runs past it."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    ordered = text[order]
    head = np.r_[True, (ordered[1:] != ordered[:-1]) | (ordered[1:] == 0)]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    alone = head & np.r_[head[1:], True]
    open_at = np.flatnonzero(~alone)
    k = 1
    while len(open_at):
        at = order[open_at]
        second = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = (rank[at] << 32) | second
        sort = np.argsort(key)
        at, key = at[sort], key[sort]
        order[open_at] = at
        head = np.r_[True, key[1:] != key[:-1]]
        rank[at] = np.maximum.accumulate(np.where(head, open_at, 0))
        open_at = open_at[~(head & np.r_[head[1:], True])]
        k *= 2
    return order


class WaveletMatrix:
    """Ranks over numbers below 2^levels: a bit vector a level, with counts every 64 bits."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in reversed(range(self.levels)):
            bits = (values >> level) & 1 == 1
            padded = np.zeros((self.n // 64 + 1) * 64, bool)
            padded[: self.n] = bits
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(words)
            self.counts.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(self.n - int(bits.sum()))
            values = np.concatenate([values[~bits], values[bits]])

    def _ones(self, depth: int, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[depth][word] + np.bitwise_count(self.words[depth][word] & below)

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c occurs before position i; element by element."""
        low, high = np.zeros_like(i), i
        for depth in range(self.levels):
            one = (c >> (self.levels - 1 - depth)) & 1 == 1
            low1, high1 = self._ones(depth, low), self._ones(depth, high)
            low = np.where(one, self.zeros[depth] + low1, low - low1)
            high = np.where(one, self.zeros[depth] + high1, high - high1)
        return high - low


class FMIndex:
    """Backward search and location over a text of word numbers (0 separates documents)."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        order = suffix_array(text)
        before = text[order - 1]  # of position 0: the last, a separator
        self.last = WaveletMatrix(before)
        self.before = before
        self.smaller = np.r_[0, np.cumsum(np.bincount(text))]
        marked = (order % sample == 0) | (before == 0)  # a walk ends before it would cross a separator
        self.marked = marked
        self.sampled = order[marked]
        self.marks = np.r_[0, np.cumsum(marked)]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases, given as right-aligned rows of word numbers."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), len(self.before), np.int64)
        for step in range(int(lengths.max(initial=0))):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            c = phrases[live, phrases.shape[1] - 1 - step]
            low[live] = self.smaller[c] + self.last.rank(c, low[live])
            high[live] = self.smaller[c] + self.last.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes."""
        found = np.empty(len(rows), np.int64)
        at, todo, steps = rows.copy(), np.arange(len(rows)), 0
        while len(todo):
            done = self.marked[at]
            found[todo[done]] = self.sampled[self.marks[at[done]]] + steps
            at, todo = at[~done], todo[~done]
            c = self.before[at]
            at = self.smaller[c] + self.last.rank(c, at)
            steps += 1
        return found


class Phrases:
    """Windows of a block of benchmark items, over the block's own vocabulary. An item without id has windows, but no
    place among ``item_ids``. About 60 bytes a word are kept."""

    def __init__(self, items: list[tuple[object, str | None]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.item_ids: list[str] = []
        rows, owners = [np.empty((0, window), np.int32)], [np.empty(0, np.int64)]
        for item_id, text in items:
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)], np.int32)
            if not len(numbers):
                continue
            short = np.full(max(0, window - len(numbers)), -1, np.int32)  # before the words: rows are aligned right
            own = np.lib.stride_tricks.sliding_window_view(np.r_[short, numbers], window)
            rows.append(own)
            owners.append(np.full(len(own), -1 if item_id is None else len(self.item_ids)))
            if item_id is not None:
                self.item_ids.append(str(item_id))
        every = np.ascontiguousarray(np.concatenate(rows))
        _, first, number = np.unique(every.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True)
        self.rows = every[first]
        self.lengths = (self.rows >= 0).sum(axis=1)
        owner = np.concatenate(owners)
        pairs = np.unique(np.stack([number[owner >= 0], owner[owner >= 0]], axis=1), axis=0)
        self.items = pairs[:, 1]
        self.starts = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))

    def numbered(self, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(windows whose words the shard has, their rows in the shard's numbers, lengths)."""
        of = np.fromiter((vocabulary.get(w, -1) for w in self.vocabulary), np.int32, len(self.vocabulary))
        if not len(of):
            return np.empty(0, np.int64), self.rows, self.lengths
        rows = of[self.rows]
        column = np.arange(self.rows.shape[1])[None, :] >= self.rows.shape[1] - self.lengths[:, None]
        kept = np.flatnonzero(((rows >= 0) | ~column).all(axis=1))
        return kept, rows[kept], self.lengths[kept]


def scan_shard(docs: list[list[bytes]], blocks: Iterator[Phrases]) -> list[tuple[list[tuple[int, int]], set[str]]]:
    """Per document: merged word spans [start, end) that lie in occurrences of windows, and the item ids."""
    vocabulary: dict[bytes, int] = {}
    starts = np.zeros(len(docs) + 1, np.int64)
    np.cumsum([len(d) + 1 for d in docs], out=starts[1:])
    text = np.zeros(int(starts[-1]), np.int64)
    number = vocabulary.setdefault
    for d, at in zip(docs, starts, strict=False):
        if d:
            text[at : at + len(d)] = [number(w, len(vocabulary) + 1) for w in d]
    index = FMIndex(text) if vocabulary else None
    edge = np.zeros(len(text) + 1, np.int64)
    items: list[set[str]] = [set() for _ in docs]
    for block in blocks:
        if index is None:
            break
        kept, rows, lengths = block.numbered(vocabulary)
        low, high = index.search(rows, lengths)
        hits = np.flatnonzero(low < high)
        for part in np.array_split(hits, max(1, int((high - low).sum()) >> 20)):
            n = (high - low)[part]
            which = np.repeat(part, n)
            at = index.locate(np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[which])
            np.add.at(edge, at, 1)
            np.add.at(edge, at + lengths[which], -1)
            doc = np.searchsorted(starts, at, side="right") - 1
            for d, w in np.unique(np.stack([doc, kept[which]], axis=1), axis=0):
                items[d].update(block.item_ids[k] for k in block.items[block.starts[w] : block.starts[w + 1]])
    hit = np.r_[False, np.cumsum(edge[:-1]) > 0, False]
    turns = np.flatnonzero(hit[1:] != hit[:-1]).reshape(-1, 2)  # no span crosses a separator
    spans: list[list[tuple[int, int]]] = [[] for _ in docs]
    for (a, b), d in zip(turns, np.searchsorted(starts, turns[:, 0], side="right") - 1, strict=True):
        spans[d].append((int(a - starts[d]), int(b - starts[d])))
    return list(zip(spans, items, strict=True))


def phrase_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list:
    """The benchmark's windows as broadcasts of at most BLOCK_BYTES of text each (one item may exceed it); the
    driver holds one block at a time, and so does a task."""
    spark = benchmark.sparkSession
    items = benchmark.select(column(item_col).alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    n = max(1, -(-2 * int(size) // BLOCK_BYTES))
    blocks = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        blocks.append(spark.sparkContext.broadcast(Phrases([(r.id, r.text) for r in part.collect()], window)))
    return blocks


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``hit_spans`` (merged word spans to remove), ``item_ids``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one; a document word inside
    any occurrence of a window is hit. A null or wordless text has no words and no hits; a null or wordless
    item has no windows; words in windows of an item without id are hit, but it is not among ``item_ids``; items that
    repeat an id count once. ``item_ids`` are sorted as strings. Columns of ``docs`` that bear an output column's name give way to it. Empty tables
    give empty results or no hits. One scan of the documents, no shuffle; a task holds one shard.
    """
    new = ("n_words", "n_hit", "hit_spans", "item_ids")
    kept = carried(docs, *new)
    blocks = phrase_blocks(benchmark, item_col, item_text_col, window)
    many = len(blocks) > 1
    text = free_name(docs, "decontamination_text")
    source = docs.select(*[column(c) for c in kept], column(text_col).alias(text))

    def loaded() -> Iterator[Phrases]:
        for b in blocks:
            yield b.value
            if many:
                b.__dict__.pop("_value", None)

    def make():
        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            held: list[tuple[tuple, list[bytes]]] = []
            size = 0

            def flush() -> Iterator[tuple]:
                found = scan_shard([w for _, w in held], loaded())
                for (row, words), (spans, ids) in zip(held, found, strict=True):
                    yield (*row, len(words), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], sorted(ids))

            for *row, body in items:
                words = words_of(body)
                held.append((tuple(row), words))
                size += len(words) + 1
                if size >= shard_words:
                    yield from flush()
                    held, size = [], 0
            if held:
                yield from flush()

        return run

    fields = arrow_fields(source, kept)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields += [
        ("n_words", pa.int64(), "bigint"),
        ("n_hit", pa.int64(), "bigint"),
        ("hit_spans", span, "array<struct<start:bigint,end:bigint>>"),
        ("item_ids", pa.list_(pa.string()), "array<string>"),
    ]
    return map_rows(source, make, fields)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of every ``benchmark`` window in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def digest(item_ids: list[str]) -> str:
    """The query's digest of item ids, for tests."""
    return hashlib.sha256(",".join(sorted(item_ids)).encode()).hexdigest()
