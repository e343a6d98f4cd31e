"""SimHash near-dedup with anchor-point covering.

A 64-bit fingerprint is cut into blocks; two fingerprints within ``threshold`` bits agree in some block up to
t = threshold // blocks bits. Each block's anchors are the words of a covering code: a Hamming code on 2^r - 1
bits (perfect, covering radius 1) beside an identity code on the block's other bits (radius 0). A fingerprint's
home is the nearest anchor, at distance 1 at most, so a partner within t of it lies within 1 + t of that home:
every fingerprint is replicated to all anchors within that distance, and homes are compared with replicas per
anchor. Links are thus found exactly, whatever the data.

An anchor with many replicas is cut into a grid of chunks, each compared in a group of its own, and a group
sends on a spanning star of each connected set instead of its pairs, so neither memory nor output follows the
square of a group.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import column, free_name, map_rows, materialise, quoted, ship

SHINGLE_WORDS = 4
THRESHOLD = 4
#: Numbers of blocks to choose from, and about how many comparisons a replica costs (it is written, shuffled and sorted).
BLOCKS = (3, 2)
REPLICA_COST = 60
#: Replicas that a task compares, about.
TASK_REPLICAS = 400_000
#: Shingles of a text that are hashed at once.
SLICE = 1 << 16
#: Replicas of an anchor that are compared in one group; more are cut into chunks of this size.
CHUNK = 2_000
#: Pairs compared at once in memory.
_PAIRS = 1 << 21
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def joined_words(text: str | None) -> bytes:
    """A text's words with A-Z lower-cased, in UTF-8, one space between them."""
    low = (text or "").encode().lower()  # bytes: A-Z only, ASCII white space only
    return b" ".join(low.split()) if len(low) < SLICE else _SPACE.sub(b" ", low).strip(b" ")


def shingle_hashes(joined: bytes, k: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the k-word shingles of joined words, in order and in slices, so that a long text's hashes are
    never all held as Python numbers. Fewer words are one shingle, no words an empty one."""
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    ends = np.r_[gaps, len(joined)]
    k = min(k, len(ends))
    starts, ends = np.r_[0, gaps + 1][: len(ends) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), SLICE):
        cuts = zip(starts[at : at + SLICE].tolist(), ends[at : at + SLICE].tolist(), strict=True)
        yield np.array([digest(joined[a:b], 42) for a, b in cuts], np.uint64)


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles (repeats included), as a signed 64-bit number; no words: 0."""
    return fingerprint_of(joined_words(text), shingle_words)


def fingerprint_of(joined: bytes, shingle_words: int) -> int:
    return majority(shingle_hashes(joined, shingle_words)) if joined else 0


def majority(slices: Iterable[np.ndarray]) -> int:
    """The bits that are set in over half the hashes, as a signed 64-bit number."""
    ones, n = np.zeros(64, np.int64), 0
    for hashes in slices:
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


class Covering:
    """Anchors of one block of a fingerprint: bits [low, low + width)."""

    def __init__(self, low: int, width: int, t: int):
        self.low, self.width = low, width
        r = 1
        while (1 << (r + 1)) - 1 <= width:
            r += 1
        n = (1 << r) - 1
        self.checks = [sum(1 << i for i in range(n) if (i + 1) >> k & 1) for k in range(r)]
        by_syndrome: list[list[tuple[int, bool]]] = [[] for _ in range(1 << r)]
        for weight in range(t + 2):
            for flips in itertools.combinations(range(width), weight):
                syndrome = 0
                for i in flips:
                    if i < n:
                        syndrome ^= i + 1
                home = weight == 0 or weight == 1 and flips[0] < n
                by_syndrome[syndrome].append((sum(1 << i for i in flips), home))
        self.masks = [np.array([m for m, _ in x], np.uint64) for x in by_syndrome]
        self.homes = [np.array([h for _, h in x], bool) for x in by_syndrome]

    def replicate(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of the fingerprint, anchor, whether it is the home) for every anchor in reach."""
        block = (fps >> np.uint64(self.low)) & np.uint64((1 << self.width) - 1)
        syndrome = np.zeros(len(fps), np.int64)
        for k, check in enumerate(self.checks):
            syndrome |= (np.bitwise_count(block & np.uint64(check)).astype(np.int64) & 1) << k
        parts = []
        for s in np.unique(syndrome):
            row = np.flatnonzero(syndrome == s)
            anchors = (block[row][:, None] ^ self.masks[s][None, :]).ravel()
            parts.append((np.repeat(row, len(self.masks[s])), anchors, np.tile(self.homes[s], len(row))))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3


def coverings(blocks: int, threshold: int) -> list[Covering]:
    """Blocks as even as can be, each with its share of the threshold."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [Covering(a, b - a, threshold // blocks) for a, b in itertools.pairwise(cuts)]


def choose_blocks(n: int, threshold: int) -> int:
    """The number of blocks that costs n fingerprints least: fewer blocks make more replicas, and fewer meet in each. The
    links do not depend on it."""

    def cost(blocks: int) -> float:
        codes = coverings(blocks, threshold)
        replicas = sum(sum(map(len, c.masks)) / len(c.masks) for c in codes)
        met = n * sum(sum(map(len, c.masks)) / (1 << c.width) for c in codes)
        return replicas * REPLICA_COST + met

    return min(BLOCKS, key=cost)


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its connected set) of the links a-b, but for those smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def close_pairs(key: np.ndarray, fps: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between homes and members of the same key; rows are sorted by key. As spanning stars."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    group = np.repeat(np.arange(len(starts)), ends - starts)
    homes = np.flatnonzero(home)
    lens = (ends - starts)[group[homes]]
    homes, lens = homes[lens > 1], lens[lens > 1]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total = np.cumsum(lens)
    i = 0
    while i < len(homes):
        j = max(i + 1, int(np.searchsorted(total, (total[i - 1] if i else 0) + _PAIRS, side="right")))
        h, n = homes[i:j], lens[i:j]
        left = np.repeat(h, n)
        offset = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        right = np.repeat(starts[group[h]], n) + offset
        x = fps[left] ^ fps[right]
        near = (np.bitwise_count(x) <= threshold) & (x != 0)
        if near.any():
            found.append(spanning_stars(fps[left[near]], fps[right[near]]))
        i = j
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return spanning_stars(*(np.concatenate(x) for x in zip(*found, strict=True)))


def links(nodes: DataFrame, threshold: int, blocks: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Edges (u, v), u > v, that connect exactly the distinct fingerprints ``fp`` linked within ``threshold``. ``blocks``
    is chosen by the number of fingerprints unless given. Replicas are made once and written."""
    ship(nodes.sparkSession)
    blocks = blocks or choose_blocks(nodes.count(), threshold)

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = coverings(blocks, threshold)
        for batch in batches:
            all_fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(all_fps), 4096):
                fps = all_fps[at : at + 4096]
                for k, code in enumerate(codes):
                    row, anchor, home = code.replicate(fps)
                    key = (anchor | np.uint64(k << 58)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[row].view(np.int64)), pa.array(home)], ["anchor", "fp", "home"])

    replicas = materialise(nodes.select("fp").mapInArrow(replicate, "anchor bigint, fp bigint, home boolean"), "simhash-replicas")
    tasks = max(1, -(-replicas.count() // TASK_REPLICAS))
    counts = replicas.groupBy("anchor").count().where(F.col("count") > chunk)
    hot = materialise(counts.select("anchor", F.ceil(F.col("count") / chunk).cast("int").alias("cuts")), "simhash-hot")
    dealt = replicas.join(hot, "anchor", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("cuts")).cast("int")
    every = F.sequence(F.lit(0), F.col("cuts") - 1)
    # chunk i of the homes meets chunk j of all members in group (anchor, i, j)
    as_home = F.when(F.col("home"), F.transform(every, lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(True).alias("home"))))
    as_member = F.transform(every, lambda i: F.struct(i.alias("i"), own.alias("j"), F.lit(False).alias("home")))
    single = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("home").alias("home")))
    cells = F.when(F.col("cuts") == 1, single).otherwise(F.concat(F.coalesce(as_home, F.array().cast("array<struct<i:int,j:int,home:boolean>>")), as_member))
    dealt = dealt.select("anchor", "fp", F.explode(cells).alias("c")).select("anchor", "fp", "c.i", "c.j", "c.home")
    dealt = dealt.repartition(tasks, "anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush(columns: list[np.ndarray]) -> pa.RecordBatch:
            anchor, fps, i, j, home = columns
            change = (np.diff(anchor) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
            key = np.r_[0, np.cumsum(change)]
            u, v = close_pairs(key, fps.view(np.uint64), home, threshold)
            u, v = u.view(np.int64), v.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if sum(len(h[0]) for h in held) < 100_000:
                continue
            columns = [np.concatenate(x) for x in zip(*held, strict=True)]
            same = (columns[0] == columns[0][-1]) & (columns[2] == columns[2][-1]) & (columns[3] == columns[3][-1])
            cut = len(same) - int(same.sum())  # the last group may go on in the next batch
            held = [[c[cut:] for c in columns]]
            if cut:
                yield flush([c[:cut] for c in columns])
        if held:
            yield flush([np.concatenate(x) for x in zip(*held, strict=True)])

    return dealt.mapInArrow(compare, "u bigint, v bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of every node of ``edges`` (u, v) but the roots: root is the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes. Every step is written to the shared
    folder; minima are aggregated before they are joined back, and both sides of each join are read from
    files, so that adaptive execution can split a hub's rows.
    """

    def star(both: DataFrame, keep: str, name: str) -> DataFrame:
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        low = materialise(low, f"{name}-min")
        moved = both.where(keep).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved, low

    current = materialise(edges.where("u != v").select("u", "v").distinct(), "cc")
    state = None
    while True:
        both = current.union(current.select("v", "u"))
        moved, _ = star(both, "v > u", "cc-large")
        large = materialise(moved.where("u != v").distinct(), "cc-large")
        moved, low = star(large, "true", "cc-small")
        small = moved.union(low.select("u", F.col("m").alias("v")))
        current = materialise(small.where("u != v").distinct(), "cc")
        signature = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if signature == state:
            return current.select(F.col("u").alias("fp"), F.col("v").alias("root"))
        state = signature


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    threshold: int = THRESHOLD,
    blocks: int | None = None,
) -> DataFrame:
    """One row a document: id, ``fp`` (signed 64-bit fingerprint), ``component_id``.

    Fingerprints within ``threshold`` differing bits are linked; ``component_id`` is the smallest id reachable.
    A null or wordless text has fingerprint zero, linked like any other. A null id is carried, but is no
    component's id unless all ids of the component are null; repeated rows give repeated results. Other
    columns are not read. Ids are whole numbers, or text that holds them. An empty table gives an empty result.
    ``blocks`` is chosen by the number of distinct fingerprints unless given; it changes the cost alone.
    """

    def make():
        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in items:
                yield doc_id, fingerprint(text, shingle_words)

        return run

    fields = [("id", pa.int64(), "bigint"), ("fp", pa.int64(), "bigint")]
    prints = map_rows(docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).alias("text")), make, fields)
    prints = materialise(prints, "simhash")
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-nodes")
    stars = components(links(nodes, threshold, blocks))
    rooted = nodes.join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialise(rooted, "simhash-rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    found = materialise(rooted.join(least, "root").select("fp", "component_id"), "simhash-components")
    return prints.join(found, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", **parameters: int) -> DataFrame:
    """Rows of ``docs``, with all their columns, that stay: of each component those of the smallest id; all rows
    with a null id stay, since no id tells them apart. Parameters are those of ``simhash_components``."""
    return without_followers(docs, id_col, simhash_components(docs, id_col, **parameters))


def without_followers(docs: DataFrame, id_col: str, found: DataFrame) -> DataFrame:
    """``docs`` without the ids whose component is named by another one.

    Dropped ids are written to the shared folder and anti-joined; the join broadcasts them only while Spark's
    own size check allows it, and its keys are ids, which are spread evenly.
    """
    name = free_name(docs, "dropped_id")
    own = column(id_col)
    dropped = found.where((own != F.col("component_id")) & own.isNotNull()).select(own.alias(name)).distinct()
    dropped = materialise(dropped, "simhash-dropped", kept=True)
    return docs.join(dropped, docs[quoted(id_col)].cast("bigint") == dropped[name], "left_anti")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_components(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
