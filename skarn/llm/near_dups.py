"""Operator 9 at a Jaccard similarity of word shingles, as the pipeline takes it: SimHash links first, then the rest.

Texts of similarity 0.8 differ in about 10 of 64 fingerprint bits, give or take 3. Anchors that cover such distances
would be replicated hundreds of times and each still meet a tenth of all fingerprints, so that a fingerprint threshold
alone either loses most links of 0.8 or compares all pairs. The operator therefore links by anchors within a few bits,
verifies these links, and completes the components by an exact join over the shingles themselves.

A text's set holds the 64-bit hashes of its word shingles. Two sets of similarity t or more share an element among
the first |x| - ceil(t |x|) + 1 of each, whatever total order the elements are in. The order is by count and hash,
with counts of the commonest elements only, so that lines that many texts hold come last. Counts merely order.

Of the texts that share such an element, each is first compared with a few centres that the element's group has in
common, for ROUNDS rounds with different centres; components are formed of what passes, so that a large group of near
copies soon is one. Then all remaining pairs whose components differ are compared, for which the number of shared
elements leaves t possible. No pair of similarity t is missed, and every link's similarity is computed.

Before sets are fetched for a pair, two sketches are compared: bit i of a sketch is the parity of the set's elements
that fall to i. Sketches differ in no more bits than the sets do in elements, so a pair whose sketches differ too much
for t is no link. Sketches are SKETCH bits whatever the text, and most pairs go no further.

Neither texts nor whole sets are shuffled to find out that a text has no candidates: sets are computed again from the
texts where they are needed, and a bitmap tells which texts those are.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.common import column, map_rows, materialise, scratch, ship
from skarn.llm.simhash import THRESHOLD, components, joined_words, links, majority, shingle_hashes, without_followers

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)
#: Rounds in which members of an element's group are compared with centres only, and centres of a group in a round.
ROUNDS = 1
CENTRES = 4
#: Elements counted at once in memory, and the commonest elements that are told from rare ones.
WINDOW = 1 << 19
COMMON = 1 << 17
#: Elements of so many texts are known to be shared; their rows are spread over SPREAD places.
HOT, SPREAD = 2_000, 256
#: Bits of a set's sketch; sets of some thousand elements and more are too large for it to tell them apart.
SKETCH = 1024
#: Least and most bits of the bitmap of texts whose sets are needed, and bits for each.
LEAST_BITS, MOST_BITS, BITS_PER_NODE = 1 << 15, 1 << 27, 16


def _node_of(joined: bytes) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(joined, 7)).view(np.int64))


def node(text: str | None) -> int:
    """Hash of a text's words, as a signed 64-bit number."""
    return _node_of(joined_words(text))


def shingle_set(text: str | None, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; fewer words are one shingle, no words an empty one."""
    return _set_of(joined_words(text), shingle_words)


def _set_of(joined: bytes, shingle_words: int) -> np.ndarray:
    return np.unique(np.concatenate(list(shingle_hashes(joined, shingle_words))))


def least_common(n: int, similarity: Fraction) -> int:
    """Elements that a set of n shares at least with one of that similarity: ceil(similarity * n)."""
    return -(-similarity.numerator * n // similarity.denominator)


def similar(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> bool:
    """Whether two sorted sets have that Jaccard similarity, in whole numbers."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * similarity.denominator >= (len(a) + len(b) - both) * similarity.numerator


def sketch_of(hashes: np.ndarray) -> bytes:
    """For each of SKETCH places the parity of the distinct hashes that fall to it."""
    return np.packbits(np.bincount(hashes.astype(np.int64) & (SKETCH - 1), minlength=SKETCH) & 1 == 1).tobytes()


def may_be_similar(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Whether sets with these sketches (a row each) and these sizes (of both together) can be similar: they share half
    of what is left of the sizes without the differing bits, at most."""
    both = (sizes - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)) // 2
    return both * (similarity.numerator + similarity.denominator) >= sizes * similarity.numerator


def _common(texts: DataFrame, shingle_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(elements, counts) of the commonest elements, sorted by element; those that repeat in no window of a task count
    as rare, which costs time but no pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for value in itertools.chain.from_iterable(b.column(0) for b in batches):
            held.append(shingle_set(value.as_py(), shingle_words))
            size += len(held[-1])
            if size >= WINDOW:
                yield repeated(held)
                held, size = [], 0
        if held:
            yield repeated(held)

    def repeated(held: list[np.ndarray]) -> pa.RecordBatch:
        e, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(e[n > 2].view(np.int64)), pa.array(n[n > 2].astype(np.int64))], ["e", "n"])

    counted = texts.mapInArrow(count, "e bigint, n bigint").groupBy("e").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "e").limit(COMMON).collect()
    elements, counts = np.array([r.e for r in rows], np.int64).view(np.uint64), np.array([r.n for r in rows], np.int64)
    order = np.argsort(elements)
    return elements[order], counts[order]


def _first(hashes: np.ndarray, elements: np.ndarray, counts: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a set, by count and hash, that a similar set must share one of; and their counts."""
    seen = np.zeros(len(hashes), np.int64)
    if len(elements):
        at = np.minimum(np.searchsorted(elements, hashes), len(elements) - 1)
        seen = np.where(elements[at] == hashes, counts[at], 0)
    first = np.lexsort((hashes, seen))[: len(hashes) - least_common(len(hashes), similarity) + 1]
    return hashes[first], seen[first]


def _prefixes(texts: DataFrame, shingle_words: int, similarity: Fraction) -> DataFrame:
    """(e, fp, size, place): the elements of each set that a similar one must share one of; a hot element's rows have
    places from 1 by their node, others place 0."""
    common = texts.sparkSession.sparkContext.broadcast(_common(texts, shingle_words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        elements, counts = common.value
        for batch in batches:
            held: list[tuple[np.ndarray, np.ndarray, int, int]] = []
            rows = 0
            for value in batch.column(0):
                joined = joined_words(value.as_py())
                hashes, own = _set_of(joined, shingle_words), _node_of(joined)
                first, seen = _first(hashes, elements, counts, similarity)
                held.append((first.view(np.int64), np.where(seen >= HOT, 1 + own % SPREAD, 0).astype(np.int32), own, len(hashes)))
                rows += len(first)
                if rows >= 50_000:
                    yield out(held)
                    held, rows = [], 0
            if held:
                yield out(held)

    def out(held: list[tuple[np.ndarray, np.ndarray, int, int]]) -> pa.RecordBatch:
        n = [len(h[0]) for h in held]
        nodes, sizes = np.repeat(np.array([h[2] for h in held], np.int64), n), np.repeat(np.array([h[3] for h in held], np.int32), n)
        columns = [np.concatenate([h[0] for h in held]), nodes, sizes, np.concatenate([h[1] for h in held])]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["e", "fp", "size", "place"])

    return texts.mapInArrow(run, "e bigint, fp bigint, size int, place int")


def _shared(prefixes: DataFrame) -> DataFrame:
    """Rows (e, fp, size) of ``prefixes``, each once, whose element several nodes have, or is hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the node's row before, and whether it was sent on
        sent = False
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            e, place, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 3, 1))
            new = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (fp[1:] != fp[:-1])])
            same = e[new][1:] == e[new][:-1]
            kept = np.r_[False, same] | np.r_[same, False] | (place[new] > 0)
            out = kept.copy()
            out[0] &= not sent
            sent = bool(kept[-1]) or (sent and len(new) == 1)
            last = batch.slice(int(new[-1]), 1)
            yield batch.take(pa.array(new[out])).select(["e", "fp", "size"])

    return prefixes.repartition("e", "place").sortWithinPartitions("e", "fp").mapInArrow(run, "e bigint, fp bigint, size int")


def _sets(texts: DataFrame, nodes: DataFrame, shingle_words: int) -> DataFrame:
    """(fp, shingles) of ``nodes`` (fp), and of others that share a bucket with one."""
    bits, wanted = LEAST_BITS, BITS_PER_NODE * nodes.count()
    while bits < wanted and bits < MOST_BITS:
        bits *= 2
    buckets = nodes.select(F.pmod(F.col("fp"), F.lit(bits)).alias("b"))
    pages = buckets.groupBy(F.expr("b div 32768").alias("page")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("bits"))
    table = np.zeros(bits // 8, np.uint8)
    for r in pages.toLocalIterator():  # MOST_BITS in all, whatever the data
        table[r.page * 4096 : (r.page + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)[: bits // 8]
    held = texts.sparkSession.sparkContext.broadcast(table)

    def make():
        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for (text,) in items:
                joined = joined_words(text)
                fp = _node_of(joined)
                b = fp & (bits - 1)
                if held.value[b >> 3] >> (b & 7) & 1:
                    yield fp, _set_of(joined, shingle_words).tobytes()

        return run

    found = map_rows(texts, make, [("fp", pa.int64(), "bigint"), ("shingles", pa.binary(), "binary")])
    return found.groupBy("fp").agg(F.first("shingles").alias("shingles"))


def _sketched(pairs: DataFrame, sketches: DataFrame, similarity: Fraction) -> DataFrame:
    """Those of the pairs (u, v), which are in files, that their ``sketches`` (node, size, sketch) leave possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, SKETCH // 64) for c in (3, 4))
            kept = may_be_similar(a, b, batch.column(2).to_numpy(), similarity)
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    left = sketches.select(F.col("node").alias("u"), F.col("size").alias("m"), F.col("sketch").alias("a"))
    right = sketches.select(F.col("node").alias("v"), F.col("size").alias("n"), F.col("sketch").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", (F.col("m") + F.col("n")).alias("sizes"), "a", "b")
    return both.mapInArrow(run, "u bigint, v bigint")


def _verified(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, shingle_words: int, similarity: Fraction, name: str) -> DataFrame:
    """Those of the pairs (u, v) whose sets are similar; written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets_of = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in (2, 3))
            kept = [similar(a, b, similarity) for a, b in zip(*sets_of, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(kept, pa.bool_()))

    with scratch(texts.sparkSession):
        pairs = materialise(pairs, f"{name}-candidates")
        pairs = materialise(_sketched(pairs, sketches, similarity), f"{name}-pairs")
        nodes = materialise(pairs.select(F.col("u").alias("fp")).union(pairs.select("v")), f"{name}-nodes")
        sets = materialise(_sets(texts, nodes, shingle_words), f"{name}-sets")
        left = sets.select(F.col("fp").alias("u"), F.col("shingles").alias("a"))
        right = sets.select(F.col("fp").alias("v"), F.col("shingles").alias("b"))
        both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
        return materialise(both.mapInArrow(run, "u bigint, v bigint"), name, kept=True)


def _anchored(nodes: DataFrame, threshold: int) -> DataFrame:
    """Pairs (u, v) of ``nodes`` (node, simhash) that operator 9 links: equal fingerprints, each with the least node of its
    own, and fingerprints that an anchor group connects, by their least nodes."""
    least = materialise(nodes.groupBy("simhash").agg(F.min("node").alias("v")), "near-fingerprints")
    stars = nodes.join(least, "simhash").where("node != v").select(F.col("node").alias("u"), "v")
    with scratch(nodes.sparkSession):
        edges = materialise(links(least.select(F.col("simhash").alias("fp")), threshold), "near-anchored", kept=True)
    ends = [least.select(F.col("simhash").alias(a), F.col("v").alias(b)) for a, b in (("u", "x"), ("v", "y"))]
    met = edges.join(ends[0], "u").join(ends[1], "v").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    return stars.union(met)


def _centred(rooted: DataFrame, turn: int, alike, similarity: Fraction) -> DataFrame:
    """Candidate pairs (u, v) of nodes with centres of the groups that they are in, CENTRES a group: for each node the
    ones that it meets most often, CENTRES at most. Centres are those of whose first elements most are shared, as an
    original's are, and copies' that are little changed."""
    num, den = similarity.numerator, similarity.denominator
    degree = materialise(rooted.groupBy("fp").agg(F.count(F.lit(1)).alias("degree")), f"near-degrees-{turn}")
    first = F.expr(f"size - (size * {num} + {den - 1}) div {den} + 1")
    ranked = rooted.join(degree, "fp").withColumn("rank", -F.floor(F.col("degree") * 16 / first))
    order = [F.struct("rank", F.xxhash64("fp", F.lit(turn * CENTRES + k)).alias("h"), "fp", "size", "root") for k in range(CENTRES)]
    found = ranked.groupBy("e").agg(F.array(*[F.min(o) for o in order]).alias("c"))
    each = F.transform("c", lambda c: F.struct(c["fp"].alias("fp"), c["size"].alias("size"), c["root"].alias("root")))
    centres = materialise(found.select("e", F.explode(F.array_distinct(each)).alias("c")).select("e", "c.*"), f"near-centres-{turn}")
    x, y = rooted.alias("x"), centres.alias("y")
    met = x.join(y, (F.col("x.e") == F.col("y.e")) & (F.col("x.root") != F.col("y.root")) & alike)
    times = met.groupBy(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    most = Window.partitionBy("a").orderBy(F.desc("c"), F.xxhash64("b", F.lit(turn)))
    best = times.withColumn("n", F.row_number().over(most)).where(F.col("n") <= CENTRES)
    return best.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _remaining(rooted: DataFrame, alike, similarity: Fraction) -> DataFrame:
    """All pairs (u, v) of different components that share an element, where the number of shared ones leaves the
    similarity possible. Of an element's group the largest component's members meet the others only."""
    num, den = similarity.numerator, similarity.denominator
    sizes = rooted.groupBy("e", "root").agg(F.count(F.lit(1)).alias("n"))
    largest = materialise(sizes.groupBy("e").agg(F.max_by("root", F.struct("n", "root")).alias("largest")), "near-largest")
    both = materialise(rooted.join(largest, "e"), "near-rest")
    x, y = both.where("root != largest").alias("x"), both.alias("y")
    apart = (F.col("x.root") != F.col("y.root")) & ((F.col("y.root") == F.col("y.largest")) | (F.col("x.root") > F.col("y.root")))
    met = x.join(y, (F.col("x.e") == F.col("y.e")) & apart & alike).select(
        F.greatest("x.fp", "y.fp").alias("u"), F.least("x.fp", "y.fp").alias("v"),
        (F.col("x.size") + F.col("y.size")).alias("both"), F.greatest("x.size", "y.size").alias("larger"),
    )
    # what a pair shares beyond ``c`` lies outside the first elements of one of the two
    enough = (F.col("c") + F.expr(f"(larger * {num} + {den - 1}) div {den}") - 1) * (num + den) >= F.col("both") * num
    return met.groupBy("u", "v", "both", "larger").agg(F.count(F.lit(1)).alias("c")).where(enough).select("u", "v")


def similar_components(texts: DataFrame, nodes: DataFrame, shingle_words: int, similarity: Fraction, threshold: int) -> DataFrame:
    """(fp, root) of every node of ``texts`` (one column) linked by similarity, but the roots; ``nodes`` (in files) has the
    texts' ``node``, ``simhash``, ``size`` of the set and its ``sketch``."""
    ship(texts.sparkSession)
    groups = materialise(_shared(_prefixes(texts, shingle_words, similarity)), "near-groups")
    num, den = similarity.numerator, similarity.denominator
    alike = (F.col("x.size") * den >= F.col("y.size") * num) & (F.col("y.size") * den >= F.col("x.size") * num)
    pairs, found = _anchored(nodes, threshold), None
    for turn in range(ROUNDS + 2):  # anchors, centres, what remains
        new = _verified(pairs, texts, nodes, shingle_words, similarity, f"near-links-{turn}")
        found = new if found is None else found.union(new)
        roots = components(found)
        if turn <= ROUNDS:
            rooted = groups.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
            rooted = materialise(rooted.select("e", "fp", "size", "root"), f"near-split-{turn}")
            mixed = rooted.groupBy("e").agg((F.min("root") < F.max("root")).alias("mixed")).where("mixed").select("e")
            rooted = materialise(rooted.join(materialise(mixed, f"near-mixed-{turn}"), "e"), f"near-rooted-{turn}")
            groups = rooted.select("e", "fp", "size")  # links never part again what is one
            pairs = _centred(rooted, turn, alike, similarity) if turn < ROUNDS else _remaining(rooted, alike, similarity)
    return roots


def near_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    similarity: Fraction = SIMILARITY,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """One row a document: id, ``component_id``, the smallest id reachable over pairs of that similarity.

    Words are those of the SimHash operator, and ``threshold`` is that of its fingerprints, over the same shingles; it
    changes the cost alone. Texts of equal words are one node (by a 64-bit hash); null and wordless texts have equal
    words. Ids are whole numbers, or text that holds them. A null id is carried, but is no component's id unless all
    ids of the component are null; repeated rows give repeated results. An empty table gives an empty result. Seven
    scans of the texts; sets of texts with candidates are written (8 bytes a shingle). A task holds one Arrow batch.
    """

    def make():
        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            for doc_id, text in items:
                joined = joined_words(text)
                slices = list(shingle_hashes(joined, shingle_words))
                hashes = np.unique(np.concatenate(slices))
                yield doc_id, _node_of(joined), majority(slices) if joined else 0, len(hashes), sketch_of(hashes)

        return run

    fields = [("id", pa.int64(), "bigint"), ("fp", pa.int64(), "bigint"), ("simhash", pa.int64(), "bigint")]
    fields += [("size", pa.int64(), "bigint"), ("sketch", pa.binary(), "binary")]
    prints = map_rows(docs.select(column(id_col).cast("bigint").alias("id"), column(text_col).alias("text")), make, fields)
    prints = materialise(prints, "near-prints")
    of = [F.first(c).alias(c) for c in ("simhash", "size", "sketch")]
    nodes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least"), *of), "near-nodes")
    hashed = nodes.select(F.col("fp").alias("node"), "simhash", "size", "sketch")
    with scratch(docs.sparkSession):
        stars = similar_components(docs.select(column(text_col).alias("text")), hashed, shingle_words, similarity, threshold)
        rooted = nodes.select("fp", "least").join(stars, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        rooted = materialise(rooted, "near-rooted", kept=True)
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "near-least")
    found = materialise(rooted.join(least, "root").select("fp", "component_id"), "near-components")
    return prints.select("id", "fp").join(found, "fp").select(F.col("id").alias(id_col), "component_id")


def one_per_near_component(docs: DataFrame, id_col: str = "doc_id", **parameters) -> DataFrame:
    """Rows of ``docs``, with all their columns, that stay: of each component those of the smallest id; all rows with a
    null id stay, since no id tells them apart. Parameters are those of ``near_components``."""
    with scratch(docs.sparkSession):
        return without_followers(docs, id_col, near_components(docs, id_col, **parameters))
