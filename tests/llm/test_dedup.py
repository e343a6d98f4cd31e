"""Exact dedup and SimHash against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash
from compare import connection, difference
from llm.conftest import EDGES

from skarn.llm import exact_dedup, simhash


def test_exact_dedup_query(spark, sf):
    assert difference(exact_dedup.op5_exact_dedup(spark, sf), connection(sf).execute(exact_dedup.OP5_SQL).df()) is None


def test_exact_dedup_edges(spark, edges, nothing):
    out = exact_dedup.exact_dedup(edges)
    assert out.columns == ["doc_id", "text", "lang", "n_words", "ids", "score", "a.b", "quality_text", "sieve `bits", "keep_id", "group_size", "kept"]
    rows = out.collect()
    assert len(rows) == len(EDGES)
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r.text or ""), []).append(r)
    for own in groups.values():
        best = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        assert all(r.keep_id == best.doc_id and r.group_size == len(own) for r in own)
        assert [r.doc_id for r in own if r.kept] == [best.doc_id]  # a single one, though id 5 comes twice
    assert exact_dedup.exact_dedup(nothing).count() == 0


@pytest.mark.parametrize("most", [1 << 30, 1])
def test_colliding_buckets_only_cost_time(spark, monkeypatch, most):
    """A bitmap of two bits, which every row passes, gives the same groups."""
    if most == 1:
        monkeypatch.setattr(exact_dedup, "LEAST_BITS", 2)
        monkeypatch.setattr(exact_dedup, "MOST_BITS", 2)
    docs = spark.createDataFrame([(i, "x" * (i % 7) + str(i % 3)) for i in range(60)], "doc_id bigint, text string")
    rows = exact_dedup.exact_dedup(docs).collect()
    for r in rows:
        same = [o.doc_id for o in rows if o.text == r.text]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), r.doc_id == min(same))


def test_only_survivors_are_hashed(spark):
    """Of 3,000 rows the 90 that share length and prefix with another are hashed in full, and a few by chance."""
    rng = random.Random(4)
    texts = [f"{i:04d}" + "y" * (i % 37) for i in range(2_900)]  # lengths recur, prefixes do not
    texts += [f"group {k} " + "z" * 100 + f"{e}" for k in range(30) for e in "aab"]  # a prefix of 64, two endings
    texts += ["w" * (200 + 7 * k) for k in range(10)]  # lengths of their own
    rng.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = {r.id for r in exact_dedup.survivors(docs, "doc_id", "text").collect()}
    assert ids == {i for i, t in enumerate(texts) if t.startswith("group")}
    hits = exact_dedup.sieve(exact_dedup.survivors(docs, "doc_id", "text")).applied(docs, "doc_id", "hit").where("hit")
    found = {r.doc_id for r in hits.collect()}
    assert ids <= found and len(found) < len(ids) + 300
    rows = exact_dedup.exact_dedup(docs).where("group_size > 1").collect()
    assert len(rows) == 60 and all(r.group_size == 2 for r in rows)


def brute_fingerprint(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[tuple], threshold=4) -> list:
    label = [i for i, _ in prints]
    fps = np.array([f for _, f in prints], np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= threshold
    while True:
        new = [min((label[j] for j in np.flatnonzero(near[i]) if label[j] is not None), default=None) for i in range(len(fps))]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("width,t", [(21, 1), (22, 1), (16, 1), (16, 2), (13, 0)])
def test_anchors_cover(width, t):
    """Whatever two blocks differ in up to t bits, one's home is among the other's anchors."""
    code, rng = simhash.Covering(3, width, t), random.Random(width)
    for _ in range(300):
        x = rng.getrandbits(width)
        y = x
        for b in rng.sample(range(width), rng.randint(0, t)):
            y ^= 1 << b
        row, anchor, home = code.replicate(np.array([x << 3, y << 3], np.uint64))
        homes = set(anchor[(row == 0) & home].tolist())
        assert len(homes) == 1 and homes <= set(anchor[row == 1].tolist())


def test_simhash_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = sorted(simhash.op9_simhash(spark, sf).collect())
    assert [r.doc_id for r in rows] == sorted(docs)
    prints = [(r.doc_id, brute_fingerprint(docs[r.doc_id])) for r in rows]
    assert [int(r.fingerprint, 16) for r in rows] == [f for _, f in prints]
    assert [r.component_id for r in rows] == brute_components(prints)


def test_simhash_edges(spark, edges, nothing):
    rows = simhash.simhash_components(edges).collect()
    assert sorted((r.doc_id or 0, r.fp & (1 << 64) - 1) for r in rows) == sorted((i or 0, brute_fingerprint(t)) for i, t in EDGES)
    assert {r.component_id for r in rows if r.fp == 0} == {1}
    assert simhash.simhash_components(nothing).count() == 0
    kept = simhash.one_per_component(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 8]


@pytest.mark.parametrize("blocks,chunk", [(3, 2000), (2, 2000), (3, 5)])
def test_links_connect_dense_balls(spark, blocks, chunk):
    """A dense ball, chains and lone fingerprints; small chunks force the grid of a hot anchor."""
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for start in list(fps)[:4]:
        for flips in itertools.islice(itertools.combinations(rng.sample(range(64), 12), 2), 30):
            fps.add(start ^ sum(1 << b for b in flips))
        chain = start
        for _ in range(8):
            for b in rng.sample(range(64), 4):
                chain ^= 1 << b
            fps.add(chain)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    edges = simhash.links(nodes, 4, blocks, chunk)
    roots = {r.fp: r.root for r in simhash.components(edges).collect()}
    own = [roots.get(f, f) for f in signed]
    want = brute_components([(f, f & (1 << 64) - 1) for f in signed])
    assert own == want
