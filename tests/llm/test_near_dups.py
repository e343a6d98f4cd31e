"""Near-dedup by five-word similarity against brute force."""

from __future__ import annotations

import os
import random
import re

import corpus_pipeline
import numpy as np
from llm.conftest import EDGES

from skarn.llm import common, near_dups


def brute_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def brute_kept(docs: list[tuple]) -> set:
    """Smallest ids of the components of Jaccard similarity 0.8 and more, all pairs compared."""
    ids, sets = [i for i, _ in docs], [brute_set(t) for _, t in docs]
    label = list(range(len(docs)))
    for j in range(len(docs)):
        for i in range(j):
            both = len(sets[i] & sets[j]) if 5 * min(len(sets[i]), len(sets[j])) >= 4 * max(len(sets[i]), len(sets[j])) else 0
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and label[i] != label[j]:
                old, new = label[j], label[i]
                label = [new if x == old else x for x in label]
    groups: dict[int, list] = {}
    for i, g in zip(ids, label, strict=True):
        groups.setdefault(g, []).append(i)
    return {min(g) for g in groups.values()}


def test_stage_finds_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, sf).collect()}
    assert kept == brute_kept([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_stage_on_copies_around_the_threshold(spark):
    """Families of edited copies, most pairs near 0.8; a line that all texts share; unlike texts of few words."""
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for _ in range(12):
        first = [word() for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(3, 9)):
            edited = list(first)
            for _ in range(rng.randint(0, max(1, len(first) // 40))):
                edited[rng.randrange(len(edited))] = word()
            texts.append(" ".join(edited))
    line = " ".join(word() for _ in range(40))
    texts += [f"{line} {word()} {word()} " + " ".join(word() for _ in range(n)) for n in (0, 1, 2, 4, 9, 12, 15, 60)]
    texts += ["a b c", "A  b\nc", "a b", "", " ", "a b c d e f"]
    rng.shuffle(texts)
    docs = list(enumerate(texts, 1))
    df = spark.createDataFrame([(i, t, "x", "y", len(t)) for i, t in docs], "doc_id bigint, text string, lang string, source string, n_chars int").repartition(3)
    assert {r.doc_id for r in corpus_pipeline.dedup_near(spark, df, "").collect()} == brute_kept(docs)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Copies of one text, each changed in its own places, and others that differ from it a little too much: few pairs are
    compared for the whole group, and what is kept is what brute force keeps. Hot elements are spread."""
    monkeypatch.setattr(near_dups, "HOT", 20)
    rng = random.Random(8)
    first = [f"w{rng.randrange(9000)}" for _ in range(150)]
    texts = []
    for k in range(260):
        edited = list(first)
        for _ in range(1 + k % 3 if k < 200 else 7):
            edited[rng.randrange(len(edited))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(edited))
    docs = list(enumerate(texts, 1))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    compared = []
    verified = near_dups._verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(near_dups, "_verified", counted)
    assert {r.doc_id for r in near_dups.one_per_near_component(df).collect()} == brute_kept(docs)
    assert sum(compared) < 260 * 259 / 2 * 0.6


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(4)
    for n in (1, 2, 9, 40, 300, 9000):
        for changed in {0, 1, n // 12, n // 9, n // 8, n // 3, n}:
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.r_[a[changed:], rng.integers(0, 2**63, changed).astype(np.uint64)])
            x, y = (np.frombuffer(near_dups.sketch_of(s), np.uint64)[None] for s in (a, b))
            may = near_dups.may_be_similar(x, y, np.array([len(a) + len(b)]), near_dups.SIMILARITY)[0]
            assert may or not near_dups.similar(a, b, near_dups.SIMILARITY)
            assert not may or changed < n // 3 or n in (1, 2, 9000)


def test_sets_are_fetched_for_few_and_tables_go(spark, monkeypatch):
    """Texts with a long passage in common and little else are candidates of one another, but no sets are fetched for
    them; and no table outlives the call but that of the dropped ids."""
    rng = random.Random(5)
    passage = " ".join(f"p{k}" for k in range(25))
    docs = [(k, f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))) for k in range(120)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    fetched, tables = [], []
    sets, path = near_dups._sets, common.shared_path

    def counted(texts, nodes, *rest):
        fetched.append(nodes.count())
        return sets(texts, nodes, *rest)

    def noted(spark, name):
        tables.append(path(spark, name))
        return tables[-1]

    monkeypatch.setattr(near_dups, "_sets", counted)
    monkeypatch.setattr(common, "shared_path", noted)
    assert {r.doc_id for r in near_dups.one_per_near_component(df).collect()} == brute_kept(docs)
    assert sum(fetched) < 20
    left = [t for t in tables if os.path.exists(t.removeprefix("file://"))]
    assert len(left) == 1 and "dropped" in left[0]


def test_near_edges(spark, edges, nothing):
    kept = near_dups.one_per_near_component(edges)
    assert kept.columns == edges.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 6, 7, 8]
    assert len(EDGES) == near_dups.near_components(edges).count()
    assert near_dups.one_per_near_component(nothing).count() == 0
