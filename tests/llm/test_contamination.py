"""Decontamination against a brute-force search, and the index's parts."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from llm.conftest import EDGES

from skarn.llm import fm_index as fm

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    windows: dict[tuple, set] = {}
    for item_id, text in items:
        own = words(text)
        for i in range(max(1, len(own) - window + 1) if own else 0):
            windows.setdefault(tuple(own[i : i + window]), set()).update(() if item_id is None else (str(item_id),))
    out = []
    for text in docs:
        own, found = words(text), set()
        hit = [False] * len(own)
        for n in {len(w) for w in windows}:
            for i in range(len(own) - n + 1):
                if (ids := windows.get(tuple(own[i : i + n]))) is not None:
                    found |= ids
                    hit[i : i + n] = [True] * n
        out.append((hit, found))
    return out


def flags(n, spans):
    hit = [False] * n
    for a, b in spans:
        hit[a:b] = [True] * (b - a)
    return hit


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_and_search(seed):
    rng = np.random.default_rng(seed)
    text = np.r_[rng.integers(0, 4, 400), np.tile([1, 2], 60), 0]
    order = fm.suffix_array(text)

    def key(i):
        out = []
        for j in range(i, len(text)):
            out.append((text[j], j if text[j] == 0 else 0))
            if text[j] == 0:
                break
        return out

    assert order.tolist() == sorted(range(len(text)), key=key)
    index = fm.FMIndex(text, sample=5)
    assert index.locate(np.arange(len(text))).tolist() == order.tolist()
    for n in (1, 2, 5):
        phrases = rng.integers(1, 4, (30, n))
        low, high = index.search(phrases, np.full(30, n))
        for p, a, b in zip(phrases, low, high, strict=True):
            want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p).all()]
            assert sorted(order[a:b].tolist()) == want


def test_wavelet_ranks():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 37, 1000)
    tree = fm.WaveletMatrix(values)
    c, i = rng.integers(0, 37, 200), rng.integers(0, 1001, 200)
    assert tree.rank(c, i).tolist() == [int((values[:b] == a).sum()) for a, b in zip(c, i, strict=True)]


def test_shards_and_blocks_agree_with_brute_force():
    rng = random.Random(2)
    docs = [" ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "..."]
    items = [(k, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(0, 9)))) for k in range(25)] + [(99, None), (None, "ab"), (5, "cd")]
    want = brute(docs, items, 4)
    blocks = [fm.Phrases(items[:10], 4), fm.Phrases(items[10:], 4)]
    for got, (hit, ids) in zip(fm.scan_shard([fm.words_of(d) for d in docs], iter(blocks)), want, strict=True):
        assert flags(len(hit), got[0]) == hit and got[1] == ids


@pytest.mark.parametrize("block_bytes,shard", [(fm.BLOCK_BYTES, fm.SHARD_WORDS), (2_000, 3_000)])
def test_query(spark, sf, monkeypatch, block_bytes, shard):
    monkeypatch.setattr(fm, "BLOCK_BYTES", block_bytes)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = dict(zip(texts, brute(texts.values(), [(r.item_id, r.text) for r in bench.collect()]), strict=True))
    found = fm.find_contamination(docs, bench, shard_words=shard)
    assert found.columns == [*docs.columns, "n_words", "n_hit", "hit_spans", "item_ids"]
    rows = found.collect()
    assert len(rows) == len(texts) and sum(r.n_hit > 0 for r in rows) > 2
    for r in rows:
        hit, ids = want[r.doc_id]
        assert r.n_words == len(hit) and flags(len(hit), r.hit_spans) == hit and r.item_ids == sorted(ids)
    query = {r.doc_id: r for r in fm.op3_decontamination(spark, sf).collect()} if block_bytes > 10_000 else {}
    for k, r in query.items():
        hit, ids = want[k]
        assert tuple(r)[1:] == (len(hit), sum(hit), len(ids), fm.digest(list(ids)), any(hit))


def test_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(1, "b c d"), (2, None), (3, "!"), (None, "hello"), (4, "lorem ipsum")], "item_id bigint, text string")
    rows = fm.find_contamination(edges, bench)
    assert rows.columns == ["doc_id", "text", "lang", "keep_id", "KEPT", "ids", "score", "a.b", "quality_text", "sieve `bits", "n_words", "n_hit", "hit_spans", "item_ids"]
    want = brute([t for _, t in EDGES], [(1, "b c d"), (4, "lorem ipsum"), (None, "hello")])
    assert any(sum(h) and not f for h, f in want) or sum(want[3][0]) == 4  # words of an item without id are hit
    key = lambda x: (x[0] or 0, x[1], x[2])
    assert sorted(((r.doc_id, r.n_hit, ",".join(r.item_ids)) for r in rows.collect()), key=key) == sorted(((i, sum(h), ",".join(sorted(f))) for (i, _), (h, f) in zip(EDGES, want, strict=True)), key=key)
    assert fm.find_contamination(nothing, bench).count() == 0
    assert {r.n_hit for r in fm.find_contamination(edges, bench.where("item_id = -1")).collect()} == {0}
