"""The pipeline, stage by stage, against brute force; and the guard around the optional folders."""

from __future__ import annotations

import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import sentencepiece
from llm.test_contamination import brute
from llm.test_near_dups import brute_kept

from skarn.llm import common
from skarn.llm.common import default_tokenizer

REPO = Path(__file__).resolve().parents[2]


def test_stages(spark, sf):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact-dedup", "near-dedup", "decontamination", "encoding"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    before = docs.collect()
    out = stages["quality"](spark, docs, sf)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert sum(i in kept for i, q in labels.items() if q == 1) >= 0.97 * sum(labels.values())
    assert len(kept) < len(before)

    rows = stages["exact-dedup"](spark, docs, sf).collect()
    groups: dict[str, list] = {}
    for r in before:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", r.text), []).append(r)
    assert {r.doc_id for r in rows} == {min(g, key=lambda r: (-len(r.text), r.doc_id)).doc_id for g in groups.values()}
    assert len(rows) == len(groups)

    near = {r.doc_id for r in stages["near-dedup"](spark, docs, sf).collect()}
    assert near == brute_kept([(r.doc_id, r.text) for r in before])

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r.doc_id for r in stages["decontamination"](spark, docs, sf).collect()}
    assert clean == {r.doc_id for r, (hit, _) in zip(before, brute([r.text for r in before], bench), strict=True) if not any(hit)}

    library = sentencepiece.SentencePieceProcessor(model_file=default_tokenizer("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in before}
    for r in stages["encoding"](spark, docs, sf).collect():
        assert r.ids == [*library.encode(texts[r.doc_id]), library.eos_id()]


def test_run_is_the_stages_in_turn(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, docs.select("doc_id", "ids_sha256").collect()))


def test_rows_reach_python_in_small_batches_whoever_writes(spark, sf, monkeypatch):
    """The stages' results are written by their caller: the bound on batches has to hold then."""

    def rows(batches):
        for batch in batches:
            assert batch.nbytes <= 2 * common.BATCH_BYTES
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    monkeypatch.setattr(common, "rows", rows)
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(name)  # whatever ran before in this session
    docs = spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('lorem ', id, ' ipsum '), 400) AS text", "'x' AS lang", "'y' AS source", "1L AS n_chars")
    assert corpus_pipeline.decontaminate(spark, docs, sf).count() == 3000
    assert corpus_pipeline.encode(spark, docs.limit(1500), sf).count() == 1500
    spark.conf.set(name, "1m")  # a smaller bound of the caller's stays
    corpus_pipeline.encode(spark, docs, sf)
    assert spark.conf.get(name) == "1m"
    spark.conf.unset(name)


def test_workers_let_go_what_the_next_task_does_not_use():
    a, b = object(), object()
    assert common.begun(lambda: common.held_by_worker("a", lambda: a)) is a
    assert common.begun(lambda: common.held_by_worker("a", object)) is a
    assert common.begun(lambda: b) is b
    assert not common._HELD


def test_rest_works_without_the_optional_folders():
    code = "import sys; sys.modules['skarn.llm'] = None; import __spark_entry__ as e; n = e.queries(); assert n and not any(k.startswith('op') or k == 'pipeline' for k in n) and set(e.oracle_sql()) <= set(n)"
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)
