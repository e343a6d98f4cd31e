"""Token counts, token files and pieces against the libraries themselves."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.conftest import EDGES
from tokenizers import AddedToken, Tokenizer, models, normalizers, pre_tokenizers

from skarn.llm import token_counts, token_files
from skarn.llm.common import default_tokenizer, shared_path
from skarn.llm.encoding import ChunkMemo, SpanEncoder, WordEncoder
from skarn.llm.pieces import PieceEncoder, encode_pieces, op4_pieces

BYTE, WORD, PIECE = (default_tokenizer(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
TEXTS = st.text(alphabet=st.sampled_from("aeithnosr ,.\n\t▁ ABC0123éß́\xa0\x1c'日🙂"), max_size=60)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORD)


@functools.cache
def encoder(kind, path):
    return kind(path)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_spans_are_the_librarys(text):
    own = encoder(SpanEncoder, BYTE)
    assert own.spans(text).tolist() == [list(o) for o in own.library.encode(text, add_special_tokens=False).offsets]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_the_librarys(text):
    own = encoder(WordEncoder, WORD)
    assert np.frombuffer(own.packed(text), own.dtype).tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_memo_evicts_and_stays_right(monkeypatch):
    monkeypatch.setattr("skarn.llm.encoding.MEMO_CHUNKS", 3)
    monkeypatch.setattr("skarn.llm.encoding.MEMO_LATER", 2)
    memo = ChunkMemo(lambda chunks: [c.encode() for c in chunks])
    rng = random.Random(1)
    for _ in range(200):
        chunks = [rng.choice("abcdefghijklm") for _ in range(6)]
        assert memo.get(chunks) == [c.encode() for c in chunks]
    assert len(memo.first) <= 3 + 6


def test_attribution_rules():
    tokens = np.array([[0, 2], [2, 5], [5, 6], [6, 10]])
    sections = np.array([[0, 3], [3, 3], [3, 8], [8, 10]])
    first, crossing = token_counts.attribute(tokens, sections, "first")
    assert first.tolist() == [2, 0, 2, 0] and crossing.tolist() == [1, 0, 1, 0]
    assert token_counts.attribute(tokens, sections, "largest")[0].tolist() == [1, 0, 3, 0]
    assert token_counts.attribute(tokens[:0], sections, "first")[0].tolist() == [0, 0, 0, 0]
    assert token_counts.attribute(tokens, sections[:0], "first")[0].tolist() == []


def test_token_counts_add_up(spark, edges, nothing, byte_library):
    rows = token_counts.token_counts(edges).collect()
    for doc_id, text in EDGES:
        own = [r for r in rows if r.doc_id == doc_id]
        times = sum(d == doc_id for d, _ in EDGES)
        assert sum(r.n_tokens for r in own) == times * len(byte_library.encode(text or "", add_special_tokens=False).ids)
        assert {(r.char_start, r.char_end) for r in own} == set(token_counts.line_sections(text or ""))
    assert token_counts.token_counts(nothing).count() == 0


def test_token_counts_of_given_sections(spark):
    docs = spark.sql("SELECT 1L AS doc_id, 'title here body text' AS text, array(named_struct('a', 10, 'b', 99), named_struct('a', 0, 'b', 10), null) AS parts")
    rows = token_counts.token_counts(docs, sections_col="parts").orderBy("char_start", "char_end").collect()
    assert [(r.char_start, r.char_end, r.n_tokens) for r in rows] == [(0, 0, 0), (0, 10, 2), (10, 20, 2)]


def _digests(library, rows):
    at, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_round_trip(spark, edges, nothing, word_library):
    out = shared_path(spark, "test")
    manifest = token_files.write_token_files(edges, out, seq_len=16)
    found = sorted((tuple(r) for r in token_files.read_token_digests(manifest, out).collect()), key=lambda r: r[1])
    assert found == _digests(word_library, EDGES)
    fs, root = pafs.FileSystem.from_uri(out)
    for m in manifest.collect():
        reader = token_files.ShardReader(fs, f"{root}/{m.path}")
        stream = np.concatenate(list(reader.ids(0, m.n_tokens)))
        n = -(-m.n_tokens // 16)
        views = [reader.sequence(i) for i in range(n)]
        assert all(ids.base is not None and mask.buffers()[1].address == reader._load(i // 64).column(1).values.buffers()[1].address for i, (ids, mask) in enumerate(views))
        both = [(ids, mask.to_numpy(zero_copy_only=False)) for ids, mask in views]
        assert np.concatenate([ids[mask] for ids, mask in both]).tolist() == stream.tolist()
        assert all(len(ids) == 16 and not ids.flags.owndata for ids, _ in both)
        assert sum(int(mask.sum()) for _, mask in both) == m.n_tokens
    empty = shared_path(spark, "test")
    assert token_files.read_token_digests(token_files.write_token_files(nothing, empty), empty).count() == 0


def test_hot_ids_fill_several_shards(spark, word_library):
    """One id, and null ids, on most rows: shards stay near their size, and what is read back is what went in."""
    rows = [(7, f"text number {k % 50}") for k in range(600)] + [(None, "same")] * 300 + [(k, "x") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = shared_path(spark, "test")
    manifest = token_files.write_token_files(docs, out, seq_len=8, shard_bytes=1_000)
    sizes = [r.n_tokens for r in manifest.collect()]
    total = sum(len(word_library.encode(t, add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(sizes) == total and len(sizes) > 8 and max(sizes) < total / 4
    found = sorted((tuple(r) for r in token_files.read_token_digests(manifest, out).collect()), key=lambda r: r[1])
    assert [r[0] or -1 for r in found] == sorted(r[0] or -1 for r in found)
    want = _digests(word_library, rows)
    assert sorted((r[0] or -1, r[2], r[3]) for r in found) == sorted((r[0] or -1, r[2], r[3]) for r in want)
    assert [r[1] for r in found] == np.r_[0, np.cumsum([r[2] for r in found])][:-1].tolist()


def _foreign(kind):
    """Tokenizers whose definitions do not allow chunks: a mark merged with its word, a prefix space, white space split."""
    if kind == "marks":
        vocab = {t: k for k, t in enumerate(["e", "t", "c", ".", "et", "etc", "etc.", "E", " "])}
        own = Tokenizer(models.BPE(vocab, [("e", "t"), ("et", "c"), ("etc", ".")]))
        own.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return own
    own = Tokenizer.from_file(BYTE)
    if kind == "prefix":
        own.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    elif kind == "accents":
        own.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.StripAccents()])
    elif kind == "added":
        own.add_tokens([AddedToken("new york", lstrip=True, rstrip=True)])
    return own


@pytest.mark.parametrize("kind", ["marks", "prefix", "accents", "added", "bytes"])
def test_foreign_tokenizers_are_served_whole(tmp_path, kind):
    library = _foreign(kind)
    library.save(str(tmp_path / "own.json"))
    words, spans = WordEncoder(str(tmp_path / "own.json")), SpanEncoder(str(tmp_path / "own.json"))
    assert not words.by_word and spans.by_chunk == (kind == "bytes")
    for text in ["etc. Etc. etc", "a  new york b", " x\n\ny ", "déjà vu, vu.", "", "e t c."]:
        found = library.encode(text, add_special_tokens=False)
        assert np.frombuffer(words.packed(text), words.dtype).tolist() == found.ids
        assert spans.spans(text).tolist() == [list(o) for o in found.offsets]


def brute_sections(text, offsets):
    """(start, end, tokens, crossing) of every line: each token looked at by itself and given to the first line it touches."""
    bounds, at = [], 0
    for line in re.findall(r"[^\n]*\n+|[^\n]+", text) or [""]:
        bounds.append([at, at + len(line), 0, 0])
        at += len(line)
    for a, b in offsets:
        touched = [s for s in bounds if s[0] < max(b, a + 1) and a < s[1]]
        if touched:
            touched[0][2] += 1
            touched[0][3] += len(touched) > 1
    return [tuple(s) for s in bounds]


def test_token_counts_query(spark, sf, byte_library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found: dict = {}
    for r in token_counts.op1_token_counts(spark, sf).orderBy("doc_id", "section_no").collect():
        found.setdefault(r.doc_id, []).append((r.char_start, r.char_end, r.n_tokens, r.n_crossing))
    assert found == {i: brute_sections(t, byte_library.encode(t, add_special_tokens=False).offsets) for i, t in docs.items()}


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_line_counts_of_random_texts(byte_library, text):
    spans = np.array(token_counts.line_sections(text), np.int64).reshape(-1, 2)
    counts = token_counts.attribute(encoder(SpanEncoder, BYTE).spans(text), spans, "first")
    want = brute_sections(text, byte_library.encode(text, add_special_tokens=False).offsets)
    assert [(a, b, n, c) for (a, b), n, c in zip(spans.tolist(), *map(np.ndarray.tolist, counts), strict=True)] == want


def test_token_files_query(spark, sf, word_library):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = sorted((tuple(r) for r in token_files.op2_token_files(spark, sf).collect()), key=lambda r: r[1])
    assert found == _digests(word_library, docs)


@pytest.fixture(scope="module")
def pieces():
    return encoder(PieceEncoder, PIECE)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_pieces_are_the_librarys(text):
    own = encoder(PieceEncoder, PIECE)
    assert own.encode(text) == own.library.encode(text)


def test_pieces_of_odd_texts(pieces):
    for text in ["", " ", " " * 40 + "x" + " " * 19, "a" * 3000, "hello" + " " * 5000 + "x", "▁▁x", "\x00", *(t or "" for _, t in EDGES)]:
        assert pieces.encode(text) == pieces.library.encode(text)


def test_piece_query(spark, sf, edges, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)

    def digest(text):
        ids = [*library.encode(text or ""), library.eos_id()]
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op4_pieces(spark, sf).collect():
        assert tuple(r)[1:] == digest(docs[r.doc_id])
    full = encode_pieces(edges)
    assert full.columns == ["doc_id", "lang", "keep_id", "KEPT", "n_words", "score", "a.b", "quality_text", "sieve `bits", "ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"]
    found = sorted(((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in full.collect()))
    assert found == sorted((i or 0, *digest(t)) for i, t in EDGES)
    assert encode_pieces(nothing).count() == 0
