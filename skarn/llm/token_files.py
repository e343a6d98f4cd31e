"""Token-ID output: Arrow IPC files of fixed-size-list batches.

A shard is one Arrow IPC file. Its record batches all have ``BATCH_ROWS`` rows (the last may have fewer); a row
is a sequence of exactly ``seq_len`` ids (``ids``: fixed-size list) with its mask (``mask``: fixed-size list of
booleans, false on the padding of a shard's last sequence; Arrow keeps them as bits, a sequence's in whole bytes). Sequence i is therefore row i % BATCH_ROWS of
batch i // BATCH_ROWS, and a memory-mapped reader gets ids and mask without copying or decoding. Documents are
packed end to end; ``<shard>.docs.arrow`` beside it holds each document's id, start and length in the shard's stream.

Texts are dealt to as many ranges of ids as there are shards of ``shard_bytes`` of text, whatever Spark's own settings
are. A shard is written under a temporary name and renamed, and its content depends on its input alone, so a task that
runs again after a lost executor leaves the same file.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skarn.llm.common import column, default_tokenizer, map_rows, shared_path
from skarn.llm.encoding import WordEncoder, encoder

SEQ_LEN = 2048
BATCH_ROWS = 64
#: Bytes of text in a shard, about: what a task sorts and encodes (some 16 million ids).
SHARD_BYTES = 64 << 20
END_ID = 2
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _file_schema(dtype: np.dtype, seq_len: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), seq_len)), ("mask", pa.list_(pa.bool_(), seq_len))])


class ShardWriter:
    """Packs documents' ids into one shard; holds one batch of sequences and the shard's document table."""

    def __init__(self, fs: pafs.FileSystem, path: str, attempt: str, dtype: np.dtype, seq_len: int):
        self.fs, self.path, self.dtype, self.seq_len = fs, path, dtype, seq_len
        self.temporary = f"{path}.{attempt}"
        self.schema = _file_schema(dtype, seq_len)
        self.sink = fs.open_output_stream(self.temporary)
        self.file = pa.ipc.new_file(self.sink, self.schema)
        self.doc_sink = fs.open_output_stream(f"{self.temporary}.docs")
        self.doc_file = pa.ipc.new_file(self.doc_sink, _DOCS)
        self.held = bytearray()
        self.docs: list[tuple[int | None, int, int]] = []
        self.total = self.n_docs = 0

    def add(self, doc_id: int | None, packed: bytes) -> None:
        n = len(packed) // self.dtype.itemsize
        self.docs.append((doc_id, self.total, n))
        self.n_docs += 1
        self.total += n
        self.held += packed
        full = BATCH_ROWS * self.seq_len * self.dtype.itemsize
        while len(self.held) >= full:
            self._write(bytes(self.held[:full]))
            del self.held[:full]
        if len(self.docs) >= 10_000:
            self._write_docs()

    def _write(self, data: bytes, real: int | None = None) -> None:
        n = len(data) // self.dtype.itemsize
        real = n if real is None else real
        ids = pa.Array.from_buffers(pa.from_numpy_dtype(self.dtype), n, [None, pa.py_buffer(data)])
        bits = np.packbits(np.arange(n) < real, bitorder="little")
        mask = pa.Array.from_buffers(pa.bool_(), n, [None, pa.py_buffer(bits)])
        columns = [pa.FixedSizeListArray.from_arrays(a, self.seq_len) for a in (ids, mask)]
        self.file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def _write_docs(self) -> None:
        if self.docs:
            columns = [pa.array(c, pa.int64()) for c in zip(*self.docs, strict=True)]
            self.doc_file.write_batch(pa.RecordBatch.from_arrays(columns, schema=_DOCS))
            self.docs = []

    def close(self) -> None:
        if self.held:
            row = self.seq_len * self.dtype.itemsize
            real = len(self.held) // self.dtype.itemsize
            self._write(bytes(self.held) + bytes(-len(self.held) % row), real)
        self._write_docs()
        for f in (self.file, self.sink, self.doc_file, self.doc_sink):
            f.close()
        self.fs.move(f"{self.temporary}.docs", f"{self.path}.docs.arrow")
        self.fs.move(self.temporary, self.path)


class ShardReader:
    """Random access to a shard's sequences, masks and documents; memory-mapped where the store is local."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        def source(p: str):
            return pa.memory_map(p) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(p)

        self.file = pa.ipc.open_file(source(path))
        self.doc_file = pa.ipc.open_file(source(f"{path}.docs.arrow"))
        self.seq_len = self.file.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def _load(self, k: int) -> pa.RecordBatch:
        if k != self._at:
            self._at, self._batch = k, self.file.get_batch(k)
        return self._batch

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids (NumPy) and mask (Arrow) of sequence i, both views of the file, without a copy."""
        batch, at = self._load(i // BATCH_ROWS), i % BATCH_ROWS * self.seq_len
        return batch.column(0).values.to_numpy()[at : at + self.seq_len], batch.column(1).values.slice(at, self.seq_len)

    def ids(self, start: int, length: int) -> Iterator[np.ndarray]:
        """Ids [start, start + length) of the shard's stream, in zero-copy pieces."""
        size = BATCH_ROWS * self.seq_len
        while length > 0:
            at = start % size
            piece = self._load(start // size).column(0).values.to_numpy()[at : at + length]
            yield piece
            start, length = start + len(piece), length - len(piece)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for k in range(self.doc_file.num_record_batches):
            yield from zip(*(c.to_pylist() for c in self.doc_file.get_batch(k).columns), strict=True)


def write_token_files(
    docs: DataFrame,
    out: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
    seq_len: int = SEQ_LEN,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode whole texts and write them as shards below ``out``, documents in ascending id order over shards.

    Texts are dealt by ranges of the id (one shuffle of id and text, after a pass for their size), sorted and encoded;
    each range becomes a shard. Rows that repeat an id are ordered by a hash of their text and may lie in several shards, so that no id
    fills one task. Returns the manifest, read back from ``out``: ``shard``, ``path``, ``n_docs``, ``n_tokens``,
    ``base`` (ids in all earlier shards); one row a shard. Ids are whole numbers, or text that holds them. A null text
    is empty (its document is the end id alone); rows with a null id come first; other columns are not read. No rows:
    no shards and an empty manifest.
    """
    spark = docs.sparkSession
    path = tokenizer_path or default_tokenizer("word_bpe_49k.json")
    own = docs.select(column(id_col).cast("bigint").alias("id"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    total = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-int(total) // shard_bytes))
    order = ("id", "h", "at")
    keyed = own.select("id", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("at"), "text")
    ranged = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order)

    def make():
        context = TaskContext.get()
        shard, attempt = context.partitionId(), f"_{context.taskAttemptId()}"

        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            writer, words = None, encoder(WordEncoder, path)
            end = np.array([end_id], words.dtype).tobytes()
            for doc_id, text in items:
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(out)
                    fs.create_dir(f"{base}/shards", recursive=True)
                    name = f"shards/shard-{shard:06d}.arrow"
                    writer = ShardWriter(fs, f"{base}/{name}", attempt, words.dtype, seq_len)
                writer.add(doc_id, words.packed(text) + end)
            if writer is not None:
                writer.close()
                yield shard, name, writer.n_docs, writer.total

        return run

    fields = [("shard", pa.int64(), "bigint"), ("path", pa.string(), "string"), ("n_docs", pa.int64(), "bigint"), ("n_tokens", pa.int64(), "bigint")]
    map_rows(ranged.select("id", "text"), make, fields).write.parquet(f"{out}/manifest")
    manifest = spark.read.schema("shard bigint, path string, n_docs bigint, n_tokens bigint").parquet(f"{out}/manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_digests(manifest: DataFrame, out: str) -> DataFrame:
    """Per document, from the files alone: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    n = max(1, manifest.count())  # a task a shard

    def make():
        def run(items: Iterator[tuple]) -> Iterator[tuple]:
            fs, root = pafs.FileSystem.from_uri(out)
            for name, base in items:
                reader = ShardReader(fs, f"{root}/{name}")
                for doc_id, start, length in reader.documents():
                    crc = 0
                    for piece in reader.ids(start, length):
                        crc = zlib.crc32(piece.astype("<u4").tobytes(), crc)
                    yield doc_id, base + start, length, crc

        return run

    fields = [(c, pa.int64(), "bigint") for c in ("doc_id", "start", "n_tokens", "ids_crc32")]
    return map_rows(manifest.select("path", "base").repartition(n), make, fields)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all of ``documents`` to token files in the shared folder and reads them back."""
    out = shared_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_digests(write_token_files(docs, out), out)
