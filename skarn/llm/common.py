"""Shared plumbing of the training-data operators: shared storage, Arrow row streaming, code shipping."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_LOCAL_BASES: dict[str, str] = {}
_SHIPPED: set[str] = set()
_OWN: set[str] = set()
_SCRATCH: list[list[str]] = []
_HELD: dict[object, object] = {}
_ASKED: set[object] = set()

#: Bytes of rows that a task holds before it sends them on.
BATCH_BYTES = 4 << 20


def shared_base(spark: SparkSession) -> str:
    """URI of the folder that the driver and every executor can see.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and driver and executors are one
    process (a local master, as in tests) is a temporary folder taken; elsewhere an unset name is an error, since a
    machine's own folder would be a different one on every executor.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_BASES:
        _LOCAL_BASES[app] = "file://" + tempfile.mkdtemp(prefix="skarn-")
    return _LOCAL_BASES[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's folder in the shared one, which goes when the driver ends."""
    own = f"{shared_base(spark)}/skarn-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(_remove, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex[:12]}"


def _remove(spark: SparkSession, path: str) -> None:
    """Best effort: the session may have been stopped."""
    with contextlib.suppress(Exception):
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialise(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors. Inside ``scratch``
    the table goes at the block's end; a ``kept`` one at the end of the block around it, if any."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    bound_batches(spark)
    df.write.parquet(path)
    if _SCRATCH[kept:]:
        _SCRATCH[-1 - kept].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialise`` writes within it go at its end, so nothing that is returned may still read them."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            _remove(spark, path)


def bound_batches(spark: SparkSession) -> None:
    """From now on the session hands rows to Python in Arrow batches of at most BATCH_BYTES (Spark's own bound is 16 times
    that, held by the JVM and by the worker alike). The bound that counts is the one in force when a result is written,
    which its caller does, so it stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that do not share the driver's import path, and bound their batches."""
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="skarn-code-")  # the driver's own; executors fetch the file from the driver
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "skarn_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def held_by_worker(key: object, make: Callable[[], object]) -> object:
    """What a worker keeps between tasks, such as an encoder with its memos, until a task begins that does not ask for it."""
    _ASKED.add(key)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def begun(make: Callable) -> Callable:
    """A task's ``make()``; what earlier tasks have kept and it does not ask for is let go."""
    _ASKED.clear()
    body = make()
    for key in _HELD.keys() - _ASKED:
        del _HELD[key]
    return body


def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples, one Python object at a time so that long texts never pile up."""
    for batch in batches:
        columns = batch.columns
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def weight(value: object) -> int:
    """About how many bytes a value takes as a Python object beside its fixed part."""
    if isinstance(value, str | bytes):
        return len(value)
    return 40 * len(value) if isinstance(value, list) else 0


def batched(items: Iterable[tuple], schema: pa.Schema, limit: int = 2000, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Tuples back into Arrow batches of at most ``limit`` rows, and of no more than ``size`` bytes but for the last row."""
    held: list[tuple] = []
    total = 0
    for item in items:
        held.append(item)
        total += sum(map(weight, item))
        if len(held) >= limit or total >= size:
            yield _batch(held, schema)
            held, total = [], 0
    if held:
        yield _batch(held, schema)


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, f.type) for values, f in zip(zip(*held, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[Iterator[tuple]], Iterator[tuple]]],
    fields: list[tuple[str, pa.DataType, str | T.DataType]],
) -> DataFrame:
    """``mapInArrow`` over row tuples. ``make`` runs once a task and returns a generator function; ``fields``
    are (name, Arrow type, Spark type or its name)."""
    ship(df.sparkSession)
    schema = pa.schema([(n, t) for n, t, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(begun(make)(rows(batches)), schema)

    kinds = [T.StructType.fromDDL(f"x {s}")[0].dataType if isinstance(s, str) else s for _, _, s in fields]
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # mapInArrow looks columns up by unquoted names
    return plain.mapInArrow(run, T.StructType([T.StructField(n, k) for (n, _, _), k in zip(fields, kinds, strict=True)]))


def quoted(name: str) -> str:
    """A column's name as SQL takes it, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The top-level column of that very name, whatever characters it has."""
    return F.col(quoted(name))


def carried(df: DataFrame, *dropped: str) -> list[str]:
    """Names of ``df``'s columns but those (in any case) that an operator's own columns take the place of."""
    taken = {c.lower() for c in dropped}
    return [c for c in df.columns if c.lower() not in taken]


def arrow_fields(df: DataFrame, names: list[str]) -> list[tuple[str, pa.DataType, T.DataType]]:
    """Fields of ``map_rows`` for columns of ``df`` that are handed on."""
    own = {f.name: f.dataType for f in df.schema}
    return [(n, to_arrow_type(own[n]), own[n]) for n in names]


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not use yet (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        k += 1
        name = f"{stem}_{k}"
    return name


def default_tokenizer(name: str) -> str:
    """Path of a public tokenizer file: ``$SKARN_TOKENIZERS/name``, else the installed collection's."""
    if base := os.environ.get("SKARN_TOKENIZERS"):
        return os.path.join(base, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
