"""INSERT, UPDATE and DELETE over immutable snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.errors import AnalysisError, DuplicatedKey, InvalidColumn, NotNullViolation, OutOfRange, TypeMismatch
from skarn.operators.values import coerce, evaluate
from skarn.plans.scope import Field, Lowering, Scope, output_column
from skarn.plans.select import distinct_names, expand, item_name
from skarn.sources.catalog import ROW_ID, Catalog
from skarn.sql import ast
from skarn.types import INTEGERS, Column


def _result(df: DataFrame, items: tuple[ast.Item, ...], fields: list[Field], aliases: list[Field]) -> DataFrame:
    """RETURNING: the items over a scope in which ``aliases`` (old and new) come first and plain names last."""
    plain = Scope(fields)
    expanded = expand(items, plain)
    lower = Lowering(Scope([*aliases, *fields]))
    names = distinct_names([item_name(i) for i in expanded])
    return df.select(*[output_column(lower(i.expr)).alias(n) for i, n in zip(expanded, names, strict=True)])


def counted(catalog: Catalog, n: int) -> DataFrame:
    """The result of a statement that returns no rows."""
    return catalog.spark.range(1).select(F.lit(n).cast("bigint").alias("affected"))


def _unique(columns: list[Column]) -> list[str]:
    return [c.name for c in columns if c.primary or c.unique]


def insert(catalog: Catalog, s: ast.Insert) -> DataFrame:
    """Checks types, NOT NULL, ranges and keys, then appends a folder. Rows come from the statement's text, so
    that the driver holds them anyway; they meet the table only in a semi-join on each unique key."""
    entry, columns = catalog.entry(s.table), catalog.columns(s.table)
    given = s.columns or tuple(c.name for c in columns if not c.type.serial)
    if len(set(given)) < len(given):
        raise AnalysisError("a column is given twice")
    known = {c.name: c for c in columns}
    for name in given:
        if name == ROW_ID:
            raise AnalysisError("the row number cannot be assigned")
        if name not in known:
            raise InvalidColumn(name, s.table)
    for row in s.rows:
        if len(row) != len(given):
            raise AnalysisError(f"{len(given)} columns but {len(row)} values")
    for c in columns:
        if c.name not in given and not c.nullable and not c.type.serial and c.type.name != "UUID":
            raise AnalysisError(f"column {c.name!r} is missing")
    values = [dict(zip(given, (coerce(evaluate(e), known[n]) for n, e in zip(given, row, strict=True)), strict=True)) for row in s.rows]
    for c in columns:
        if c.type.serial and c.name not in given:
            first = catalog.draw(f"{s.table}.{c.name}", len(values))
            if first + len(values) - 1 > INTEGERS[c.type.name][1]:
                raise OutOfRange(f"sequence of {c.name!r} is used up")
            for k, v in enumerate(values):
                v[c.name] = first + k
        elif c.type.name == "UUID" and c.name not in given:
            for v in values:
                v[c.name] = str(uuid.uuid4())
        for v in values:
            if v.setdefault(c.name, None) is None and not c.nullable:
                raise NotNullViolation(f"column {c.name!r} cannot be null")
    for name in _unique(columns):
        keys = [v[name] for v in values if v[name] is not None]
        if len(set(keys)) < len(keys):
            raise DuplicatedKey(f"duplicated key in column {name!r}")
    if entry["row_id"]:
        first = catalog.draw(f"{s.table}.{ROW_ID}", len(values))
        for k, v in enumerate(values):
            v[ROW_ID] = first + k
    schema = catalog.schema(s.table, row_id=True)
    new = catalog.spark.createDataFrame([tuple(v[f.name] for f in schema) for v in values], schema)
    for name in _unique(columns):
        clash = catalog.rows(s.table).select(name).join(F.broadcast(new.select(name)), name, "left_semi").first()
        if clash:
            raise DuplicatedKey(f"duplicated key {clash[0]} in column {name!r}")
    catalog.write(s.table, new.coalesce(1), append=True)
    if not s.returning:
        return counted(catalog, len(values))
    fields = [Field(s.table, c, f"{s.table}.{c.name}") for c in columns]
    renamed = new.select(*[F.col(f"`{f.column.name}`").alias(f.internal) for f in fields])
    return _result(renamed, s.returning, fields, [])


def load(catalog: Catalog, name: str, df: DataFrame) -> int:
    """Appends a DataFrame's rows, columns matched by name; returns how many.

    The rows are written once beside the table, then checked there by aggregates (nulls, lengths, ranges, enum
    variants) and, for each unique key, by one grouping and one semi-join with the table. Missing SERIAL columns
    and row numbers are dense: a partition's rows follow those of the partitions before it, so nothing is sorted.
    """
    entry, columns = catalog.entry(name), catalog.columns(name)
    known = set(df.columns)
    for c in columns:
        if c.name not in known and not (c.nullable or c.type.serial or c.type.name == "UUID"):
            raise AnalysisError(f"column {c.name!r} is missing")
    for n in df.columns:
        if n not in {c.name for c in columns}:
            raise InvalidColumn(n, name)
    place, number = F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")
    given = [F.col(f"`{c.name}`") if c.name in known else F.uuid().alias(c.name) for c in columns if c.name in known or c.type.name == "UUID" and not c.nullable]
    staged_at = f"data/{name}-staged-{uuid.uuid4().hex[:12]}"
    df.select(*given, place, number).write.parquet(catalog.store.uri(staged_at))
    staged = catalog.spark.read.parquet(catalog.store.uri(staged_at))
    try:
        sizes = sorted((r.part, r["count"]) for r in staged.groupBy("part").count().collect())  # a row a partition
        total = sum(n for _, n in sizes)
        before, starts = 0, []
        for part, n in sizes:
            starts.append((part, before))
            before += n
        offsets = catalog.spark.createDataFrame(starts, "part int, start bigint")
        numbered = staged.join(F.broadcast(offsets), "part", "left").withColumn("at", F.col("start") + F.col("at") % (1 << 33))
        missing = [c.name for c in columns if c.type.serial and c.name not in known] + ([ROW_ID] if entry["row_id"] else [])
        firsts = {n: catalog.draw(f"{name}.{n}", total) for n in missing}
        for c in columns:
            if c.name in firsts and firsts[c.name] + total - 1 > INTEGERS[c.type.name][1]:
                raise OutOfRange(f"sequence of {c.name!r} is used up")
        values = {n: (F.col("at") + first) for n, first in firsts.items()}
        bad = []
        for c in columns:
            if c.name not in staged.columns:
                continue
            x = F.col(f"`{c.name}`")
            wrong = F.lit(False)
            if c.type.kind == "enum":
                wrong = ~x.isin(*c.type.variants)
            elif c.type.name == "VARCHAR":
                wrong = F.length(x) > c.type.args[0]
            elif c.type.name in INTEGERS:
                low, high, _ = INTEGERS[c.type.name]
                wrong = ~x.cast("decimal(38,0)").between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)"))
            bad.append(F.count_if(x.isNull() & F.lit(not c.nullable) | F.coalesce(wrong, F.lit(False))).alias(c.name))
        found = staged.agg(*bad).first().asDict() if bad else {}
        for n, count in found.items():
            if count:
                raise OutOfRange(f"{count} values do not fit column {n!r}")
        schema = catalog.schema(name, row_id=True)
        out = numbered.select(*[values.get(f.name, F.col(f"`{f.name}`") if f.name in staged.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        for n in _unique(columns):
            key = F.col(f"`{n}`")
            clash = out.where(key.isNotNull()).groupBy(key).count().where("count > 1").select(key).first()
            clash = clash or out.select(key).join(catalog.rows(name).select(key), n, "left_semi").first()
            if clash:
                raise DuplicatedKey(f"duplicated key {clash[0]} in column {n!r}")
        catalog.write(name, out, append=True)
    finally:
        catalog.store.delete(staged_at)
    return total


def _check_stored(catalog: Catalog, name: str, df: DataFrame, changed: set[str]) -> None:
    """Constraints of changed columns over a written snapshot: one aggregate for each key, one for all nulls."""
    columns = [c for c in catalog.columns(name) if c.name in changed]
    for c in columns:
        if c.primary or c.unique:
            clash = df.where(F.col(f"`{c.name}`").isNotNull()).groupBy(f"`{c.name}`").count().where("count > 1").first()
            if clash:
                raise DuplicatedKey(f"duplicated key {clash[0]} in column {c.name!r}")
    strict = [c.name for c in columns if not c.nullable]
    if strict:
        nulls = df.agg(*[F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in strict]).first()
        for n in strict:
            if nulls[n]:
                raise NotNullViolation(f"column {n!r} cannot be null")


def _assigned(x, c: Column):
    """An assigned expression as the column's type, its family checked; enums and lengths are checked row by row."""
    families = ({"int", "float", "numeric"}, {"string", "enum", "uuid"}, {"date", "timestamp"})
    kinds = {x.kind, c.type.kind} - {"null"}
    same = len(kinds) < 2 or c.type.kind == "json" or any(kinds <= f for f in families)
    if not same:
        raise TypeMismatch(f"column {c.name!r} of type {c.type} cannot hold {x.type}")
    if c.type.kind == "json" and x.kind != "json":
        return F.when(x.column.isNotNull(), F.get_json_object(F.to_json(F.struct(x.column.alias("v"))), "$.v") if x.kind != "string" else F.regexp_extract(F.to_json(F.struct(x.column.alias("v"))), r'^\{"v":(.*)\}$', 1))
    if c.type.kind == "numeric":  # RETURNING shows it as computed; storing rounds it to the declared scale
        return x.column if x.kind == "numeric" else x.column.cast("decimal(38,10)")
    column = x.column.cast(c.type.spark())
    bad = None
    if c.type.kind == "enum" and x.kind != "enum":
        bad = ~x.column.isin(*c.type.variants)
    elif c.type.name == "VARCHAR":
        bad = F.length(x.column) > c.type.args[0]
    elif c.type.name in INTEGERS:
        low, high, _ = INTEGERS[c.type.name]
        bad = ~x.column.cast("decimal(38,0)").between(F.lit(low).cast("decimal(38,0)"), F.lit(high).cast("decimal(38,0)"))
    if bad is None:
        return column
    return F.when(bad, F.raise_error(F.lit(f"value does not fit column {c.name} of type {c.type}")).cast(c.type.spark())).otherwise(column)


def update(catalog: Catalog, s: ast.Update) -> DataFrame:
    """Rewrites the table as a new snapshot. Assignments see the row as changed so far; the condition sees it as
    it was. The rows of RETURNING read the old snapshot, which stays."""
    entry, columns = catalog.entry(s.table), catalog.columns(s.table)
    known = {c.name: c for c in columns}
    old = [Field("old", c, f"old.{c.name}") for c in columns]
    new = [Field("new", c, f"new.{c.name}") for c in columns]
    plain = [Field(s.table, c, f"new.{c.name}") for c in columns]
    before = [Field(s.table, c, f"old.{c.name}") for c in columns]
    rows = catalog.rows(s.table, row_id=True)
    rid = [F.col(ROW_ID)] if entry["row_id"] else []
    df = rows.select(*rid, *[F.col(f"`{c.name}`").alias(f"{side}.{c.name}") for side in ("old", "new") for c in columns])
    hit = Lowering(Scope(before)).condition(s.where) if s.where is not None else F.lit(True)
    df = df.withColumn("hit", F.coalesce(hit, F.lit(False)))
    changed = set()
    for name, e in s.sets:
        if name not in known:
            raise InvalidColumn(name, s.table)
        expr = ast.Literal(e.value, "string") if isinstance(e, ast.Literal) and e.kind == "string" else e
        lower = Lowering(Scope([*old, *new, *plain]))
        value = lower._open(lower(expr), _like_column(known[name]))
        df = df.withColumn(f"new.{name}", F.when(F.col("hit"), _assigned(value, known[name])).otherwise(F.col(f"`new.{name}`")))
        changed.add(name)
    catalog.write(s.table, df.select(*rid, *[F.col(f"`new.{c.name}`").cast(c.type.spark()).alias(c.name) for c in columns]), append=False)
    _check_stored(catalog, s.table, catalog.rows(s.table), changed)
    touched = df.where("hit")
    return _result(touched, s.returning, plain, [*old, *new]) if s.returning else counted(catalog, touched.count())


def _like_column(c: Column):
    from skarn.plans.scope import Typed

    return Typed(None, c.type)


def delete(catalog: Catalog, s: ast.Delete) -> DataFrame:
    """Rewrites the table without the rows whose condition is true."""
    columns = catalog.columns(s.table)
    catalog.entry(s.table)
    rows = catalog.rows(s.table, row_id=True)
    fields = [Field(s.table, c, c.name) for c in columns]
    hit = F.coalesce(Lowering(Scope(fields)).condition(s.where), F.lit(False)) if s.where is not None else F.lit(True)
    gone = rows.where(hit).count()
    if gone:
        catalog.write(s.table, rows.where(~hit), append=False)
    return counted(catalog, gone)
