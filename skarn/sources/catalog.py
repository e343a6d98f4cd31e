"""The catalog: declared tables in a manifest, their data in immutable Parquet folders.

A statement never changes a folder; it adds one and names it in a new manifest, which replaces the old one in
one rename. A transaction works on a copy of the manifest and writes it at its end. Sequences are reserved in
the stored manifest at once, so that a rollback leaves gaps.
"""

from __future__ import annotations

import copy
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skarn.errors import AlreadyExists, InvalidTable
from skarn.sources.storage import Store
from skarn.types import Column, SqlType, of_spark

#: The row number that a table without a primary key carries; never shown by *.
ROW_ID = "__row_id"
_EMPTY = {"tables": {}, "sequences": {}, "indexes": {}}


def _dump(c: Column) -> dict:
    return {"name": c.name, "type": [c.type.name, list(c.type.args), list(c.type.variants)], "primary": c.primary, "unique": c.unique, "nullable": c.nullable}


def _load(d: dict) -> Column:
    name, args, variants = d["type"]
    return Column(d["name"], SqlType(name, tuple(args), tuple(variants)), d["primary"], d["unique"], d["nullable"])


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        text = self.store.read("manifest.json")
        self.stored = json.loads(text) if text else copy.deepcopy(_EMPTY)
        self.state = copy.deepcopy(self.stored)
        self.external: dict[str, tuple[DataFrame | str, dict[str, SqlType], str | None]] = {}
        self.resolved: dict[str, tuple[list[Column], DataFrame]] = {}

    # -- transactions

    def save(self) -> None:
        self.state["sequences"] = {k: max(v, self.stored["sequences"].get(k, 0)) for k, v in self.state["sequences"].items()}
        self.stored = copy.deepcopy(self.state)
        self.store.replace("manifest.json", json.dumps(self.stored))

    def discard(self) -> None:
        """Back to the stored manifest; numbers drawn meanwhile stay drawn."""
        self.state = copy.deepcopy(self.stored)

    def draw(self, sequence: str, n: int) -> int:
        """Reserves n numbers and returns the first."""
        first = max(self.state["sequences"].get(sequence, 0), self.stored["sequences"].get(sequence, 0)) + 1
        self.state["sequences"][sequence] = self.stored["sequences"][sequence] = first + n - 1
        self.store.replace("manifest.json", json.dumps(self.stored))
        return first

    # -- tables

    def register(self, name: str, source: DataFrame | str, types: dict[str, SqlType] | None = None, primary: str | None = None) -> None:
        """A read-only relation; ``types`` declares columns (enums, JSONB), ``primary`` the key. A Parquet path is
        not looked at before a statement names the relation."""
        self.external[name] = (source, types or {}, primary)
        self.resolved.pop(name, None)

    def _external(self, name: str) -> tuple[list[Column], DataFrame]:
        if name not in self.resolved:
            self.resolved[name] = self._resolve(*self.external[name])
        return self.resolved[name]

    def _resolve(self, source: DataFrame | str, types: dict[str, SqlType], primary: str | None) -> tuple[list[Column], DataFrame]:
        df = self.spark.read.parquet(source) if isinstance(source, str) else source
        columns = [Column(f.name, types.get(f.name, of_spark(f.dataType)), primary=f.name == primary, nullable=f.nullable) for f in df.schema]
        for f in df.schema:
            if isinstance(f.dataType, T.TimestampType):
                df = df.withColumn(f.name, F.col(f"`{f.name}`").cast("timestamp_ntz"))
        return columns, df

    def exists(self, name: str) -> bool:
        return name in self.external or name in self.state["tables"]

    def entry(self, name: str) -> dict:
        """A declared table's entry in the manifest."""
        if name not in self.state["tables"]:
            raise InvalidTable(name)
        return self.state["tables"][name]

    def columns(self, name: str) -> list[Column]:
        if name in self.external:
            return self._external(name)[0]
        return [_load(c) for c in self.entry(name)["columns"]]

    def schema(self, name: str, row_id: bool = False) -> T.StructType:
        fields = [T.StructField(c.name, c.type.spark()) for c in self.columns(name)]
        hidden = [T.StructField(ROW_ID, T.LongType())] if row_id and self.entry(name)["row_id"] else []
        return T.StructType(hidden + fields)

    def rows(self, name: str, row_id: bool = False) -> DataFrame:
        """A table's rows, read from its present folders."""
        if name in self.external:
            return self._external(name)[1]
        schema = self.schema(name, row_id)
        folders = self.entry(name)["folders"]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.store.uri(f) for f in folders])

    def table(self, name: str) -> tuple[list[Column], DataFrame]:
        return self.columns(name), self.rows(name)

    def create(self, name: str, columns: list[Column], sql: str) -> None:
        if self.exists(name):
            raise AlreadyExists(f"table {name!r} already exists")
        row_id = not columns[0].primary
        self.state["tables"][name] = {"columns": [_dump(c) for c in columns], "folders": [], "sql": sql, "row_id": row_id}
        for c in columns:
            if c.type.serial:
                self.state["sequences"][f"{name}.{c.name}"] = 0

    def drop(self, name: str) -> None:
        self.entry(name)
        del self.state["tables"][name]
        for kind in ("sequences", "indexes"):
            mine = [k for k in self.state[kind] if k.startswith(f"{name}.") or kind == "indexes" and self.state[kind][k]["table"] == name]
            for k in mine:
                del self.state[kind][k]

    def set_unique(self, table: str, column: str, index: str, sql: str) -> None:
        for c in self.entry(table)["columns"]:
            if c["name"] == column:
                c["unique"] = True
        self.state["indexes"][index] = {"table": table, "sql": sql}

    def write(self, name: str, df: DataFrame, append: bool) -> None:
        """Adds a folder with ``df``'s rows; unless ``append``, it takes the place of all others."""
        folder = f"data/{name}-{uuid.uuid4().hex[:12]}"
        df.write.parquet(self.store.uri(folder))
        entry = self.entry(name)
        entry["folders"] = [*entry["folders"], folder] if append else [folder]

    def vacuum(self) -> int:
        """Deletes folders that the stored manifest does not name; for use while no reader holds an old snapshot."""
        named = {f for t in self.stored["tables"].values() for f in t["folders"]}
        stale = [f"data/{f}" for f in self.store.folders("data") if f"data/{f}" not in named]
        for f in stale:
            self.store.delete(f)
        return len(stale)

    def listing(self) -> DataFrame:
        """The system catalog: type, name, table_name, sql."""
        rows = [("table", n, n, t["sql"]) for n, t in self.state["tables"].items()]
        rows += [("index", n, i["table"], i["sql"]) for n, i in self.state["indexes"].items()]
        rows += [("sequence", n, n.split(".")[0], None) for n in self.state["sequences"]]
        return self.spark.createDataFrame(rows, "type string, name string, table_name string, sql string")
