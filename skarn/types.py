"""Declared types of the dialect and their Spark counterparts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Kinds whose values are whole numbers: (least, greatest, Spark type).
INTEGERS = {
    "SMALLINT": (-(1 << 15), (1 << 15) - 1, T.ShortType()),
    "INT": (-(1 << 31), (1 << 31) - 1, T.IntegerType()),
    "BIGINT": (-(1 << 63), (1 << 63) - 1, T.LongType()),
    "SMALLINT UNSIGNED": (0, (1 << 16) - 1, T.IntegerType()),
    "INT UNSIGNED": (0, (1 << 32) - 1, T.LongType()),
    "BIGINT UNSIGNED": (0, (1 << 64) - 1, T.DecimalType(20, 0)),
    "SMALLSERIAL": (1, (1 << 15) - 1, T.ShortType()),
    "SERIAL": (1, (1 << 31) - 1, T.IntegerType()),
    "BIGSERIAL": (1, (1 << 63) - 1, T.LongType()),
}
INTERVAL = T.StructType(
    [T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("micros", T.LongType())]
)


@dataclass(frozen=True)
class SqlType:
    """``name`` is the declared base name; ``args`` its numbers; ``variants`` those of an inline enum."""

    name: str
    args: tuple[int, ...] = ()
    variants: tuple[str, ...] = ()

    @property
    def kind(self) -> str:
        """int, float, numeric, bool, string, uuid, date, time, timestamp, interval, json, enum or null."""
        if self.variants:
            return "enum"
        if self.name in INTEGERS:
            return "int"
        return {
            "REAL": "float", "DOUBLE PRECISION": "float", "NUMERIC": "numeric", "BOOLEAN": "bool", "VARCHAR": "string",
            "TEXT": "string", "UUID": "uuid", "DATE": "date", "TIME": "time", "TIMESTAMP": "timestamp",
            "INTERVAL": "interval", "JSONB": "json",
        }.get(self.name, "null")

    @property
    def serial(self) -> bool:
        return self.name.endswith("SERIAL")

    def spark(self) -> T.DataType:
        if self.name in INTEGERS:
            return INTEGERS[self.name][2]
        if self.name == "NUMERIC":
            return T.DecimalType(*(self.args if len(self.args) == 2 else (*self.args, 0) if self.args else (18, 6)))
        simple = {
            "REAL": T.FloatType(), "DOUBLE PRECISION": T.DoubleType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(),
            "TIMESTAMP": T.TimestampNTZType(), "TIME": T.IntegerType(), "INTERVAL": INTERVAL,
        }
        return simple.get(self.name, T.StringType())

    def __str__(self) -> str:
        if self.variants:
            return " | ".join(f'"{v}"' for v in self.variants)
        return self.name + (f"({', '.join(map(str, self.args))})" if self.args else "")


@dataclass(frozen=True)
class Column:
    name: str
    type: SqlType
    primary: bool = False
    unique: bool = False
    nullable: bool = False


INT, BIGINT, DOUBLE, TEXT, BOOLEAN = map(SqlType, ("INT", "BIGINT", "DOUBLE PRECISION", "TEXT", "BOOLEAN"))
DATE, TIME, TIMESTAMP, INTERVAL_TYPE, JSONB, NULL = map(SqlType, ("DATE", "TIME", "TIMESTAMP", "INTERVAL", "JSONB", "NULL"))
NUMERIC = SqlType("NUMERIC")
#: Whole numbers beyond 64 bits.
WIDE = SqlType("NUMERIC", (38, 0))


def of_spark(t: T.DataType) -> SqlType:
    """The declared type that a table read from outside has."""
    if isinstance(t, T.DecimalType):
        return SqlType("NUMERIC", (t.precision, t.scale))
    names = {
        T.ByteType: "SMALLINT", T.ShortType: "SMALLINT", T.IntegerType: "INT", T.LongType: "BIGINT", T.FloatType: "REAL",
        T.DoubleType: "DOUBLE PRECISION", T.BooleanType: "BOOLEAN", T.DateType: "DATE", T.TimestampNTZType: "TIMESTAMP",
        T.TimestampType: "TIMESTAMP", T.VariantType: "JSONB",
    }
    return SqlType(names.get(type(t), "TEXT"))
