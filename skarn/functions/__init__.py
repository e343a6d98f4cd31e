"""Column helpers for what Spark's own functions lack; all stay in the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

Parts = tuple[object, object, object]  # months, days, microseconds; numbers or columns

# EXTRACT units by operand.
DATE_UNITS = ("CENTURY", "DECADE", "YEAR", "QUARTER", "MONTH", "DAY", "EPOCH")
TIME_UNITS = ("HOUR", "MINUTE", "SECOND", "EPOCH")
TIMESTAMP_UNITS = (*DATE_UNITS, "HOUR", "MINUTE", "SECOND")


def trunc_number(x: Column, digits: int, exact: bool = False) -> Column:
    """Truncates toward zero after ``digits`` places (before the point where negative). ``exact``: a decimal, whose
    remainder has its sign."""
    if exact:
        out = x - x % F.lit(Decimal(1).scaleb(-digits))
        return out.cast(f"decimal(38,{min(12, max(0, digits))})")
    scale = float(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale) / scale


def whole_power(x: Column, y: Column) -> Column:
    """x to the power of y, whole numbers, exact up to 38 digits and an error beyond; a negative y truncates toward zero.
    The power is a product over the bits of y, so that its cost follows the logarithm of y."""
    one, zero = (F.lit(n).cast("decimal(38,0)") for n in (1, 0))
    base, power = x.cast("decimal(38,0)"), y.cast("bigint")
    sign = F.when((x < 0) & (power % 2 != 0), -one).otherwise(one)
    bits = F.transform(F.sequence(F.lit(6), F.lit(0)), lambda k: F.getbit(F.greatest(power, F.lit(0)), k))
    product = F.aggregate(bits, one, lambda acc, bit: (acc * acc * F.when(bit == 1, base).otherwise(one)).cast("decimal(38,0)"))
    much = F.raise_error(F.lit("POWER exceeds 38 digits")).cast("decimal(38,0)")
    small = F.when(power == 0, one).when(x == 0, F.when(power > 0, zero)).when(F.abs(x) == 1, sign)
    return F.when(x.isNull() | power.isNull(), F.lit(None)).when((power == 0) | (F.abs(x) <= 1), small).when(power < 0, zero).when(power > 127, much).otherwise(product)


def substring(s: Column, start: Column | None, length: Column | None) -> Column:
    """1-based characters; start 0 is 1, a negative start gives an empty string, a negative length runs to the end."""
    start = F.lit(1) if start is None else F.when(start == 0, 1).otherwise(start)
    rest = F.length(s)
    length = rest if length is None else F.when(length < 0, rest).otherwise(length)
    return F.when(start < 1, F.when(s.isNotNull(), F.lit(""))).otherwise(F.substring(s, F.greatest(start, F.lit(1)).cast("int"), length.cast("int")))


def extract(unit: str, x: Column, kind: str) -> Column:
    """EXTRACT of a date, timestamp (without time zone), time (seconds of the day) or interval struct."""
    if kind == "time":
        return {
            "HOUR": F.floor(x / 3600), "MINUTE": F.floor(x / 60) % 60, "SECOND": x % 60, "EPOCH": x,
        }[unit].cast("bigint")
    if kind == "interval":
        months, days, micros = x["months"].cast("bigint"), x["days"].cast("bigint"), x["micros"]
        seconds = _toward_zero(micros, 1_000_000)
        return {
            "CENTURY": _toward_zero(months, 1200), "DECADE": _toward_zero(months, 120), "YEAR": _toward_zero(months, 12),
            "QUARTER": _toward_zero(months % 12, 3) + 1, "MONTH": months, "DAY": days, "HOUR": _toward_zero(seconds, 3600),
            "MINUTE": _toward_zero(seconds, 60) % 60, "SECOND": seconds % 60,
            "EPOCH": (months * 30 + days) * 86_400 + seconds,
        }[unit].cast("bigint")
    year = F.year(x)
    simple = {
        "CENTURY": F.floor((year - 1) / 100) + 1, "DECADE": F.floor(year / 10), "YEAR": year, "QUARTER": F.quarter(x),
        "MONTH": F.month(x), "DAY": F.dayofmonth(x),
    }
    if unit in simple:
        return simple[unit].cast("bigint")
    if unit == "EPOCH":
        days = F.unix_date(x.cast("date")).cast("bigint") * 86_400  # whatever the session's time zone
        return days if kind == "date" else days + F.hour(x) * 3600 + F.minute(x) * 60 + F.second(x)
    return {"HOUR": F.hour, "MINUTE": F.minute, "SECOND": F.second}[unit](x).cast("bigint")


def _toward_zero(x: Column, n: int) -> Column:
    return (x - x % n) / n


def add_interval(x: Column, kind: str, parts: Parts, sign: int) -> Column:
    """Date (calendar months with end-of-month clamp, then days), timestamp (then whole seconds too) or time of
    day (seconds only, around midnight) plus or minus an interval."""
    months, days, micros = (p if isinstance(p, Column) else F.lit(p) for p in parts)
    seconds = F.floor(micros / 1_000_000) if isinstance(parts[2], Column) else F.lit(int(parts[2]) // 1_000_000)
    if kind == "time":
        return F.pmod(x + sign * seconds, F.lit(86_400)).cast("int")
    if kind == "date":
        return F.date_add(F.add_months(x, (sign * months).cast("int")), (sign * days).cast("int"))
    zero = F.lit(0)
    return x + F.make_interval(zero, (sign * months).cast("int"), zero, (sign * days).cast("int"), zero, zero, (sign * seconds).cast("decimal(18,6)"))


def time_text(x: Column) -> Column:
    """HH:MM:SS of seconds of the day."""
    return F.format_string("%02d:%02d:%02d", F.floor(x / 3600).cast("int"), (F.floor(x / 60) % 60).cast("int"), (x % 60).cast("int"))


def time_seconds(text: Column) -> Column:
    parts = F.split(text, ":")
    return (parts[0].cast("int") * 3600 + parts[1].cast("int") * 60 + parts[2].cast("int")).cast("int")


def like(x: Column, pattern: str | Column) -> Column:
    """LIKE without an escape character."""
    if isinstance(pattern, str):
        return x.like(pattern.replace("\\", "\\\\"))
    return F.like(x, F.replace(pattern, F.lit("\\"), F.lit("\\\\")))


def enum_ordinal(x: Column, variants: tuple[str, ...]) -> Column:
    """Position of an enum's value among its variants."""
    return F.array_position(F.array(*[F.lit(v) for v in variants]), x)


def json_path(text: Column, path: tuple[object, ...], target: str, whole: bool = False) -> Column:
    """The value at a path of JSON text as ``target``; missing, or of another type: null.

    A path is names and integers; a negative one counts from an array's end. ``whole``: the path's end must be
    an array, which is returned whole.
    """
    node, held = F.try_parse_json(text), "$"

    def escaped(name: str) -> str:
        return f"['{name}']" if not name.replace("_", "a").isalnum() or name[:1].isdigit() else f".{name}"

    for part in path:
        if isinstance(part, int) and part < 0:
            node = F.try_element_at(F.try_variant_get(node, held, "array<variant>"), F.lit(part))
            held = "$"
        else:
            held += f"[{part}]" if isinstance(part, int) else escaped(str(part))
    if whole:
        items = F.try_variant_get(node, held, "array<variant>")
        return F.when(items.isNotNull(), F.to_json(F.try_variant_get(node, held, "variant")))
    return F.try_variant_get(node, held, target)
