"""SELECT: relations, joins, filter, grouping, order and limits as one DataFrame for Catalyst to plan."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn import types as S
from skarn.errors import AnalysisError, InvalidGroupBy, TypeMismatch
from skarn.plans.scope import Field, Lowering, Scope, Typed, contains_aggregate, output_column, sort_columns, substitute, walk
from skarn.sql import ast

#: Columns and rows of a table by its name.
Tables = Callable[[str], tuple[list[S.Column], DataFrame]]


def relation(tables: Tables, table: ast.Table) -> tuple[list[Field], DataFrame]:
    """A table's fields, and its rows under names that no other relation has."""
    columns, df = tables(table.name)
    known = table.known_as
    fields = [Field(known, c, f"{known}.{c.name}") for c in columns]
    return fields, df.select(*[F.col(f"`{f.column.name}`").alias(f.internal) for f in fields])


def item_name(item: ast.Item) -> str:
    """Alias, else a column's own name, a function's name, or the expression itself."""
    e = item.expr
    if item.alias:
        return item.alias
    if isinstance(e, ast.Name):
        return str(e.parts[-1]) if len(e.parts) <= 2 and isinstance(e.parts[-1], str) else str(e)
    if isinstance(e, ast.Call):
        return e.name
    return show(e)


def show(e: object) -> str:
    """An expression as text."""
    if isinstance(e, ast.Binary):
        return f"{show(e.left)} {e.op} {show(e.right)}"
    if isinstance(e, ast.Unary):
        return f"{e.op}{show(e.operand)}"
    if isinstance(e, ast.Literal):
        return f"'{e.value}'" if e.kind == "string" else str(e.value)
    if isinstance(e, ast.Call):
        return f"{e.name}({', '.join(show(a) for a in e.args if a is not None)})"
    if isinstance(e, ast.Star):
        return "*"
    return str(e) if isinstance(e, ast.Name) else type(e).__name__


def distinct_names(names: list[str]) -> list[str]:
    """Names without repeats: a later one gets a number."""
    out: list[str] = []
    for n in names:
        k, found = 1, n
        while found in out:
            k += 1
            found = f"{n}_{k}"
        out.append(found)
    return out


def expand(items: tuple[ast.Item, ...], scope: Scope) -> list[ast.Item]:
    """Items with * replaced by all visible columns, each qualified."""
    out = []
    for item in items:
        if isinstance(item.expr, ast.Star):
            out += [ast.Item(ast.Name((f.relation, f.column.name)), None) for f in scope.fields if not f.hidden]
        else:
            out.append(item)
    return out


def conjuncts(e: object) -> list[object]:
    """The conditions that AND connects."""
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, ast.Binary) and e.op == "AND" else [e]


def relations_of(e: object, scope: Scope) -> set[str]:
    return {scope.find(x.parts)[0].relation for x in walk(e) if isinstance(x, ast.Name)}


def joined(tables: Tables, q: ast.Select) -> tuple[Scope, DataFrame]:
    """What a query's relations hold, and their join; names of a join's condition are those of the relations up to it."""
    fields, df = relation(tables, q.table)
    scope, parts = Scope(list(fields)), {q.table.known_as: df}
    conditions: list[tuple[set[str], SparkColumn]] = []
    for j in q.joins:
        if j.table.known_as in parts:
            raise AnalysisError(f"relation {j.table.known_as!r} appears twice")
        own, other = relation(tables, j.table)
        scope.fields += own
        parts[j.table.known_as] = other
        lower = Lowering(scope)
        condition = lower.condition(j.on)
        df = df.join(other, condition, j.how)
        conditions += [(relations_of(e, scope), lower.condition(e)) for e in conjuncts(j.on)]
    if len(parts) > 2 and all(j.how == "inner" for j in q.joins):
        order = join_order(q, scope, parts, [c for c, _ in conditions])
        if order:
            df, held = parts[order[0]], {order[0]}
            for name in order[1:]:
                now = [c for known, c in conditions if known <= held | {name} and not known <= held]
                df = df.join(parts[name], functools.reduce(operator.and_, now), "inner")
                held.add(name)
    return scope, df


def join_order(q: ast.Select, scope: Scope, parts: dict[str, DataFrame], links: list[set[str]]) -> list[str] | None:
    """Relations of a chain of inner joins: the largest first, then of those that a condition connects to what is joined
    already the ones that WHERE filters by themselves, smaller ones first. Sizes are those of the planner's statistics
    (of files, without reading them). None, for the order as written, if a condition names fewer than two relations."""
    if any(len(c) < 2 for c in links):
        return None
    names = {i.alias: i.expr for i in q.items if i.alias}
    alone = [relations_of(substitute(e, names), scope) for e in conjuncts(q.where)] if q.where is not None else []
    filtered = {r for c in alone if len(c) == 1 for r in c}
    size = {n: int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for n, df in parts.items()}
    order = [max(parts, key=lambda n: size[n])]
    while len(order) < len(parts):
        near = [n for n in parts if n not in order and any(n in c and c <= {n, *order} for c in links)]
        if not near:
            return None
        order.append(min(near, key=lambda n: (n not in filtered, size[n])))
    return order


def lower_select(spark: SparkSession, q: ast.Select, tables: Tables) -> DataFrame:
    scope, df = joined(tables, q)
    items = expand(q.items, scope)
    names = distinct_names([item_name(i) for i in items])
    aliases = {i.alias: i.expr for i in items if i.alias}
    group = [substitute(e, aliases) for e in q.group]
    if len(items) == 1 and isinstance(items[0].expr, ast.Call) and items[0].expr.name == "TYPEOF" and not q.joins:
        return spark.range(1).select(Lowering(scope)(items[0].expr).column.alias(names[0]))  # one row, whatever the table
    if q.where is not None:
        where = substitute(q.where, aliases)
        if contains_aggregate(where):
            raise AnalysisError("aggregates are not allowed in WHERE")
        df = df.where(Lowering(scope).condition(where))
    order = [ast.Order(substitute(o.expr, aliases), o.descending) for o in q.order]
    if group or any(contains_aggregate(i.expr) for i in items):
        df = _grouped(df, scope, items, names, group, order)
    else:
        lower = Lowering(scope)
        if order:
            df = df.orderBy(*[k for o in order for k in sort_columns(lower(o.expr), o.descending)])
        df = df.select(*[output_column(lower(i.expr)).alias(n) for i, n in zip(items, names, strict=True)])
    if q.offset:
        df = df.offset(q.offset)
    return df if q.limit is None else df.limit(q.limit)


def _grouped(df: DataFrame, scope: Scope, items: list[ast.Item], names: list[str], group: list[object], order: list[ast.Order]) -> DataFrame:
    base = Lowering(scope)
    if any(contains_aggregate(g) for g in group):
        raise AnalysisError("aggregates are not allowed in GROUP BY")
    keys: dict[str, Typed] = {}
    by_expr: dict[object, str] = {}
    by_field: dict[str, str] = {}

    def add_key(x: Typed) -> str:
        name = f"key {len(keys)}"
        keys[name] = x
        return name

    for g in group:
        x = base(g)
        if x.kind in ("interval", "json"):
            raise TypeMismatch(f"cannot group by {x.type}")
        name = by_expr[g] = add_key(x)
        if isinstance(g, ast.Name):
            found, path = scope.find(g.parts)
            if not path:
                by_field[found.internal] = name
    grouped_keys = {f.relation for f in scope.fields if f.column.primary and f.internal in by_field}

    def key_column(name: str) -> Typed:
        return Typed(F.col(f"`{name}`"), keys[name].type)

    def grouped(e: object) -> Typed | None:
        if e in by_expr:
            return key_column(by_expr[e])
        return None

    def ungrouped(f: Field) -> Typed:
        """A grouped column, or one that a grouped primary key of its table determines."""
        if f.internal not in by_field:
            if f.relation not in grouped_keys:
                raise InvalidGroupBy(f.column.name)
            by_field[f.internal] = add_key(Typed(F.col(f"`{f.internal}`"), f.column.type))
        return key_column(by_field[f.internal])

    lower = Lowering(scope, grouped, ungrouped)
    outputs = [lower(i.expr) for i in items]
    sorts = [k for o in order for k in [(lower(o.expr), o.descending)]] if group else []  # a global aggregate is one row
    for e in [i.expr for i in items]:
        for x in walk(e):
            if isinstance(x, ast.Star) and x is e:
                raise AnalysisError("* cannot be grouped")
    own = df.withColumns({n: k.column for n, k in keys.items()})
    results = [output_column(x).alias(f"out {i}") for i, x in enumerate(outputs)]
    sort_names = [[f"sort {i} {k}" for k in range(2 if x.path else 1)] for i, (x, _) in enumerate(sorts)]
    for (x, _), cols in zip(sorts, sort_names, strict=True):
        results += [c.alias(n) for c, n in zip(_sort_values(x), cols, strict=True)]
    out = own.groupBy(*[F.col(f"`{n}`") for n in keys]).agg(*results)
    if sorts:
        columns = [(F.col(f"`{n}`"), d) for (_, d), cols in zip(sorts, sort_names, strict=True) for n in cols]
        out = out.orderBy(*[c.desc_nulls_first() if d else c.asc_nulls_last() for c, d in columns])
    return out.select(*[F.col(f"`out {i}`").alias(n) for i, n in enumerate(names)])


def _sort_values(x: Typed) -> list:
    from skarn import functions as X

    if x.kind == "enum":
        return [X.enum_ordinal(x.column, x.type.variants)]
    return [X.json_path(*x.path, "double"), x.column] if x.path else [x.column]
