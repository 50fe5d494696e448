"""Literals and relations as Columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.functions import timeuuid
from colonnade.functions.token import token_column
from colonnade.lang import nodes as n
from colonnade.plans.catalog import Column as TableColumn
from colonnade.plans.catalog import Table
from colonnade.plans.restrictions import members
from colonnade.plans.terms import Terms
from colonnade.plans.types import TEXT, CqlType, Misfit, bound, resolve

TOKEN = "_token"
_NUMBERS = frozenset({"tinyint", "smallint", "int", "bigint", "counter", "time", "float", "double", "varint", "decimal"})


def literal(value: object, kind: CqlType) -> Column:
    """A stored value as a typed Column."""
    target = kind.spark()
    if value is None:
        return F.lit(None).cast(target)
    if kind.name in ("list", "set"):
        return F.array(*(literal(v, kind.args[0]) for v in value)).cast(target) if value else F.array().cast(target)
    if kind.name == "map":
        if not value:
            return F.map_from_arrays(F.array(), F.array()).cast(target)
        keys = [list(k) if isinstance(k, tuple) and kind.args[0].name in ("list", "set") else k for k in value]
        return F.map_from_arrays(F.array(*(literal(k, kind.args[0]) for k in keys)), F.array(*(literal(v, kind.args[1]) for v in value.values())))
    if kind.name in ("tuple", "duration") or kind.fields:
        inner = kind.args or tuple(t for _, t in kind.fields) or (CqlType("int"), CqlType("int"), CqlType("bigint"))
        return F.struct(*(literal(v, t).alias(f.name) for v, t, f in zip(value, inner, target.fields, strict=True)))
    return F.lit(value).cast(target)


def order_key(col: Column, kind: CqlType) -> Column:
    """What a column sorts by."""
    if kind.name == "timeuuid":
        return timeuuid.timeuuid_key(col)
    if kind.name == "uuid":
        return timeuuid.uuid_key(col)
    if kind.name in ("float", "double"):
        # -0.0 stands before 0.0
        return F.struct(col.alias("v"), F.when(col == 0, F.when(col.cast("string").startswith("-"), 0).otherwise(1)).alias("z"))
    return col


def equality_key(col: Column, kind: CqlType) -> Column:
    """Maps can't be compared; their sorted entries can."""
    return F.array_sort(F.map_entries(col)) if kind.name == "map" else col


def _apply(op: str, left: Column, right: Column) -> Column:
    return {"=": lambda: left == right, "!=": lambda: left != right, "<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right}[op]()


def never() -> Column:
    """Matches no row."""
    return F.lit(False)


def compare(col: Column, kind: CqlType, op: str, value: object) -> Column:
    """A value of the type against a constant: typed if it fits, else by kind of value; what can't be compared never matches."""
    if value is None:
        return never()
    try:
        fitted = literal(resolve(bound(value, kind), kind), kind)
    except Misfit:
        return _loosely(col, kind, op, value)
    if op in ("=", "!="):
        return _apply(op, equality_key(col, kind), equality_key(fitted, kind))
    if not kind.basic or kind.name == "duration":
        return never()
    if kind.name in ("uuid", "timeuuid"):
        return _apply(op, order_key(col, kind), order_key(fitted, kind))
    return _apply(op, col, fitted)


def _loosely(col: Column, kind: CqlType, op: str, value: object) -> Column:
    if isinstance(value, (int, float)):
        if kind.name in _NUMBERS:
            return _apply(op, col, F.lit(int(value) if isinstance(value, bool) else value))
        if kind.name == "boolean" and not isinstance(value, bool):
            return _apply(op, col.cast("int"), F.lit(value))
    if isinstance(value, str) and kind.name in TEXT:
        return _apply(op, col, F.lit(value))
    if isinstance(value, uuid.UUID) and kind.name in ("uuid", "timeuuid"):
        return _apply(op, col, F.lit(str(value)))
    return never()


def _any(conditions: list[Column]) -> Column:
    out = never()
    for c in conditions:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def is_member(col: Column, kind: CqlType, value: object) -> Column:
    parts = members(value)
    if parts is None:
        return compare(col, kind, "=", value)
    try:
        if kind.basic:
            fitted = [resolve(bound(v, kind), kind) for v in parts if v is not None]
            return col.isin([literal(v, kind) for v in fitted]) if fitted else never()
    except Misfit:
        pass
    return _any([compare(col, kind, "=", v) for v in parts])


def _contains(col: Column, kind: CqlType, op: str, value: object) -> Column:
    if value is None or kind.name not in ("list", "set", "map") or op == "contains key" and kind.name != "map":
        return never()
    inner = kind.args[0] if op == "contains key" or kind.name != "map" else kind.args[1]
    try:
        wanted = literal(resolve(bound(value, inner), inner), inner)
    except Misfit:
        return never()
    held = col if kind.name != "map" else F.map_keys(col) if op == "contains key" else F.map_values(col)
    return F.array_contains(held, wanted)


def lexicographic(columns: list[tuple[Column, CqlType]], op: str, values: list) -> Column:
    """Columns against values, the first that differs decides; a NULL on either side never matches."""
    strict = op[0]
    cases = []
    for i in range(len(columns)):
        equal = [compare(c, k, "=", v) for (c, k), v in zip(columns[:i], values[:i], strict=True)]
        cases.append(_all([*equal, compare(*columns[i], strict, values[i])]))
    if op.endswith("="):
        cases.append(_all([compare(c, k, "=", v) for (c, k), v in zip(columns, values, strict=True)]))
    return _any(cases) & _all([c.isNotNull() for c, _ in columns])


def token_of(table: Table, available: list[str]) -> Column:
    if TOKEN in available:
        return F.col(TOKEN)
    return token_column([F.col(f"`{c.name}`") for c in table.partition], [c.type for c in table.partition])


def relation(rel: object, table: Table, terms: Terms, available: list[str]) -> Column:
    """The condition that a relation puts on rows."""
    value = terms.value(rel.term)

    def col(name: str) -> tuple[Column, CqlType]:
        found: TableColumn = table.column(name)
        return F.col(f"`{name}`"), found.type

    if isinstance(rel, n.Compare):
        c, kind = col(rel.column)
        if rel.op == "in":
            return is_member(c, kind, value)
        if rel.op.startswith("contains"):
            return _contains(c, kind, rel.op, value)
        return compare(c, kind, rel.op, value)
    if isinstance(rel, n.ElementCompare):
        c, kind = col(rel.column)
        if kind.name != "map" or rel.op not in ("=", "!=", "<", "<=", ">", ">="):
            return never()
        try:
            key = literal(terms.fitted(rel.key, kind.args[0]), kind.args[0])
        except Misfit:
            return never()
        return compare(F.try_element_at(c, key), kind.args[1], rel.op, value)
    if isinstance(rel, n.TokenCompare):
        return _apply(rel.op, token_of(table, available), F.lit(value).cast("long")) if value is not None else never()
    columns = [col(c) for c in rel.columns]
    parts = members(value)
    if rel.op == "in":
        rows = [members(v) if members(v) is not None else [v] for v in parts or []]
        return _any([_all([compare(c, k, "=", v) for (c, k), v in zip(columns, row, strict=False)]) for row in rows])
    if parts is None:
        parts = [value]
    if len(parts) < len(columns):
        return never()
    if rel.op == "=":
        return _all([compare(c, k, "=", v) for (c, k), v in zip(columns, parts, strict=False)])
    if rel.op == "!=":
        return ~_all([compare(c, k, "=", v) for (c, k), v in zip(columns, parts, strict=False)])
    return lexicographic(columns, rel.op, parts[: len(columns)])
