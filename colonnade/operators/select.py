"""SELECT as a DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.errors import InvalidRequest, NotSupported
from colonnade.functions import scalars
from colonnade.lang import nodes as n
from colonnade.operators.predicates import TOKEN, compare, order_key, relation, token_of
from colonnade.plans.catalog import Catalog, Table
from colonnade.plans.restrictions import Restrictions, analyse, check_select, reversed_order
from colonnade.plans.terms import Terms, conversion
from colonnade.plans.types import INTEGER_BITS, CqlType

ORDINAL = "_ordinal"
#: Columns beside a table's own: writing time and expiry of a cell, expiry of a row.
WRITTEN, EXPIRES, ROW_EXPIRES = "_wt$", "_ex$", "_row_exp"
#: Up to so many listed keys their frame is small enough to broadcast; the scan is filtered by them in any case.
MAX_BROADCAST_KEYS = 10_000


@dataclass
class Source:
    """A table's rows, static columns merged in; expired rows left out."""

    table: Table
    frame: DataFrame


@dataclass
class SelectPlan:
    restrictions: Restrictions
    turned: bool
    limit: int | None


def plan(s: n.Select, table: Table, terms: Terms) -> SelectPlan:
    """What a SELECT restricts; raises if it may not run."""
    if s.transform == "json":
        raise NotSupported("SELECT JSON is not supported")
    if s.group_by:
        raise NotSupported("GROUP BY is not supported")
    if s.per_partition is not None:
        raise NotSupported("PER PARTITION LIMIT is not supported")
    r = analyse(s.where, table, terms)
    check_select(s, r, table)
    return SelectPlan(r, reversed_order(s, r, table) if s.order_by else False, row_limit(s, terms))


def select(spark: SparkSession, s: n.Select, planned: SelectPlan, source: Source, terms: Terms, catalog: Catalog) -> DataFrame:
    table, r, turned, limit = source.table, planned.restrictions, planned.turned, planned.limit
    df = filtered(source.frame, r, table, terms)
    if s.selected is not None and any(isinstance(x.selector, n.CountSelector) for x in s.selected):
        label = s.selected[0].alias or "count"
        return df.agg(F.count("*").alias(label))
    outputs = [projected(x, table, terms, catalog, df.columns) for x in s.selected] if s.selected is not None else [F.col(f"`{c.name}`") for c in table.star]
    if s.transform == "distinct":
        return distinct(s, df, table, outputs, limit)
    if r.multiple and r.partitions is not None and not s.order_by:
        df = in_listed_order(spark, df, r, table)
    df = ordered(df, s, r, table, turned, limit)
    return (df if limit is None else df.limit(limit)).select(*outputs)


def row_limit(s: n.Select, terms: Terms) -> int | None:
    if s.limit is None:
        return None
    value = terms.value(s.limit)
    if value is None or not isinstance(value, int) or isinstance(value, bool):
        return None
    return value if 0 <= value < 1 << 31 else None


def filtered(df: DataFrame, r: Restrictions, table: Table, terms: Terms) -> DataFrame:
    if r.nothing:
        return df.limit(0)
    for rel in r.filters:
        df = df.filter(relation(rel, table, terms, df.columns))
    for op, bound in r.token_bounds:
        df = df.filter(compare(token_of(table, df.columns), CqlType("bigint"), op, bound))
    return df


def distinct(s: n.Select, df: DataFrame, table: Table, outputs: list[Column], limit: int | None) -> DataFrame:
    if s.selected is None or any(not isinstance(x.selector, n.ColumnSelector) or table.column(x.selector.name).kind not in ("partition", "static") for x in s.selected):
        raise InvalidRequest("SELECT DISTINCT queries must only request partition key columns and/or static columns")
    named = {x.selector.name for x in s.selected}
    if {c.name for c in table.partition} - named:
        raise InvalidRequest("SELECT DISTINCT queries must request all the partition key columns")
    # static columns have one value in a partition, so partial aggregation finds each partition once
    out = df.select(*(F.col(f"`{c}`") for c in sorted(named))).dropDuplicates([c.name for c in table.partition])
    if limit is not None:
        out = out.orderBy(token_of(table, out.columns), *(F.col(f"`{c.name}`") for c in table.partition)).limit(limit)
    return out.select(*outputs)


def in_listed_order(spark: SparkSession, df: DataFrame, r: Restrictions, table: Table) -> DataFrame:
    """A copy of a partition's rows for each time its key is listed, numbered by place in the list."""
    keys = r.partitions or []
    fields = [T.StructField(f"_k{i}", c.type.spark()) for i, c in enumerate(table.partition)]
    frame = spark.createDataFrame([(*key, i) for i, key in enumerate(keys)], T.StructType([*fields, T.StructField(ORDINAL, T.LongType())]))
    if len(keys) <= MAX_BROADCAST_KEYS:
        frame = F.broadcast(frame)
    on = [F.col(f"`{c.name}`") == F.col(f"_k{i}") for i, c in enumerate(table.partition)]
    return df.join(frame, on, "inner").drop(*(f.name for f in fields))


def clustering_order(table: Table, turned: bool) -> list[Column]:
    """Rows that have no clustering key, of a partition with static columns alone, come first."""
    out = []
    for c in table.clustering:
        key = order_key(F.col(f"`{c.name}`"), c.type)
        out.append(key.desc_nulls_first() if c.descending != turned else key.asc_nulls_first())
    return out


def ordered(df: DataFrame, s: n.Select, r: Restrictions, table: Table, turned: bool, limit: int | None) -> DataFrame:
    """Sorted where the order shows: within partitions, under ORDER BY, and where LIMIT picks rows."""
    ties = [F.col(f"`{c.name}`") for c in table.partition]
    if s.order_by:
        return df.orderBy(*clustering_order(table, turned), *ties)
    if r.within_partitions:
        by = [F.col(ORDINAL)] if ORDINAL in df.columns else []
        by += clustering_order(table, False)
        return df.orderBy(*by) if by else df
    if limit is None:
        return df
    return df.orderBy(token_of(table, df.columns), *ties, *clustering_order(table, False))


def by_token(df: DataFrame, table: Table) -> DataFrame:
    """All rows in the table's own order; a global sort, so only on request."""
    return df.orderBy(token_of(table, df.columns), *(F.col(f"`{c.name}`") for c in table.partition), *clustering_order(table, False))


def projected(x: n.Selected, table: Table, terms: Terms, catalog: Catalog, available: list[str]) -> Column:
    col, _, label = selector(x.selector, table, terms, catalog, available)
    return col.alias(x.alias or label)


def selector(sel: object, table: Table, terms: Terms, catalog: Catalog, available: list[str]) -> tuple[Column, CqlType, str]:
    if isinstance(sel, n.ColumnSelector):
        found = table.column(sel.name)
        return F.col(f"`{sel.name}`"), found.type, sel.name
    if isinstance(sel, n.CastSelector):
        if not isinstance(sel.inner, n.ColumnSelector):
            raise InvalidRequest("CAST currently only supports a column reference as its argument")
        found, target = table.column(sel.inner.name), catalog.type(sel.type, table.keyspace)
        if not (found.type.basic and target.basic):
            raise InvalidRequest("CAST is only supported between basic types")
        numbers = {found.type.name, target.name} <= INTEGER_BITS.keys() | {"blob"} and "blob" in (found.type.name, target.name)
        col = F.col(f"`{found.name}`")
        out = scalars.convert(col, found.type, target) if numbers or found.type == target else F.lit(None).cast(target.spark())
        return out, target, f"cast({found.name} as {target.name})"
    if isinstance(sel, n.CallSelector):
        return call(sel, table, terms, catalog, available)
    raise InvalidRequest("Bare term expressions in SELECT clause are not supported")


def call(sel: n.CallSelector, table: Table, terms: Terms, catalog: Catalog, available: list[str]) -> tuple[Column, CqlType, str]:
    name = sel.name.lower()
    if name in ("ttl", "writetime"):
        return cell_data(name, sel, table, terms, available)
    if name == "token":
        given = [a.name for a in sel.args if isinstance(a, n.ColumnSelector)]
        if given != [c.name for c in table.partition] or len(given) != len(sel.args):
            raise InvalidRequest("The token() function must contain all the partition key columns, in order")
        return token_of(table, available), CqlType("bigint"), f"system.token({', '.join(given)})"
    if name not in scalars.RETURNS and not conversion(name):
        raise InvalidRequest(f"Undefined column name Unknown function {sel.name}")
    if len(sel.args) == 1 and not isinstance(sel.args[0], n.TermSelector):
        inner = sel.args[0]
        if isinstance(inner, n.CallSelector) and not (conversion(name) and (conversion(inner.name.lower()) or inner.name.lower() in ("ttl", "writetime"))):
            raise InvalidRequest("Undefined column name Nested function/cast arguments are not yet supported")
        if isinstance(inner, n.CastSelector):
            raise InvalidRequest("Undefined column name Nested function/cast arguments are not yet supported")
        col, kind, label = selector(inner, table, terms, catalog, available)
        out, result = scalars.over_column(name, col, kind)
        return out, result, f"{name}({label})"
    if any(not isinstance(a, n.TermSelector) for a in sel.args):
        return F.lit(None).cast(CqlType(scalars.RETURNS.get(name, "blob")).spark()), CqlType(scalars.RETURNS.get(name, "blob")), f"{name}(...)"
    out, result = scalars.over_constants(name, [terms.value(a.term) for a in sel.args], terms)
    return out, result, f"{name}({', '.join('?' for _ in sel.args)})"


def cell_data(name: str, sel: n.CallSelector, table: Table, terms: Terms, available: list[str]) -> tuple[Column, CqlType, str]:
    if len(sel.args) != 1 or not isinstance(sel.args[0], n.ColumnSelector):
        raise InvalidRequest(f"{name} requires a single column argument")
    found = table.column(sel.args[0].name)
    if found.kind in ("partition", "clustering"):
        raise InvalidRequest(f"Cannot use selection function {name} on PRIMARY KEY part {found.name}")
    if found.type.name in ("list", "set", "map"):
        raise InvalidRequest(f"Cannot use selection function {name} on collection column {found.name}")
    label = f"{name}({found.name})"
    stored = (WRITTEN if name == "writetime" else EXPIRES) + found.name
    if stored not in available:  # mounted tables have no cell data
        return F.lit(None).cast("bigint" if name == "writetime" else "int"), CqlType("bigint" if name == "writetime" else "int"), label
    if name == "writetime":
        return F.col(f"`{stored}`"), CqlType("bigint"), label
    left = F.greatest(F.floor((F.col(f"`{stored}`") - terms.now_ms) / 1000), F.lit(0)).cast("int")
    return F.when(F.col(f"`{stored}`").isNotNull(), left), CqlType("int"), label


def merged(rows: DataFrame, statics: DataFrame | None, table: Table, now_ms: int, expire_cells: bool = False) -> DataFrame:
    """Live rows with their partition's static columns; a partition with static columns alone gives one row."""
    if ROW_EXPIRES in rows.columns:
        rows = rows.filter(F.col(ROW_EXPIRES).isNull() | (F.col(ROW_EXPIRES) > now_ms))
    if statics is not None:
        # the token is a function of the key, so joining by it too changes nothing
        rows = rows.join(statics, [*(c.name for c in table.partition), TOKEN], "full_outer")
    if expire_cells:
        live = {c.name: F.when(F.col(f"`{EXPIRES}{c.name}`").isNull() | (F.col(f"`{EXPIRES}{c.name}`") > now_ms), F.col(f"`{c.name}`")) for c in (*table.regulars, *table.statics)}
        rows = rows.withColumns(live)
    return rows


__all__ = ["SelectPlan", "Source", "by_token", "merged", "plan", "select"]
