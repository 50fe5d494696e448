"""Scalar functions of SELECT lists, as Columns."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.functions import timeuuid
from colonnade.plans.terms import Terms, conversion
from colonnade.plans.types import INTEGER_BITS, TEXT, CqlType, from_millis

#: Names in SELECT lists, and the types they give.
RETURNS = {
    "uuid": "uuid",
    "now": "timeuuid",
    "currenttimeuuid": "timeuuid",
    "mintimeuuid": "timeuuid",
    "maxtimeuuid": "timeuuid",
    "currenttimestamp": "timestamp",
    "totimestamp": "timestamp",
    "dateof": "timestamp",
    "unixtimestampof": "bigint",
    "tounixtimestamp": "bigint",
    "currentdate": "date",
    "todate": "date",
    "currenttime": "time",
    "textasblob": "blob",
    "intasblob": "blob",
    "bigintasblob": "blob",
    "blobastext": "text",
    "blobasint": "int",
    "blobasbigint": "bigint",
}


def constant(value: object, kind: str) -> Column:
    """An evaluated function result under the function's return type."""
    target = CqlType(kind).spark()
    if isinstance(value, uuid.UUID):
        value = str(value)
    elif kind == "timestamp" and isinstance(value, int):
        value = from_millis(value)
    elif kind == "date" and isinstance(value, int):
        value = dt.date(1970, 1, 1) + dt.timedelta(days=value)
    return F.lit(value).cast(target)


def _raw(col: Column, kind: CqlType) -> Column:
    """An integer-family value as a long."""
    if kind.name == "timestamp":
        return F.unix_millis(col.cast("timestamp"))
    return F.unix_date(col).cast("long") if kind.name == "date" else col.cast("long")


def _cooked(value: Column, kind: str) -> Column:
    if kind == "timestamp":
        return F.timestamp_millis(value)
    return F.date_from_unix_date(value.cast("int")) if kind == "date" else value.cast(CqlType(kind).spark())


def convert(col: Column, source: CqlType, target: CqlType) -> Column:
    """Integer family to and from big-endian blobs of its width, text to and from UTF-8; anything else is NULL."""
    if source.name == target.name:
        return col
    if target.name == "blob" and source.name in INTEGER_BITS:
        digits = INTEGER_BITS[source.name] // 4
        return F.unhex(F.substring(F.lpad(F.hex(_raw(col, source)), 16, "0"), 17 - digits, digits))
    if source.name == "blob" and target.name in INTEGER_BITS:
        size = INTEGER_BITS[target.name] // 8
        raw = F.conv(F.hex(col), 16, -10).cast("long") if size == 8 else F.conv(F.hex(col), 16, 10).cast("long")
        if size < 8:
            raw = F.when(raw >= 1 << (8 * size - 1), raw - (1 << 8 * size)).otherwise(raw)
        return F.when(F.octet_length(col) == size, _cooked(raw, target.name))
    if target.name == "blob" and source.name in TEXT:
        return F.encode(col, "UTF-8")
    if source.name == "blob" and target.name in TEXT:
        return F.decode(col, "UTF-8")
    return F.lit(None).cast(target.spark())


def _millis(col: Column, kind: CqlType) -> Column | None:
    if kind.name == "timestamp":
        return F.unix_millis(col.cast("timestamp"))
    if kind.name == "timeuuid":
        return timeuuid.millis_column(col)
    return col.cast("long") if kind.name in ("bigint", "int", "smallint", "tinyint", "counter", "time") else None


def over_column(name: str, col: Column, kind: CqlType) -> tuple[Column, CqlType]:
    """A function of one column; NULL where the column's type doesn't suit it."""
    result = CqlType(RETURNS[name]) if name in RETURNS else CqlType("blob")
    none = F.lit(None).cast(result.spark())
    if kinds := conversion(name):
        source, target = (CqlType(k) for k in kinds)
        suits = kind.name == source.name or {kind.name, source.name} <= TEXT
        return (convert(col, source, target) if suits else F.lit(None).cast(target.spark())), target
    ms = _millis(col, kind)
    if ms is None or name in ("dateof", "unixtimestampof") and kind.name != "timeuuid":
        return none, result
    if name == "todate":
        days = F.when(ms >= 0, F.floor(ms / 86_400_000)).otherwise(F.ceil(ms / 86_400_000))
        return F.date_from_unix_date(days.cast("int")), result
    if name in ("totimestamp", "dateof"):
        return F.timestamp_millis(ms), result
    if name in ("tounixtimestamp", "unixtimestampof"):
        return ms, result
    if name == "mintimeuuid":
        return timeuuid.bound_column(ms, "-8000-000000000000", 0), result
    if name == "maxtimeuuid":
        return timeuuid.bound_column(ms, "-bfff-ffffffffffff", 9_999), result
    return none, result


def over_constants(name: str, args: list, terms: Terms) -> tuple[Column, CqlType]:
    kind = RETURNS.get(name) or (conversion(name) or ("", "blob"))[1]
    return constant(terms.call(name, args), kind), CqlType(kind)
