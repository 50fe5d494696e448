"""Column types, their Spark types, and which constants fit them."""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
import uuid
from collections import namedtuple
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import types as T

from colonnade.errors import InvalidRequest

Duration = namedtuple("Duration", "months days nanos")

#: Names of the basic types and the Spark types that hold them.
BASIC: dict[str, T.DataType] = {
    "ascii": T.StringType(),
    "text": T.StringType(),
    "varchar": T.StringType(),
    "tinyint": T.ByteType(),
    "smallint": T.ShortType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "counter": T.LongType(),
    "varint": T.DecimalType(38, 0),
    "decimal": T.DecimalType(38, 18),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "time": T.LongType(),
    "timestamp": T.TimestampType(),
    "duration": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("nanos", T.LongType())]),
    "uuid": T.StringType(),
    "timeuuid": T.StringType(),
    "inet": T.BinaryType(),
    "blob": T.BinaryType(),
}
TEXT = frozenset({"ascii", "text", "varchar"})
#: Integer constants fit these; the width that each is cut to.
INTEGER_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "date": 32, "bigint": 64, "timestamp": 64, "counter": 64, "time": 64}
#: Types whose values have a partition token.
TOKEN_TYPES = frozenset({"tinyint", "smallint", "int", "bigint", "float", "double", "boolean", "uuid", "timeuuid", "blob", "date", "timestamp", "time"}) | TEXT
COLLECTIONS = frozenset({"list", "set", "map"})
_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


class Unset:
    """The marker of a bound value that leaves its column unchanged."""

    def __repr__(self) -> str:
        return "UNSET"


UNSET = Unset()


@dataclass(frozen=True)
class CqlType:
    name: str
    args: tuple[CqlType, ...] = ()
    fields: tuple[tuple[str, CqlType], ...] = ()
    frozen: bool = False
    zoneless: bool = False  # a mounted timestamp that Spark stores without time zone; it is read as UTC

    @property
    def basic(self) -> bool:
        return self.name in BASIC

    @property
    def collection(self) -> bool:
        """A list, set or map whose parts can be changed one by one."""
        return self.name in COLLECTIONS and not self.frozen

    def __str__(self) -> str:
        inner = f"{self.name}<{', '.join(map(str, self.args))}>" if self.args else self.name
        return f"frozen<{inner}>" if self.frozen else inner

    def spark(self) -> T.DataType:
        if self.zoneless:
            return T.TimestampNTZType()
        if self.basic:
            return BASIC[self.name]
        if self.name in ("list", "set"):
            return T.ArrayType(self.args[0].spark())
        if self.name == "map":
            return T.MapType(self.args[0].spark(), self.args[1].spark())
        if self.name == "tuple":
            return T.StructType([T.StructField(f"_{i + 1}", a.spark()) for i, a in enumerate(self.args)])
        return T.StructType([T.StructField(k, t.spark()) for k, t in self.fields])

    def mentions(self, name: str) -> bool:
        return self.name == name or any(a.mentions(name) for a in self.args) or any(t.mentions(name) for _, t in self.fields)


class Misfit(InvalidRequest):
    """A constant that the column's type doesn't take."""


# evaluated collection terms, before a type is known
ListValue = namedtuple("ListValue", "items")
SetValue = namedtuple("SetValue", "items")
MapValue = namedtuple("MapValue", "pairs")
UdtValue = namedtuple("UdtValue", "fields")
TupleValue = namedtuple("TupleValue", "items")


def parse_duration(text: str) -> Duration:
    months = days = nanos = 0
    for amount, unit in re.findall(r"(\d+)(mo|ms|us|ns|[yYwWdDhHmMsS])", text):
        k, u = int(amount), unit.lower()
        months += {"y": 12, "mo": 1}.get(u, 0) * k
        days += {"w": 7, "d": 1}.get(u, 0) * k
        nanos += {"h": 3600 * 10**9, "m": 60 * 10**9, "s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}.get(u, 0) * k
    return Duration(months, days, nanos)


def wrap(value: int, bits: int) -> int:
    """Two's complement of the low bits."""
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


def from_millis(ms: int) -> dt.datetime:
    return _EPOCH + dt.timedelta(milliseconds=ms)


def to_millis(at: dt.datetime) -> int:
    aware = at.replace(tzinfo=dt.timezone.utc) if at.tzinfo is None else at
    return (aware - _EPOCH) // dt.timedelta(milliseconds=1)


def _basic(value: object, name: str) -> object:
    if isinstance(value, bool):
        if name == "boolean":
            return value
    elif isinstance(value, int):
        if name in INTEGER_BITS:
            cut = wrap(value, INTEGER_BITS[name])
            if name == "date":
                return dt.date(1970, 1, 1) + dt.timedelta(days=cut)
            return from_millis(cut) if name == "timestamp" else cut
    elif isinstance(value, float):
        if name in ("float", "double"):
            return value
    elif isinstance(value, uuid.UUID):
        if name in ("uuid", "timeuuid"):
            return str(value)
    elif isinstance(value, str):
        if name in TEXT:
            return value
    elif isinstance(value, Duration):
        if name == "duration":
            return tuple(value)
    elif isinstance(value, (bytes, bytearray)):
        if name == "blob":
            return bytes(value)
        if name == "inet" and len(value) in (4, 16):
            return bytes(value)
    elif isinstance(value, dt.datetime):
        if name == "timestamp":
            return from_millis(to_millis(value))
    elif isinstance(value, dt.date):
        if name == "date":
            return value
    elif isinstance(value, (ipaddress.IPv4Address, ipaddress.IPv6Address)):
        if name == "inet":
            return value.packed
    elif isinstance(value, Decimal) and name in ("decimal", "varint"):
        return value
    raise Misfit("Incompatible literal for column type")


def bound(value: object, kind: CqlType) -> object:
    """A value given for a bind marker, under the type of what it is bound to: numbers and text take their column's form."""
    if kind.basic and not isinstance(value, bool):
        if kind.name in ("float", "double") and isinstance(value, int):
            return float(value)
        if kind.name in ("decimal", "varint") and isinstance(value, (int, float)):
            return Decimal(str(value))
        if kind.name in ("uuid", "timeuuid") and isinstance(value, str):
            return uuid.UUID(value)
        if kind.name == "inet" and isinstance(value, str):
            return ipaddress.ip_address(value)
    return value


def resolve(value: object, kind: CqlType) -> object:
    """An evaluated constant as the column stores it; raises Misfit."""
    if value is None or value is UNSET:
        return value
    if kind.basic:
        return _basic(value, kind.name)
    if kind.name == "list" and isinstance(value, (ListValue, list)):
        return [resolve(x, kind.args[0]) for x in (value.items if isinstance(value, ListValue) else value)]
    if kind.name == "set" and isinstance(value, (SetValue, set, frozenset)):
        return sorted_set([resolve(x, kind.args[0]) for x in (value.items if isinstance(value, SetValue) else value)], kind.args[0])
    if kind.name == "map" and isinstance(value, SetValue) and not value.items:
        return {}
    if kind.name == "map" and isinstance(value, (MapValue, dict)):
        pairs = value.pairs if isinstance(value, MapValue) else value.items()
        return {hashable(resolve(k, kind.args[0])): resolve(v, kind.args[1]) for k, v in pairs}
    if kind.name == "tuple" and isinstance(value, (TupleValue, tuple)):
        items = value.items if isinstance(value, TupleValue) else value
        if len(items) > len(kind.args):
            raise Misfit("Incompatible literal for column type")
        done = [resolve(x, a) for x, a in zip(items, kind.args)]  # noqa: B905  a short literal is padded
        return tuple(done + [None] * (len(kind.args) - len(done)))
    if kind.fields and isinstance(value, (UdtValue, dict)):
        given = dict(value.fields) if isinstance(value, UdtValue) else value
        if set(given) - {k for k, _ in kind.fields}:
            raise Misfit("Incompatible literal for column type")
        return tuple(resolve(given.get(k), t) for k, t in kind.fields)
    raise Misfit("Incompatible literal for column type")


def hashable(value: object) -> object:
    return tuple(value) if isinstance(value, list) else value


def sorted_set(items: list, kind: CqlType) -> list:
    """Distinct members in canonical order."""
    out: list = []
    for x in items:
        if x not in out:
            out.append(x)
    try:
        return sorted(out)
    except TypeError:
        return out
