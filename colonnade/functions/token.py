"""Partition tokens: Murmur3 (x64, 128 bits, first half) whose tail bytes are sign-extended."""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from colonnade.plans.types import TEXT, CqlType, to_millis

_ALL = (1 << 64) - 1
#: Fixed values of the hash.
_C1, _C2 = 0x87C37B91114253D5, 0x4CF5AD432745937F
_F1, _F2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53
_ADD1, _ADD2 = 0x52DCE729, 0x38495AB5
LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def _rotate(x: int, r: int) -> int:
    return (x << r | x >> (64 - r)) & _ALL


def _finish(x: int) -> int:
    x = (x ^ x >> 33) * _F1 & _ALL
    x = (x ^ x >> 33) * _F2 & _ALL
    return x ^ x >> 33


def _scramble(k: int, first: int, turn: int, second: int) -> int:
    return _rotate(k * first & _ALL, turn) * second & _ALL


def murmur3(data: bytes) -> int:
    """The token of a serialised partition key; nothing has token 0."""
    if not data:
        return 0
    h1 = h2 = 0
    whole = len(data) // 16 * 16
    for a, b in struct.iter_unpack("<QQ", data[:whole]):
        h1 = ((_rotate(h1 ^ _scramble(a, _C1, 31, _C2), 27) + h2) * 5 + _ADD1) & _ALL
        h2 = ((_rotate(h2 ^ _scramble(b, _C2, 33, _C1), 31) + h1) * 5 + _ADD2) & _ALL
    k1 = k2 = 0
    for i, byte in enumerate(data[whole:]):
        wide = byte | (_ALL ^ 0xFF) if byte >> 7 else byte
        if i < 8:
            k1 ^= wide << 8 * i & _ALL
        else:
            k2 ^= wide << 8 * (i - 8) & _ALL
    h2 ^= _scramble(k2, _C2, 33, _C1)
    h1 ^= _scramble(k1, _C1, 31, _C2)
    h1 ^= len(data)
    h2 ^= len(data)
    h1 = (h1 + h2) & _ALL
    h2 = (h2 + h1) & _ALL
    out = (_finish(h1) + _finish(h2)) & _ALL
    signed = out - (1 << 64) if out >> 63 else out
    return GREATEST if signed == LEAST else signed


def wire(value: object, kind: CqlType) -> bytes:
    """The bytes of one key column, as the protocol has them."""
    name = kind.name
    if name in TEXT:
        return str(value).encode()
    if name == "blob":
        return bytes(value)
    if name in ("uuid", "timeuuid"):
        return uuid.UUID(str(value)).bytes
    if name == "boolean":
        return b"\x01" if value else b"\x00"
    if name in ("float", "double"):
        return struct.pack(">f" if name == "float" else ">d", value)
    if name == "date" and isinstance(value, dt.date):
        value = (value - dt.date(1970, 1, 1)).days
    if name == "timestamp" and isinstance(value, dt.datetime):
        value = to_millis(value)
    return int(value).to_bytes({"tinyint": 1, "smallint": 2, "int": 4, "date": 4}.get(name, 8), "big", signed=True)


def key_bytes(values: list, kinds: list[CqlType]) -> bytes:
    parts = [wire(v, k) for v, k in zip(values, kinds, strict=True)]
    if len(parts) == 1:
        return parts[0]
    return b"".join(len(p).to_bytes(2, "big") + p + b"\x00" for p in parts)


def token(values: list, kinds: list[CqlType]) -> int:
    return murmur3(key_bytes(values, kinds))


_WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "date": 4, "bigint": 8, "timestamp": 8, "time": 8}


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rotated(x: Column, r: int) -> Column:
    return F.shiftleft(x, r).bitwiseOR(F.shiftrightunsigned(x, 64 - r))


def _finished(x: Column) -> Column:
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 33)) * _signed(_F1)
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 33)) * _signed(_F2)
    return x.bitwiseXOR(F.shiftrightunsigned(x, 33))


def _scrambled(k: Column, first: int, turn: int, second: int) -> Column:
    return _rotated(k * _signed(first), turn) * _signed(second)


def _ended(h1: Column, h2: Column, length: Column) -> Column:
    h1, h2 = h1.bitwiseXOR(length), h2.bitwiseXOR(length)
    return _let(h1 + h2, lambda h1: _let(_finished(h1) + _finished(h2 + h1), lambda out: F.when(out == F.lit(LEAST), F.lit(GREATEST)).otherwise(out)))


def _of_integer(value: Column, width: int) -> Column:
    """The token of an integer of up to 8 bytes; needs wrapping arithmetic (ANSI mode off)."""

    def byte(i: int) -> Column:
        return F.shiftleft(F.shiftright(value, 8 * (width - 1 - i)).cast("tinyint").cast("long"), 8 * i)

    k1 = reduce(lambda a, i: a.bitwiseXOR(byte(i)), range(1, width), byte(0))
    return _ended(_scrambled(k1, _C1, 31, _C2), F.lit(0).cast("long"), F.lit(width).cast("long"))


def _of_bytes(data: Column) -> Column:
    """The token of serialised keys of any length, in the JVM; needs wrapping arithmetic."""

    def word(at: Column) -> Column:
        """Eight bytes from a place on (from 1), the first the lowest."""
        x = F.conv(F.hex(F.substring(data, at, F.lit(8))), 16, -10).cast("long")
        for mask, r in ((0x00FF00FF00FF00FF, 8), (0x0000FFFF0000FFFF, 16)):
            x = F.shiftleft(x.bitwiseAND(F.lit(mask)), r).bitwiseOR(F.shiftrightunsigned(x, r).bitwiseAND(F.lit(mask)))
        return F.shiftleft(x, 32).bitwiseOR(F.shiftrightunsigned(x, 32))

    def both(h1: Column, h2: Column) -> Column:
        return F.struct(h1.alias("h1"), h2.alias("h2"))

    def block(h: Column, i: Column) -> Column:
        a, b = _scrambled(word(i * 16 + 1), _C1, 31, _C2), _scrambled(word(i * 16 + 9), _C2, 33, _C1)
        first = (_rotated(h["h1"].bitwiseXOR(a), 27) + h["h2"]) * 5 + _ADD1
        return _let(first, lambda h1: both(h1, (_rotated(h["h2"].bitwiseXOR(b), 31) + h1) * 5 + _ADD2))

    def tail(from_byte: Column, bytes_: Column) -> Column:
        """Up to eight bytes as signed ones into a word."""

        def add(x: Column, i: Column) -> Column:
            byte = F.conv(F.hex(F.substring(data, from_byte + i, F.lit(1))), 16, 10).cast("int").cast("tinyint").cast("long")
            return x.bitwiseXOR(F.call_function("shiftleft", byte, i * 8))

        steps = F.when(bytes_ > 0, F.sequence(F.lit(0), bytes_ - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, F.lit(0).cast("long"), add)

    def whole(n: Column) -> Column:
        blocks, rest = F.floor(n / 16).cast("int"), n % 16
        steps = F.when(blocks > 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array().cast("array<int>"))
        zero = F.lit(0).cast("long")
        k1, k2 = tail(n - rest + 1, F.least(rest, F.lit(8))), tail(n - rest + 9, rest - 8)
        end = lambda h: _ended(h["h1"].bitwiseXOR(_scrambled(k1, _C1, 31, _C2)), h["h2"].bitwiseXOR(_scrambled(k2, _C2, 33, _C1)), n.cast("long"))
        return F.when(n == 0, zero).otherwise(_let(F.aggregate(steps, both(zero, zero), block), end))

    return F.when(data.isNotNull(), _let(F.octet_length(data), whole))


def _wire_column(col: Column, kind: CqlType) -> Column | None:
    """The bytes of a key column, as wire() gives them; None for kinds that the JVM's functions don't serialise."""
    name = kind.name
    if name in TEXT or name == "blob":
        return col.cast("binary")
    if name in ("uuid", "timeuuid"):
        return F.unhex(F.regexp_replace(col, "-", ""))
    if name == "boolean":
        return F.unhex(F.when(col, F.lit("01")).when(~col, F.lit("00")))
    if name in _WIDTHS:
        digits = 2 * _WIDTHS[name]
        return F.unhex(F.substring(F.lpad(F.hex(_as_long(col, kind)), 16, "0"), 17 - digits, digits))
    return None


def _as_long(col: Column, kind: CqlType) -> Column:
    col = F.unix_date(col) if kind.name == "date" else F.unix_millis(col.cast("timestamp")) if kind.name == "timestamp" else col
    return col.cast("long")


def token_column(columns: list[Column], kinds: list[CqlType]) -> Column:
    """The token of a table's partition key columns; null where a part is. Floating-point and like kinds alone go through Python."""
    if len(kinds) == 1 and kinds[0].name in _WIDTHS:
        return _of_integer(_as_long(columns[0], kinds[0]), _WIDTHS[kinds[0].name])
    parts = [_wire_column(c, k) for c, k in zip(columns, kinds, strict=True)]
    if None not in [p if p is None else True for p in parts]:
        if len(parts) == 1:
            return _of_bytes(parts[0])
        framed = [x for p in parts for x in (F.unhex(F.lpad(F.hex(F.octet_length(p)), 4, "0")), p, F.lit(b"\x00"))]
        return _let(F.concat(*framed), _of_bytes)

    @F.pandas_udf("long")
    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            rows = frame.itertuples(index=False, name=None)
            yield pd.Series([token(list(row), kinds) if whole else None for *row, whole in rows], dtype="Int64")

    whole = reduce(lambda a, c: a & c.isNotNull(), columns[1:], columns[0].isNotNull())
    shown = [_as_long(c, k) if k.name in _WIDTHS else c for c, k in zip(columns, kinds, strict=True)]
    # a null would turn a batch's integers into floating-point numbers
    shown = [F.coalesce(c, F.lit(0)) if k.name in _WIDTHS else F.coalesce(c, F.lit(0.0)) if k.name in ("float", "double") else c for c, k in zip(shown, kinds, strict=True)]
    return compute(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(shown)), whole.alias("whole")))
