"""Time-based UUIDs: making them, reading their time, ordering them."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100-nanosecond steps from the UUID calendar's start to 1970.
EPOCH_STEPS = 0x01B21DD213814000
_STEPS_PER_MS = 10_000


def from_parts(steps: int, clock: int, node: int) -> uuid.UUID:
    return uuid.UUID(fields=(steps & 0xFFFFFFFF, steps >> 32 & 0xFFFF, steps >> 48 & 0x0FFF | 0x1000, clock >> 8 & 0x3F | 0x80, clock & 0xFF, node))


def least(ms: int) -> uuid.UUID:
    """The smallest time-based UUID of a millisecond."""
    return from_parts(ms * _STEPS_PER_MS + EPOCH_STEPS, 0, 0)


def greatest(ms: int) -> uuid.UUID:
    return from_parts(ms * _STEPS_PER_MS + EPOCH_STEPS + _STEPS_PER_MS - 1, 0x3FFF, 0xFFFFFFFFFFFF)


def millis(value: uuid.UUID) -> int | None:
    """The time of a version 1 UUID."""
    if value.version != 1:
        return None
    return (value.time - EPOCH_STEPS) // _STEPS_PER_MS


class Generator:
    """Version 1 UUIDs, each later than the last."""

    def __init__(self) -> None:
        self.node, self.clock, self.last, self.lock = uuid.getnode(), uuid.uuid4().int & 0x3FFF, 0, threading.Lock()

    def next(self, ms: int) -> uuid.UUID:
        with self.lock:
            self.last = max(ms * _STEPS_PER_MS + EPOCH_STEPS, self.last + 1)
            return from_parts(self.last, self.clock, self.node)


def _hex_long(text: Column) -> Column:
    return F.conv(text, 16, 10).cast("long")


def steps_column(text: Column) -> Column:
    """The 60-bit time of a UUID in canonical text."""
    return _hex_long(F.concat(F.substring(text, 16, 3), F.substring(text, 10, 4), F.substring(text, 1, 8)))


def _div(steps: Column, by: int) -> Column:
    """Whole quotient of a non-negative count, without going through doubles."""
    return F.floor((steps - F.pmod(steps, F.lit(by))).cast("decimal(20,0)") / by).cast("long")


def millis_column(text: Column) -> Column:
    return F.when(F.substring(text, 15, 1) == "1", _div(steps_column(text) - EPOCH_STEPS, _STEPS_PER_MS))


def bound_column(ms: Column, tail: str, more: int) -> Column:
    """The smallest or largest UUID of a millisecond, as text."""
    digits = F.lower(F.lpad(F.hex(ms * _STEPS_PER_MS + EPOCH_STEPS + more), 15, "0"))
    return F.concat(F.substring(digits, 8, 8), F.lit("-"), F.substring(digits, 4, 4), F.lit("-1"), F.substring(digits, 1, 3), F.lit(tail))


def timeuuid_key(text: Column) -> Column:
    """Sorts as time-based UUIDs do: by time, then by the unsigned bytes after it."""
    return F.struct(steps_column(text).alias("time"), F.substring(text, 20, 17).alias("tail"))


def uuid_key(text: Column) -> Column:
    """Sorts as UUIDs do: by version, version 1 by time, then by bytes."""
    version = F.substring(text, 15, 1)
    return F.struct(version.alias("version"), F.when(version == "1", steps_column(text)).alias("time"), text.alias("text"))
