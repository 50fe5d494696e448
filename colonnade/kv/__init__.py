"""Key-value commands over a snapshot table."""

from colonnade.kv.engine import KeyValue
from colonnade.kv.wire import encode, parse

__all__ = ["KeyValue", "encode", "parse"]
