"""The commands. Writes are buffered by key and written as runs in scan order, which reads merge and which become one in time."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.kv.wire import CommandError, Simple, encode, parse
from colonnade.sources.store import Files, qualified, scratch_path

SCHEMA = "k string, v string, place long"
#: Keys whose changes are buffered, and runs of changes that reads merge, before they are written as one.
MAX_BUFFERED, MAX_RUNS = 10_000, 8
OK = Simple("OK")


def glob(pattern: str) -> str:
    """A regular expression for a pattern in which only * and ? are special."""
    return "(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def cursor(key: Column) -> Column:
    """A key's place in the scan order."""
    return F.xxhash64(key)


def place_of(key: str) -> int:
    """cursor() of one key, on the driver."""
    found = xxhash.xxh64_intdigest(key.encode(), 42)
    return found - (1 << 64) if found >> 63 else found


class KeyValue:
    """String keys and values. path: where snapshots are kept; without it a folder of its own."""

    def __init__(self, spark: SparkSession, path: str | None = None, frame: DataFrame | None = None):
        self.spark, self.files = spark, Files(spark)
        root = path or scratch_path(spark)
        self.root = qualified(spark, root)
        self.buffer: dict[str, str | None] = {}
        self.mounted = frame
        text = self.files.read(f"{self.root}/CURRENT")
        held = json.loads(text) if text else {"runs": [], "stale": []}
        self.runs: list[str] = held["runs"]
        self.stale: list[str] = held["stale"]

    # state ------------------------------------------------------------------------------------------------

    def _placed(self) -> DataFrame:
        """k, v, place without what is buffered: of each key what the newest run holds; null values are deletions."""
        if not self.runs:
            held = self.mounted.select("k", "v") if self.mounted is not None else self.spark.createDataFrame([], "k string, v string")
            return held.withColumn("place", cursor(F.col("k")))
        runs = [self.spark.read.schema(SCHEMA).parquet(f"{self.root}/{r}") for r in self.runs]
        if len(runs) == 1:
            return runs[0].filter("v is not null")
        both = reduce(DataFrame.unionByName, (r.withColumn("age", F.lit(i)) for i, r in enumerate(runs)))
        # place is a function of k; grouping by it too lets filters on it reach the files
        return both.groupBy("k", "place").agg(F.max_by("v", "age").alias("v")).filter("v is not null").select("k", "v", "place")

    def snapshot(self) -> DataFrame:
        """Keys and values, without what is buffered."""
        return self._placed().select("k", "v")

    def frame(self) -> DataFrame:
        """Keys and values as they are now."""
        if not self.buffer:
            return self.snapshot()
        changes = self.spark.createDataFrame(list(self.buffer.items()), "k string, new string")
        kept = self.snapshot().join(changes.select("k"), "k", "left_anti")
        return kept.unionByName(changes.filter("new is not null").select("k", F.col("new").alias("v")))

    def flush(self) -> None:
        """Write the buffer as a new run; what a mount holds is written with the first one, and many runs become one."""
        if not self.buffer:
            return
        if len(self.runs) >= MAX_RUNS or self.mounted is not None and not self.runs:
            self._keep(self.frame())
        else:
            changes = self.spark.createDataFrame(list(self.buffer.items()), "k string, v string")
            self._point([*self.runs, self._write(changes.coalesce(1))], [])
            self.buffer = {}

    def _keep(self, frame: DataFrame) -> None:
        """The frame as the only run, its files in ranges of the scan order, so that a key is looked for in one of them."""
        placed = frame.withColumn("place", cursor(F.col("k")))
        self._point([self._write(placed.repartitionByRange("place").select("k", "v"))], self.runs)
        self.buffer = {}

    def _write(self, frame: DataFrame) -> str:
        name = uuid.uuid4().hex
        frame.withColumn("place", cursor(F.col("k"))).sortWithinPartitions("place").write.parquet(f"{self.root}/{name}")
        return name

    def _point(self, runs: list[str], replaced: list[str]) -> None:
        """Move the pointer. Replaced runs stay until the next are, so that frames handed out before can still be read."""
        gone = self.stale if replaced else []
        self.runs, self.stale = runs, replaced or self.stale
        self.files.replace(f"{self.root}/CURRENT", json.dumps({"runs": self.runs, "stale": self.stale}))
        for run in gone:
            self.files.delete(f"{self.root}/{run}")

    def _set(self, items: dict[str, str | None]) -> None:
        self.buffer |= items
        if len(self.buffer) > MAX_BUFFERED:
            self.flush()

    def _at(self, keys: list[str]) -> DataFrame:
        """What the runs hold at some keys; files and row groups elsewhere in the scan order are skipped."""
        places = sorted({place_of(k) for k in keys})
        return self._placed().filter(F.col("place").isin(places) & F.col("k").isin(sorted(set(keys)))).select("k", "v")

    def _look_up(self, keys: list[str]) -> dict[str, str]:
        found = {k: v for k, v in ((k, self.buffer.get(k)) for k in keys) if v is not None}
        rest = sorted({k for k in keys if k not in self.buffer})
        if rest:
            found |= {r.k: r.v for r in self._at(rest).collect()}
        return found

    # DataFrame forms --------------------------------------------------------------------------------------

    def mget_frame(self, keys: list[str]) -> DataFrame:
        """place, k, v in the order of the request; v is null for what isn't there."""
        wanted = self.spark.createDataFrame(list(enumerate(keys)), "place long, k string")
        held = self.frame()
        if len(keys) <= MAX_BUFFERED:
            changed = [(k, self.buffer[k]) for k in sorted(set(keys)) if self.buffer.get(k) is not None]
            rest = [k for k in keys if k not in self.buffer]
            held = self._at(rest).unionByName(self.spark.createDataFrame(changed, "k string, v string"))
        return wanted.join(held, "k", "left").select("place", "k", "v").orderBy("place")

    def keys_frame(self, pattern: str) -> DataFrame:
        return self.frame().filter(F.col("k").rlike(glob(pattern))).select("k")

    def scan_frame(self, start: int, pattern: str = "*", count: int = 10) -> DataFrame:
        """The next `count` keys from a cursor on, those that match: k and its place."""
        return self._page(start, count).filter(F.col("k").rlike(glob(pattern)))

    def _page(self, start: int, count: int) -> DataFrame:
        placed = self.frame().select("k", cursor(F.col("k")).alias("place"))
        signed = start - (1 << 64) if start >> 63 else start
        rank = lambda c: (c < 0).cast("int")  # noqa: E731  unsigned order
        place = F.col("place")
        later = (rank(place) > int(signed < 0)) | ((rank(place) == int(signed < 0)) & (place >= signed))
        return placed.filter(later).orderBy(rank(place), place, "k").limit(count)

    # commands ---------------------------------------------------------------------------------------------

    def execute(self, *words: str) -> object:
        """The reply to one command: text, a number, a list, or None; CommandError is raised."""
        if not words:
            raise CommandError("ERR empty command")
        name, args = words[0].upper(), list(words[1:])
        method = getattr(self, f"_do_{name.lower()}", None)
        if method is None:
            raise CommandError(f"ERR unknown command '{words[0]}'")
        return method(args)

    def line(self, text: str) -> object:
        return self.execute(*text.split())

    def serve(self, data: bytes) -> tuple[bytes, bytes]:
        """Replies to the whole commands in a buffer, and what is left of it."""
        commands, rest = parse(data)
        out = []
        for words in commands:
            try:
                out.append(encode(self.execute(*words)))
            except CommandError as e:
                out.append(encode(e))
        return b"".join(out), rest

    @staticmethod
    def _need(args: list[str], least: int, name: str) -> None:
        if len(args) < least:
            raise CommandError(f"ERR wrong number of arguments for '{name}' command")

    def _do_ping(self, args: list[str]) -> object:
        return args[0] if args else Simple("PONG")

    def _do_quit(self, args: list[str]) -> object:
        return OK

    def _do_get(self, args: list[str]) -> object:
        self._need(args, 1, "get")
        return self._look_up(args[:1]).get(args[0])

    def _do_set(self, args: list[str]) -> object:
        self._need(args, 2, "set")
        key, value, *flags = args
        upper = [f.upper() for f in flags]
        for f in upper:
            if f in ("EX", "PX", "EXAT", "PXAT", "KEEPTTL"):
                raise CommandError("ERR key expiry is not supported")
            if f not in ("NX", "XX"):
                raise CommandError("ERR syntax error")
        if upper:
            there = key in self._look_up([key])
            if "NX" in upper and there or "XX" in upper and not there:
                return None
        self._set({key: value})
        return OK

    def _do_del(self, args: list[str]) -> object:
        self._need(args, 1, "del")
        there = self._look_up(args)
        self._set(dict.fromkeys(there))
        return len(there)

    def _do_exists(self, args: list[str]) -> object:
        self._need(args, 1, "exists")
        there = self._look_up(args)
        return sum(k in there for k in args)

    def _do_mget(self, args: list[str]) -> object:
        self._need(args, 1, "mget")
        there = self._look_up(args)
        return [there.get(k) for k in args]

    def _do_mset(self, args: list[str]) -> object:
        self._need(args, 2, "mset")
        self._set(dict(zip(args[::2], args[1::2])))  # noqa: B905  a key without a value is ignored
        return OK

    def _do_keys(self, args: list[str]) -> object:
        self._need(args, 1, "keys")
        return [r.k for r in self.keys_frame(args[0]).toLocalIterator()]

    def _do_scan(self, args: list[str]) -> object:
        self._need(args, 1, "scan")
        pattern, count, rest = "*", 10, args[1:]
        try:
            start = int(args[0])
            for flag, value in zip(rest[::2], rest[1::2], strict=True):
                if flag.upper() == "MATCH":
                    pattern = value
                elif flag.upper() == "COUNT":
                    count = int(value)
                else:
                    raise ValueError(flag)
        except ValueError:
            raise CommandError("ERR syntax error") from None
        found = self._page(start, max(1, count) + 1).collect()
        page, following = found[: max(1, count)], found[max(1, count) :]
        wanted = re.compile(glob(pattern))
        return [str(following[0].place % (1 << 64)) if following else "0", [r.k for r in page if wanted.match(r.k)]]

    def _do_flushdb(self, args: list[str]) -> object:
        self._keep(self.spark.createDataFrame([], SCHEMA))
        return OK

    _do_flushall = _do_flushdb

    def _do_dbsize(self, args: list[str]) -> object:
        return self.frame().count()

    def _do_type(self, args: list[str]) -> object:
        self._need(args, 1, "type")
        return Simple("string" if self._look_up(args[:1]) else "none")

    def _do_command(self, args: list[str]) -> object:
        return []

    def _do_select(self, args: list[str]) -> object:
        self._need(args, 1, "select")
        if args[0] != "0":
            raise CommandError("ERR DB index is out of range")
        return OK

    def _do_client(self, args: list[str]) -> object:
        self._need(args, 1, "client")
        return None if args[0].upper() == "GETNAME" else OK

    def _do_info(self, args: list[str]) -> object:
        return f"# Server\r\nredis_version:7.0.0\r\n# Keyspace\r\ndb0:keys={self._do_dbsize([])},expires=0,avg_ttl=0\r\n"
