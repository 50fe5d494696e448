"""Snapshots of tables: versioned Parquet folders by shard, and a pointer that a rename moves.

Files are reached through the file systems that Spark knows, so a store can lie wherever executors can read.
"""

from __future__ import annotations

import json
import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.errors import InvalidRequest
from colonnade.functions.token import token
from colonnade.operators.mutate import empty_rows, stored_schema
from colonnade.operators.predicates import TOKEN
from colonnade.plans.catalog import Catalog, Table

#: Shards of a new table, the column that deals rows to them, and the ranges of tokens in which tasks write a shard.
SHARDS, SHARD, RANGES = 8, "_shard", 64
#: Bytes of files that a shard is meant to hold; a table of twice as many a shard is dealt to more.
SHARD_BYTES = 512 << 20


def on_one_machine(spark: SparkSession) -> bool:
    """Whether executors are threads of the driver, so that its own folders are theirs."""
    return spark.sparkContext.master.split("[")[0] == "local"


def scratch_path(spark: SparkSession) -> str:
    """A new folder beside the cluster's checkpoints; in one local process without any, a temporary one. It goes with the application."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not on_one_machine(spark):
        raise InvalidRequest("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}" if base else f"file://{tempfile.mkdtemp(prefix='colonnade-tables-')}"
    shown = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = shown.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(shown)
    fs.deleteOnExit(shown)
    return path


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system; one without any lies in Spark's default one, which on a cluster is shared."""
    shown = spark._jvm.org.apache.hadoop.fs.Path(path)
    return shown.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(shown).toString().rstrip("/")


class Files:
    """The few file operations a store needs, by Hadoop's file system."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        shown = self.jvm.org.apache.hadoop.fs.Path(path)
        return shown.getFileSystem(self.conf), shown

    def read(self, path: str) -> str | None:
        fs, shown = self._at(path)
        if not fs.exists(shown):
            return None
        stream = fs.open(shown)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, path: str, text: str) -> None:
        """Write beside, then rename over: readers see the old text or the new."""
        fs, shown = self._at(path)
        fresh = self.jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf)
        how = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(fresh, shown, how)

    def names(self, path: str) -> list[str]:
        """What lies in a folder; nothing if there is none."""
        fs, shown = self._at(path)
        return [x.getPath().getName() for x in fs.listStatus(shown)] if fs.exists(shown) else []

    def size(self, path: str) -> int:
        fs, shown = self._at(path)
        return fs.getContentSummary(shown).getLength()

    def delete(self, path: str) -> None:
        fs, shown = self._at(path)
        fs.delete(shown, True)


class Store:
    """Tables in shards by token, so that a write renews only the shards its keys are in, and a read of known
    partitions opens only theirs. A table's pointer names the version and size of each shard; as the table grows, it is dealt to
    more shards, so that a small write never renews more than about two SHARD_BYTES for each key.

    What a write replaces stays for one write more, so that results which nothing has evaluated yet can still be read.
    """

    def __init__(self, spark: SparkSession, root: str, shards: int = SHARDS, shard_bytes: int = SHARD_BYTES):
        self.spark, self.files, self.shards, self.shard_bytes = spark, Files(spark), shards, shard_bytes
        self.root = qualified(spark, root)

    # catalog ----------------------------------------------------------------------------------------------

    def load_catalog(self) -> Catalog:
        text = self.files.read(f"{self.root}/catalog.json")
        return Catalog.from_json(text) if text else Catalog()

    def save_catalog(self, catalog: Catalog) -> None:
        self.files.replace(f"{self.root}/catalog.json", catalog.to_json())

    # tables -----------------------------------------------------------------------------------------------

    def _base(self, table: Table) -> str:
        return f"{self.root}/{table.keyspace}/{table.name}"

    def _pointer(self, table: Table) -> dict:
        text = self.files.read(f"{self._base(table)}/CURRENT")
        return json.loads(text) if text else {"shards": self.shards, "rows": {}, "statics": {}, "stale": []}

    def shards_of(self, table: Table, keys: list[tuple]) -> set[int]:
        """The shards that hold partitions."""
        kinds, count = [c.type for c in table.partition], self._pointer(table)["shards"]
        return {token(list(k[: len(kinds)]), kinds) % count for k in keys}

    def shard_column(self, table: Table, of: Column) -> Column:
        return F.pmod(of, F.lit(self._pointer(table)["shards"])).cast("int")

    def read(self, table: Table, shards: set[int] | None = None) -> tuple[DataFrame, DataFrame | None]:
        """Rows, and static cells if the table has such columns, of some shards or all. Columns added since are NULL,
        dropped ones unread."""
        pointer = self._pointer(table)

        def part(name: str, static: bool) -> DataFrame:
            held = {int(k): v for k, v in pointer[name].items()}
            paths = [f"{self._base(table)}/{v}/{name}/{SHARD}={k}" for k, v in sorted(held.items()) if shards is None or k in shards]
            if not paths:
                return empty_rows(self.spark, table, static)
            return self.spark.read.schema(stored_schema(table, static)).parquet(*paths)

        return part("rows", False), part("statics", True) if table.statics else None

    def write(self, table: Table, rows: DataFrame, statics: DataFrame | None, shards: set[int] | None = None) -> None:
        """Renew some shards or all: files sorted by token and clustering key, then the pointer."""
        pointer = self._pointer(table)
        old_stale = pointer["stale"]
        pointer = self._renew(table, pointer, rows, statics, shards)
        total = sum(pointer["bytes"].values())
        if total > 2 * self.shard_bytes * pointer["shards"]:
            kept = pointer["stale"]
            count = 1 << math.ceil(math.log2(total / self.shard_bytes))
            pointer = self._renew(table, {**pointer, "shards": count}, *self.read(table), None)
            pointer["stale"] += kept
            self._point(table, pointer)
        for path in old_stale:
            self.files.delete(path)

    def _point(self, table: Table, pointer: dict) -> None:
        self.files.replace(f"{self._base(table)}/CURRENT", json.dumps(pointer))

    def _renew(self, table: Table, pointer: dict, rows: DataFrame, statics: DataFrame | None, shards: set[int] | None) -> dict:
        version, base, stale = uuid.uuid4().hex, self._base(table), []
        sizes = {k: v for k, v in pointer.get("bytes", {}).items() if shards is not None and int(k) not in shards}
        for name, frame in (("rows", rows), ("statics", statics)):
            if frame is not None:
                order = [SHARD, TOKEN, *((c.name for c in table.clustering) if name == "rows" else ())]
                # several tasks write a large shard, each a range of its tokens; small ranges are put together at run time
                part = F.shiftright(F.col(TOKEN), 64 - RANGES.bit_length() + 1)
                dealt = frame.withColumn(SHARD, F.pmod(F.col(TOKEN), F.lit(pointer["shards"])).cast("int")).repartition(SHARD, part)
                dealt.sortWithinPartitions(*(f"`{c}`" for c in order)).write.partitionBy(SHARD).parquet(f"{base}/{version}/{name}")
            replaced = {k for k in pointer[name] if shards is None or int(k) in shards}
            stale += [f"{base}/{pointer[name].pop(k)}/{name}/{SHARD}={k}" for k in replaced]
            written = [x.partition("=")[2] for x in self.files.names(f"{base}/{version}/{name}") if x.startswith(f"{SHARD}=")]
            if not all(k.isdigit() for k in written):
                raise InvalidRequest("Invalid null value in a PRIMARY KEY part")
            pointer[name] |= dict.fromkeys(written, version)
            for k in written:
                sizes[k] = sizes.get(k, 0) + self.files.size(f"{base}/{version}/{name}/{SHARD}={k}")
        pointer = {**pointer, "bytes": sizes, "stale": stale}
        self._point(table, pointer)
        return pointer

    def drop(self, table: Table) -> None:
        self.files.delete(self._base(table))
