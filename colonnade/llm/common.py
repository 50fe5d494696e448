"""Shared plumbing: written intermediate tables, Arrow batches, row keys."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.sources.store import on_one_machine

#: Rows of whole texts that one Arrow batch may hold, so that a Python worker's memory stays bounded.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: small Arrow batches, shuffle files dropped after each query."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    for key in ("spark.sql.classic.shuffleDependency.fileCleanup.enabled",):
        try:
            spark.conf.set(key, "true")
        except Exception:  # noqa: BLE001  a setting that this Spark doesn't know or allow
            pass


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir.

    Where it is unset and everything runs in one local process, a temporary folder is set; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='colonnade-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder; each cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.base = f"{shared_dir(spark)}/colonnade/{name}-{uuid.uuid4().hex}"
        self.leaving = False

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        self.go_at_exit()
        return self.spark.read.schema(df.schema).parquet(path)

    def go_at_exit(self) -> None:
        """Results may read the tables as long as the application lives; then they go."""
        if not self.leaving:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
            self.leaving = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).deleteOnExit(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later result reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def give_back() -> None:
    """Return a Python worker's unused memory to the system; workers outlive their tasks, and other stages' workers run beside them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)


def text_bytes(col: str | Column = "text") -> Column:
    """The text's UTF-8, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def neutral(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The rows with doc_id and text under these names and all other columns under names that clash with none, and
    a function that selects them again under their own names, in their own order."""
    names = docs.columns
    inner = [c if c in ("doc_id", "text") and c not in names[:i] else f"other_column_{i}" for i, c in enumerate(names)]
    return docs.toDF(*inner), lambda frame: frame.select(*inner).toDF(*names)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
