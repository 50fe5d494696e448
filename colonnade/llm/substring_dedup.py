"""Removal of repeated passages by a log-structured index of window fingerprints.

A window is WINDOW consecutive words. Each window is filed under the smallest of its GRAM-word hashes (its anchor),
which equal windows share; consecutive windows with one anchor make a span. A run holds a row (anchor, span hash, count)
per distinct span: about a tenth of all windows, so that the whole corpus can be indexed. Runs are immutable, bucketed
and sorted by anchor; a new batch's run is merge-joined with the historical ones, and runs of like size are compacted
into one. An index is a folder that can be opened again: its manifest names the runs and batches, and moves by a rename.

A span that occurs twice is a candidate. Where an anchor has spans that differ (the ends of shared passages), each
distinct span's windows are candidates one by one. Candidates are verified by digests of the words themselves.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import Scratch, prepare, text_bytes
from colonnade.sources.store import Files

WINDOW, GRAM = 35, 16
#: Batches in which one call takes its table into the index; rows that a run's bucket is meant to hold, and how many buckets.
BATCHES, BUCKET_ROWS, BUCKETS = 2, 1 << 20, (32, 1 << 16)
#: A run is compacted with the one before it unless that holds this many times its rows.
FANOUT = 2
#: Odd multipliers of the rolling hashes, and of the mixer.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class _Rolling:
    """Hashes of runs of words, modulo 2**64, from prefix sums."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, words: np.ndarray, base: int):
        up, self.down = self._powers(base, len(words) + 1)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    @classmethod
    def _powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls.powers or len(cls.powers[base][0]) < n:
            size = max(4096, 1 << n.bit_length())
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                made.append(np.cumprod(p, dtype=np.uint64))
            cls.powers[base] = (made[0], made[1])
        return cls.powers[base]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.down[start])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def spans(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Word hashes -> the spans of a text's windows: anchor hash, span hash, first window, windows."""
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    at = np.arange(len(words) - gram + 1)
    grams = _Rolling(words, _BASES[0]).of(at, at + gram)
    anchor = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    count = np.diff(np.append(first, n))
    place = anchor[first]
    whole = _Rolling(words, _BASES[1]).of(first, first + count + window - 1)
    whole = _mixed(whole + (place - first).astype(np.uint64) * np.uint64(_BASES[0]) + count.astype(np.uint64) * _MIX)
    return grams[place].view(np.int64), whole.view(np.int64), first, count


def _span_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, offsets, columns = 0, [0], ([], [], [], [])
            for text in batch.column("body").to_pylist():
                words = text.split()  # at ASCII white space
                if len(words) >= window:
                    found = spans(word_hashes(words), window, gram)
                    for column, part in zip(columns, found, strict=True):
                        column.append(part)
                    size += len(found[0])
                offsets.append(size)
            arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in columns]
            inner = pa.StructArray.from_arrays([arrays[0], arrays[1], arrays[2].cast(pa.int32()), arrays[3].cast(pa.int32())], names=["h", "s", "a", "c"])
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner)], names=["k1", "k2", "spans"])

    return run


_SPAN_SCHEMA = "k1 long, k2 long, spans array<struct<h:bigint,s:bigint,a:int,c:int>>"


class SpanIndex:
    """Runs (h, s, n): sorted immutable tables, bucketed by h, of the spans of all batches so far.

    The folder's manifest names the runs, oldest first, and the batches that they hold; opening the folder goes on from there.
    A batch is in the index from the moment that the manifest names it, or not at all.
    """

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.path, self.bucket_rows, self.files = spark, path.rstrip("/"), bucket_rows, Files(spark)
        text = self.files.read(f"{self.path}/MANIFEST.json")
        held = json.loads(text) if text else {"runs": [], "batches": []}
        self.runs: list[dict] = held["runs"]
        self.batches: list[str] = held["batches"]
        for run in self.runs:
            self._register(run)

    def _register(self, run: dict) -> None:
        place = f"{self.path}/{run['name']}".replace("'", "\\'")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {run['name']} (h BIGINT, s BIGINT, n BIGINT) USING parquet CLUSTERED BY (h) SORTED BY (h, s) INTO {run['buckets']} BUCKETS LOCATION '{place}'")

    def _buckets(self, rows: int) -> int:
        """At least as many as the largest run's, so that runs join without being dealt anew; more as the index grows."""
        held = max((r["buckets"] for r in self.runs), default=BUCKETS[0])
        return min(BUCKETS[1], max(held, 1 << math.ceil(math.log2(max(1, rows / self.bucket_rows)))))

    def _write_run(self, rows: DataFrame, buckets: int) -> dict:
        name = f"span_run_{uuid.uuid4().hex}"
        dealt = rows.repartition(buckets, "h")
        dealt.write.bucketBy(buckets, "h").sortBy("h", "s").option("path", f"{self.path}/{name}").option("compression", "zstd").saveAsTable(name)
        return {"name": name, "rows": self.spark.table(name).count(), "buckets": buckets}

    def _merged(self, runs: list[dict]) -> DataFrame:
        def both(a: DataFrame, b: DataFrame) -> DataFrame:
            joined = a.alias("o").join(b.alias("b").hint("merge"), ["h", "s"], "full_outer")
            return joined.select("h", "s", (F.coalesce("o.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))).alias("n"))

        return reduce(both, (self.spark.table(r["name"]) for r in runs))

    def ingest(self, batch: DataFrame, name: str = "", rows: int | None = None) -> None:
        """Add a batch of spans (h, s); runs of like size are compacted. rows: the batch's number, where it is known."""
        rows = batch.count() if rows is None else rows
        runs = [*self.runs, self._write_run(batch.groupBy("h", "s").agg(F.count("*").alias("n")), self._buckets(rows))]
        gone = []
        while len(runs) > 1 and runs[-2]["rows"] < FANOUT * runs[-1]["rows"]:
            two = runs[-2:]
            gone += two
            runs[-2:] = [self._write_run(self._merged(two), self._buckets(sum(r["rows"] for r in two)))]
        self.runs, self.batches = runs, [*self.batches, name]
        self.files.replace(f"{self.path}/MANIFEST.json", json.dumps({"runs": self.runs, "batches": self.batches}))
        for run in gone:
            self._drop_run(run)

    def _drop_run(self, run: dict) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")
        self.files.delete(f"{self.path}/{run['name']}")

    def rows(self) -> DataFrame:
        """All runs, merge-joined."""
        return self._merged(self.runs) if self.runs else self.spark.createDataFrame([], "h long, s long, n long")

    def repeated(self) -> DataFrame:
        """(h, s, whole, mixed) of anchors that occur twice: does the span repeat whole, are there others?"""
        rows = self.rows()
        anchors = rows.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("kinds")).filter("all > 1")
        return rows.join(anchors, "h").select("h", "s", (F.col("n") > 1).alias("whole"), (F.col("kinds") > 1).alias("mixed"))

    def close(self) -> None:
        """Forget the runs' names in this session; the folder stays."""
        for run in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run['name']}")


def _digest(words: list[bytes]) -> tuple[int, int]:
    held = blake2b(b" ".join(words), digest_size=16).digest()
    return int.from_bytes(held[:8], "little", signed=True), int.from_bytes(held[8:], "little", signed=True)


def _candidates(window: int):
    """Spans to verify -> a row for each whole span and each single window: place, digest of its words, times it counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k1, k2, body, found in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "body", "spans")), strict=True):
                words = body.split()
                for f in found:
                    a, c = f["a"], f["c"]
                    if f["whole"]:
                        out.append((k1, k2, a, c, *_digest(words[a : a + c + window - 1]), 1))
                    if f["singly"]:
                        # a span that repeats whole stands here for all its copies, and its place needs no further mark
                        place, times = (0, 2) if f["whole"] else (1, 1)
                        out += [(k1, k2, i, place, *_digest(words[i : i + window]), times) for i in range(a, a + c)]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["k1", "k2", "a", "c", "d1", "d2", "times"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with equal id and text share a key; their windows count once for each."""
    return docs.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64("text", F.lit(1))})


class PassageIndex:
    """Documents taken in batch by batch, in this session or later ones, and what remains of them without repeated passages.

    The folder holds each batch's documents and spans, and the runs of a SpanIndex over all of them.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM):
        prepare(spark)
        self.spark, self.path, self.window, self.gram = spark, path.rstrip("/"), window, gram
        self.index = SpanIndex(spark, f"{self.path}/spans")
        self.scratch = Scratch(spark, "substring")

    def _table(self, kind: str, batch: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{batch}/{kind}")

    def _all(self, kind: str, batches: list[str], schema: str) -> DataFrame:
        return reduce(DataFrame.unionByName, (self._table(kind, b, schema) for b in batches))

    def ingest(self, docs: DataFrame) -> str:
        """Take a batch of docs (doc_id, text) in; gives its name."""
        name = f"batch-{uuid.uuid4().hex}"
        rows = _keyed(docs.select("doc_id", "text")).select("k1", "k2", F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("body"))
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}/documents")
        bodies = self._table("documents", name, _DOCUMENTS).select("k1", "k2", "body")
        bodies.mapInArrow(_span_rows(self.window, self.gram), _SPAN_SCHEMA).filter("size(spans) > 0").write.option("compression", "zstd").parquet(f"{self.path}/{name}/spans")
        filed = self._table("spans", name, _SPAN_SCHEMA)
        count = filed.agg(F.sum(F.size("spans"))).first()[0] or 0
        self.index.ingest(filed.select(F.explode("spans").alias("x")).select("x.h", "x.s"), name, count)
        return name

    def repeated_windows(self, last: bool = False) -> DataFrame:
        """(k1, k2, ranges): the windows (a, c: first and count) of each key that also start elsewhere.

        last: no later batch follows, so spans and runs are deleted as soon as they have been read.
        """
        scratch = self.scratch
        batches = self.index.batches
        exploded = self._all("spans", batches, _SPAN_SCHEMA).select("k1", "k2", F.explode("spans").alias("x")).select("k1", "k2", "x.*")
        marked = scratch.write(exploded.join(self.index.repeated(), ["h", "s"]), "marked")
        if last:
            self.drop_spans()
        # of a whole span among others one copy is compared window by window, for all of its copies
        stands = marked.filter("whole and mixed").groupBy("h", "s").agg(F.min(F.struct("k1", "k2", "a")).alias("first"))
        stands = stands.select("first.*", F.lit(True).alias("stands"))
        # a whole span's copy may be another's place too, but no two spans of a text start at the same word
        units = marked.join(stands, ["k1", "k2", "a"], "left").withColumn("singly", F.col("mixed") & (~F.col("whole") | F.coalesce("stands", F.lit(False))))
        todo = units.filter("whole or singly").groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "c", "whole", "singly")).alias("spans"))
        # rows that share a key compare their windows too: they are joined, not merged
        bodies = self._all("documents", batches, _DOCUMENTS).select("k1", "k2", "body")
        found = bodies.join(todo, ["k1", "k2"]).mapInArrow(_candidates(self.window), "k1 long, k2 long, a int, c int, d1 long, d2 long, times int")
        found = scratch.write(found, "candidates")
        # written, so that the join below deals both sides anew and can split a passage that very many texts share
        twice = scratch.write(found.groupBy("d1", "d2").agg(F.sum("times").alias("n")).filter("n > 1").select("d1", "d2"), "twice")
        ranges = found.filter("c > 0").join(twice, ["d1", "d2"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "c")).alias("ranges"))
        out = scratch.write(ranges, "ranges")
        scratch.drop("marked", "candidates", "twice")
        return out

    def kept(self, batches: list[str] | None = None, last: bool = False) -> DataFrame:
        """A row per row of the batches (default: all): doc_id, n_words, n_removed, kept; windows of any batch count as elsewhere.

        last: the index is not used again.
        """
        chosen = self.index.batches if batches is None else batches
        if not chosen:
            return self.spark.createDataFrame([], _KEPT)
        joined = self._all("documents", chosen, _DOCUMENTS).join(self.repeated_windows(last), ["k1", "k2"], "left").select("doc_id", "body", "ranges")
        return joined.mapInArrow(_remover(self.window), _KEPT)

    def drop_spans(self) -> None:
        """Delete what only later batches would need."""
        for batch in self.index.batches:
            self.index.files.delete(f"{self.path}/{batch}/spans")
        for run in self.index.runs:
            self.index._drop_run(run)


_DOCUMENTS = "k1 long, k2 long, doc_id long, body binary"
_KEPT = "doc_id long, n_words long, n_removed long, kept string"


def _remover(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for body, ranges in zip(batch.column("body").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = body.split()
                counts.append(len(words))
                if ranges:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [r["a"] for r in ranges], 1)
                    np.add.at(edge, [r["a"] + r["c"] + window - 1 for r in ranges], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                removed.append(counts[-1] - len(words))
                texts.append(b" ".join(words))
            done = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *done], names=[*batch.schema.names[:-2], "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES) -> DataFrame:
    """docs (doc_id, text) -> a row per row: doc_id, n_words, n_removed, kept (the words that stay, one space apart).

    Every occurrence of a repeated window goes, its first included. Null and empty texts have no words; texts of
    fewer words than a window are kept. Rows that repeat whole lose all words if they have a window. An empty table
    gives none.
    """
    scratch = Scratch(docs.sparkSession, "passages")
    index = PassageIndex(docs.sparkSession, f"{scratch.base}/index", window, gram)
    scratch.go_at_exit()
    for k in range(batches):
        index.ingest(docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(batches)) == k))
    return index.kept(last=True)
