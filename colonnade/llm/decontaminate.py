"""Benchmark decontamination: a generalised suffix automaton over the words of normalised test items.

Training texts stream through the automaton; the longest match ending at each word tells which windows of an item
end there. Long items are cut into overlapping parts, and parts dealt to blocks of at most BLOCK_BYTES of text. One block at
a time is collected, its automaton broadcast, and what it finds written, so neither the driver nor a worker holds
more than a block: a larger benchmark means more passes, not larger broadcasts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.llm.common import Scratch, neutral, prepare, text_bytes

WINDOW = 10
#: A text of which more than this share of words is hit is dropped whole; else the hit spans are cut out.
MAX_COVERAGE = 0.5
BLOCK_BYTES = 1 << 20
#: What [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ matches in lower-cased UTF-8.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def normalised_words(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())  # touches ASCII alone


class Automaton:
    """Suffix automaton of several word sequences, with the items whose windows end in each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, words) for i, words in items if words]
        for _, words in items:
            last = 0
            for word in words:
                last = self._extend(last, word)
        size = len(self.next)
        by_length = sorted(range(size), key=self.length.__getitem__)
        #: The state of a state's suffixes of `window` words; -1 if its match is shorter.
        self.full = [-1] * size
        for v in by_length:
            if self.length[v] >= window:
                above = self.full[self.link[v]]
                self.full[v] = v if above < 0 else above
        self.window_items: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}
        for item, words in items:
            v = n = 0
            for word in words:
                v, n = self.step(v, n, word)
                if n >= window:
                    self.window_items.setdefault(self.full[v], set()).add(item)
            if len(words) < window:
                short.setdefault(v, {}).setdefault(len(words), set()).add(item)
        #: Whole short items that end in a state: (words, items), longest first.
        self.short: list[list[tuple[int, set]]] = [[] for _ in range(size)]
        for v in by_length:
            own = sorted(short.get(v, {}).items(), reverse=True)
            self.short[v] = own + (self.short[self.link[v]] if v else [])

    def _extend(self, last: int, word: bytes) -> int:
        nexts, link, length = self.next, self.link, self.length
        if word in nexts[last]:
            q = nexts[last][word]
            return q if length[q] == length[last] + 1 else self._split(last, word, q)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p != -1:
            q = nexts[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return new

    def _split(self, p: int, word: bytes, q: int) -> int:
        nexts, link, length = self.next, self.link, self.length
        clone = len(nexts)
        nexts.append(dict(nexts[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p != -1 and nexts[p].get(word) == q:
            nexts[p][word] = clone
            p = link[p]
        return clone

    def step(self, v: int, n: int, word: bytes) -> tuple[int, int]:
        """The state and length of the longest match after one more word."""
        nexts, link = self.next, self.link
        while v and word not in nexts[v]:
            v = link[v]
            n = self.length[v]
        if word in nexts[v]:
            return nexts[v][word], n + 1
        return 0, 0

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Spans of words covered by windows, disjoint and in order, and the items whose windows occur."""
        nexts, link, length, short, window = self.next, self.link, self.length, self.short, self.window
        spans: list[tuple[int, int]] = []
        states: set[int] = set()
        found: set = set()
        v = n = 0
        for i, word in enumerate(words):
            below = nexts[v]
            if word in below:
                v = below[word]
                n += 1
            elif v == 0:
                continue
            else:
                while v and word not in nexts[v]:
                    v = link[v]
                if word not in nexts[v]:
                    v = n = 0
                    continue
                n = length[v] + 1
                v = nexts[v][word]
            start = -1
            if n >= window:
                states.add(self.full[v])
                start = i + 1 - window
            if short[v]:
                for size, items in short[v]:
                    if size <= n:
                        found |= items
                        start = i + 1 - size if start < 0 else min(start, i + 1 - size)
            if start >= 0:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        for state in states:
            found |= self.window_items.get(state, set())
        return spans, found


def _cut_items(window: int, most: int):
    """Items as rows of words, cut into parts of at most about `most` bytes that share window-1 words with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = normalised_words(text)
                at = 0
                while at < len(words):
                    end, size = at, 0
                    while end < len(words) and (size <= most or end - at < 2 * window):
                        size += len(words[end]) + 1
                        end += 1
                    ids.append(item)
                    parts.append(b" ".join(words[at:end]))
                    at = end if end == len(words) else end - window + 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(parts, pa.binary())], names=["item_id", "part"])

    return run


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items' parts, at most about block_bytes of text at a time; at least one block, which may be empty.

    Parts are a sixteenth of that and blocks are aimed at half of it, so that chance doesn't fill one beyond.
    """
    parts = items.mapInArrow(_cut_items(window, block_bytes // 16), "item_id string, part binary").distinct()
    total = parts.agg(F.sum(F.octet_length("part") + 1)).first()[0] or 0
    count = max(1, math.ceil(2 * total / block_bytes)) if total > block_bytes else 1
    for k in range(count):
        rows = parts if count == 1 else parts.filter(F.pmod(F.xxhash64("item_id", "part"), F.lit(count)) == k)
        yield [(r.item_id, bytes(r.part).split()) for r in rows.collect()]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_FOUND = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_hits(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with `text`, items (item_id, text) -> the kept columns (default: all), n_words, spans, items.

    spans: array of (start, end) in words, disjoint and ordered; items: sorted array of item_id strings.
    Null texts have no words, null item_ids don't appear in items though their windows count. Items without
    words never match. Where the items fit in one block, documents pass it once, without a shuffle. Else each block writes the
    distinct texts it hits with their spans, and these are joined to the documents by the texts' hashes at the end.
    """
    spark = docs.sparkSession
    prepare(spark)
    kept = docs.columns if keep is None else keep
    inner = [f"c{i}" for i in range(len(kept))]
    frame = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(kept, inner, strict=True)), text_bytes(docs["text"]).alias("body"))
    ready = items.select(F.col("item_id").cast("string").alias("item_id"), text_bytes(items["text"]).alias("text"))
    blocks = _blocks(ready, window, block_bytes)
    first, second = next(blocks), next(blocks, None)

    def found_schema(before: T.StructType) -> T.StructType:
        return before.add("n_words", T.LongType()).add("spans", _FOUND).add("items", T.ArrayType(T.StringType()))

    schema = found_schema(frame.drop("body").schema)
    if second is None:
        found = frame.mapInArrow(_matcher(spark.sparkContext.broadcast(Automaton(first, window))), schema)
    else:
        keys = {"k1": F.xxhash64("body"), "k2": F.xxhash64("body", F.lit(1))}
        texts, scratch, parts = frame.withColumns(keys).select("k1", "k2", "body"), Scratch(spark, "benchmark"), []
        keyed = found_schema(texts.drop("body").schema)
        for k, block in enumerate(chain((first, second), blocks)):
            shared = spark.sparkContext.broadcast(Automaton(block, window))
            hits = texts.mapInArrow(_matcher(shared), keyed).filter(F.size("spans") > 0)
            parts.append(scratch.write(hits.groupBy("k1", "k2").agg(F.first("spans").alias("spans"), F.first("items").alias("items")), f"hits{k}"))
            shared.destroy()
        hits = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
        found = frame.withColumns(keys).join(scratch.write(hits, "hits"), ["k1", "k2"], "left").select(*inner, "body", "spans", "items").mapInArrow(_gathered, schema)
        scratch.drop(*(f"hits{k}" for k in range(len(parts))))
    return found.select(*(F.col(n).alias(k) for k, n in zip(kept, inner, strict=True)), "n_words", "spans", "items")


def _matcher(shared):
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column("body").to_pylist():
                words = normalised_words(text)
                now, found = automaton.hits(words)
                counts.append(len(words))
                spans.append([{"start": s, "end": e} for s, e in now])
                items.append(sorted(x for x in found if x is not None))
            yield _with_found(batch.drop_columns(["body"]), counts, spans, items)

    return match


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the blocks found of each text, merged; and its number of words."""
    for batch in batches:
        counts = [len(normalised_words(t)) for t in batch.column("body").to_pylist()]
        spans = [[{"start": s, "end": e} for s, e in _merged([(x["start"], x["end"]) for x in held or ()])] for held in batch.column("spans").to_pylist()]
        items = [sorted(set(held or ())) for held in batch.column("items").to_pylist()]
        yield _with_found(batch.drop_columns(["body", "spans", "items"]), counts, spans, items)


def _with_found(batch: pa.RecordBatch, counts: list, spans: list, items: list) -> pa.RecordBatch:
    done = [pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*batch.columns, *done], names=[*batch.schema.names, "n_words", "spans", "items"])


def n_hit(spans: str | Column = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the spans of words out of `text`; the white space at a cut is closed up."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = []
        for text, spans in zip(batch.column(at).to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if spans:
                raw = text.encode()
                places = [m.span() for m in _WORD.finditer(raw.lower())]
                parts, done = [], 0
                for span in spans:
                    parts.append(raw[done : places[span["start"]][0]].rstrip(b" "))
                    done = places[span["end"] - 1][1]
                parts.append(raw[done:])
                text = b"".join(p if not i or not p[:1].isalnum() else b" " + p for i, p in enumerate(parts)).decode()
            texts.append(text)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        yield pa.RecordBatch.from_arrays(columns[:-1], names=batch.schema.names[:-1])


def decontaminate(docs: DataFrame, items: DataFrame, max_coverage: float = MAX_COVERAGE, window: int = WINDOW) -> DataFrame:
    """The documents without benchmark passages: hit spans are cut out, texts hit beyond max_coverage dropped.

    Texts without a hit, nulls among them, stay as they are. Columns are those of docs.
    """
    frame, restored = neutral(docs)
    found = find_hits(frame, items, window=window)
    kept = found.filter(n_hit() <= F.lit(max_coverage) * F.col("n_words")).select(*frame.columns, "spans")
    return restored(kept.mapInArrow(_cut, frame.schema))
