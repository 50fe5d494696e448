"""Near-duplicate groups: 64-bit SimHash fingerprints linked through BK-trees.

Two fingerprints at most 2 bits apart agree on at least two of any four equal blocks, so each fingerprint is
dealt to the 6 shards named by its pairs of 16-bit blocks. A shard with more than SHARD fingerprints is dealt
again by pairs of the remaining bits' blocks (48, then 56 fixed bits), so a tree never holds more than SHARD or
256 distinct fingerprints, whatever the input. One task builds a shard's BK-tree and queries it with the
shard's own fingerprints; trees aren't broadcast, since all of them together grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm import shingles
from colonnade.llm.common import Scratch, neutral, text_bytes
from colonnade.llm.graph import components

WORDS, RADIUS, SHARD = 3, 2, 1024
_CHUNK = 1 << 16
_ALL = (1 << 64) - 1


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of 64-bit hashes: a bit is 1 if it is in over half of them; 0 of none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """The SimHash of a UTF-8 text; 0 if it has no words."""
    return fingerprint_of(shingles.hashes(text, words))


class BKTree:
    """A metric tree over 64-bit integers; a child hangs on its parent by their Hamming distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Positions of the members within the radius."""
        found, todo, values, children = [], [0] if self.values else [], self.values, self.children
        while todo:
            at = todo.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            below = children[at]
            if below:
                for edge in range(d - radius, d + radius + 1):
                    if edge in below:
                        todo.append(below[edge])
        return found

    def add(self, value: int) -> None:
        at, new = 0, len(self.values)
        while self.values:
            d = (self.values[at] ^ value).bit_count()
            if d not in self.children[at]:
                self.children[at][d] = new
                break
            at = self.children[at][d]
        self.values.append(value)
        self.children.append({})


def tree_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that join what is within the radius, one fewer than each group's members."""
    values = sorted(set(values))
    tree, parent, links = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tree.add(value)
    for i in range(len(values)):
        if (r := root(i)) != i:
            links.append((values[i], values[r]))
    return links


def _masks(free: list[int]) -> list[tuple[int, list[int]]]:
    """Masks of two of four blocks of the free bits, and the bits each leaves free."""
    size = len(free) // 4
    blocks = [free[i * size : (i + 1) * size] for i in range(4)]
    out = []
    for pair in combinations(range(4), 2):
        mask = sum(1 << b for i in pair for b in blocks[i])
        out.append((mask, [b for i in range(4) if i not in pair for b in blocks[i]]))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(rows: DataFrame, level: int) -> DataFrame:
    """rows (mask, fp) -> the shards of the next level: (mask, key, fp). mask holds the bits fixed so far."""
    if level == 1:
        picks = [F.lit(_signed(m)) for m, _ in _masks(list(range(64)))]
        dealt = rows.select("fp", F.explode(F.array(*picks)).alias("mask"))
    else:
        cases = None
        for m in _level_masks(level - 1):
            free = [b for b in range(64) if not m >> b & 1]
            more = F.array(*(F.lit(_signed(m | x)) for x, _ in _masks(free)))
            cond = F.col("mask") == F.lit(_signed(m))
            cases = F.when(cond, more) if cases is None else cases.when(cond, more)
        dealt = rows.select("fp", F.explode(cases).alias("mask"))
    return dealt.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _level_masks(level: int) -> list[int]:
    masks = [0]
    for _ in range(level):
        masks = [m | x for m in masks for x, _ in _masks([b for b in range(64) if not m >> b & 1])]
    return sorted(set(masks))


def _shard_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (mask, key, fp) rows: one BK-tree per shard; gives links (u, v)."""
    now, members = None, []

    def links() -> pa.RecordBatch:
        found = tree_links([m & _ALL for m in members])
        return pa.RecordBatch.from_arrays([pa.array([_signed(x[i]) for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for shard, fp in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2).to_pylist(), strict=True):
            if shard != now:
                if len(members) > 1:
                    yield links()
                now, members = shard, []
            members.append(fp)
    if len(members) > 1:
        yield links()


def fingerprint_links(prints: DataFrame, scratch: Scratch, shard: int = SHARD) -> DataFrame:
    """prints (fp long, distinct) -> links (u, v) that join all fingerprints within RADIUS bits."""
    rows, links = prints.select("fp"), None
    for level in (1, 2, 3):
        dealt = _deal(rows, level)
        sizes = scratch.write(dealt.groupBy("mask", "key").agg(F.count("*").alias("n")).filter("n > 1"), f"shards{level}")
        fits = sizes if level == 3 else sizes.filter(F.col("n") <= shard)
        tree_rows = dealt.join(fits.select("mask", "key"), ["mask", "key"]).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = tree_rows.mapInArrow(_shard_trees, "u long, v long")
        links = found if links is None else links.unionByName(found)
        if level == 3 or not sizes.filter(F.col("n") > shard).limit(1).count():
            return links
        rows = dealt.join(sizes.filter(F.col("n") > shard).select("mask", "key"), ["mask", "key"]).select("mask", "fp").distinct()
    return links


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = [_signed(fingerprint(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64()), batch.column(2)], names=["doc_id", "fp", "text_key"])


def near_duplicates(docs: DataFrame, name: str = "simhash") -> DataFrame:
    """docs (doc_id, text) -> a row per input row: doc_id, fp, text_key (xxhash64 of the text), root, component_id.

    root is the smallest fingerprint of the group, component_id its smallest doc_id. Null text counts as empty; texts without words share
    fingerprint 0 and are linked like any others. Rows with a null doc_id take part in linking and get their
    group's id; a group of such rows alone has a null id. Repeated rows stay repeated. An empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, name)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"), F.xxhash64("text").alias("text_key"))
    rows = scratch.write(read.mapInArrow(_prints, "doc_id long, fp long, text_key long"), "prints")
    firsts = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "firsts")
    roots = components(fingerprint_links(firsts, scratch), scratch).withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    mapped = scratch.write(rooted.join(groups, "root").select("fp", "root", "component_id"), "mapped")
    return rows.join(mapped, "fp").select("doc_id", "fp", "text_key", "root", "component_id")


def hex_fingerprint(col: str = "fp"):
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents with one row of each group of near copies: its smallest doc_id (ties: smallest text key).

    Near copies are texts whose sets of 5-word shingles agree by 0.8 or more. Fingerprints of these shingles within RADIUS bits,
    found by the BK-trees, are compared first; what 64 bits can't tell is found by shingles.firsts(), so no pair is missed.
    A group without any doc_id keeps one row too; of rows that repeat whole one stays. Columns are those of docs.
    """
    frame, restored = neutral(docs)
    key = shingles.key_columns(F.col("doc_id").cast("long"), F.xxhash64("text"))
    kept = shingles.firsts(frame, fingerprint_of, fingerprint_links)
    return restored(frame.withColumns(key).join(kept, list(key), "left_semi").dropDuplicates(list(key)))
