"""Near copies by content: sets of WORDS-word shingles whose Jaccard similarity is SIMILARITY or more, with none missed.

Equal sets are grouped first. Sets whose fingerprints (simhash.py) are close are compared, then all others that can be
similar: sets are put into one order of shingles, commonly found ones last. Of two sets of similarity 0.8 the larger has one
of its first n - ceil(0.8 n) + 1 shingles in common with the first n - ceil(8/9 n) + 1 of the smaller (prefix filtering), so
postings of these shingles hold every pair. A long posting's members are paired with its LEADERS, and similar ones
linked; then pairs across groups follow, as far as the sizes and the places of the shared shingle allow the similarity.
Parity maps rule out most of these: each shingle flips one of BITS bits, so sets differ in at least as many shingles as their maps
in bits. What is left is compared over the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colonnade.llm.common import Scratch, give_back, text_bytes
from colonnade.llm.graph import components

SEED, WORDS = 42, 5
#: Similarity as a fraction, so that comparisons are of integers.
LEAST, OF = 4, 5
#: Documents that the order of shingles is drawn from are one in SAMPLE; it lists at most COMMON shingles found OFTEN.
#: The order decides how many pairs are compared, never which are found.
SAMPLE, COMMON, OFTEN = 16, 50_000, 4
#: Leaders of a posting: its least members by orders drawn by these masks. Only postings with more members have any.
LEADERS = [k * 0x1E3779B97F4A7C15 & (1 << 63) - 1 for k in range(8)]
BITS = 2048


def hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of a UTF-8 text's shingles in turn; a shorter text is one shingle, one without words has none."""
    parts = text.lower().split()  # both touch ASCII alone
    if not parts:
        return np.empty(0, "<u8")
    grams = [b" ".join(parts)] if len(parts) < words else map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False))
    h, seed = xxhash.xxh64_intdigest, SEED
    return np.fromiter((h(g, seed) for g in grams), "<u8", max(1, len(parts) - words + 1))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(hashes(text, words).view(np.int64))


def parity(grams: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit integers; a shingle flips the bit that its low bits name."""
    odd = np.bincount(grams & (BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _arrays(lists: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *lists]), pa.int64()))


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([_arrays([shingles(t) for t in batch.column(0).to_pylist()])], names=["grams"])


_ROWS = "doc_id long, text_key long, set_id long, n long, fp long, bits array<long>, prefix array<long>"


def _rows(common: np.ndarray, fingerprint: Callable[[np.ndarray], int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """common: shingles that come last in the order, the most common at the end."""
    by_value = np.argsort(common)
    values = common[by_value]

    def prefix(grams: np.ndarray) -> np.ndarray:
        n = len(grams)
        if not n:
            return grams
        rank = np.full(n, -1)
        if len(values):
            at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
            rank = np.where(values[at] == grams, by_value[at], -1)
        return grams[np.argsort(rank, kind="stable")][: n - -(-LEAST * n // OF) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prints, maps, firsts = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                grams = shingles(text)
                ids.append(xxhash.xxh64_intdigest(grams.tobytes(), SEED))
                sizes.append(len(grams))
                prints.append(fingerprint(grams))
                maps.append(parity(grams))
                firsts.append(prefix(grams))
            whole = [pa.array(np.array(x, "<u8").view(np.int64), pa.int64()) for x in (ids, prints)]
            columns = [batch.column(0), batch.column(1), whole[0], pa.array(sizes, pa.int64()), whole[1], _arrays(maps), _arrays(firsts)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "set_id", "n", "fp", "bits", "prefix"])
        give_back()

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _arrays([shingles(t) for t in batch.column(1).to_pylist()])], names=["set_id", "grams"])


def _sizes_fit(u: Column, v: Column) -> Column:
    return F.least(u, v) * OF >= F.greatest(u, v) * LEAST


def _likely(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sizes and parity maps allow the similarity: sets that differ in d shingles have d <= (a + b) / 9."""
    one, other = (sets.select(F.col("set_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "uv")
    differ = reduce(add, (F.bit_count(F.col("bits_u")[i].bitwiseXOR(F.col("bits_v")[i])) for i in range(BITS // 64)))
    met = _sizes_fit(F.col("n_u"), F.col("n_v")) & (differ * (LEAST + OF) <= (F.col("n_u") + F.col("n_v")) * (OF - LEAST))
    return pairs.join(one, "u").join(other, "v").filter(met).select("u", "v")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (u, v) of similar sets."""
    one, other = (sets.select(F.col("set_id").alias(x), F.col("grams").alias(f"grams_{x}")) for x in "uv")
    shared, both = F.size(F.array_intersect("grams_u", "grams_v")), F.size("grams_u") + F.size("grams_v")
    return pairs.join(one, "u").join(other, "v").filter(shared * (LEAST + OF) >= both * LEAST).select("u", "v")


def key_columns(doc_id: Column, text_key: Column) -> dict[str, Column]:
    """A row's key without nulls, in columns id, none, key."""
    return {"id": F.coalesce(doc_id, F.lit(0)), "none": doc_id.isNull(), "key": text_key}


def _pair(u: str | Column, v: str | Column) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _close_prints(sets: DataFrame, linked: Callable[[DataFrame, Scratch], DataFrame], scratch: Scratch) -> DataFrame:
    """Pairs (u, v) that join the sets of equal and of linked fingerprints."""
    prints = scratch.write(sets.groupBy("fp").agg(F.min("set_id").alias("lead")), "prints")
    equal = sets.select("fp", "set_id").join(prints, "fp").select(*_pair("lead", "set_id"))
    one, other = (prints.select(F.col("fp").alias(x), F.col("lead").alias(f"lead_{x}")) for x in "uv")
    near = linked(prints, scratch).join(one, "u").join(other, "v").select(*_pair("lead_u", "lead_v"))
    return equal.unionByName(near)


def firsts(docs: DataFrame, fingerprint: Callable[[np.ndarray], int], linked: Callable[[DataFrame, Scratch], DataFrame], name: str = "shingles") -> DataFrame:
    """docs (doc_id, text) -> the key columns of one row of each group: its smallest doc_id, ties by text_key (xxhash64).

    Groups are what pairs of similar sets join. fingerprint gives that of a set's hashes, linked the links (u, v) between close ones of
    a table's fp. Null text counts as empty; texts without words are one group.
    """
    scratch = Scratch(docs.sparkSession, name)
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), text_bytes().alias("text"))
    sampled = read.filter(F.pmod("text_key", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled, "grams array<long>")
    often = sampled.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df")).filter(F.col("df") >= OFTEN)
    common = [r.gram for r in often.orderBy(F.desc("df"), "gram").limit(COMMON).collect()]
    rows = read.mapInArrow(_rows(np.array(common[::-1], np.int64), fingerprint), _ROWS)
    rows = scratch.write(rows, "rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("k")
    sets = scratch.write(rows.groupBy("set_id").agg(least, *(F.first(c).alias(c) for c in ("n", "fp", "bits", "prefix"))), "sets")
    scratch.drop("rows")

    posts = sets.select("set_id", "n", F.posexplode("prefix").alias("at", "gram"))
    lists = scratch.write(posts.groupBy("gram").agg(F.count("*").alias("members")).filter("members > 1"), "lists")
    posts = scratch.write(posts.join(lists.select("gram"), "gram"), "posts")
    texts = read.select("text", *(c.alias(x) for x, c in key_columns(F.col("doc_id"), F.col("text_key")).items()))

    def links_of(pairs: DataFrame, k: int) -> DataFrame:
        pairs = scratch.write(_likely(pairs.filter("u != v").distinct(), sets), f"pairs{k}")
        ids = pairs.select(F.col("u").alias("set_id")).union(pairs.select("v")).distinct()
        members = sets.join(ids, "set_id").select("set_id", *(c.alias(x) for x, c in key_columns(F.col("k.doc_id"), F.col("k.text_key")).items()))
        whole = texts.join(members, ["id", "none", "key"]).select("set_id", "text").dropDuplicates(["set_id"])
        links = scratch.write(_alike(pairs, scratch.write(whole.mapInArrow(_whole, "set_id long, grams array<long>"), f"grams{k}")), f"links{k}")
        scratch.drop(f"grams{k}", f"pairs{k}")
        return links

    masked = [F.min(F.col("set_id").bitwiseXOR(F.lit(m))).bitwiseXOR(F.lit(m)) for m in LEADERS]
    long = lists.filter(F.col("members") > len(LEADERS)).select("gram")
    leaders = posts.join(long, "gram").groupBy("gram").agg(F.array_distinct(F.array(*masked)).alias("leaders"))
    led = posts.join(leaders, "gram").select("set_id", F.explode("leaders").alias("leader")).select(*_pair("leader", "set_id"))
    links = links_of(_close_prints(sets, linked, scratch).unionByName(led), 1)
    roots = components(links, Scratch(docs.sparkSession, f"{name}-near")).withColumnRenamed("node", "set_id")
    grouped = posts.join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    grouped = scratch.write(grouped, "grouped")
    split = grouped.groupBy("gram").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("gram")
    left = scratch.write(grouped.join(split, "gram"), "split")
    u, v = (left.select("gram", F.col("set_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "at", "root"))) for x in "uv")
    v = v.filter(F.col("at_v") * (LEAST + OF) <= F.col("n_v") * (OF - LEAST))
    n_u, n_v = F.col("n_u"), F.col("n_v")
    larger = (n_u > n_v) | ((n_u == n_v) & (F.col("u") > F.col("v")))
    # the first shingle that a pair shares leaves room for as many as it needs; later ones need not
    room = F.least(n_u - F.col("at_u"), n_v - F.col("at_v")) * (LEAST + OF) >= (n_u + n_v) * LEAST
    crossing = u.join(v, "gram").filter((F.col("root_u") != F.col("root_v")) & larger & _sizes_fit(n_u, n_v) & room)
    links = links.unionByName(links_of(crossing.select(*_pair("u", "v")), 2))
    roots = components(links, Scratch(docs.sparkSession, f"{name}-all")).withColumnRenamed("node", "set_id")
    rooted = sets.select("set_id", "k").join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    kept = rooted.groupBy("root").agg(F.min("k").alias("k"))
    return kept.select(*(c.alias(x) for x, c in key_columns(F.col("k.doc_id"), F.col("k.text_key")).items()))
