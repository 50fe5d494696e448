import random

import brute
import pytest
from pyspark.sql import functions as F

from colonnade.llm import simhash
from colonnade.llm.common import Scratch
from colonnade.llm.graph import components


@pytest.mark.parametrize("text", ["", " ", "one", "One two", "a b c", "A b\tC d\x0be", "é É ß x y z", "w " * 500])
def test_fingerprints(text):
    assert simhash.fingerprint(text.encode()) == brute.simhash(text)


def clustered(rng, centres, each, flips):
    out = set()
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rng.randrange(flips + 1)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


def test_trees_find_all_within_the_radius():
    rng = random.Random(1)
    values = clustered(rng, 8, 40, 4)
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.values[i] for i in tree.near(v, 2)) == [w for w in values if (v ^ w).bit_count() <= 2]
    assert brute.groups(simhash.tree_links(values), values) == brute.near_groups(values)


@pytest.mark.parametrize("shard", [1024, 30, 3])
def test_shards_lose_no_link(spark, shard):
    values = clustered(random.Random(2), 6, 60, 5)
    signed = [simhash._signed(v) for v in values]
    frame = spark.createDataFrame([(s,) for s in signed], "fp long")
    links = simhash.fingerprint_links(frame, Scratch(spark, "test-links"), shard)
    found = [(r.u & simhash._ALL, r.v & simhash._ALL) for r in links.collect()]
    assert all((a ^ b).bit_count() and a in values and b in values for a, b in found)
    assert brute.groups(found, values) == brute.near_groups(values)


def test_no_pair_escapes_the_blocks():
    rng = random.Random(3)
    masks = [m for m, _ in simhash._masks(list(range(64)))]
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(a & m == b & m for m in masks)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(500, k) for k in range(501, 700)] + [(-5, 500)]
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.root for r in components(frame, Scratch(spark, "test-graph")).collect()}
    assert got == {x: r for x, r in brute.groups(edges, {x for e in edges for x in e}).items() if x in nodes}


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test-none")).collect() == []


def test_hex():
    assert simhash._signed(1 << 63) == -(1 << 63)


def test_hot_groups_of_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the very same text again").otherwise(F.concat(F.lit("text number "), F.col("id").cast("string"), F.lit(" differs here"))).alias("text"))
    got = simhash.near_duplicates(docs).filter("doc_id % 3 = 0").select("component_id").distinct().collect()
    assert [r.component_id for r in got] == [0]
