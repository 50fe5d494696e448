import random

import numpy as np
import pytest

from colonnade.llm import packing


def test_least_squares_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.random((8, 20)), rng.normal(size=8)
        x = packing.nnls(a, b)
        gradient = a.T @ (b - a @ x)
        assert (x >= 0).all() and gradient.max() < 1e-6 and abs(gradient @ x) < 1e-6


def test_combinations_fill_the_window_on_average():
    table = packing.combinations(16, 3)
    middles = np.arange(16) + 0.5
    assert (abs(table @ middles - 16) <= 0.5).all() and table.sum(axis=1).max() == 3 and len({tuple(r) for r in table}) == len(table)
    pairs = {tuple(np.flatnonzero(r)) for r in table if r.sum() == 2 and r.max() == 1}
    assert pairs == {(a, 15 - a) for a in range(8)}


def no_plan(a, b, gram=None):
    return np.zeros(a.shape[1])


LENGTHS = {
    "spread": np.clip(np.random.default_rng(1).lognormal(6, 1, 6000).astype(int), 1, 20000),
    "short": np.random.default_rng(2).integers(5, 60, 40000),
    "even": np.random.default_rng(3).integers(1, 2047, 3000),
}


@pytest.mark.parametrize("name,share", [("spread", 0.35), ("short", 0.35), ("even", 0.6)])
def test_the_plan_keeps_documents_whole(name, share):
    """Of the cuts that the solver's plan could spare, it leaves but a share; without it each window costs one."""
    lengths = LENGTHS[name].tolist()
    needed = sum((n - 1) // 2048 for n in lengths)
    cuts = [sum(map(len, packing.pack_block(lengths, solve=solve))) - len(lengths) - needed for solve in (packing.nnls, no_plan)]
    assert cuts[0] <= share * cuts[1]


@pytest.mark.parametrize("lengths", [[1], [2048], [5000], [1024, 1024], [3] * 1000, [2047, 1, 2047, 1], [700] * 50 + [300] * 40, [1500] * 99, list(range(1, 400))])
def test_blocks_place_every_token_once(lengths):
    check(lengths)


def test_random_blocks():
    rng = random.Random(2)
    for _ in range(30):
        check([rng.choice([rng.randrange(1, 200), rng.randrange(1, 6000)]) for _ in range(rng.randrange(1, 300))])


@pytest.mark.parametrize("window", [1, 7, 64])
def test_small_windows(window):
    rng = random.Random(window)
    check([rng.randrange(1, 200) for _ in range(200)], window)


def check(lengths, window=2048):
    sequences = packing.pack_block(lengths, window)
    held = {}
    for s in sequences:
        assert 0 < sum(p[2] for p in s) <= window
        for doc, start, n in s:
            held.setdefault(doc, []).append((start, start + n))
    for doc, n in enumerate(lengths):
        pieces = sorted(held[doc])
        assert pieces[0][0] == 0 and pieces[-1][1] == n and all(a[1] == b[0] for a, b in zip(pieces, pieces[1:]))  # noqa: B905
    short = [s for s in sequences if sum(p[2] for p in s) < window]
    assert len(short) <= 1 and (not short or short[0] is sequences[-1])


def test_short_sequences_split_at_powers():
    parts = packing._split_powers([(0, 0, 1000), (1, 5, 337)])
    sizes = [sum(p[2] for p in s) for s in parts]
    assert sizes == [1024, 256, 32, 16, 8, 1]


def test_ids_are_the_tokenizers():
    words = packing.WordIds(packing.vocabulary_path())
    rng = random.Random(3)
    pools = ["abc XYZ 'stdm", "***%%%!!.,'", [chr(c) for c in range(0xA0, 0x180)], [chr(c) for c in range(0x300, 0x370)], [chr(c) for c in range(1, 0x80)], ["日", " ", "🙂", "ﬁ", "İ"]]
    texts = ["<|endoftext|> a", "<|EndOfText|>", "it's HE'LL", "É́ é H̱", "a\x1cb\x85c d", ""]
    texts += ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 50))) for _ in range(1500)]
    for at in range(0, len(texts), 9):
        some = texts[at : at + 9]
        for text, got in zip(some, words.encode([t.encode() for t in some]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_tasks_number_their_sequences_apart_and_pad_nothing(spark):
    docs = spark.range(400, numPartitions=4).selectExpr("id AS doc_id", "repeat('word and other words ', cast(id * 7 % 900 AS int)) AS text")
    sizes = packing.pack(docs).groupBy("sequence_id").sum("length").collect()
    assert all(r[1] & (r[1] - 1) == 0 for r in sizes) and sum(r[1] == 2048 for r in sizes) > 100
