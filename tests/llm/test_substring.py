import random

import brute
import numpy as np
import pytest

from colonnade.llm import substring_dedup as sub


def texts(rng, n, letters):
    base = [" ".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(n)]
    out = []
    for t in base:
        words = t.split()
        for _ in range(rng.randrange(3)):
            other = rng.choice(base).split()
            i = rng.randrange(len(other) + 1)
            j = rng.randrange(len(words) + 1)
            words[j:j] = other[i : i + rng.randrange(20)]
        out.append("  ".join(words))
    return out


@pytest.mark.parametrize(("window", "gram", "batches", "seed"), [(5, 2, 1, 1), (6, 3, 3, 2), (9, 4, 2, 3), (4, 4, 2, 4)])
def test_removes_what_plain_search_removes(spark, window, gram, batches, seed):
    rng = random.Random(seed)
    some = texts(rng, 40, "abcdefgh") + texts(rng, 30, [f"w{i}" for i in range(300)]) + ["a a a a a a a a a a a a"]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sub.remove_repeats(docs, window, gram, batches).collect()}
    assert got == dict(enumerate(brute.kept_words(some, window)))


def test_equal_windows_share_their_anchor():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 1 << 63, 80).astype(np.uint64)
    for _ in range(20):
        held = []
        for _ in range(2):
            words = np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 50)).astype(np.uint64), passage, rng.integers(0, 1 << 63, 30).astype(np.uint64)])
            at = len(words) - 110
            anchors, _, first, count = sub.spans(words, 35, 16)
            by_window = {int(a) + k: int(h) for h, a, c in zip(anchors, first, count, strict=True) for k in range(int(c))}
            held.append([by_window[at + k] for k in range(46)])
        assert held[0] == held[1]


def test_spans_cover_all_windows():
    words = np.random.default_rng(2).integers(0, 1 << 63, 500).astype(np.uint64)
    _, _, first, count = sub.spans(words, 35, 16)
    assert first[0] == 0 and (first[1:] == (first + count)[:-1]).all() and first[-1] + count[-1] == 466
    assert all(len(x) == 0 for x in sub.spans(words[:34], 35, 16))


def test_runs_merge_batch_by_batch(spark, tmp_path):
    batches = ([(1, 1), (1, 1), (2, 5)], [(1, 1), (3, 3)], [(2, 6), (3, 3)], [(9, 9)])
    for batch in batches:
        index = sub.SpanIndex(spark, f"file://{tmp_path}/runs", bucket_rows=1)  # opened again for each
        index.ingest(spark.createDataFrame(batch, "h long, s long"))
        index.close()
    index = sub.SpanIndex(spark, f"file://{tmp_path}/runs")
    assert len(index.batches) == 4 and 1 < len(index.runs) < 4
    assert len([x for x in (tmp_path / "runs").iterdir() if x.name.startswith("span_run")]) == len(index.runs)
    assert sorted(tuple(r) for r in index.rows().collect()) == [(1, 1, 3), (2, 5, 1), (2, 6, 1), (3, 3, 2), (9, 9, 1)]
    assert sorted(tuple(r) for r in index.repeated().collect()) == [(1, 1, True, False), (2, 5, False, True), (2, 6, False, True), (3, 3, True, False)]
    index.close()


def test_later_batches_are_held_against_earlier_ones(spark, tmp_path):
    """Batches taken in by three indexes that are opened one after the other, the last in another session."""
    rng = random.Random(9)
    some = list(enumerate(texts(rng, 60, "abcdefgh") + texts(rng, 60, [f"w{i}" for i in range(300)])))
    some += [some[3], some[3], some[100], (None, some[5][1]), (None, None)]
    rng.shuffle(some)
    names = []
    for k, session in enumerate((spark, spark, spark.newSession())):
        index = sub.PassageIndex(session, f"file://{tmp_path}/index", 6, 3)
        names.append(index.ingest(session.createDataFrame(some[k::3], "doc_id long, text string")))
        index.index.close()
    index = sub.PassageIndex(spark, f"file://{tmp_path}/index", 6, 3)
    plain = [(i, *r) for (i, _), r in zip(some, brute.kept_words([t for _, t in some], 6), strict=True)]
    assert sorted((tuple(r) for r in index.kept().collect()), key=repr) == sorted(plain, key=repr)
    last = [x for k, x in enumerate(plain) if k % 3 == 2]
    assert sorted((tuple(r) for r in index.kept([names[2]]).collect()), key=repr) == sorted(last, key=repr)
    index.index.close()


def test_rows_that_repeat_whole_cost_no_more_each(spark):
    text = " ".join(f"r{i}" for i in range(400))
    docs = spark.range(600).selectExpr("7L AS doc_id", f"'{text}' AS text").unionByName(spark.createDataFrame([(8, f"new {text[:200]}")], "doc_id long, text string"))
    got = sub.remove_repeats(docs).groupBy("doc_id", "n_words", "n_removed").count().collect()
    words = len(text[:200].split())
    # the last word of the excerpt is cut
    assert sorted(tuple(r) for r in got) == [(7, 400, 400, 600), (8, words + 1, words - 1, 1)]


def test_a_passage_that_a_third_of_all_texts_share(spark):
    passage = " ".join(f"p{i}" for i in range(50))
    some = [f"u{k} v{k} {passage} z{k}" if k % 3 == 0 else " ".join(f"{k}x{i}" for i in range(50)) for k in range(900)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sub.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute.kept_words(some)))
