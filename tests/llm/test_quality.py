import os

import numpy as np
import pytest

from colonnade.llm import quality


def test_separable_texts_are_learned():
    rng = np.random.default_rng(1)
    good, bad = ["river", "house", "under", "stone", "light"], ["xx%%", "zz$$", "buy!!", "QQQ"]

    def example(words, label):
        return *quality.shares_of(" ".join(rng.choice(words, 40)).encode()), label

    model = quality.Model(*quality.folded(*quality.train([example(good, 1) for _ in range(40)] + [example(bad, 0) for _ in range(40)])))
    fine, bad_one, unseen, empty = model.scores([b"stone house river " * 30, b"buy!! zz$$ xx%% " * 30, b"stones housed " * 30, b""])
    assert fine > 0.9 > 0.1 > bad_one and unseen > 0.5 and 0 <= empty <= 1  # unseen by their character n-grams


def test_features_are_those_of_each_word():
    ids, owners = quality.features([b"ab", b"", b"abab"])
    for k, w in enumerate([b"ab", b"", b"abab"]):
        alone, _ = quality.features([w])
        assert sorted(ids[owners == k]) == sorted(alone) and len(alone) == 1 + sum(max(0, len(w) + 3 - n) for n in quality.GRAMS)
    assert quality.words_of(b"a a b a a a") == [b"a", quality.SAME, b"b", b"a", quality.SAME, quality.SAME]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert model.scores([b"a"]) == [0.5]


def test_the_cache_changes_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    weights = rng.normal(size=1 << quality.BITS).astype(np.float32)
    text = " ".join(f"w{i % 37}" for i in range(500)).encode()
    (whole,) = quality.Model(weights, 0.1).scores([text])
    monkeypatch.setattr(quality, "_CACHE", 3)
    model = quality.Model(weights, 0.1)
    assert [model.scores([t])[0] for t in (text, b"x", text)][2] == pytest.approx(whole)


def test_held_out_accuracy(spark):
    base = "/root/testdata/sf0.01"
    if not os.path.exists(base):
        pytest.skip("no driver tables here")
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scored = quality.score(docs, quality.fit(docs, labels), ["doc_id"]).filter(~quality.in_training())
    rows = scored.join(labels, "doc_id").select("score", "quality").collect()
    right = [(r.score >= 0.5) == (r.quality == 1) for r in rows]
    assert len(rows) > 80 and sum(right) / len(right) > 0.95
    rejected = [r for r in rows if r.quality == 0]
    assert sum(r.score < 0.5 for r in rejected) / len(rejected) > 0.9


def test_scores_are_those_of_the_unfolded_softmax():
    """Word by word: the mean of the vectors of all features, through the output matrix and a softmax over two classes."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["aa", "b", "cde", "é", "x%"], n)).encode() for n in (1, 5, 60, 400)] + [b"", b"a a a"]
    vectors, out, bias = quality.train([(*quality.shares_of(t), k % 2) for k, t in enumerate(texts[:4])])

    def plain(text):
        found = [vectors[quality.PAD_ID].astype(float)] * quality.PAD
        last = None
        for word in text.split():
            ids, _ = quality.features([quality.SAME if word == last else word])
            found += [vectors[i].astype(float) for i in ids]
            last = word
        logits = np.mean(found, axis=0) @ out + bias
        return np.exp(logits[1]) / np.exp(logits).sum()

    scores = quality.Model(*quality.folded(vectors, out, bias)).scores(texts)
    assert scores == pytest.approx([plain(t) for t in texts], abs=1e-5) and len(set(np.round(scores, 6))) > 3


def test_a_repeated_id_brings_one_row(spark):
    docs = spark.range(3000).selectExpr("2L AS doc_id", "concat('text ', id % 700) AS text").unionByName(spark.createDataFrame([(4, "one two"), (4, "one two"), (4, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(2, 1), (4, 0), (2, 1), (None, 0)], "doc_id long, quality int")
    seen = []
    kept = quality.train
    quality.train = lambda rows: seen.extend(rows) or kept(rows)
    try:
        quality.fit(docs, labels)
    finally:
        quality.train = kept
    assert len(seen) == sum(quality.zlib.crc32(str(i).encode()) % 3 != 1 for i in (2, 4))


def test_the_driver_gives_back_what_training_took(spark, monkeypatch):
    docs, done = spark.createDataFrame([(1, "a")], "doc_id long, text string"), []
    model = quality.Model(np.zeros(1 << quality.BITS, np.float32), 0.0)
    monkeypatch.setattr(quality, "fit", lambda *_: done.append("trained") or model)
    monkeypatch.setattr(quality, "give_back", lambda: done.append("given back"))
    quality.keep_good(docs, docs)
    assert done == ["trained", "given back"]
