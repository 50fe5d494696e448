"""Each stage on its own input, held against the plain versions."""

import brute
import pytest
from odd_rows import CLASHING, ITEMS, TEXTS

import corpus_pipeline
from colonnade.llm import quality

COLUMNS = ["doc_id", "text", *CLASHING]
STAGES = dict(corpus_pipeline.STAGES)


def rows(frame):
    assert frame.columns == COLUMNS
    return sorted(((r[0], r[1]) for r in frame.collect()), key=repr)


def test_stage_order():
    assert list(STAGES) == ["quality", "near_duplicates", "benchmark", "personal_data", "packing"]


def test_quality_keeps_what_scores_half(spark, odd, odd_dir):
    labels = spark.read.parquet(f"{odd_dir}/labels.parquet")
    model = quality.fit(odd, labels)
    plain = sorted([(i, t) for i, t in TEXTS if model.scores([(t or "").encode()])[0] >= 0.5], key=repr)
    assert rows(STAGES["quality"](spark, odd, odd_dir)) == plain


def test_one_of_each_group_stays(spark, odd, odd_dir):
    """Groups are what pairs of 5-word shingle sets of similarity 0.8 or more join."""
    got = rows(STAGES["near_duplicates"](spark, odd, odd_dir))
    sets = [brute.shingle_set(t) for _, t in TEXTS]
    nodes = range(len(TEXTS))
    roots = brute.groups([(i, j) for i in nodes for j in range(i) if brute.alike(sets[i], sets[j])], nodes)
    wanted = []
    for root in set(roots.values()):
        members = [TEXTS[i] for i in nodes if roots[i] == root]
        wanted.append(min((i for i, _ in members if i is not None), default=None))
    assert sorted((i for i, _ in got), key=repr) == sorted(wanted, key=repr)
    assert all(x in TEXTS for x in got)


def test_benchmark_passages_go(spark, odd, odd_dir):
    got = rows(STAGES["benchmark"](spark, odd, odd_dir))
    for i, t in got:
        assert not brute.contamination(t, ITEMS)[1], i
    clean = [(i, t) for i, t in TEXTS if not brute.contamination(t, ITEMS)[1]]
    assert all(x in got for x in clean)
    assert 13 not in [i for i, _ in got]  # nothing but a benchmark window
    assert dict(got)[7] == "x y and here, where many clean words of its own stand so that the text stays"


def test_personal_data_is_hidden(spark, odd, odd_dir):
    got = rows(STAGES["personal_data"](spark, odd, odd_dir))
    assert len(got) == len(TEXTS)
    assert dict(got)[8] == "mail <email> from <ip> or 256.1.1.1 card <card> call <phone> é 🙂 <email>"
    untouched = [(i, t) for i, t in TEXTS if not brute.pii(t)]
    assert all(x in got for x in untouched)


def test_all_stages(spark, odd_dir):
    out = corpus_pipeline.run(spark, odd_dir)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns)
    assert out.count() > 0


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_all_stages_on_driver_tables(spark, scale):
    from pathlib import Path

    base = f"/root/testdata/{scale}"
    if not Path(base).exists():
        pytest.skip("no driver tables here")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{base}/benchmark.parquet").select("item_id", "text").collect()]
    for name in ("near_duplicates", "benchmark"):
        docs = STAGES[name](spark, docs, base)
    kept = docs.collect()
    assert not any(brute.contamination(r.text, items)[1] for r in kept)
