import random

import brute

from colonnade.llm import simhash


def edited(rng, words, times):
    words = list(words)
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


def test_one_of_each_group_of_near_copies_stays(spark):
    rng = random.Random(5)
    line = [f"line{i}" for i in range(12)]
    texts = ["", None, " \n", "one", "ONE", "one two three four five", "One two three four five six"]
    for c in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 250))]
        chain = base
        for k in range(12):
            chain = edited(rng, chain, rng.randrange(4))  # ends of a chain may differ by more than its neighbours do
            texts.append(" ".join(chain + (line if k % 2 else [])))
    hot = [f"hot{i}" for i in range(200)]
    texts += [" ".join(edited(rng, hot, rng.randrange(12))) for _ in range(60)]
    texts += [" ".join(line + [f"x{rng.randrange(10**6)}" for _ in range(20)]) for _ in range(60)]
    sets = [brute.shingle_set(t) for t in texts]
    nodes = range(len(texts))
    roots = brute.groups([(i, j) for i in nodes for j in range(i) if brute.alike(sets[i], sets[j])], nodes)
    assert any(sets[i] != sets[r] for i, r in roots.items()) and any(not brute.alike(sets[i], sets[r]) for i, r in roots.items())
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(frame).collect()) == sorted(set(roots.values()))
