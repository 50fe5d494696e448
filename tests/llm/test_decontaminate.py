import random
import time

import brute
from colonnade.llm import decontaminate


def random_case(rng, letters="abcd"):
    items = [(k, " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 14)))) for k in range(6)]
    text = " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 80)))
    for _, t in rng.sample(items, 2):
        text += " " + t + " " + rng.choice(letters)
    return items, text


def test_automaton_finds_what_plain_search_finds():
    rng = random.Random(5)
    for _ in range(300):
        items, text = random_case(rng)
        window = rng.choice([2, 3, 5, 10])
        automaton = decontaminate.Automaton([(i, decontaminate.normalised_words(t.encode())) for i, t in items], window)
        spans, found = automaton.hits(decontaminate.normalised_words(text.encode()))
        _, hit, names = brute.contamination(text, items, window)
        assert {p for s, e in spans for p in range(s, e)} == hit and found == names
        assert spans == sorted(spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905


def test_blocks_of_items_give_the_same(spark):
    rng = random.Random(6)
    cases = [random_case(rng, "abcdefgh") for _ in range(20)]
    items = [(100 * k + i, t) for k, (c, _) in enumerate(cases) for i, t in c]
    docs = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(cases)], "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")

    def run(block_bytes):
        return {r.doc_id: (r.n_words, [tuple(s) for s in r.spans], r["items"]) for r in decontaminate.find_hits(docs, table, ["doc_id"], block_bytes=block_bytes).collect()}

    whole = run(1 << 20)
    assert any(v[1] for v in whole.values())
    assert run(600) == whole  # 9 passes


def test_a_long_item_is_cut_without_loss(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(300)}" for _ in range(3000)]
    texts = [" ".join(["x", *words[i : i + 40], "y"]) for i in range(0, 2960, 37)] + [" ".join(words), "w1 w2", None, ""]
    docs = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    table = spark.createDataFrame([(1, " ".join(words)), (2, "w1 w2"), (1, " ".join(words)), (None, texts[3]), (3, None)], "item_id long, text string")
    got = {r.doc_id: ({p for s, e in r.spans for p in range(s, e)}, r["items"]) for r in decontaminate.find_hits(docs, table, ["doc_id"], block_bytes=4000).collect()}
    whole = {r.doc_id: ({p for s, e in r.spans for p in range(s, e)}, r["items"]) for r in decontaminate.find_hits(docs, table, ["doc_id"]).collect()}
    assert got == whole and got[0][0] >= set(range(1, 41)) and got[0] == got[len(texts)]


def test_repetitive_items_cost_linear_time():
    def seconds(n):
        at = time.process_time()
        decontaminate.Automaton([(1, [b"w"] * n)])
        return time.process_time() - at

    seconds(1000)
    assert seconds(64000) < 40 * max(seconds(4000), 0.01)  # 16 times the words; squares would be 256


def test_words_are_those_of_the_contract():
    for text in ("Ab-c_d É ß 1x\x00y", "日本 語 a", "\x7f"):
        assert [w.decode() for w in decontaminate.normalised_words(text.encode())] == brute.LICENCE_WORD.findall(brute.lower(text))
