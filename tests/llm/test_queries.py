"""Every query over empty and odd tables, held against the plain versions."""

import zlib

import brute
import pytest
from odd_rows import ITEMS, TEXTS

import corpus_pipeline
from colonnade.llm.queries import QUERIES


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables_give_no_rows(spark, empty_dir, name):
    run = corpus_pipeline.run if name == "pipeline" else QUERIES[name]
    assert run(spark, empty_dir).collect() == []


def collected(spark, odd_dir, name):
    return sorted((tuple(r) for r in QUERIES[name](spark, odd_dir).collect()), key=repr)


def wanted(function):
    return sorted(((i, *function(t)) for i, t in TEXTS), key=repr)


def test_op1(spark, odd_dir):
    def plain(text):
        spans = brute.pii(text)
        return (*(sum(k == kind for k, _, _ in spans) for kind in brute.PII), brute.sha(brute.joined(spans)))

    got = collected(spark, odd_dir, "op1_pii")
    assert sorted((r[:6] for r in got), key=repr) == wanted(plain)
    mail = next(r for r in got if r[0] == 8)
    assert set(brute.joined(brute.pii(dict(TEXTS)[8])).split(",")) <= set(mail[6].split(","))


def test_op2(spark, odd_dir):
    got = collected(spark, odd_dir, "op2_license")
    assert sorted((r[:6] for r in got), key=repr) == wanted(brute.licences)
    assert all(0 <= r[7] <= 1 and set(r[5].split(",")) <= set(r[6].split(",")) for r in got)


def test_op3(spark, odd_dir):
    results = brute.kept_words([t for _, t in TEXTS])
    plain = sorted(((i, n, k, brute.sha(kept)) for (i, _), (n, k, kept) in zip(TEXTS, results, strict=True)), key=repr)
    assert collected(spark, odd_dir, "op3_substring_dedup") == plain


def test_op4(spark, odd_dir):
    def plain(text):
        raw = (text or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        return len(raw), len(payload), __import__("hashlib").sha256(payload).hexdigest(), zlib.crc32(payload[-32:])

    got = collected(spark, odd_dir, "op4_ogg")
    assert sorted((r[:5] for r in got), key=repr) == wanted(plain)
    by_text = {}
    for i, t in TEXTS:
        by_text.setdefault(t or "", set()).update(r[5:] for r in got if r[0] == i and r[1] == len((t or "").encode()))
    assert all(len(v) == 1 for k, v in by_text.items() if k.startswith("same"))


def test_op5(spark, odd_dir):
    from tokenizers import Tokenizer

    from colonnade.llm.packing import vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    rows = QUERIES["op5_packing"](spark, odd_dir).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048
    tokens = [(i, tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in TEXTS]
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in tokens)
    possible = {(i, s, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + r.length])), len(ids), r.length) for i, ids in tokens for r in rows for s in [r.start] if r.doc_id == i and s + r.length <= len(ids)}
    assert all((r.doc_id, r.start, r.ids_crc32, r.doc_tokens, r.length) in possible for r in rows)


def test_op6(spark, odd_dir):
    def plain(text):
        spans = brute.secrets(text)
        return (*(sum(k == kind for k, _, _ in spans) for kind in brute.SECRETS), brute.sha(brute.joined(spans)))

    got = collected(spark, odd_dir, "op6_secrets")
    assert sorted((r[:5] for r in got), key=repr) == wanted(plain)


def test_op7(spark, odd_dir):
    def plain(text):
        words, hit, found = brute.contamination(text, ITEMS)
        return len(words), len(hit), len(found), brute.sha(",".join(sorted(map(str, found)))), bool(hit)

    assert collected(spark, odd_dir, "op7_decontaminate") == wanted(plain)


def test_op8(spark, odd_dir):
    import hashlib

    pages = spark.read.parquet(f"{odd_dir}/pages.parquet").collect()
    rows = [(p.page_id, (p.html or "").encode()) for p in pages]
    plain = []
    for i, body in rows:
        first = min((j for j, b in rows if b == body and j is not None), default=None)
        revisit = len(body) >= 100 and first is not None and i != first
        plain.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert collected(spark, odd_dir, "op8_warc") == sorted(plain, key=repr)


def test_op9(spark, odd_dir):
    prints = [brute.simhash(t) for _, t in TEXTS]
    roots = brute.near_groups(prints)
    least = {}
    for (i, _), p in zip(TEXTS, prints, strict=True):
        known = [x for x in (least.get(roots[p]), i) if x is not None]
        least[roots[p]] = min(known, default=None)
    plain = sorted(((i, f"{p:016x}", least[roots[p]]) for (i, _), p in zip(TEXTS, prints, strict=True)), key=repr)
    assert collected(spark, odd_dir, "op9_simhash") == plain


def test_op10(spark, odd_dir):
    got = QUERIES["op10_quality"](spark, odd_dir).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.doc_id is None or r.held_out == brute.held_out(r.doc_id)
