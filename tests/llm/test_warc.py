import random

import pytest

from colonnade.llm import warc


def chunked(data, size):
    return (data[i : i + size] for i in range(0, len(data), size))


@pytest.mark.parametrize("size", [1, 7, 1000, 1 << 16])
def test_members_however_the_stream_is_cut(size):
    rng = random.Random(1)
    bodies = [b"", b"x", rng.randbytes(5000), b"\r\n\r\nWARC/1.1\r\n" * 50, b"z" * 600_000][: 5 if size > 1 else 4]
    archive = b"".join(warc.write_record(i, f"http://u/{i}", b, None, False) for i, b in enumerate(bodies))
    records = list(warc.read_records(chunked(archive, size)))
    assert [r.payload for r in records] == bodies and all(r.intact for r in records)
    assert [warc._page_id(r.fields["warc-record-id"]) for r in records] == list(range(len(bodies)))


def test_revisits_leave_the_payload_out():
    (record,) = warc.read_records([warc.write_record(9, "a b\n", b"p" * 500, 3, True)])
    assert record.intact and record.payload == b"" and record.http_length() == 500
    assert record.fields["warc-refers-to"] == "<urn:page:3>" and record.fields["warc-target-uri"] == "a%20b%0A"


def test_damage():
    good = warc.write_record(1, "u", b"payload", None, False)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.read_records([good[:-5]]))
    import gzip

    raw = gzip.decompress(good).replace(b"payload", b"PAYLOAD")
    assert not next(warc.read_records([gzip.compress(raw)])).intact


def test_files(spark, tmp_path):
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.write_record(i, "u", f"body {i}".encode(), None, False) for i in range(5)))
    got = warc.read_files(spark, str(tmp_path)).collect()
    assert sorted((r.page_id, bytes(r.payload), r.intact) for r in got) == [(i, f"body {i}".encode(), True) for i in range(5)]


def test_segments_are_bounded(spark):
    pages = spark.range(60).selectExpr("id AS page_id", "'u' AS url", "concat_ws('', transform(sequence(1, 4000), i -> sha2(cast(i * id AS string), 256))) AS html")
    archives = warc.write_archives(pages.coalesce(1))
    sizes = [len(r.data) for r in archives.collect()]
    assert len(sizes) > 1 and max(sizes) <= warc.SEGMENT
    assert warc.round_trip(pages).filter("intact").count() == 60


def test_written_files_are_read_back(spark, tmp_path):
    page = "<p>" + "é" * 80
    rows = [(5, "http://a", page), (3, "b", page), (9, "c", "small"), (None, "d", None), (7, "e", page * 40000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/out"
    files = warc.write_files(pages, folder).collect()
    assert sorted(x.name for x in (tmp_path / "out").iterdir()) == sorted(r.archive for r in files)
    assert all((tmp_path / "out" / r.archive).stat().st_size == r.bytes for r in files)
    got = {r.page_id: (r.url, bytes(r.payload) if r.payload is not None else None, r.record_type, r.refers_to, r.intact) for r in warc.read_files(spark, folder).collect()}
    assert got[5] == ("http://a", None, "revisit", 3, True) and got[3] == ("b", page.encode(), "response", None, True)
    assert got[7][1] == (page * 40000).encode() and got[None] == ("d", b"", "response", None, True) and len(got) == 5


def test_damaged_archives_end_with_a_mark(spark, tmp_path):
    good = b"".join(warc.write_record(i, "u", b"x" * 200, None, False) for i in range(3))
    (tmp_path / "cut.warc.gz").write_bytes(good[:-9])
    got = warc.read_files(spark, f"file://{tmp_path}").collect()
    assert [(r.page_id, r.intact) for r in got] == [(0, True), (1, True), (None, False)]
    archives = spark.createDataFrame([(bytearray(b"no gzip"),), (None,), (bytearray(good),)], "data binary")
    assert sorted(((r.page_id, r.intact) for r in warc.read_archives(archives).collect()), key=repr) == [(0, True), (1, True), (2, True), (None, False)]


def test_a_payload_that_most_pages_share(spark):
    pages = spark.range(500).selectExpr("id + 1 AS page_id", "'u' AS url", "IF(id % 5 = 0, concat('own', id), repeat('same page ', 30)) AS html")
    marked = warc.mark_revisits(pages).collect()
    assert sum(r.revisit for r in marked) == 399 and {r.refers_to for r in marked if r.revisit} == {2}
