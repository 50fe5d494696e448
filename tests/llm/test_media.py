import random

import pytest

from colonnade.llm import media_ogg as ogg


def slow_checksum(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if crc & 0x80000000 else (crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum():
    rng = random.Random(1)
    for n in (0, 1, 5, 300):
        data = rng.randbytes(n)
        assert ogg.checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 50_000, 146_880, 300_001])
def test_round_trip(n):
    data = random.Random(n).randbytes(n)
    payload = ogg.pad(data)
    media = ogg.read_payload(ogg.write_payload(payload, n))
    assert (media.payload, media.plain, media.damaged) == (payload, n, 0)
    assert media.duration == pytest.approx(len(payload) / ogg.RATE) and media.packets == len(payload) // ogg.FRAME


@pytest.mark.parametrize("sizes", [[0], [255], [510, 0, 1], [255 * 255], [255 * 255 * 3 + 7, 5], [70_000] * 4])
def test_packets_over_pages(sizes):
    rng = random.Random(7)
    packets = [b"head", *(rng.randbytes(s) for s in sizes)]
    other = [b"other", b"x" * 1000]
    a, b = ogg.paginate(1, packets, list(range(len(packets)))), ogg.paginate(2, other, [0, 9])
    mixed = [p for pair in zip(a, b) for p in pair] + a[len(b) :] + b[len(a) :]  # noqa: B905
    streams, damaged = ogg.demultiplex(b"".join(map(ogg.page_bytes, mixed)))
    assert not damaged and streams[1].packets == packets and streams[2].packets == other
    assert streams[1].ended and streams[1].gaps == 0 and streams[1].granules[-1] == len(packets) - 1


def test_damage_is_noticed_and_skipped():
    raw = bytearray(ogg.write_payload(ogg.pad(b"ab" * 100_000), 200_000))
    raw[len(raw) // 2] ^= 1
    media = ogg.read_payload(bytes(raw))
    assert media.damaged == 1 and 0 < len(media.payload) < 200_000
    for junk in (b"", b"OggS", b"no media at all", bytes(raw[:100])):
        assert ogg.read_payload(junk).payload == b""


@pytest.mark.parametrize("sizes", [[2000], [576] * 6, [2000, 100, 3000, 510, 0, 700]])
def test_each_lost_page_costs_its_packets_alone(sizes):
    """Pages of at most two segments, so that packets run over three and more; whatever page is lost, no cut packet is returned."""
    rng = random.Random(11)
    packets = [b"head", *(rng.randbytes(n) for n in sizes)]
    ends = [sum(sizes[:k]) for k in range(len(packets))]
    pages = ogg.paginate(1, packets, ends, most=2)
    assert len(pages) > 4
    held, k = [], 0  # the packets that each page holds a part of
    for page in pages:
        held.append(set())
        for lace in page.segments:
            held[-1].add(k)
            k += lace < 255
    for lost in [{i} for i in range(len(pages))] + [{i, i + 2} for i in range(len(pages) - 2)]:
        streams, damaged = ogg.demultiplex(b"".join(ogg.page_bytes(p) for i, p in enumerate(pages) if i not in lost))
        cut = set().union(*(held[i] for i in lost))
        whole = [k for k in range(len(packets)) if k not in cut]
        assert streams[1].packets == [packets[k] for k in whole] and streams[1].gaps == len(lost) and not damaged
        known = ogg.packet_ends(streams[1])
        assert all(e in (None, ends[k]) for e, k in zip(known, whole, strict=True))
    streams, _ = ogg.demultiplex(b"".join(map(ogg.page_bytes, pages)))
    assert streams[1].gaps == 0 and ogg.packet_ends(streams[1]) == ends


def test_granules_give_times():
    stream = ogg.Stream([b"h", b"a" * 576, b"b" * 576, b"c" * 100, b"d" * 7], [-1, -1, -1, 1252, -1], [True, True, False, True, False])
    assert ogg.packet_ends(stream) == [None, None, 1152, 1252, None]
    media = ogg.read_payload(ogg.write_payload(ogg.pad(b"x" * 1200), 1200))
    assert media.times == [576 / 8000, 1152 / 8000, 1728 / 8000] and media.duration == 1728 / 8000


def test_columns_of_damaged_files(spark):
    raw = ogg.write_payload(ogg.pad(b"ab" * 300), 600)
    rows = spark.createDataFrame([(1, raw), (2, raw[:-1]), (3, None), (4, b"junk")], "id long, media binary")
    got = {r.id: r for r in ogg.decode(rows, ["id"]).collect()}
    assert got[1].times == [576 / 8000, 1152 / 8000] and (got[1].gaps, got[1].damaged, got[1].n_bytes) == (0, 0, 600)
    assert got[2].damaged == 1 and got[2].gaps == 1
    assert got[3].payload == got[4].payload == b"" and got[3].times == []
