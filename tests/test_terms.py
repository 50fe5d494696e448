import math
import uuid

import pytest

from colonnade.functions import timeuuid
from colonnade.functions.token import murmur3, token
from colonnade.lang.parser import parse
from colonnade.plans.terms import Terms
from colonnade.plans.types import UNSET, CqlType, Duration, Misfit, parse_duration, resolve


def value(text, binds=(), now=1_700_000_000_123):
    return Terms(binds, lambda: now).value(parse(f"INSERT INTO t (a) VALUES ({text})").values[0])


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("1 + 2", 3),
        ("2 * 1.5", 3.0),
        ("5 / 2", 2),
        ("-5 / 2", -2),
        ("17 % 5", 2),
        ("-5 % 2", -1),
        ("'hel' + 'lo'", "hello"),
        ("-(7)", -7),
        ("1 / 0", None),
        ("1 % 0", None),
        ("1.5 % 1.0", None),
        ("1 + null", None),
        ("'a' - 'b'", None),
        ("9223372036854775807 + 1", -(1 << 63)),
        ("1.0 / 0.0", math.inf),
        ("toTimestamp(minTimeuuid(1234567890))", 1234567890),
        ("toDate(86400000)", 1),
        ("toDate(-1)", 0),
        ("toUnixTimestamp(maxTimeuuid(5))", 5),
        ("dateOf(minTimeuuid(7))", 7),
        ("dateOf(7)", None),
        ("currentTimestamp()", 1_700_000_000_123),
        ("currentDate()", 19675),
        ("blobAsText(textAsBlob('hé'))", "hé"),
        ("blobAsInt(intAsBlob(-2))", -2),
        ("blobAsBigint(intAsBlob(1))", None),
        ("blobAsSmallint(smallintAsBlob(-3))", -3),
        ("nosuch(1)", None),
        ("(bigint)3", 3),
    ],
)
def test_values(text, wanted):
    assert value(text) == wanted


def test_unset_and_binds():
    assert value("? + 1", [UNSET]) is UNSET
    assert value("?", [41]) == 41
    assert value(":x + 1", {"x": 41}) == 42


def test_random_and_time_uuids():
    assert value("uuid()").version == 4
    made = timeuuid.Generator()
    a, b = made.next(5), made.next(5)
    assert a.version == 1 and a.time < b.time


def test_tokens_of_small_integers():
    wanted = [-3485513579396041028, -4069959284402364209, -3248873570005575792, 9010454139840013625, -2729420104000364805]
    assert [token([i], [CqlType("int")]) for i in range(5)] == wanted
    assert murmur3(b"") == 0


def test_token_columns_agree_with_the_scalar(spark):
    from pyspark.sql import functions as F

    from colonnade.functions.token import token_column

    session = spark.newSession()
    session.conf.set("spark.sql.ansi.enabled", "false")
    values = [0, 1, -1, 7, 255, -256, 1 << 40, -(1 << 63), (1 << 63) - 1]
    rows = session.createDataFrame([(v, str(v)) for v in values], "k long, s string")
    longs = rows.select("k", token_column([F.col("k")], [CqlType("bigint")]).alias("t")).collect()
    assert all(r.t == token([r.k], [CqlType("bigint")]) for r in longs)
    kinds = [CqlType("bigint"), CqlType("text")]
    both = rows.select("k", "s", token_column([F.col("k"), F.col("s")], kinds).alias("t")).collect()
    assert all(r.t == token([r.k, r.s], kinds) for r in both)


def test_tokens_of_all_lengths_and_kinds_agree_with_the_scalar(spark):
    import datetime as dt
    import random

    from pyspark.sql import functions as F

    from colonnade.functions.token import token_column

    session = spark.newSession()
    session.conf.set("spark.sql.ansi.enabled", "false")
    rng = random.Random(3)
    rows = [(n, bytearray(rng.randbytes(n)), "é🙂x"[: n % 4] * n, str(uuid.UUID(int=rng.getrandbits(128))), bool(n % 2), rng.getrandbits(15) - (1 << 14), dt.date(1970, 1, 1) + dt.timedelta(days=n * 400 - 9000), n / 3) for n in [*range(70), 255, 256, 1000]]
    frame = session.createDataFrame([*rows, (None,) * 8], "a int, b binary, c string, d string, e boolean, f smallint, g date, h double").repartition(3)
    kinds = dict(zip("abcdefgh", map(CqlType, "int blob text uuid boolean smallint date double".split()), strict=True))
    for key in ["b", "c", "d", "e", "f", "g", "h", "ab", "bc", "cd", "ecg", "ha", "abcdefg"]:
        used = [kinds[k] for k in key]
        found = frame.select(*key, token_column([F.col(k) for k in key], used).alias("t"))
        if "h" not in key:
            assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
        for r in found.collect():
            assert r.t == (None if r[0] is None else token(list(r[:-1]), used)), (key, r)


def test_durations():
    assert parse_duration("1y2mo3w4d5h6m7s8ms9us10ns") == Duration(14, 25, ((5 * 60 + 6) * 60 + 7) * 10**9 + 8_009_010)


def test_literals_fit_by_kind():
    assert resolve(300, CqlType("tinyint")) == 44
    assert resolve(uuid.UUID(int=5), CqlType("timeuuid")).endswith("05")
    for misfit, kind in ((1, "double"), ("x", "timestamp"), (1.5, "int"), ("x", "blob"), (True, "int"), ("127.0.0.1", "inet")):
        with pytest.raises(Misfit):
            resolve(misfit, CqlType(kind))


def test_uuid_order(spark):
    from pyspark.sql import functions as F

    from colonnade.operators.predicates import order_key

    ids = [timeuuid.least(ms) for ms in (5, 1_000_000, 3_000_000_000_000)]
    rows = spark.createDataFrame([(str(x),) for x in reversed(ids)], "u string")
    assert [r.u for r in rows.orderBy(order_key(F.col("u"), CqlType("timeuuid"))).collect()] == [str(x) for x in ids]
    mixed = [str(ids[0]), "00000000-0000-4000-8000-000000000000"]
    rows = spark.createDataFrame([(x,) for x in reversed(mixed)], "u string")
    assert [r.u for r in rows.orderBy(order_key(F.col("u"), CqlType("uuid"))).collect()] == mixed
