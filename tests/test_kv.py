import pytest

from colonnade.kv import KeyValue, encode, parse
from colonnade.kv.wire import CommandError


def test_commands(spark, tmp_path):
    kv = KeyValue(spark, str(tmp_path))
    assert kv.line("PING") == "PONG" and kv.line("ping hello") == "hello"
    assert kv.line("SET foo bar") == "OK" and kv.line("GET foo") == "bar" and kv.line("GET nope") is None
    kv.line("MSET a 1 b 2 a 3 odd")
    kv.flush()
    assert kv.line("MGET a b x foo") == ["3", "2", None, "bar"]
    assert kv.line("EXISTS a a x b") == 3 and kv.line("DEL a x a") == 1 and kv.line("EXISTS a") == 0
    assert kv.line("SET foo z NX") is None and kv.line("GET foo") == "bar"
    assert kv.line("SET new z XX") is None and kv.line("SET foo z XX") == "OK"
    assert kv.line("TYPE foo") == "string" and kv.line("TYPE a") == "none" and kv.line("DBSIZE") == 2
    assert kv.line("COMMAND DOCS") == [] and kv.line("SELECT 0") == "OK" and kv.line("CLIENT GETNAME") is None and kv.line("CLIENT SETNAME x") == "OK"
    assert "db0:keys=2" in kv.line("INFO") and kv.line("QUIT") == "OK"
    kv.flush()
    assert KeyValue(spark, str(tmp_path)).line("GET foo") == "z"
    assert kv.line("FLUSHALL") == "OK" and kv.line("DBSIZE") == 0
    for bad in ("NOPE", "GET", "SET a b EX 5", "SELECT 3", "SET a b WHAT", "SCAN x", "SCAN 0 COUNT"):
        with pytest.raises(CommandError):
            kv.line(bad)


def test_patterns_and_scans(spark):
    kv = KeyValue(spark)
    kv.line("MSET user:1 a user:2 b other c user:[3 d a.b e")
    assert sorted(kv.line("KEYS user:*")) == ["user:1", "user:2", "user:[3"]
    assert kv.line("KEYS user:?") and sorted(kv.line("KEYS a.b")) == ["a.b"] and kv.line("KEYS user:[3") == ["user:[3"]
    cursor, seen = "0", []
    while True:
        cursor, keys = kv.line(f"SCAN {cursor} COUNT 2")
        seen += keys
        if cursor == "0":
            break
    assert sorted(seen) == ["a.b", "other", "user:1", "user:2", "user:[3"]
    assert sorted(kv.line("SCAN 0 MATCH user:* COUNT 100")[1]) == ["user:1", "user:2", "user:[3"]


def test_framing(spark):
    whole = b"*2\r\n$3\r\nGET\r\n$3\r\nfoo\r\nPING\r\n\r\n"
    assert parse(whole) == ([["GET", "foo"], ["PING"]], b"")
    assert parse(whole + b"*1\r\n$4\r\nPI") == ([["GET", "foo"], ["PING"]], b"*1\r\n$4\r\nPI")
    assert encode([None, 3, "é", CommandError("ERR x")]) == b"*4\r\n$-1\r\n:3\r\n$2\r\n\xc3\xa9\r\n-ERR x\r\n"
    assert KeyValue(spark).serve(b"PING\r\nGET\r\n")[0].startswith(b"+PONG\r\n-ERR wrong number")


def test_runs_of_changes_are_merged_and_become_one(spark, tmp_path):
    from colonnade.kv import engine

    kv, plain = KeyValue(spark, str(tmp_path)), {}
    for k in range(engine.MAX_RUNS + 2):
        for line, changes in ((f"MSET a {k} k{k} {k}", {"a": str(k), f"k{k}": str(k)}), (f"DEL k{k - 2}", {f"k{k - 2}": None})):
            kv.line(line)
            plain |= changes
        pending = kv.frame()
        kv.flush()
        assert dict(map(tuple, pending.collect())) == {k: v for k, v in plain.items() if v is not None}
    assert len(kv.runs) < engine.MAX_RUNS
    held = {k: v for k, v in plain.items() if v is not None}
    again = KeyValue(spark, str(tmp_path))
    assert dict(map(tuple, again.frame().collect())) == held
    assert again.line("MGET a k1 k7 k9") == [held.get(k) for k in ("a", "k1", "k7", "k9")]


def test_look_ups_push_the_scan_order_down(spark, tmp_path):
    import io
    from contextlib import redirect_stdout

    frame = spark.range(5000).selectExpr("concat('k', id) AS k", "cast(id AS string) AS v")
    kv = KeyValue(spark, str(tmp_path), frame)
    kv.line("SET k7 changed")
    kv.flush()
    kv.line("DEL k8")
    kv.flush()
    assert kv.line("MGET k7 k8 k9 nobody") == ["changed", None, "9", None] and kv.line("DBSIZE") == 4999
    shown = io.StringIO()
    with redirect_stdout(shown):
        kv._at(["k7"]).explain("formatted")
    assert shown.getvalue().count("PushedFilters") == 2 and shown.getvalue().count("place") > 4
    assert all("EqualTo(place" in line or "In(place" in line for line in shown.getvalue().splitlines() if "PushedFilters" in line)
