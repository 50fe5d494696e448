"""Statements end to end, on small stored tables."""

import datetime as dt

import pytest

from colonnade.errors import AlreadyExists, ConfigurationFailure, InvalidRequest, NotSupported, SyntaxFailure
from colonnade.plans.types import UNSET
from colonnade.session import Session


class Clock:
    now = 1_700_000_000_000

    def __call__(self):
        return self.now


@pytest.fixture
def db(spark):
    clock = Clock()
    session = Session(spark, clock=clock)
    session.tick = clock
    session.execute("CREATE KEYSPACE ks WITH replication = {'class': 'SimpleStrategy', 'replication_factor': 1}")
    session.execute("USE ks")
    return session


def rows(db, text, params=()):
    return [tuple(r) for r in db.execute(text, params).collect()]


def run(db, *statements):
    for s in statements:
        db.execute(s)


def test_users(db):
    run(db, "CREATE TABLE users (id int PRIMARY KEY, name text, age int)", "INSERT INTO users (id, name, age) VALUES (1, 'Alice', 30)", "INSERT INTO users (id, name, age) VALUES (2, 'Bob', 25)")
    assert sorted(rows(db, "SELECT * FROM users")) == [(1, 30, "Alice"), (2, 25, "Bob")]
    run(db, "UPDATE users SET age = 31 WHERE id = 1", "DELETE FROM users WHERE id = 2")
    assert rows(db, "SELECT name, age FROM users") == [("Alice", 31)]
    run(db, "CREATE INDEX ON users (age)")
    assert rows(db, "SELECT id FROM users WHERE age = 31") == [(1,)]
    run(db, "TRUNCATE users")
    assert rows(db, "SELECT * FROM users") == []


def test_kind_time(db):
    run(db, "CREATE TABLE kt (kind text, time int, v int, PRIMARY KEY (kind, time))")
    for k, t in (("a", 0), ("a", 1), ("a", 2), ("b", 0)):
        run(db, f"INSERT INTO kt (kind, time, v) VALUES ('{k}', {t}, {t})")
    assert rows(db, "SELECT COUNT(*) FROM kt") == [(4,)]
    assert rows(db, "SELECT COUNT(1) FROM kt WHERE kind = 'a'") == [(3,)]
    frame = db.execute("SELECT COUNT(*) AS user_count, kind FROM kt WHERE kind IN ('a', 'b') AND time = 0")
    assert frame.columns == ["user_count"] and frame.first()[0] == 2


def test_upsert_keeps_other_cells_and_null_deletes(db):
    run(db, "CREATE TABLE u (id int PRIMARY KEY, a text, b text)", "INSERT INTO u (id, a, b) VALUES (1, 'x', 'y')", "INSERT INTO u (id, a) VALUES (1, 'z')")
    assert rows(db, "SELECT a, b FROM u") == [("z", "y")]
    run(db, "INSERT INTO u (id, b) VALUES (1, null)")
    assert rows(db, "SELECT a, b FROM u") == [("z", None)]
    db.execute("INSERT INTO u (id, a, b) VALUES (?, ?, ?)", [1, UNSET, "w"])
    assert rows(db, "SELECT a, b FROM u") == [("z", "w")]


def test_prepared_binds(db):
    run(db, "CREATE TABLE p (id int PRIMARY KEY, name text, score double)")
    q = db.prepare("INSERT INTO p (id, name, score) VALUES (?, ?, ?)")
    db.execute(q, [42, "Alice", 99.5])
    db.execute("INSERT INTO p (id, name, score) VALUES (:id, :name, :score)", {"id": 99, "name": "Bob", "score": 77.7})
    assert rows(db, "SELECT name, score FROM p WHERE id = ?", [99]) == [("Bob", 77.7)]
    assert db.prepare(q.text) is q


def test_expressions_in_values(db):
    run(db, "CREATE TABLE e (val bigint PRIMARY KEY, tag text)", "INSERT INTO e (val, tag) VALUES (1 + 2 * 3, 'he' + 'llo')")
    assert rows(db, "SELECT val, tag FROM e") == [(7, "hello")]


def test_collections(db):
    run(db, "CREATE TABLE c (id int PRIMARY KEY, l list<text>, s set<text>, m map<text, int>)", "INSERT INTO c (id, l, s, m) VALUES (1, ['a', 'b'], {'b', 'a'}, {'a': 1, 'b': 2})")
    run(db, "UPDATE c SET l = l + ['c'] WHERE id = 1", "UPDATE c SET l = ['z'] + l WHERE id = 1", "UPDATE c SET l = l - ['b'] WHERE id = 1")
    assert rows(db, "SELECT l FROM c") == [(["z", "a", "c"],)]
    run(db, "UPDATE c SET l[0] = 'X' WHERE id = 1", "UPDATE c SET l[7] = 'no' WHERE id = 1")
    assert rows(db, "SELECT l FROM c") == [(["X", "a", "c"],)]
    run(db, "DELETE l[0] FROM c WHERE id = 1", "DELETE l[9] FROM c WHERE id = 1", "UPDATE c SET l[1] = null WHERE id = 1")
    assert rows(db, "SELECT l FROM c") == [(["a"],)]
    run(db, "UPDATE c SET s = s + {'c'} WHERE id = 1", "UPDATE c SET s = s - {'b'} WHERE id = 1", "DELETE s['a'] FROM c WHERE id = 1")
    assert rows(db, "SELECT s FROM c") == [(["c"],)]
    run(db, "UPDATE c SET m = m + {'c': 3, 'a': 9} WHERE id = 1", "UPDATE c SET m = m - {'b'} WHERE id = 1", "UPDATE c SET m['z'] = 42 WHERE id = 1", "DELETE m['c'] FROM c WHERE id = 1", "UPDATE c SET m['q'] = null WHERE id = 1")
    assert rows(db, "SELECT m FROM c") == [({"a": 9, "z": 42},)]
    run(db, "UPDATE c SET l = l - ['a'], s = {}, m = {} WHERE id = 1")
    assert rows(db, "SELECT l, s, m FROM c") == [(None, [], {})]


@pytest.mark.parametrize(
    "assignment",
    ["s['a'] = 'b'", "l = ['a'] - l", "l = l * ['a']", "id = 2", "l.f = 1", "n['a'] = 1", "n = n + 1", "l[0] = l"],
)
def test_refused_assignments(db, assignment):
    run(db, "CREATE TABLE c (id int PRIMARY KEY, l list<text>, s set<text>, n int)")
    with pytest.raises((InvalidRequest, SyntaxFailure)):
        run(db, f"UPDATE c SET {assignment} WHERE id = 1")


def test_collection_indexes(db):
    run(db, "CREATE TABLE ci (id int PRIMARY KEY, l list<text>, s set<int>, m map<text, int>)", "INSERT INTO ci (id, l, s, m) VALUES (1, ['a'], {5}, {'x': 1})", "INSERT INTO ci (id, l) VALUES (2, ['b'])")
    for text in ("SELECT id FROM ci WHERE s CONTAINS 5", "SELECT id FROM ci WHERE m CONTAINS KEY 'x'", "SELECT id FROM ci WHERE m['x'] = 1"):
        with pytest.raises(InvalidRequest):
            rows(db, text)
    run(db, "CREATE INDEX ON ci (s)", "CREATE INDEX mk ON ci (keys(m))", "CREATE INDEX me ON ci (entries(m))", "CREATE INDEX ON ci (values(l))")
    for text in ("s CONTAINS 5", "m CONTAINS KEY 'x'", "m['x'] = 1", "l CONTAINS 'a'"):
        assert rows(db, f"SELECT id FROM ci WHERE {text}") == [(1,)]
    for bad in ("CREATE INDEX ON ci (keys(l))", "CREATE INDEX ON ci (values(id))", "CREATE INDEX ON ci (id)", "CREATE INDEX ON ci (nope)", "CREATE INDEX x ON ci (full(m))", "CREATE INDEX x ON ci (some(m))"):
        with pytest.raises(InvalidRequest):
            run(db, bad)
    with pytest.raises(AlreadyExists):
        run(db, "CREATE INDEX mk ON ci (values(m))")
    run(db, "CREATE INDEX IF NOT EXISTS mk ON ci (values(m))", "DROP INDEX mk", "DROP INDEX IF EXISTS mk")
    with pytest.raises(InvalidRequest):
        run(db, "DROP INDEX mk")


def test_statics(db):
    run(db, "CREATE TABLE cy (country text, name text, flag text STATIC, PRIMARY KEY (country, name))", "INSERT INTO cy (country, name, flag) VALUES ('Belgium', 'Boonen', 'BE')", "INSERT INTO cy (country, name) VALUES ('Belgium', 'Steels')")
    assert rows(db, "SELECT * FROM cy WHERE country = 'Belgium'") == [("Belgium", "Boonen", "BE"), ("Belgium", "Steels", "BE")]
    run(db, "INSERT INTO cy (country, flag) VALUES ('Chile', 'CL')")
    assert rows(db, "SELECT * FROM cy WHERE country = 'Chile'") == [("Chile", None, "CL")]
    assert rows(db, "SELECT * FROM cy WHERE country = 'Chile' AND name > 'A'") == []
    assert rows(db, "SELECT COUNT(*) FROM cy") == [(3,)]
    assert sorted(rows(db, "SELECT DISTINCT country, flag FROM cy")) == [("Belgium", "BE"), ("Chile", "CL")]
    run(db, "DELETE FROM cy WHERE country = 'Belgium' AND name = 'Boonen'")
    assert rows(db, "SELECT * FROM cy WHERE country = 'Belgium'") == [("Belgium", "Steels", "BE")]
    run(db, "DELETE FROM cy WHERE country = 'Belgium' AND name = 'Steels'")
    assert rows(db, "SELECT * FROM cy WHERE country = 'Belgium'") == []
    run(db, "DELETE flag FROM cy WHERE country = 'Chile'")
    assert rows(db, "SELECT * FROM cy") == []
    for bad in ("UPDATE cy SET flag = 'x' WHERE country = 'a' AND name = 'b'", "DELETE flag FROM cy WHERE country = 'a' AND name = 'b'", "SELECT DISTINCT name FROM cy"):
        with pytest.raises(InvalidRequest):
            db.execute(bad)


def test_range_deletes_and_missing_keys(db):
    run(db, "CREATE TABLE d (pk int, ck int, val text, PRIMARY KEY (pk, ck))", *(f"INSERT INTO d (pk, ck, val) VALUES ({p}, {c}, 'v')" for p, c in ((1, 1), (1, 2), (1, 3), (2, 1))))
    run(db, "DELETE FROM d WHERE pk = 1 AND ck > 1 AND ck < 3")
    assert sorted(rows(db, "SELECT pk, ck FROM d")) == [(1, 1), (1, 3), (2, 1)]
    run(db, "DELETE FROM d WHERE pk = 1", "INSERT INTO d (pk, ck, val) VALUES (1, 9, 'w')")
    assert sorted(rows(db, "SELECT pk, ck, val FROM d")) == [(1, 9, "w"), (2, 1, "v")]
    wrong = {
        "UPDATE d SET val = 'x' WHERE pk = 1": "Some clustering keys are missing: ck",
        "UPDATE d SET val = 'x' WHERE ck = 1": "Some partition key parts are missing: pk",
        "DELETE val FROM d WHERE pk = 1 AND ck > 2": "Range deletions are not supported for specific columns",
        "DELETE FROM d WHERE pk > 1": "Only EQ and IN relation are supported on the partition key",
        "DELETE FROM d WHERE token(pk) > 1": "The token function cannot be used in WHERE clauses for DELETE",
        "UPDATE d SET val = 'x' WHERE pk = 1 AND ck = 1 AND val = 'y'": "Non PRIMARY KEY columns found in where clause: val",
        "UPDATE d SET val = 'x', val = 'y' WHERE pk = 1 AND ck = 1": "Column val is assigned twice in UPDATE",
        "INSERT INTO d (pk, val) VALUES (1, 'x')": "Missing mandatory PRIMARY KEY part ck",
        "INSERT INTO d (pk, ck) VALUES (1)": "Column count does not match value count",
        "INSERT INTO d (pk, ck, pk) VALUES (1, 1, 1)": "Multiple definitions of identifier pk",
        "INSERT INTO d (pk, ck, val) VALUES (1, 1, 5)": "Incompatible literal for column type",
        "INSERT INTO d (pk, ck, nope) VALUES (1, 1, 5)": "Undefined column name nope",
        "INSERT INTO d VALUES (1, 1, 'x')": "Column count does not match value count",
        "INSERT INTO d (pk, ck) VALUES (1, 1) USING TTL -1": "A TTL must be greater or equal to 0",
        "INSERT INTO d (pk, ck) VALUES (1, 1) USING TTL 700000000": "ttl is too large.",
        "SELECT JSON pk FROM d": "SELECT JSON is not supported",
        "SELECT pk FROM d GROUP BY pk": "GROUP BY is not supported",
        "SELECT pk FROM d PER PARTITION LIMIT 1": "PER PARTITION LIMIT is not supported",
        "SELECT max(ck) FROM d": "Unknown function max",
        "SELECT nope FROM d": "Undefined column name nope",
        "SELECT ttl(ck) FROM d": "Cannot use selection function ttl on PRIMARY KEY part ck",
        "INSERT INTO d (pk, ck) VALUES (1, 1) IF NOT EXISTS": "not supported",
        "SELECT * FROM nowhere": "Table 'ks.nowhere' does not exist",
        "SELECT * FROM x.y": "Keyspace 'x' does not exist",
        "INSERT INTO system.local (key) VALUES ('x')": "system keyspaces cannot be modified",
    }
    for text, message in wrong.items():
        with pytest.raises(InvalidRequest) as e:
            db.execute(text)
        assert message in str(e.value), text
    with pytest.raises(InvalidRequest, match="Invalid unset value for column pk"):
        db.execute("INSERT INTO d (pk, ck) VALUES (?, 1)", [UNSET])


def test_clustering_orders(db):
    run(db, "CREATE TABLE o (k int, c int, v text, PRIMARY KEY (k, c)) WITH CLUSTERING ORDER BY (c DESC)", *(f"INSERT INTO o (k, c, v) VALUES (0, {c}, 'v{c}')" for c in range(5)))
    assert [r[0] for r in rows(db, "SELECT c FROM o WHERE k = 0")] == [4, 3, 2, 1, 0]
    assert [r[0] for r in rows(db, "SELECT c FROM o WHERE k = 0 ORDER BY c ASC LIMIT 2")] == [0, 1]
    assert [r[0] for r in rows(db, "SELECT v FROM o WHERE k = 0 AND c >= 1 AND c < 4 ORDER BY c DESC")] == ["v3", "v2", "v1"]
    assert rows(db, "SELECT c FROM o WHERE k = 0 LIMIT 0") == []
    assert len(rows(db, "SELECT c FROM o WHERE k = 0 LIMIT ?", [-1])) == 5


def test_tuples_of_clustering_columns(db):
    run(db, "CREATE TABLE t (k int, c1 int, c2 int, tag text, PRIMARY KEY (k, c1, c2))", *(f"INSERT INTO t (k, c1, c2) VALUES (1, {a}, {b})" for a, b in ((1, 1), (1, 2), (2, 1), (2, 2))))

    def some(where):
        return [tuple(r) for r in rows(db, f"SELECT c1, c2 FROM t WHERE k = 1 AND {where}")]

    assert some("(c1, c2) > (1, 2)") == [(2, 1), (2, 2)]
    assert some("(c1, c2) >= (1, 2)") == [(1, 2), (2, 1), (2, 2)]
    assert some("(c1, c2) < (2, 1)") == [(1, 1), (1, 2)]
    assert some("(c1, c2) = (2, 1)") == [(2, 1)]
    assert some("(c1, c2) IN ((1, 1), (2, 2), (9, 9))") == [(1, 1), (2, 2)]
    run(db, "DELETE FROM t WHERE k = 1 AND (c1, c2) IN ((1, 1), (2, 2))")
    assert some("c1 >= 0") == [(1, 2), (2, 1)]


def test_partitions_in_listed_order(db):
    run(db, "CREATE TABLE p (pk text, ck int, v text, PRIMARY KEY (pk, ck))", *(f"INSERT INTO p (pk, ck, v) VALUES ('{k}', {c}, '{v}')" for k, c, v in (("a", 3, "three"), ("b", 1, "one"), ("c", 2, "two"))))
    assert [r[0] for r in rows(db, "SELECT v FROM p WHERE pk IN ('a', 'b', 'c') ORDER BY ck")] == ["one", "two", "three"]
    assert [r[0] for r in rows(db, "SELECT v FROM p WHERE pk IN ('c', 'a', 'c')")] == ["two", "three", "two"]
    assert rows(db, "SELECT v FROM p WHERE pk IN ()") == []


def test_counters(db):
    run(db, "CREATE TABLE n (k int PRIMARY KEY, c counter)", "UPDATE n SET c = c + 5 WHERE k = 1", "UPDATE n SET c = c - 2 WHERE k = 1", "UPDATE n SET c = c + 1 WHERE k = 2")
    assert sorted(rows(db, "SELECT k, c FROM n")) == [(1, 3), (2, 1)]
    for bad in ("INSERT INTO n (k, c) VALUES (1, 1)", "UPDATE n SET c = 5 WHERE k = 1", "UPDATE n SET c = c + null WHERE k = 1", "CREATE TABLE x (k int PRIMARY KEY, c counter, v int)", "CREATE TABLE x (k counter PRIMARY KEY)", "SELECT k FROM n WHERE c = null ALLOW FILTERING"):
        with pytest.raises(InvalidRequest):
            db.execute(bad)


def test_expiry_and_writing_time(db):
    run(db, "CREATE TABLE x (k int, c int, a int, b int, PRIMARY KEY (k, c))", "INSERT INTO x (k, c, a) VALUES (1, 1, 1) USING TTL 10 AND TIMESTAMP 77", "INSERT INTO x (k, c, a, b) VALUES (1, 2, 1, 1) USING TTL 10", "UPDATE x SET b = 2 WHERE k = 1 AND c = 2", "INSERT INTO x (k, c) VALUES (1, 3) USING TTL 5", "INSERT INTO x (k, c, a) VALUES (1, 4, 1)")
    assert rows(db, "SELECT c, ttl(a), writetime(a) FROM x WHERE k = 1 AND c = 1") == [(1, 10, 77)]
    db.tick.now += 6_000
    assert rows(db, "SELECT c, ttl(a) FROM x WHERE k = 1") == [(1, 4), (2, 4), (4, None)]
    db.tick.now += 6_000
    assert rows(db, "SELECT c, a, ttl(a) FROM x WHERE k = 1") == [(2, 1, 0), (4, 1, None)]
    assert rows(db, "SELECT COUNT(*) FROM x") == [(2,)]
    hiding = Session(db.spark, db.store.root, clock=db.tick, expire_cells=True)
    assert [tuple(r) for r in hiding.execute("SELECT c, a, b FROM ks.x WHERE k = 1").collect()] == [(2, None, 2), (4, 1, None)]


def test_default_time_to_live(db):
    run(db, "CREATE TABLE x (k int PRIMARY KEY, a int) WITH default_time_to_live = 10", "INSERT INTO x (k, a) VALUES (1, 1)", "INSERT INTO x (k, a) VALUES (2, 1) USING TTL 0")
    db.tick.now += 11_000
    assert rows(db, "SELECT k FROM x") == [(2,)]


def test_batches(db):
    run(db, "CREATE TABLE b (k int PRIMARY KEY, v text)", "BEGIN BATCH USING TTL 60 INSERT INTO b (k, v) VALUES (1, 'a'); INSERT INTO b (k, v) VALUES (2, 'b') USING TTL 0; APPLY BATCH")
    assert sorted(rows(db, "SELECT k, ttl(v) FROM b")) == [(1, 60), (2, None)]
    insert = db.prepare("INSERT INTO b (k, v) VALUES (?, ?)")
    db.batch([(insert, [3, "c"]), ("DELETE FROM b WHERE k = 1", [])])
    assert sorted(r[0] for r in rows(db, "SELECT k FROM b")) == [2, 3]
    with pytest.raises(InvalidRequest):
        db.execute("BEGIN BATCH DELETE FROM b WHERE k = 2; INSERT INTO b (k, v) VALUES (9, 9); APPLY BATCH")
    assert sorted(r[0] for r in rows(db, "SELECT k FROM b")) == [2, 3]
    with pytest.raises(InvalidRequest):
        db.batch([("SELECT * FROM b", [])])


def test_user_types_tuples_and_frozen_collections(db):
    run(db, "CREATE TYPE address (street text, city text, zip int)", "CREATE TABLE a (id int PRIMARY KEY, home frozen<address>, t tuple<int, text, boolean>, nums frozen<list<int>>, m map<text, frozen<map<text, set<int>>>>)")
    run(db, "INSERT INTO a (id, home, t, nums, m) VALUES (1, {city: 'X', street: 'Y'}, (1, 'a'), [10, 20, 30], {'k': {'j': {2, 1}}})")
    (got,) = rows(db, "SELECT home, t, nums, m FROM a")
    assert tuple(got[0]) == ("Y", "X", None) and tuple(got[1]) == (1, "a", None) and got[2] == [10, 20, 30] and got[3] == {"k": {"j": [1, 2]}}
    assert rows(db, "SELECT id FROM a WHERE nums = [10, 20, 30] ALLOW FILTERING") == [(1,)]
    run(db, "ALTER TYPE address ADD country text")
    assert tuple(rows(db, "SELECT home FROM a")[0][0]) == ("Y", "X", None, None)
    run(db, "ALTER TYPE address RENAME zip TO code")
    assert db.execute("SELECT home FROM a").first().home.asDict() == {"street": "Y", "city": "X", "code": None, "country": None}
    with pytest.raises(InvalidRequest):
        run(db, "DROP TYPE address")
    run(db, "DROP TABLE a", "DROP TYPE address", "DROP TYPE IF EXISTS address")


def test_types_round_trip(db):
    run(db, "CREATE TABLE ty (k int PRIMARY KEY, a ascii, b blob, c date, d double, e float, f boolean, g smallint, h tinyint, i timestamp, j time, l timeuuid, n uuid, o duration, p decimal, q varint, r inet, s bigint)")
    db.execute("INSERT INTO ty (k, a, b, p, q, r, e) VALUES (1, 'x', ?, ?, ?, ?, 1.5)", [b"\x00\xff", 1.25, 7, "127.0.0.1"])
    run(db, "INSERT INTO ty (k, c, d, f, g, h, i, j, l, n, o, s) VALUES (1, 19675, 2.5, true, 300, 5, 1700000000123, 7, minTimeuuid(1000), 123e4567-e89b-42d3-a456-426614174000, 1mo2d3ns, -1)")
    r = db.execute("SELECT * FROM ty").first().asDict(recursive=True)
    assert r["b"] == b"\x00\xff" and r["r"] == b"\x7f\x00\x00\x01" and float(r["p"]) == 1.25 and int(r["q"]) == 7
    assert r["c"] == dt.date(2023, 11, 14) and (r["g"], r["h"], r["j"], r["s"], r["f"], r["d"]) == (300, 5, 7, -1, True, 2.5)
    assert r["o"] == {"months": 1, "days": 2, "nanos": 3} and r["n"] == "123e4567-e89b-42d3-a456-426614174000"
    (got,) = rows(db, "SELECT toDate(i), toUnixTimestamp(i), unixTimestampOf(l), blobAsSmallint(smallintAsBlob(g)), blobAsBigint(bigintAsBlob(s)), CAST(k AS blob), CAST(a AS int), textAsBlob(a) FROM ty")
    assert got == (dt.date(2023, 11, 14), 1700000000123, 1000, 300, -1, b"\x00\x00\x00\x01", None, b"x")
    assert rows(db, "SELECT bigintAsBlob(writetime(s)) FROM ty")[0][0] == (1_700_000_000_000_000).to_bytes(8, "big")
    assert rows(db, "SELECT k FROM ty WHERE i = 1700000000123 AND n = 123e4567-e89b-42d3-a456-426614174000 AND d > 2 ALLOW FILTERING") == [(1,)]
    with pytest.raises(InvalidRequest):
        db.execute("INSERT INTO ty (k, d) VALUES (1, 5)")


def test_definitions(db):
    for bad in (
        "CREATE TABLE z (a int, b int)",
        "CREATE TABLE z (a int PRIMARY KEY, b int PRIMARY KEY)",
        "CREATE TABLE z (a int PRIMARY KEY, a int)",
        "CREATE TABLE z (id int PRIMARY KEY, info text STATIC)",
        "CREATE TABLE z (a int STATIC, b int, PRIMARY KEY (a, b))",
        "CREATE TABLE z (a int PRIMARY KEY, b list<counter>)",
        "CREATE TABLE z (a nosuch PRIMARY KEY)",
        "CREATE TABLE z (a int, b int, c int, PRIMARY KEY (a, b, c)) WITH CLUSTERING ORDER BY (c DESC)",
        "CREATE TABLE z (a int PRIMARY KEY, b text MASKED WITH DEFAULT)",
    ):
        with pytest.raises(InvalidRequest):
            db.execute(bad)
    run(db, "CREATE TABLE z (a int PRIMARY KEY, b text)", "CREATE TABLE IF NOT EXISTS z (a int PRIMARY KEY)", "INSERT INTO z (a, b) VALUES (1, 'x')", "ALTER TABLE z ADD c int", "UPDATE z SET c = 5 WHERE a = 1")
    with pytest.raises(AlreadyExists):
        db.execute("CREATE TABLE z (a int PRIMARY KEY)")
    assert rows(db, "SELECT * FROM z") == [(1, "x", 5)]
    run(db, "ALTER TABLE z DROP b", "ALTER TABLE z ADD b text")
    assert rows(db, "SELECT * FROM z") == [(1, None, 5)]
    run(db, "ALTER TABLE z DROP b")
    for bad in ("ALTER TABLE z ADD b int", "ALTER TABLE z DROP nope", "ALTER TABLE z DROP a", "ALTER TABLE z ADD c int"):
        with pytest.raises(InvalidRequest):
            db.execute(bad)
    with pytest.raises(NotSupported):
        db.execute("ALTER TABLE z RENAME c TO d")
    run(db, "ALTER TABLE z WITH default_time_to_live = 5 AND comment = 'x'", "ALTER TABLE IF EXISTS nowhere ADD x int")
    with pytest.raises(ConfigurationFailure):
        db.execute("ALTER KEYSPACE ks WITH replication = {'class': 'Nope'}")
    with pytest.raises(AlreadyExists):
        db.execute("CREATE KEYSPACE ks")
    run(db, "DROP TABLE z", "DROP TABLE IF EXISTS z", "DROP KEYSPACE ks", "DROP KEYSPACE IF EXISTS ks")
    with pytest.raises(InvalidRequest, match="No keyspace has been specified"):
        db.execute("SELECT * FROM z")


def test_snapshots_outlive_the_session(spark, tmp_path):
    first = Session(spark, str(tmp_path))
    run(first, "CREATE KEYSPACE ks", "CREATE TABLE ks.t (k int PRIMARY KEY, v text)", "INSERT INTO ks.t (k, v) VALUES (1, 'a')")
    assert rows(first, "SELECT * FROM ks.t") == [(1, "a")]
    run(first, "INSERT INTO ks.t (k, v) VALUES (2, 'b')")
    first.flush(first.catalog.table("ks", "t"))
    again = Session(spark, str(tmp_path))
    assert sorted(rows(again, "SELECT * FROM ks.t")) == [(1, "a"), (2, "b")]


def test_system_tables(db):
    run(db, "CREATE TABLE s (a int, b text, PRIMARY KEY (a, b)) WITH CLUSTERING ORDER BY (b DESC)", "CREATE INDEX bi ON s (b)", "CREATE TYPE ut (x int)")
    assert rows(db, "SELECT column_name, clustering_order, kind, position, type FROM system_schema.columns WHERE keyspace_name = 'ks' AND table_name = 's'") == [("a", "none", "partition_key", 0, "int"), ("b", "desc", "clustering", 0, "text")]
    assert rows(db, "SELECT index_name, options FROM system_schema.indexes WHERE keyspace_name = 'ks'") == [("bi", {"target": "b"})]
    assert rows(db, "SELECT type_name, field_names FROM system_schema.types WHERE keyspace_name = 'ks'") == [("ut", ["x"])]
    assert rows(db, "SELECT key, partitioner FROM system.local")[0][0] == "local"
    for empty in ("system.peers", "system.peers_v2", "system_schema.views", "system_schema.triggers", "system_schema.functions", "system_schema.aggregates", "system_schema.dropped_columns"):
        assert rows(db, f"SELECT * FROM {empty}") == []
    assert ("system_schema",) in rows(db, "SELECT keyspace_name FROM system_schema.keyspaces")


def test_token_ranges_follow_tokens_not_values(db):
    run(db, "CREATE TABLE tk (k int PRIMARY KEY)", *(f"INSERT INTO tk (k) VALUES ({k})" for k in range(5)))
    assert [r[0] for r in rows(db, "SELECT k FROM tk LIMIT 5")] == [1, 0, 2, 4, 3]
    assert sorted(r[0] for r in rows(db, "SELECT k FROM tk WHERE k > 2")) == [3, 4]
    assert rows(db, "SELECT token(k) FROM tk WHERE k = 3") == [(9010454139840013625,)]
    assert sorted(r[0] for r in rows(db, "SELECT k FROM tk WHERE token(k) <= token(0)")) == [0, 1]
    assert [r[0] for r in Session(db.spark, db.store.root, token_order=True).execute("SELECT k FROM ks.tk").collect()] == [1, 0, 2, 4, 3]


def test_streams_upsert(db, tmp_path):
    from colonnade.streaming import upsert_stream

    run(db, "CREATE TABLE st (k bigint PRIMARY KEY, v bigint)", "INSERT INTO st (k, v) VALUES (1, 0)")
    db.spark.range(1, 4).selectExpr("id AS k", "id * 10 AS v", "id AS at").union(db.spark.sql("SELECT 1L, 99L, 50L")).write.parquet(str(tmp_path / "in"))
    stream = db.spark.readStream.schema("k long, v long, at long").parquet(str(tmp_path / "in"))
    upsert_stream(db, "ks.st", stream, order="at").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(rows(db, "SELECT k, v FROM st")) == [(1, 99), (2, 20), (3, 30)]


def test_known_partitions_open_only_their_shards(spark, tmp_path):
    db = Session(spark, str(tmp_path), shards=16)
    run(db, "CREATE KEYSPACE w", "CREATE TABLE w.t (k int PRIMARY KEY, v int)", *(f"INSERT INTO w.t (k, v) VALUES ({k}, {k})" for k in range(40)))
    assert len(rows(db, "SELECT * FROM w.t")) == 40
    assert len(db.execute("SELECT * FROM w.t WHERE k = 7").inputFiles()) == 1
    assert len(db.execute("SELECT * FROM w.t WHERE k IN (7, 8, 9)").inputFiles()) <= 3
    before = set(db.execute("SELECT * FROM w.t").inputFiles())
    run(db, "UPDATE w.t SET v = 70 WHERE k = 7")
    after = set(db.execute("SELECT * FROM w.t").inputFiles())
    assert len(before - after) == 1 and rows(db, "SELECT v FROM w.t WHERE k = 7") == [(70,)]
    run(db, "DELETE FROM w.t WHERE k IN (7, 8)")
    assert len(rows(db, "SELECT * FROM w.t")) == 38


def test_results_outlive_the_next_write(db):
    run(db, "CREATE TABLE r (k int PRIMARY KEY, v int)", "INSERT INTO r (k, v) VALUES (1, 1)")
    pending = db.execute("SELECT * FROM r")
    run(db, "UPDATE r SET v = 2 WHERE k = 1")
    assert rows(db, "SELECT v FROM r") == [(2,)]
    assert [tuple(x) for x in pending.collect()] == [(1, 1)]


def test_null_keys_restrict_nothing(db):
    run(db, "CREATE TABLE nk (k int PRIMARY KEY, v int)", "INSERT INTO nk (k, v) VALUES (1, 1)")
    assert rows(db, "SELECT k FROM nk WHERE k = null") == [(1,)]
    assert rows(db, "SELECT k FROM nk WHERE k IN (null, 1)") == [(1,)]
    assert rows(db, "SELECT k FROM nk WHERE v != null ALLOW FILTERING") == []


def test_bulk_changes_merge_by_key(db):
    run(db, "CREATE TABLE bk (k text, c int, v int, w text, PRIMARY KEY (k, c))", "INSERT INTO bk (k, c, v, w) VALUES ('a', 1, 1, 'old') USING TTL 100", "INSERT INTO bk (k, c, v) VALUES ('z', 9, 9)")
    changes = db.spark.createDataFrame([("a", 1, 5), ("b", 2, 6), ("a", 3, None)], "k string, c int, v int")
    db.apply_changes("ks.bk", changes)
    assert sorted(rows(db, "SELECT k, c, v, w FROM bk")) == [("a", 1, 5, "old"), ("a", 3, None, None), ("b", 2, 6, None), ("z", 9, 9, None)]
    assert rows(db, "SELECT ttl(v), ttl(w) FROM bk WHERE k = 'a' AND c = 1") == [(None, 100)]


@pytest.mark.parametrize("rows_in", [[(None, 1, 2)], [("a", None, 2)], [("a", 1, 2), ("a", 1, 3)], [("b", 1, 1), (None, 1, 2)]])
def test_bulk_changes_with_bad_keys_change_nothing(db, rows_in):
    run(db, "CREATE TABLE bad (k text, c int, v int, PRIMARY KEY (k, c))", "INSERT INTO bad (k, c, v) VALUES ('a', 1, 1)")
    with pytest.raises(InvalidRequest):
        db.apply_changes("ks.bad", db.spark.createDataFrame(rows_in, "k string, c int, v int"))
    assert rows(db, "SELECT k, c, v FROM bad") == [("a", 1, 1)]
    db.apply_changes("ks.bad", db.spark.createDataFrame([("a", 1, 9), ("n", 2, 2)], "k string, c int, v int"))
    assert sorted(rows(db, "SELECT k, c, v FROM bad")) == [("a", 1, 9), ("n", 2, 2)]
    with pytest.raises(InvalidRequest, match="Missing mandatory"):
        db.apply_changes("ks.bad", db.spark.createDataFrame([("a", 1)], "k string, v int"))


def test_a_pointer_never_names_a_shard_without_number(db):
    run(db, "CREATE TABLE sh (k int PRIMARY KEY, v int)", "INSERT INTO sh (k, v) VALUES (1, 1)")
    table = db.catalog.table("ks", "sh")
    assert rows(db, "SELECT v FROM sh") == [(1,)]
    whole, _ = db.store.read(table)
    with pytest.raises(InvalidRequest):
        db.store.write(table, whole.withColumn("_token", whole["_token"] * None), None)
    assert rows(db, "SELECT v FROM sh") == [(1,)]


def test_shards_multiply_as_a_table_grows(spark, tmp_path):
    db = Session(spark, str(tmp_path), shards=1)
    db.store.shard_bytes = 20_000
    run(db, "CREATE KEYSPACE w", "CREATE TABLE w.t (k bigint PRIMARY KEY, v text)", "INSERT INTO w.t (k, v) VALUES (-1, 'first')")
    pending = db.execute("SELECT * FROM w.t")
    db.apply_changes("w.t", spark.range(3000).selectExpr("id AS k", "sha2(cast(id AS string), 512) AS v"))
    table = db.catalog.table("w", "t")
    shards = db.store._pointer(table)["shards"]
    assert shards >= 8 and pending.count() == 1
    assert db.execute("SELECT COUNT(*) FROM w.t").first()[0] == 3001
    before = set(db.execute("SELECT * FROM w.t").inputFiles())
    run(db, "UPDATE w.t SET v = 'new' WHERE k = 7")
    assert rows(db, "SELECT v FROM w.t WHERE k = 7") == [("new",)]
    after = set(db.execute("SELECT * FROM w.t").inputFiles())
    assert 0 < len(before - after) <= len(before) / 4
    assert len(db.execute("SELECT * FROM w.t WHERE k = 7").inputFiles()) < len(after) / 4
    assert Session(spark, str(tmp_path)).execute("SELECT COUNT(*) FROM w.t").first()[0] == 3001
