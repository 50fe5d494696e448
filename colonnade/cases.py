"""Small cases of the inventory's items, each a query that answers with text, held against literal rows in DuckDB SQL.

A case sets tables up and asks statements by label. What a statement returns is one row per row, its columns as text;
what it refuses is one row with the error's status class, and its wording where that is fixed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.errors import FILTERING, StatementError
from colonnade.kv import KeyValue
from colonnade.kv.engine import CommandError
from colonnade.plans.types import UNSET
from colonnade.session import Session

#: The moment at which all cases run, in milliseconds.
NOW = 1_700_000_000_000

#: name -> (statements before, [(label, statement[, parameters]), ...], {label: answers in any order})
Ask = tuple[str, str] | tuple[str, str, list]
CASES: dict[str, tuple[list[str], list[Ask], dict[str, list[str]]]] = {}


def _text(frame: DataFrame, name: str) -> Column:
    kind, col = frame.schema[name].dataType, F.col(f"`{name}`")
    return F.coalesce(F.lower(F.hex(col)) if isinstance(kind, T.BinaryType) else col.cast("string"), F.lit("null"))


def _answers(session: Session, label: str, statement: str, params: list | tuple = ()) -> list[tuple[str, str]]:
    """(label, answer) of each of the few rows; taken at once, since later statements may drop the table."""
    try:
        found = session.execute(statement, params)
    except StatementError as e:
        worded = f" {e}" if label.endswith("!") else ""
        return [(label, f"error {e.code:04x}{worded}")]
    if found is None:
        return [(label, "done")]
    return [(label, "|".join(r)) for r in found.select(*(_text(found, c) for c in found.columns)).collect()]


def _run(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before, asked, _ = CASES[name]
        now = [NOW]
        session = Session(spark, clock=lambda: now[0])
        session.execute("CREATE KEYSPACE w")
        session.execute("USE w")
        for statement in before:
            if statement.startswith("tick "):
                now[0] += int(statement[5:])
            else:
                session.execute(statement)
        return session.spark.createDataFrame([row for ask in asked for row in _answers(session, *ask)], "label string, answer string")

    return run


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _literal(rows: dict[str, list[str]]) -> str:
    pairs = ", ".join(f"({_quoted(k)}, {_quoted(a)})" for k, answers in rows.items() for a in answers)
    return f"SELECT * FROM (VALUES {pairs}) t(label, answer)"


_FILTERING = f"error 2200 {FILTERING}"
_T = "CREATE TABLE t (k int, c1 int, c2 int, v int, PRIMARY KEY (k, c1, c2))"
_P = "CREATE TABLE p (a int, b int, c int, v int, PRIMARY KEY ((a, b), c))"
_FILL = [f"INSERT INTO t (k, c1, c2, v) VALUES ({k}, {a}, {b}, {k + a + b})" for k in (1, 2) for a in (1, 2) for b in (1, 2)]
_FILL += [f"INSERT INTO p (a, b, c, v) VALUES ({a}, {b}, {a + b}, {a})" for a in (1, 2) for b in (1, 2)]

CASES["filtering_rules"] = (
    [_T, _P, *_FILL],
    [
        ("R1 unindexed column!", "SELECT k FROM t WHERE v = 3"),
        ("R1 allowed", "SELECT k, c1, c2 FROM t WHERE v = 3 ALLOW FILTERING"),
        ("R2 part of the key!", "SELECT c FROM p WHERE a = 1"),
        ("R2 allowed", "SELECT b, c FROM p WHERE a = 1 ALLOW FILTERING"),
        ("R3 composite range!", "SELECT c FROM p WHERE a > 1"),
        ("R3 not equal!", "SELECT k FROM t WHERE k != 1"),
        ("R4 after a range!", "SELECT v FROM t WHERE k = 1 AND c1 > 1 AND c2 = 1"),
        ("R5 unrestricted before!", "SELECT v FROM t WHERE k = 1 AND c2 = 1"),
        ("R6 R4 waived", "SELECT c1, c2 FROM t WHERE k = 1 AND c1 > 1 AND c2 = 1 ALLOW FILTERING"),
        ("R6 R5 waived", "SELECT c1, c2 FROM t WHERE k = 1 AND c2 = 1 ALLOW FILTERING"),
        ("R9 clustering alone", "SELECT k, c2 FROM t WHERE c1 = 2"),
        ("R10 token", "SELECT COUNT(*) AS n FROM t WHERE token(k) >= token(1)"),
        ("R11 mixed tuple!", "SELECT k FROM t WHERE k = 1 AND (c1, v) = (1, 3)"),
        ("R11 allowed", "SELECT c2 FROM t WHERE k = 1 AND (c1, v) = (1, 3) ALLOW FILTERING"),
        ("R12 tuple range", "SELECT c1, c2 FROM t WHERE k = 1 AND (c1, c2) > (1, 1)"),
        ("R13 null key", "SELECT COUNT(*) AS n FROM t WHERE k = null"),
        ("R14 one value in a list", "SELECT c1, c2 FROM t WHERE k = 1 AND c1 IN (2) ORDER BY c2 DESC LIMIT 1"),
    ],
    {
        "R1 unindexed column!": [_FILTERING],
        "R1 allowed": ["1|1|1"],
        "R2 part of the key!": [_FILTERING],
        "R2 allowed": ["2|3", "1|2"],
        "R3 composite range!": [_FILTERING],
        "R3 not equal!": [_FILTERING],
        "R4 after a range!": ["error 2200 Clustering column \"c2\" cannot be restricted (preceding column \"c1\" is restricted by a non-EQ relation)"],
        "R5 unrestricted before!": ["error 2200 PRIMARY KEY column \"c2\" cannot be restricted as preceding column \"c1\" is not restricted"],
        "R6 R4 waived": ["2|1"],
        "R6 R5 waived": ["1|1", "2|1"],
        "R9 clustering alone": ["2|1", "2|2", "1|1", "1|2"],
        "R10 token": ["8"],
        "R11 mixed tuple!": [_FILTERING],
        "R11 allowed": ["1"],
        "R12 tuple range": ["1|2", "2|1", "2|2"],
        "R13 null key": ["8"],
        "R14 one value in a list": ["2|2"],
    },
)
CASES["index_rules"] = (
    ["CREATE TABLE i (k int PRIMARY KEY, a int, b int, l list<text>, s set<int>, m map<text, int>)", "INSERT INTO i (k, a, b, l, s, m) VALUES (1, 1, 1, ['a'], {5}, {'x': 1})", "INSERT INTO i (k, a, b, l, m) VALUES (2, 1, 2, ['b'], {'x': 2})", "INSERT INTO i (k, a) VALUES (3, 2)", "CREATE INDEX ON i (a)", "CREATE INDEX ON i (b)", "CREATE INDEX ON i (values(l))", "CREATE INDEX ON i (s)", "CREATE INDEX mk ON i (keys(m))", "CREATE INDEX me ON i (entries(m))", "UPDATE i SET a = 2 WHERE k = 2"],
    [
        ("R7 key before index", "SELECT b FROM i WHERE k = 1 AND a = 1 ALLOW FILTERING"),
        ("R8 the first index", "SELECT k FROM i WHERE a = 2 AND b = 2 ALLOW FILTERING"),
        ("S11 values of a list", "SELECT k FROM i WHERE l CONTAINS 'a'"),
        ("S11 values of a set", "SELECT k FROM i WHERE s CONTAINS 5"),
        ("S11 keys", "SELECT k FROM i WHERE m CONTAINS KEY 'x'"),
        ("S11 entries", "SELECT k FROM i WHERE m['x'] = 2"),
        ("M39 after an update", "SELECT k FROM i WHERE a = 2"),
        ("D16 default name", "SELECT index_name FROM system_schema.indexes WHERE keyspace_name = 'w' AND table_name = 'i'"),
        ("D16 keys of a list", "CREATE INDEX x ON i (keys(l))"),
        ("D16 sole key column", "CREATE INDEX x ON i (k)"),
        ("D17 full of a map", "CREATE INDEX x ON i (full(m))"),
        ("D16 taken name", "CREATE INDEX mk ON i (values(m))"),
        ("D19 drop", "DROP INDEX mk"),
        ("D19 dropped before", "DROP INDEX mk"),
        ("D19 if exists", "DROP INDEX IF EXISTS mk"),
        ("D18 an index of another kind", "SELECT k FROM i WHERE m CONTAINS KEY 'x' ALLOW FILTERING"),
    ],
    {
        "R7 key before index": ["1"],
        "R8 the first index": ["2"],
        "S11 values of a list": ["1"],
        "S11 values of a set": ["1"],
        "S11 keys": ["1", "2"],
        "S11 entries": ["2"],
        "M39 after an update": ["2", "3"],
        "D16 default name": ["i_a_idx", "i_b_idx", "i_l_idx", "i_s_idx", "me", "mk"],
        "D16 keys of a list": ["error 2200"],
        "D16 sole key column": ["error 2200"],
        "D17 full of a map": ["error 2200"],
        "D16 taken name": ["error 2400"],
        "D19 drop": ["done"],
        "D19 dropped before": ["error 2200"],
        "D19 if exists": ["done"],
        "D18 an index of another kind": ["1", "2"],
    },
)
CASES["select_refusals"] = (
    [_T, "CREATE TABLE n (k int PRIMARY KEY, c counter)"],
    [
        ("P11 arithmetic!", "SELECT k + 1 FROM t"),
        ("P11 constant!", "SELECT 1 FROM t"),
        ("P13 json!", "SELECT JSON k FROM t"),
        ("A5 max", "SELECT max(v) FROM t"),
        ("A5 sum", "SELECT sum(v) FROM t"),
        ("A7 distinct of a regular column", "SELECT DISTINCT v FROM t"),
        ("A8 group by!", "SELECT k FROM t GROUP BY k"),
        ("O3 order by a regular column", "SELECT k FROM t WHERE k = 1 ORDER BY v"),
        ("O8 per partition limit!", "SELECT k FROM t PER PARTITION LIMIT 1"),
        ("F14 unset!", "SELECT k FROM t WHERE k = ?", [UNSET]),
        ("F15 counter!", "SELECT k FROM n WHERE c = null ALLOW FILTERING"),
        ("P5 ttl of a key", "SELECT ttl(c1) FROM t"),
        ("unknown column!", "SELECT nope FROM t"),
        ("unknown table!", "SELECT * FROM nowhere"),
        ("unknown keyspace!", "SELECT * FROM x.y"),
    ],
    {
        "P13 json!": ["error 2200 SELECT JSON is not supported"],
        "A5 max": ["error 2200"],
        "A5 sum": ["error 2200"],
        "A7 distinct of a regular column": ["error 2200"],
        "A8 group by!": ["error 2200 GROUP BY is not supported"],
        "O3 order by a regular column": ["error 2200"],
        "O8 per partition limit!": ["error 2200 PER PARTITION LIMIT is not supported"],
        "F14 unset!": ["error 2200 Invalid unset value in where clause"],
        "F15 counter!": ["error 2200 Invalid null value for counter increment/decrement"],
        "P5 ttl of a key": ["error 2200"],
        "unknown column!": ["error 2200 Undefined column name nope"],
        "unknown table!": ["error 2200 Table 'w.nowhere' does not exist"],
        "unknown keyspace!": ["error 2200 Keyspace 'x' does not exist"],
        "P11 arithmetic!": ["error 2000 Bare term expressions in SELECT clause are not supported"],
        "P11 constant!": ["error 2000 Bare term expressions in SELECT clause are not supported"],
    },
)
CASES["select_quirks"] = (
    [_T, *[x for x in _FILL if " t " in x], "CREATE TABLE y (k int PRIMARY KEY, d double, b boolean, a ascii)", "INSERT INTO y (k, d, b, a) VALUES (1, 2.5, true, 'x')"],
    [
        ("A3 count among others", "SELECT COUNT(*) AS n, k FROM t WHERE k = 1"),
        ("O1 by clustering key", "SELECT c1, c2 FROM t WHERE k = 1 LIMIT 2"),
        ("O5 by the whole key", "SELECT k, c1, c2 FROM t WHERE k IN (2, 1) ORDER BY c1 DESC LIMIT 2"),
        ("O7 unbound limit", "SELECT c1, c2 FROM t WHERE k = 2 LIMIT ?", [UNSET]),
        ("O6 bound limit", "SELECT c1, c2 FROM t WHERE k = 2 LIMIT ?", [1]),
        ("F3 text", "SELECT k FROM y WHERE a > 'w' ALLOW FILTERING"),
        ("F3 an integer against a double", "SELECT k FROM y WHERE d > 2 ALLOW FILTERING"),
        ("F3 incomparable", "SELECT k FROM y WHERE b = 'x' ALLOW FILTERING"),
        ("F13 hint", "SELECT c1, c2 FROM t WHERE k = (int)1 AND c1 = 1 AND c2 = 2"),
        ("P15 cast", "SELECT CAST(k AS blob) AS b, CAST(a AS int) AS i, CAST(k AS int) AS k FROM y"),
        ("S5 token range", "SELECT COUNT(*) AS n FROM t WHERE k > 1"),
        ("F11 token", "SELECT COUNT(*) AS n FROM t WHERE token(k) < token(1)"),
    ],
    {
        "A3 count among others": ["4"],
        "O1 by clustering key": ["1|1", "1|2"],
        "O5 by the whole key": ["1|2|2", "2|2|2"],
        "O7 unbound limit": ["1|1", "1|2", "2|1", "2|2"],
        "O6 bound limit": ["1|1"],
        "F3 text": ["1"],
        "F3 an integer against a double": ["1"],
        "F13 hint": ["1|2"],
        "P15 cast": ["00000001|null|1"],
        "S5 token range": ["4"],
        "F11 token": ["0"],
    },
)
CASES["insert_refusals"] = (
    [_T, "CREATE TABLE n (k int PRIMARY KEY, c counter)"],
    [
        ("M2 count!", "INSERT INTO t (k, c1, c2) VALUES (1, 1)"),
        ("M2 unknown column!", "INSERT INTO t (k, c1, c2, nope) VALUES (1, 1, 1, 1)"),
        ("M2 twice!", "INSERT INTO t (k, c1, c2, k) VALUES (1, 1, 1, 1)"),
        ("M2 misfit!", "INSERT INTO t (k, c1, c2, v) VALUES (1, 1, 1, 'x')"),
        ("M2 no clustering key!", "INSERT INTO t (k, c1, v) VALUES (1, 1, 1)"),
        ("M2 no partition key", "INSERT INTO t (c1, c2, v) VALUES (1, 1, 1)"),
        ("M2 unset key!", "INSERT INTO t (k, c1, c2) VALUES (?, 1, 1)", [UNSET]),
        ("M2 counters", "INSERT INTO n (k, c) VALUES (1, 1)"),
        ("M4 without names!", "INSERT INTO t VALUES (1, 1, 1, 1)"),
        ("M5 json", "INSERT INTO t JSON '{}'"),
        ("M6 if not exists", "INSERT INTO t (k, c1, c2) VALUES (1, 1, 1) IF NOT EXISTS"),
        ("M30 negative ttl!", "INSERT INTO t (k, c1, c2) VALUES (1, 1, 1) USING TTL -1"),
        ("M30 large ttl!", "INSERT INTO t (k, c1, c2) VALUES (1, 1, 1) USING TTL 700000000"),
        ("D22 system!", "INSERT INTO system.local (key) VALUES ('x')"),
        ("nothing came of these", "SELECT COUNT(*) AS n FROM t"),
    ],
    {
        "M2 count!": ["error 2200 Column count does not match value count"],
        "M2 unknown column!": ["error 2200 Undefined column name nope"],
        "M2 twice!": ["error 2200 Multiple definitions of identifier k"],
        "M2 misfit!": ["error 2200 Incompatible literal for column type"],
        "M2 no clustering key!": ["error 2200 Missing mandatory PRIMARY KEY part c2"],
        "M2 no partition key": ["error 2200"],
        "M2 unset key!": ["error 2200 Invalid unset value for column k"],
        "M2 counters": ["error 2200"],
        "M4 without names!": ["error 2200 Column count does not match value count"],
        "M5 json": ["error 2200"],
        "M6 if not exists": ["error 2200"],
        "M30 negative ttl!": ["error 2200 A TTL must be greater or equal to 0"],
        "M30 large ttl!": ["error 2200 ttl is too large."],
        "D22 system!": ["error 2200 system keyspaces cannot be modified"],
        "nothing came of these": ["0"],
    },
)
CASES["change_refusals"] = (
    [_T, "CREATE TABLE n (k int PRIMARY KEY, c counter)", "CREATE TYPE pair (x int, y int)", "CREATE TABLE c (id int PRIMARY KEY, l list<text>, s set<text>, n int, u frozen<pair>)", "CREATE TABLE st (k int, c int, s text STATIC, v int, PRIMARY KEY (k, c))"],
    [
        ("M10 set a counter", "UPDATE n SET c = 5 WHERE k = 1"),
        ("M10 add to a plain column", "UPDATE c SET n = n + 1 WHERE id = 1"),
        ("M11 twice!", "UPDATE t SET v = 1, v = 2 WHERE k = 1 AND c1 = 1 AND c2 = 1"),
        ("M21 subscript of a plain column", "UPDATE c SET n[0] = 1 WHERE id = 1"),
        ("M21 subscript of a set", "UPDATE c SET s['a'] = 'b' WHERE id = 1"),
        ("M21 list from a value", "UPDATE c SET l = ['a'] - l WHERE id = 1"),
        ("M21 times", "UPDATE c SET l = l * ['a'] WHERE id = 1"),
        ("M21 column in a subscript", "UPDATE c SET l[0] = l WHERE id = 1"),
        ("M22 field", "UPDATE c SET u.x = 1 WHERE id = 1"),
        ("M26 a key column", "DELETE k FROM t WHERE k = 1 AND c1 = 1 AND c2 = 1"),
        ("M26 a static with a clustering key", "DELETE s FROM st WHERE k = 1 AND c = 1"),
        ("M26 a column by range!", "DELETE v FROM st WHERE k = 1 AND c > 1"),
        ("M26 no clustering key", "DELETE v FROM st WHERE k = 1"),
        ("M27 delete if", "DELETE FROM st WHERE k = 1 AND c = 1 IF EXISTS"),
        ("M27 update if", "UPDATE st SET v = 1 WHERE k = 1 AND c = 1 IF v = 2"),
        ("M28 ttl", "DELETE FROM st USING TTL 5 WHERE k = 1 AND c = 1"),
        ("M29 other column!", "UPDATE st SET v = 1 WHERE k = 1 AND c = 1 AND v = 2"),
        ("M29 key range!", "DELETE FROM st WHERE k > 1"),
        ("M29 token!", "DELETE FROM st WHERE token(k) > 1"),
        ("M7 no clustering key!", "UPDATE st SET v = 1 WHERE k = 1"),
        ("M7 no partition key!", "UPDATE st SET v = 1 WHERE c = 1"),
        ("M36 a conditional child", "BEGIN BATCH INSERT INTO st (k, c) VALUES (1, 1) IF NOT EXISTS; APPLY BATCH"),
        ("M37 a failing child", "BEGIN BATCH INSERT INTO st (k, c) VALUES (7, 7); INSERT INTO st (k, c) VALUES (1, 'x'); APPLY BATCH"),
        ("M37 nothing came of it", "SELECT COUNT(*) AS n FROM st"),
    ],
    {
        "M10 set a counter": ["error 2200"],
        "M10 add to a plain column": ["error 2200"],
        "M11 twice!": ["error 2200 Column v is assigned twice in UPDATE"],
        "M21 subscript of a plain column": ["error 2200"],
        "M21 subscript of a set": ["error 2200"],
        "M21 list from a value": ["error 2200"],
        "M21 times": ["error 2200"],
        "M21 column in a subscript": ["error 2200"],
        "M22 field": ["error 2200"],
        "M26 a key column": ["error 2200"],
        "M26 a static with a clustering key": ["error 2200"],
        "M26 a column by range!": ["error 2200 Range deletions are not supported for specific columns"],
        "M26 no clustering key": ["error 2200"],
        "M27 delete if": ["error 2200"],
        "M27 update if": ["error 2200"],
        "M28 ttl": ["error 2200"],
        "M29 other column!": ["error 2200 Non PRIMARY KEY columns found in where clause: v"],
        "M29 key range!": ["error 2200 Only EQ and IN relation are supported on the partition key (unless you use the token() function) — > is not supported"],
        "M29 token!": ["error 2200 The token function cannot be used in WHERE clauses for DELETE"],
        "M7 no clustering key!": ["error 2200 Some clustering keys are missing: c"],
        "M7 no partition key!": ["error 2200 Some partition key parts are missing: k"],
        "M36 a conditional child": ["error 2200"],
        "M37 a failing child": ["error 2200"],
        "M37 nothing came of it": ["0"],
    },
)
CASES["unset_and_expiry"] = (
    ["CREATE TABLE d (k int PRIMARY KEY, a int, b int) WITH default_time_to_live = 10", "INSERT INTO d (k, a, b) VALUES (1, 1, 1)", "INSERT INTO d (k, a, b) VALUES (2, 2, 2) USING TTL 0", "INSERT INTO d (k, a, b) VALUES (3, 3, 3) USING TTL 100", "UPDATE d USING TTL 5 SET b = 33 WHERE k = 3", "tick 20000"],
    [
        ("M32 M33 rows", "SELECT k, a, b FROM d"),
        ("M34 an expired cell of a live row", "SELECT b, ttl(b) AS t FROM d WHERE k = 3"),
        ("M23 unset", "UPDATE d SET a = ?, b = 9 WHERE k = 2", [UNSET]),
        ("M23 unset leaves a cell", "SELECT a, b FROM d WHERE k = 2"),
    ],
    {
        "M32 M33 rows": ["3|3|33", "2|2|2"],
        "M34 an expired cell of a live row": ["33|0"],
        "M23 unset": ["done"],
        "M23 unset leaves a cell": ["2|9"],
    },
)
_U = "INSERT INTO f (k, ts, u, n, s) VALUES (1, 1699999999123, minTimeuuid(1699999999123), -2, 'hé')"
CASES["time_functions"] = (
    ["CREATE TABLE f (k int PRIMARY KEY, ts timestamp, u timeuuid, n bigint, s text)", _U],
    [
        ("toDate", "SELECT toDate(ts) AS a, toDate(u) AS b FROM f"),
        ("toTimestamp", "SELECT toTimestamp(u) AS a FROM f WHERE ts = toTimestamp(minTimeuuid(1699999999123)) ALLOW FILTERING"),
        ("toUnixTimestamp", "SELECT toUnixTimestamp(ts) AS a, toUnixTimestamp(u) AS b FROM f"),
        ("unixTimestampOf", "SELECT unixTimestampOf(u) AS a FROM f"),
        ("dateOf", "SELECT dateOf(u) AS a FROM f WHERE ts = dateOf(minTimeuuid(1699999999123)) ALLOW FILTERING"),
        ("minTimeuuid", "SELECT u FROM f"),
        ("minTimeuuid in a condition", "SELECT k FROM f WHERE u >= minTimeuuid(1699999999123) AND u < maxTimeuuid(1699999999123) ALLOW FILTERING"),
        ("maxTimeuuid", "SELECT k FROM f WHERE ts = dateOf(maxTimeuuid(1699999999123)) AND u != maxTimeuuid(1699999999123) ALLOW FILTERING"),
        ("now", "SELECT k FROM f WHERE u < now() ALLOW FILTERING"),
        ("currentTimeUUID", "SELECT k FROM f WHERE u < currentTimeUUID() ALLOW FILTERING"),
        ("currentTimestamp", "SELECT k FROM f WHERE ts <= currentTimestamp() ALLOW FILTERING"),
        ("uuid", "SELECT k FROM f WHERE u = uuid() ALLOW FILTERING"),
    ],
    {
        "toDate": ["2023-11-14|2023-11-14"],
        "toTimestamp": ["2023-11-14 22:13:19.123"],
        "toUnixTimestamp": ["1699999999123|1699999999123"],
        "unixTimestampOf": ["1699999999123"],
        "dateOf": ["2023-11-14 22:13:19.123"],
        "minTimeuuid": ["0429ee30-833b-11ee-8000-000000000000"],
        "minTimeuuid in a condition": ["1"],
        "maxTimeuuid": ["1"],
        "now": ["1"],
        "currentTimeUUID": ["1"],
        "currentTimestamp": ["1"],
    },
)
CASES["blob_functions"] = (
    ["CREATE TABLE f (k int PRIMARY KEY, ts timestamp, u timeuuid, n bigint, s text)", _U, "CREATE TABLE v (k bigint PRIMARY KEY, d date, t time, s text, i int)", "INSERT INTO v (k, d, t, s, i) VALUES (1 + 2 * 3, currentDate(), currentTime(), 'he' + 'llo', -(7 - 2) % 3)", "INSERT INTO v (k, i) VALUES (token(1) - token(1), 7 / 2)"],
    [
        ("textAsBlob", "SELECT textAsBlob(s) AS a, blobAsText(textAsBlob(s)) AS b FROM f"),
        ("intAsBlob", "SELECT intAsBlob(k) AS a, blobAsInt(intAsBlob(k)) AS b FROM f"),
        ("bigintAsBlob", "SELECT bigintAsBlob(n) AS a, blobAsBigint(bigintAsBlob(n)) AS b FROM f"),
        ("blobAsInt of another length", "SELECT blobAsInt(bigintAsBlob(n)) AS a FROM f"),
        ("generic names", "SELECT blobAsSmallint(intAsBlob(k)) AS a, timestampAsBlob(ts) AS b FROM f"),
        ("writetime", "SELECT writetime(n) AS a, ttl(n) AS b FROM f"),
        ("arithmetic, string +, currentDate, currentTime", "SELECT k, d, t, s, i FROM v WHERE k = 7"),
        ("division", "SELECT i FROM v WHERE i = 3 ALLOW FILTERING"),
    ],
    {
        "textAsBlob": ["68c3a9|hé"],
        "intAsBlob": ["00000001|1"],
        "bigintAsBlob": ["fffffffffffffffe|-2"],
        "blobAsInt of another length": ["null"],
        "generic names": ["null|0000018bcfe56493"],
        "writetime": ["1700000000000000|null"],
        "arithmetic, string +, currentDate, currentTime": ["7|2023-11-14|80000000000000|hello|-2"],
        "division": ["3"],
    },
)
CASES["definitions"] = (
    [],
    [
        ("D1 keyspace", "CREATE KEYSPACE ks2 WITH replication = {'class': 'SimpleStrategy', 'replication_factor': 1}"),
        ("D1 again", "CREATE KEYSPACE ks2"),
        ("D1 if not exists", "CREATE KEYSPACE IF NOT EXISTS ks2"),
        ("D3 alter", "ALTER KEYSPACE ks2 WITH replication = {'class': 'SimpleStrategy', 'replication_factor': 2}"),
        ("D3 unknown class", "ALTER KEYSPACE ks2 WITH replication = {'class': 'Nope'}"),
        ("D2 use", "USE ks2"),
        ("D2 no such", "USE nosuch"),
        ("D5 table", "CREATE TABLE z (a int, b text, c int, PRIMARY KEY (a, c)) WITH CLUSTERING ORDER BY (c DESC) AND comment = 'x'"),
        ("D5 again", "CREATE TABLE z (a int PRIMARY KEY)"),
        ("D5 columnfamily", "CREATE COLUMNFAMILY IF NOT EXISTS y (a int PRIMARY KEY)"),
        ("D6 no key", "CREATE TABLE x (a int, b int)"),
        ("D6 two keys", "CREATE TABLE x (a int PRIMARY KEY, b int PRIMARY KEY)"),
        ("D6 a column twice", "CREATE TABLE x (a int PRIMARY KEY, a int)"),
        ("D6 static without clustering", "CREATE TABLE x (a int PRIMARY KEY, b int STATIC)"),
        ("D6 counter as key", "CREATE TABLE x (a counter PRIMARY KEY)"),
        ("D6 counter in a list", "CREATE TABLE x (a int PRIMARY KEY, b list<counter>)"),
        ("D6 counters among others", "CREATE TABLE x (a int PRIMARY KEY, b counter, c int)"),
        ("D6 unknown type", "CREATE TABLE x (a nosuch PRIMARY KEY)"),
        ("D7 order not of a prefix", "CREATE TABLE x (a int, b int, c int, PRIMARY KEY (a, b, c)) WITH CLUSTERING ORDER BY (c DESC)"),
        ("D8 compact storage", "CREATE TABLE x8 (a int PRIMARY KEY, b int) WITH COMPACT STORAGE"),
        ("D9 options", "CREATE TABLE x9 (a int PRIMARY KEY, b int) WITH default_time_to_live = 60 AND gc_grace_seconds = 5"),
        ("D10 masked", "CREATE TABLE x (a int PRIMARY KEY, b text MASKED WITH DEFAULT)"),
        ("D7 stored order", "INSERT INTO z (a, c, b) VALUES (1, 1, 'one')"),
        ("D7 two", "INSERT INTO z (a, c, b) VALUES (1, 2, 'two')"),
        ("D7 first", "SELECT c FROM z WHERE a = 1 LIMIT 1"),
        ("D11 add", "ALTER TABLE z ADD d int"),
        ("D11 rows", "SELECT c, b, d FROM z WHERE a = 1"),
        ("D12 drop", "ALTER TABLE z DROP b"),
        ("D11 of another type", "ALTER TABLE z ADD b int"),
        ("D11 again", "ALTER TABLE z ADD b text"),
        ("D12 its cells are gone", "SELECT c, b FROM z WHERE a = 1"),
        ("D12 a key", "ALTER TABLE z DROP a"),
        ("D13 rename", "ALTER TABLE z RENAME c TO e"),
        ("D14 with", "ALTER TABLE z WITH default_time_to_live = 5"),
        ("D14 D9 stored", "SELECT table_name, default_time_to_live FROM system_schema.tables WHERE keyspace_name = 'ks2'"),
        ("D15 drop", "DROP TABLE z"),
        ("D15 gone", "SELECT * FROM z"),
        ("D15 if exists", "DROP TABLE IF EXISTS z"),
        ("D4 drop", "DROP KEYSPACE ks2"),
        ("D4 dropped before", "DROP KEYSPACE ks2"),
        ("D4 if exists", "DROP KEYSPACE IF EXISTS ks2"),
        ("D2 none is in use!", "SELECT * FROM z"),
    ],
    {
        "D1 keyspace": ["done"],
        "D1 again": ["error 2400"],
        "D1 if not exists": ["done"],
        "D3 alter": ["done"],
        "D3 unknown class": ["error 2300"],
        "D2 use": ["done"],
        "D2 no such": ["error 2200"],
        "D5 table": ["done"],
        "D5 again": ["error 2400"],
        "D5 columnfamily": ["done"],
        "D6 no key": ["error 2200"],
        "D6 two keys": ["error 2200"],
        "D6 a column twice": ["error 2200"],
        "D6 static without clustering": ["error 2200"],
        "D6 counter as key": ["error 2200"],
        "D6 counter in a list": ["error 2200"],
        "D6 counters among others": ["error 2200"],
        "D6 unknown type": ["error 2200"],
        "D7 order not of a prefix": ["error 2200"],
        "D8 compact storage": ["done"],
        "D9 options": ["done"],
        "D10 masked": ["error 2200"],
        "D7 stored order": ["done"],
        "D7 two": ["done"],
        "D7 first": ["2"],
        "D11 add": ["done"],
        "D11 rows": ["2|two|null", "1|one|null"],
        "D12 drop": ["done"],
        "D11 of another type": ["error 2200"],
        "D11 again": ["done"],
        "D12 its cells are gone": ["2|null", "1|null"],
        "D12 a key": ["error 2200"],
        "D13 rename": ["error 2200"],
        "D14 with": ["done"],
        "D14 D9 stored": ["x8|0", "x9|60", "y|0", "z|5"],
        "D15 drop": ["done"],
        "D15 gone": ["error 2200"],
        "D15 if exists": ["done"],
        "D4 drop": ["done"],
        "D4 dropped before": ["error 2200"],
        "D4 if exists": ["done"],
        "D2 none is in use!": ["error 2200 No keyspace has been specified. USE a keyspace, or explicitly specify keyspace.tablename"],
    },
)
CASES["user_types"] = (
    ["CREATE TYPE address (street text, zip int)", "CREATE TABLE a (id int PRIMARY KEY, home frozen<address>, t tuple<int, text>, n frozen<list<int>>)", "INSERT INTO a (id, home, t, n) VALUES (1, {zip: 5, street: 'Y'}, (1, 'a'), [10, 20])"],
    [
        ("D20 rows", "SELECT id, t, n FROM a"),
        ("F16 frozen list", "SELECT id FROM a WHERE n = [10, 20] ALLOW FILTERING"),
        ("D20 again", "CREATE TYPE address (x int)"),
        ("D21 add", "ALTER TYPE address ADD country text"),
        ("D21 rename", "ALTER TYPE address RENAME zip TO code"),
        ("D21 a field twice", "ALTER TYPE address ADD code int"),
        ("D21 fields", "SELECT field_names FROM system_schema.types WHERE keyspace_name = 'w'"),
        ("D21 values", "SELECT home FROM a"),
        ("D20 in use", "DROP TYPE address"),
        ("D20 unused", "DROP TABLE a"),
        ("D20 drop", "DROP TYPE address"),
        ("D20 if exists", "DROP TYPE IF EXISTS address"),
        ("D20 gone", "SELECT type_name FROM system_schema.types WHERE keyspace_name = 'w'"),
        ("nothing is left", "SELECT table_name FROM system_schema.tables WHERE keyspace_name = 'w'"),
    ],
    {
        "D20 rows": ["1|{1, a}|[10, 20]"],
        "F16 frozen list": ["1"],
        "D20 again": ["error 2400"],
        "D21 add": ["done"],
        "D21 rename": ["done"],
        "D21 a field twice": ["error 2200"],
        "D21 fields": ["[street, code, country]"],
        "D21 values": ["{Y, 5, null}"],
        "D20 in use": ["error 2200"],
        "D20 unused": ["done"],
        "D20 drop": ["done"],
        "D20 if exists": ["done"],
    },
)
CASES["virtual_tables"] = (
    [_T, "CREATE INDEX vi ON t (v)", "CREATE TYPE pair (x int, y text)"],
    [
        ("S15 local", "SELECT key, partitioner FROM system.local"),
        *((f"S15 S17 {x}", f"SELECT * FROM {x}") for x in ("system.peers", "system.peers_v2", "system_schema.views", "system_schema.triggers", "system_schema.dropped_columns", "system_schema.functions", "system_schema.aggregates")),
        ("S16 keyspaces", "SELECT keyspace_name FROM system_schema.keyspaces WHERE keyspace_name = 'w'"),
        ("S16 tables", "SELECT table_name FROM system_schema.tables WHERE keyspace_name = 'w'"),
        ("S16 columns", "SELECT column_name, kind, position, type, clustering_order FROM system_schema.columns WHERE keyspace_name = 'w'"),
        ("S16 indexes", "SELECT index_name, options FROM system_schema.indexes WHERE keyspace_name = 'w'"),
        ("S16 types", "SELECT type_name, field_names, field_types FROM system_schema.types WHERE keyspace_name = 'w'"),
    ],
    {
        "S15 local": ["local|org.apache.cassandra.dht.Murmur3Partitioner"],
        "S16 keyspaces": ["w"],
        "S16 tables": ["t"],
        "S16 columns": ["c1|clustering|0|int|asc", "c2|clustering|1|int|asc", "k|partition_key|0|int|none", "v|regular|-1|int|none"],
        "S16 indexes": ["vi|{target -> v}"],
        "S16 types": ["pair|[x, y]|[int, text]"],
    },
)

#: Commands in turn, and the replies.
COMMANDS: list[tuple[str, object]] = [
    ("PING", "PONG"),
    ("PING hi", "hi"),
    ("SET a 1", "OK"),
    ("GET a", "1"),
    ("GET nobody", None),
    ("SET a 2 NX", None),
    ("SET b 3 XX", None),
    ("SET b 3 NX", "OK"),
    ("SET a 4 XX", "OK"),
    ("MSET c 1 c 2 d", "OK"),
    ("MGET c a nobody d", ["2", "4", None, None]),
    ("EXISTS a a nobody", 2),
    ("DEL a a nobody", 1),
    ("DBSIZE", 2),
    ("TYPE b", "string"),
    ("TYPE a", "none"),
    ("KEYS ?", ["b", "c"]),
    ("KEYS [b]", []),
    ("DEL c", 1),
    ("SCAN 0 MATCH * COUNT 10", ["0", ["b"]]),
    ("SCAN 0 MATCH x*", ["0", []]),
    ("COMMAND", []),
    ("SELECT 0", "OK"),
    ("SELECT 1", "error ERR DB index is out of range"),
    ("CLIENT GETNAME", None),
    ("CLIENT SETNAME x", "OK"),
    ("SET b 1 EX 5", "error ERR key expiry is not supported"),
    ("LPUSH l 1", "error ERR unknown command 'LPUSH'"),
    ("GET", "error ERR wrong number of arguments for 'get' command"),
    ("GET b", "3"),
    ("FLUSHDB", "OK"),
    ("DBSIZE", 0),
    ("SET b 5", "OK"),
    ("FLUSHALL", "OK"),
    ("GET b", None),
    ("QUIT", "OK"),
]


def _shown(reply: object) -> str:
    return reply if isinstance(reply, str) else json.dumps(reply)


def _commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv, out = KeyValue(spark), []
    for k, (line, _) in enumerate(COMMANDS):
        try:
            reply = kv.line(line)
        except CommandError as e:
            reply = f"error {e}"
        out.append((k, line, _shown(sorted(reply) if line.startswith("KEYS") else reply)))
    return spark.createDataFrame(out, "place int, line string, reply string")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _run(k) for k in CASES} | {"kv_commands": _commands}


def oracle_sql() -> dict[str, str]:
    replies = ", ".join("(" + ", ".join((str(k), _quoted(line), _quoted(_shown(reply)))) + ")" for k, (line, reply) in enumerate(COMMANDS))
    return {k: _literal(v[2]) for k, v in CASES.items()} | {"kv_commands": f"SELECT * FROM (VALUES {replies}) t(place, line, reply)"}
