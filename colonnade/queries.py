"""Queries over the driver's tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade import cases
from colonnade.kv import KeyValue
from colonnade.session import Session

#: Mounts: table -> (file, partition key, clustering key, descending).
MOUNTS = {
    "tpch.orders": ("orders", ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderdate"]),
    "tpch.orders_by_id": ("orders", ["o_orderkey"], [], []),
    "tpch.lineitem": ("lineitem", ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"], []),
    "tpch.customer": ("customer", ["c_custkey"], [], []),
    "tpch.part": ("part", ["p_partkey"], [], []),
    "tpch.supplier": ("supplier", ["s_suppkey"], [], []),
    "tpch.nation": ("nation", ["n_nationkey"], [], []),
    "tpch.region": ("region", ["r_regionkey"], [], []),
    "app.events": ("events", ["user_id"], ["ts"], ["ts"]),
    "app.conversations": ("conversations", ["conv_id"], ["turn"], []),
    "app.documents": ("documents", ["doc_id"], [], []),
    "app.pages": ("pages", ["page_id"], [], []),
    "app.labels": ("labels", ["doc_id"], [], []),
    "app.embeddings": ("embeddings", ["vec_id"], [], []),
    "app.benchmark": ("benchmark", ["item_id"], [], []),
}


def mounted(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    """A session with the named tables mounted."""
    session = Session(spark)
    for name in names:
        file, partition, clustering, descending = MOUNTS[name]
        session.mount(name, f"{sf_dir}/{file}.parquet", partition, clustering, descending)
    return session


def _over(table: str, text: str, params: list | tuple = (), before: list[str] = ()) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = mounted(spark, sf_dir, table)
        for statement in before:
            session.execute(statement)
        found = session.execute(text, params)
        shown = (F.hex(f.name).alias(f.name) if isinstance(f.dataType, T.BinaryType) else f.name for f in found.schema)
        return found.select(*shown)  # bytes in hexadecimal

    return run




def _token_sql(table: str, key: str, width: int) -> str:
    """DuckDB SQL: the table's columns and `token`, the Murmur3 token of a key of `width` bytes that isn't negative.

    A step a level: bytes as signed ones into a word, two multiplications about a rotation, the length, and for both halves the finish.
    """
    times = lambda x, by: f"((({x})::UHUGEINT * {by}) % 18446744073709551616)::UBIGINT"
    plus = lambda a, b: f"((({a})::UHUGEINT + {b}) % 18446744073709551616)::UBIGINT"
    byte = lambda i: f"(({key}::UBIGINT >> {8 * (width - 1 - i)}) & 255)"
    wide = lambda i: times(f"CASE WHEN {byte(i)} > 127 THEN 18446744073709551360::UBIGINT + {byte(i)} ELSE {byte(i)} END", 1 << 8 * i)
    word = wide(0)
    for i in range(1, width):
        word = f"xor({word}, {wide(i)})"
    steps = [word, times("x", 0x87C37B91114253D5), f"{times('x', 1 << 31)} | (x >> 33)", times("x", 0x4CF5AD432745937F), f"xor(x, {width}::UBIGINT)", plus("x", width)]
    sql = f"SELECT *, {steps[0]} AS x FROM {table}"
    for step in steps[1:]:
        sql = f"SELECT * REPLACE ({step} AS x) FROM ({sql})"
    sql = f"SELECT *, {plus('x', width)} AS y FROM ({sql})"
    for by in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        sql = f"SELECT * REPLACE (xor(x, x >> 33) AS x, xor(y, y >> 33) AS y) FROM ({sql})"
        sql = f"SELECT * REPLACE ({times('x', by)} AS x, {times('y', by)} AS y) FROM ({sql})"
    sql = f"SELECT *, {plus('xor(x, x >> 33)', 'xor(y, y >> 33)')} AS z FROM ({sql})"
    return f"SELECT *, CASE WHEN z > 9223372036854775807 THEN (z::HUGEINT - 18446744073709551616)::BIGINT ELSE z::BIGINT END AS token FROM ({sql})"


#: name -> (mounted table, statement, DuckDB SQL or None, statements before)
_READS: dict[str, tuple] = {
    "scan_star": ("tpch.nation", "SELECT * FROM tpch.nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "point_lookup": ("tpch.orders_by_id", "SELECT o_orderkey, o_custkey, o_totalprice FROM tpch.orders_by_id WHERE o_orderkey = 42", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42"),
    "partition_slice": ("tpch.orders", "SELECT o_orderkey, o_totalprice FROM tpch.orders WHERE o_custkey = 7", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7"),
    "ck_range": (
        "app.events",
        "SELECT event_id, event_type, value FROM app.events WHERE user_id = 8 AND ts >= 1704844800000 AND ts < 1705708800000",
        "SELECT event_id, event_type, value FROM events WHERE user_id = 8 AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'",
    ),
    "ck_prefix": ("tpch.lineitem", "SELECT l_partkey, l_quantity FROM tpch.lineitem WHERE l_orderkey = 47 AND l_linenumber = 2", "SELECT l_partkey, l_quantity FROM lineitem WHERE l_orderkey = 47 AND l_linenumber = 2"),
    "ck_in": ("app.conversations", "SELECT turn, role, text FROM app.conversations WHERE conv_id = 3 AND turn IN (0, 2)", "SELECT turn, role, text FROM conversations WHERE conv_id = 3 AND turn IN (0, 2)"),
    "pk_in": ("tpch.customer", "SELECT c_custkey, c_name FROM tpch.customer WHERE c_custkey IN (3, 1, 2)", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 1, 2)"),
    "pk_in_repeated": (
        "tpch.customer",
        "SELECT c_custkey, c_name FROM tpch.customer WHERE c_custkey IN (2, 1, 2)",
        "SELECT c_custkey, c_name FROM customer JOIN (VALUES (2), (1), (2)) k(id) ON c_custkey = id",
    ),
    "pk_in_empty": ("tpch.customer", "SELECT c_custkey, c_name FROM tpch.customer WHERE c_custkey IN ()", "SELECT c_custkey, c_name FROM customer WHERE false"),
    "tuple_eq": (
        "tpch.lineitem",
        "SELECT l_linenumber, l_partkey, l_suppkey FROM tpch.lineitem WHERE (l_linenumber, l_partkey) = (2, 50) ALLOW FILTERING",
        "SELECT l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber = 2 AND l_partkey = 50",
    ),
    "tuple_in": (
        "tpch.lineitem",
        "SELECT l_linenumber, l_partkey, l_suppkey FROM tpch.lineitem WHERE l_orderkey = 47 AND (l_linenumber) IN ((1), (3))",
        "SELECT l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey = 47 AND l_linenumber IN (1, 3)",
    ),
    "tuple_gt": (
        "tpch.lineitem",
        "SELECT l_linenumber, l_partkey FROM tpch.lineitem WHERE l_orderkey = 47 AND (l_linenumber, l_partkey) > (3, 50)",
        "SELECT l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 47 AND (l_linenumber > 3 OR l_linenumber = 3 AND l_partkey > 50)",
    ),
    "filter_eq": ("tpch.customer", "SELECT c_custkey, c_acctbal FROM tpch.customer WHERE c_mktsegment = 'BUILDING' ALLOW FILTERING", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_ne": ("tpch.customer", "SELECT c_custkey FROM tpch.customer WHERE c_mktsegment != 'BUILDING' ALLOW FILTERING", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "filter_range": (
        "tpch.orders_by_id",
        "SELECT o_orderkey, o_totalprice FROM tpch.orders_by_id WHERE o_totalprice > 200000.5 AND o_totalprice <= 300000 ALLOW FILTERING",
        "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000.5 AND o_totalprice <= 300000",
    ),
    "filter_in": ("tpch.customer", "SELECT c_custkey FROM tpch.customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') ALLOW FILTERING", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')"),
    "filter_null": ("tpch.customer", "SELECT c_custkey FROM tpch.customer WHERE c_mktsegment != null ALLOW FILTERING", "SELECT c_custkey FROM customer WHERE c_mktsegment <> NULL"),
    "index_eq": (
        "tpch.customer",
        "SELECT c_custkey, c_name FROM tpch.customer WHERE c_mktsegment = 'BUILDING'",
        "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
        ["CREATE INDEX ON tpch.customer (c_mktsegment)"],
    ),
    "order_desc_limit": (
        "tpch.orders",
        "SELECT o_orderkey, o_orderdate, o_totalprice FROM tpch.orders WHERE o_custkey = 7 ORDER BY o_orderdate ASC LIMIT 3",
        "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate, o_orderkey DESC LIMIT 3",
    ),
    "pk_in_order_limit": (
        "tpch.orders",
        "SELECT o_custkey, o_orderkey, o_orderdate FROM tpch.orders WHERE o_custkey IN (1, 2, 3) ORDER BY o_orderdate DESC LIMIT 5",
        "SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_custkey IN (1, 2, 3) ORDER BY o_orderdate DESC, o_orderkey LIMIT 5",
    ),
    "count_all": ("tpch.lineitem", "SELECT COUNT(*) AS n FROM tpch.lineitem", "SELECT count(*) AS n FROM lineitem"),
    "count_where": ("tpch.lineitem", "SELECT COUNT(1) AS n FROM tpch.lineitem WHERE l_quantity >= 25 ALLOW FILTERING", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 25"),
    "count_pk_in": ("tpch.orders", "SELECT COUNT(*) AS n FROM tpch.orders WHERE o_custkey IN (1, 2, 3)", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (1, 2, 3)"),
    "distinct_pk": ("app.events", "SELECT DISTINCT user_id FROM app.events", "SELECT DISTINCT user_id FROM events"),
    "alias_project": ("tpch.orders_by_id", "SELECT o_orderkey AS k, o_orderstatus AS status FROM tpch.orders_by_id", "SELECT o_orderkey AS k, o_orderstatus AS status FROM orders"),
    "bind_values": ("tpch.orders", "SELECT o_orderkey FROM tpch.orders WHERE o_custkey = ? AND o_orderdate > ?", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderdate > TIMESTAMP '1995-01-01 00:00:00'", (), [7, 788918400000]),
    "int_blob_roundtrip": ("tpch.nation", "SELECT n_name, blobAsInt(intAsBlob(n_nationkey)) AS k FROM tpch.nation", "SELECT n_name, n_nationkey AS k FROM nation"),
    "cast_blob": ("tpch.nation", "SELECT n_name, CAST(n_nationkey AS blob) AS b FROM tpch.nation", "SELECT n_name, printf('%08X', n_nationkey) AS b FROM nation"),
    "to_date": ("app.events", "SELECT event_id, toDate(ts) AS d FROM app.events", "SELECT event_id, CAST(ts AS DATE) AS d FROM events"),
    "to_unix": ("app.events", "SELECT event_id, toUnixTimestamp(ts) AS ms FROM app.events", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events"),
    "token_value": ("tpch.nation", "SELECT n_nationkey, token(n_nationkey) AS t FROM tpch.nation", f"SELECT n_nationkey, token AS t FROM ({_token_sql('nation', 'n_nationkey', 4)})"),
    "token_range": ("tpch.customer", "SELECT c_custkey FROM tpch.customer WHERE token(c_custkey) > 0", f"SELECT c_custkey FROM ({_token_sql('customer', 'c_custkey', 8)}) WHERE token > 0"),
    "token_order_limit": ("tpch.customer", "SELECT c_custkey FROM tpch.customer LIMIT 10", f"SELECT c_custkey FROM ({_token_sql('customer', 'c_custkey', 8)}) ORDER BY token LIMIT 10"),
}


def _tags(spark: SparkSession, sf_dir: str) -> Session:
    """A table with a list and a map, derived from orders and customer."""
    session = Session(spark)
    orders = session.spark.read.parquet(f"{sf_dir}/orders.parquet")
    tags = orders.select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags"), F.map_from_arrays(F.array("o_orderstatus", F.lit("n")), F.array(F.col("o_custkey"), F.lit(1).cast("long"))).alias("m"))
    session.mount("app.tags", tags, ["o_orderkey"])
    return session


def _tagged(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _tags(spark, sf_dir).execute(text)


_TAGGED = {
    "list_contains": ("SELECT o_orderkey FROM app.tags WHERE tags CONTAINS '1-URGENT' ALLOW FILTERING", "SELECT o_orderkey FROM orders WHERE '1-URGENT' IN (o_orderstatus, o_orderpriority)"),
    "map_contains": ("SELECT o_orderkey FROM app.tags WHERE m CONTAINS 7 ALLOW FILTERING", "SELECT o_orderkey FROM orders WHERE o_custkey = 7"),
    "map_contains_key": ("SELECT o_orderkey FROM app.tags WHERE m CONTAINS KEY 'F' ALLOW FILTERING", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'"),
    "map_element": ("SELECT o_orderkey FROM app.tags WHERE m['O'] <= 20 ALLOW FILTERING", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey <= 20"),
    "list_equality": ("SELECT o_orderkey FROM app.tags WHERE tags = ['F', '1-URGENT'] ALLOW FILTERING", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
}

#: Small stored tables: name -> (definition, statements, query, the rows as DuckDB SQL).
_TABLE = "CREATE TABLE w.t (k int, c int, v text, n int, s text STATIC, PRIMARY KEY (k, c))"
_CELLS = "CREATE TABLE w.t (id int PRIMARY KEY, l list<text>, s set<int>, m map<text, int>)"
_ROWS = [f"INSERT INTO w.t (k, c, v, n) VALUES ({k}, {c}, 'v{k}{c}', {10 * k + c})" for k in (1, 2) for c in (1, 2, 3)]
_FULL = ["INSERT INTO w.t (id, l, s, m) VALUES (1, ['a', 'b', 'a'], {3, 1, 2}, {'x': 1, 'y': 2})"]
_STORED: dict[str, tuple[str, list[str], str, str]] = {
    "upsert_merge": (_TABLE, [*_ROWS, "INSERT INTO w.t (k, c, v) VALUES (1, 1, 'new')", "UPDATE w.t SET n = 99 WHERE k = 2 AND c IN (2, 4)"], "SELECT k, c, v, n FROM w.t", "SELECT * FROM (VALUES (1,1,'new',11),(1,2,'v12',12),(1,3,'v13',13),(2,1,'v21',21),(2,2,'v22',99),(2,3,'v23',23),(2,4,NULL,99)) t(k,c,v,n)"),
    "update_counter": (
        "CREATE TABLE w.t (k int PRIMARY KEY, n counter)",
        ["UPDATE w.t SET n = n + 5 WHERE k IN (1, 2)", "UPDATE w.t SET n = n - 7 WHERE k = 1", "UPDATE w.t SET n = n + 1 WHERE k = 3"],
        "SELECT k, n FROM w.t",
        "SELECT k, CAST(n AS BIGINT) AS n FROM (VALUES (1,-2),(2,5),(3,1)) t(k,n)",
    ),
    "delete_row": (_TABLE, [*_ROWS, "DELETE FROM w.t WHERE k = 1 AND c = 2"], "SELECT k, c FROM w.t", "SELECT * FROM (VALUES (1,1),(1,3),(2,1),(2,2),(2,3)) t(k,c)"),
    "delete_range": (_TABLE, [*_ROWS, "DELETE FROM w.t WHERE k = 1 AND c >= 2", "INSERT INTO w.t (k, c, n) VALUES (1, 3, 7)"], "SELECT k, c, v, n FROM w.t WHERE k = 1", "SELECT * FROM (VALUES (1,1,'v11',11),(1,3,NULL,7)) t(k,c,v,n)"),
    "delete_partition": (_TABLE, [*_ROWS, "DELETE FROM w.t WHERE k = 2"], "SELECT k, c FROM w.t", "SELECT * FROM (VALUES (1,1),(1,2),(1,3)) t(k,c)"),
    "delete_column": (_TABLE, [*_ROWS, "DELETE v FROM w.t WHERE k = 1 AND c IN (1, 3)"], "SELECT c, v FROM w.t WHERE k = 1", "SELECT * FROM (VALUES (1,NULL),(2,'v12'),(3,NULL)) t(c,v)"),
    "batch_mix": (
        _TABLE,
        [*_ROWS, "BEGIN BATCH INSERT INTO w.t (k, c, n) VALUES (3, 1, 1); UPDATE w.t SET n = 2 WHERE k = 3 AND c = 1; DELETE FROM w.t WHERE k = 1 AND c = 1; APPLY BATCH"],
        "SELECT k, c, n FROM w.t",
        "SELECT * FROM (VALUES (1,2,12),(1,3,13),(2,1,21),(2,2,22),(2,3,23),(3,1,2)) t(k,c,n)",
    ),
    "truncate_table": (_TABLE, [*_ROWS, "TRUNCATE w.t"], "SELECT COUNT(*) AS n FROM w.t", "SELECT 0::BIGINT AS n"),
    "static_broadcast": (_TABLE, [*_ROWS, "UPDATE w.t SET s = 'one' WHERE k = 1"], "SELECT k, c, s FROM w.t", "SELECT * FROM (VALUES (1,1,'one'),(1,2,'one'),(1,3,'one'),(2,1,NULL),(2,2,NULL),(2,3,NULL)) t(k,c,s)"),
    "static_only_row": (_TABLE, ["INSERT INTO w.t (k, c, v, s) VALUES (1, 1, 'v', 's1')", "INSERT INTO w.t (k, s) VALUES (2, 's2')"], "SELECT k, c, s, v FROM w.t", "SELECT * FROM (VALUES (1,1,'s1','v'),(2,NULL,'s2',NULL)) t(k,c,s,v)"),
    "distinct_static": (_TABLE, [*_ROWS, "UPDATE w.t SET s = 'one' WHERE k = 1"], "SELECT DISTINCT k, s FROM w.t", "SELECT * FROM (VALUES (1,'one'),(2,NULL)) t(k,s)"),
    "ttl_row_filter": (
        _TABLE,
        ["INSERT INTO w.t (k, c, n) VALUES (1, 1, 1) USING TTL 60", "INSERT INTO w.t (k, c, n) VALUES (1, 2, 2)", "INSERT INTO w.t (k, c, n) VALUES (1, 3, 3) USING TTL 600", "tick 120000"],
        "SELECT c, n, ttl(n) AS left FROM w.t WHERE k = 1",
        "SELECT * FROM (VALUES (2,2,NULL),(3,3,480)) t(c,n,\"left\")",
    ),
    "writetime_value": (_TABLE, ["INSERT INTO w.t (k, c, n) VALUES (1, 1, 1) USING TIMESTAMP 123456"], "SELECT c, writetime(n) AS w FROM w.t", "SELECT 1 AS c, 123456::BIGINT AS w"),
    "list_append": (_CELLS, [*_FULL, "UPDATE w.t SET l = l + ['c'] WHERE id = 1"], "SELECT l FROM w.t", "SELECT ['a','b','a','c'] AS l"),
    "list_prepend": (_CELLS, [*_FULL, "UPDATE w.t SET l = ['z'] + l WHERE id = 1"], "SELECT l FROM w.t", "SELECT ['z','a','b','a'] AS l"),
    "list_subtract": (_CELLS, [*_FULL, "UPDATE w.t SET l = l - ['a'] WHERE id = 1"], "SELECT l FROM w.t", "SELECT ['b'] AS l"),
    "list_set_index": (_CELLS, [*_FULL, "UPDATE w.t SET l[1] = 'B', l[9] = 'no' WHERE id = 1"], "SELECT l FROM w.t", "SELECT ['a','B','a'] AS l"),
    "list_delete_index": (_CELLS, [*_FULL, "DELETE l[0] FROM w.t WHERE id = 1"], "SELECT l FROM w.t", "SELECT ['b','a'] AS l"),
    "set_union": (_CELLS, [*_FULL, "UPDATE w.t SET s = s + {5, 1} WHERE id = 1"], "SELECT s FROM w.t", "SELECT [1,2,3,5] AS s"),
    "set_diff": (_CELLS, [*_FULL, "UPDATE w.t SET s = s - {2, 9} WHERE id = 1"], "SELECT s FROM w.t", "SELECT [1,3] AS s"),
    "set_emptied": (_CELLS, [*_FULL, "UPDATE w.t SET s = s - {1, 2, 3} WHERE id = 1"], "SELECT id, s FROM w.t", "SELECT 1 AS id, NULL::INTEGER[] AS s"),
    "map_merge": (_CELLS, [*_FULL, "UPDATE w.t SET m = m + {'y': 7, 'z': 8} WHERE id = 1"], "SELECT id FROM w.t WHERE m['y'] = 7 AND m['z'] = 8 AND m['x'] = 1 ALLOW FILTERING", "SELECT 1 AS id"),
    "map_minus": (_CELLS, [*_FULL, "UPDATE w.t SET m = m - {'x'} WHERE id = 1"], "SELECT id FROM w.t WHERE m = {'y': 2} ALLOW FILTERING", "SELECT 1 AS id"),
    "map_put": (_CELLS, [*_FULL, "UPDATE w.t SET m['x'] = 42 WHERE id = 1"], "SELECT id FROM w.t WHERE m = {'x': 42, 'y': 2} ALLOW FILTERING", "SELECT 1 AS id"),
    "map_delete": (_CELLS, [*_FULL, "DELETE m['y'] FROM w.t WHERE id = 1"], "SELECT id FROM w.t WHERE m = {'x': 1} ALLOW FILTERING", "SELECT 1 AS id"),
    "system_tables": (_TABLE, [], "SELECT table_name FROM system_schema.tables WHERE keyspace_name = 'w'", "SELECT 't' AS table_name"),
    "system_columns": (_TABLE, [], "SELECT column_name, kind, position, type FROM system_schema.columns WHERE keyspace_name = 'w' AND table_name = 't'", "SELECT * FROM (VALUES ('k','partition_key',0,'int'),('c','clustering',0,'int'),('s','static',-1,'text'),('n','regular',-1,'int'),('v','regular',-1,'text')) t(column_name,kind,position,type)"),
}


def _stored(definition: str, statements: list[str], query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        now = [1_700_000_000_000]
        session = Session(spark, clock=lambda: now[0])
        session.execute("CREATE KEYSPACE w")
        session.execute(definition)
        for statement in statements:
            if statement.startswith("tick "):
                now[0] += int(statement[5:])
            else:
                session.execute(statement)
        return session.execute(query)

    return run


def bulk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' newest value by user, taken in by one keyed merge over a stored table."""
    session = Session(spark)
    session.execute("CREATE KEYSPACE w")
    session.execute("CREATE TABLE w.newest (user_id bigint PRIMARY KEY, event_id bigint, value double)")
    session.execute("INSERT INTO w.newest (user_id, event_id, value) VALUES (-1, -1, 0.0)")
    events = session.spark.read.parquet(f"{sf_dir}/events.parquet")
    newest = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("e")).select("user_id", "e.event_id", "e.value")
    session.apply_changes("w.newest", newest)
    return session.execute("SELECT user_id, event_id, value FROM w.newest")


def _customers(spark: SparkSession, sf_dir: str) -> KeyValue:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return KeyValue(spark, frame=customers.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("k"), F.col("c_name").alias("v")))


def kv_mget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir)
    kv.line("SET customer:2 changed")
    kv.line("DEL customer:3")
    return kv.mget_frame(["customer:2", "customer:1", "nobody", "customer:3", "customer:1"])


def kv_keys_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).keys_frame("customer:1?")


def kv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _customers(spark, sf_dir).scan_frame(0, "customer:*", 100)


def kv_scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key once, by following the cursor."""
    kv, seen, at = _customers(spark, sf_dir), [], "0"
    while True:
        at, keys = kv.execute("SCAN", at, "COUNT", "600")
        seen += keys
        if at == "0":
            return spark.createDataFrame([(k,) for k in seen], "k string")


def kv_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    kv = _customers(spark, sf_dir)
    return spark.createDataFrame([(kv.execute("EXISTS", "customer:1", "customer:1", "nobody"), kv.execute("DBSIZE"))], "there long, keys long")


_KV = {
    "kv_mget": (kv_mget, "SELECT place::BIGINT AS place, k, CASE k WHEN 'customer:2' THEN 'changed' WHEN 'customer:3' THEN NULL ELSE c_name END AS v FROM (VALUES (0,'customer:2'),(1,'customer:1'),(2,'nobody'),(3,'customer:3'),(4,'customer:1')) w(place, k) LEFT JOIN customer ON k = 'customer:' || c_custkey"),
    "kv_keys_glob": (kv_keys_glob, "SELECT 'customer:' || c_custkey AS k FROM customer WHERE c_custkey BETWEEN 10 AND 19"),
    "kv_scan": (kv_scan, None),
    "kv_scan_all": (kv_scan_all, "SELECT 'customer:' || c_custkey AS k FROM customer"),
    "kv_exists": (kv_exists, "SELECT 2::BIGINT AS there, count(*) AS keys FROM customer"),
}

_BULK = "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id UNION ALL SELECT -1, -1, 0.0"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {k: _over(v[0], v[1], v[4] if len(v) > 4 else (), v[3] if len(v) > 3 else ()) for k, v in _READS.items()}
    out |= {k: _tagged(v[0]) for k, v in _TAGGED.items()}
    out |= {k: _stored(*v[:3]) for k, v in _STORED.items()}
    return out | {k: v[0] for k, v in _KV.items()} | {"bulk_upsert": bulk_upsert} | cases.queries()


def oracle_sql() -> dict[str, str]:
    out = {k: v[2] for k, v in _READS.items()} | {k: v[1] for k, v in _TAGGED.items()}
    out |= {k: v[3] for k, v in _STORED.items()} | {k: v[1] for k, v in _KV.items()} | {"bulk_upsert": _BULK}
    return {k: v for k, v in out.items() if v} | cases.oracle_sql()
