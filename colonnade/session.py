"""Sessions: statements in, DataFrames out."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.errors import InvalidRequest
from colonnade.functions import timeuuid
from colonnade.lang import nodes as n
from colonnade.lang.parser import Parser
from colonnade.operators import mutate
from colonnade.operators.select import Source, by_token, merged, plan, select
from colonnade.plans.catalog import SYSTEM, Column, Keyspace, Table
from colonnade.plans.terms import Terms
from colonnade.plans.types import UNSET, CqlType
from colonnade.sources import system
from colonnade.sources.store import SHARDS, Store, scratch_path

#: Keys with buffered changes beyond which a table's buffer is taken in, and prepared statements that are kept.
MAX_BUFFERED_KEYS, MAX_PREPARED = 10_000, 1024

#: Spark types of mounted columns, and the types they count as.
_MOUNTED = {"string": "text", "int": "int", "bigint": "bigint", "smallint": "smallint", "tinyint": "tinyint", "double": "double", "float": "float", "boolean": "boolean", "timestamp": "timestamp", "date": "date", "binary": "blob"}


@dataclass(frozen=True)
class Prepared:
    text: str
    statement: object
    binds: int


class Session:
    """Runs statements over tables that it stores, or that were mounted from elsewhere.

    path: where the catalog and snapshots are kept; without it, a folder of the session's own beside the cluster's
    checkpoints, which executors share. clock: milliseconds since 1970, for tests. expire_cells: also hide single expired cells.
    token_order: sort full scans by token, which the language implies but which costs a global sort. shards: parts of
    new tables that are renewed one by one.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, clock: Callable[[], int] | None = None, expire_cells: bool = False, token_order: bool = False, shards: int = SHARDS):
        # a session of its own: wrapping 64-bit arithmetic, NULL for what has no value, the last of equal map keys
        self.spark = spark.newSession()
        for key, value in (("spark.sql.ansi.enabled", "false"), ("spark.sql.mapKeyDedupPolicy", "LAST_WIN"), ("spark.sql.session.timeZone", "UTC")):
            self.spark.conf.set(key, value)
        for key in ("spark.sql.shuffle.partitions",):
            self.spark.conf.set(key, spark.conf.get(key))
        self.clock = clock or (lambda: time.time_ns() // 1_000_000)
        self.generator = timeuuid.Generator()
        self.expire_cells, self.token_order = expire_cells, token_order
        self.store = Store(self.spark, path or scratch_path(spark), shards)
        self.catalog = self.store.load_catalog()
        self.current: str | None = None
        self.mounts: dict[str, DataFrame] = {}
        self.buffers: dict[str, list[mutate.Segment]] = {}
        self.prepared: OrderedDict[str, Prepared] = OrderedDict()

    # mounts -----------------------------------------------------------------------------------------------

    def mount(self, name: str, frame: DataFrame | str, partition: list[str], clustering: list[str] = (), descending: list[str] = (), types: dict[str, CqlType] | None = None) -> None:
        """Read-only table over a DataFrame or a Parquet path; its keys are declared, not checked."""
        space, _, table_name = name.partition(".")
        if isinstance(frame, str):
            frame = self.spark.read.parquet(frame)
        frame = self._own(frame)
        columns: dict[str, Column] = {}
        for field in frame.schema.fields:
            shown = field.dataType.simpleString()
            given = (types or {}).get(field.name)
            if shown == "timestamp_ntz":
                given = CqlType("timestamp", zoneless=True)
            if not given and shown.startswith("array<"):
                given = CqlType("list", (CqlType(_MOUNTED[shown[6:-1]]),))
            elif not given and shown.startswith("map<"):
                key, value = shown[4:-1].split(",")
                given = CqlType("map", (CqlType(_MOUNTED[key]), CqlType(_MOUNTED[value])))
            elif not given and shown not in _MOUNTED:
                raise InvalidRequest(f"Column {field.name} has type {shown}, which no column type holds")
            kind = "partition" if field.name in partition else "clustering" if field.name in clustering else "regular"
            place = (list(partition) if kind == "partition" else list(clustering)).index(field.name) if kind != "regular" else 0
            columns[field.name] = Column(field.name, given or CqlType(_MOUNTED[shown]), kind, place, field.name in descending)
        self.catalog.keyspaces.setdefault(space, Keyspace(space, {"class": "SimpleStrategy", "replication_factor": "1"}))
        self.catalog.keyspaces[space].tables[table_name] = Table(space, table_name, columns, mounted=True)
        self.mounts[name] = frame
        self.catalog.changed()

    # statements -------------------------------------------------------------------------------------------

    def execute(self, statement: str | Prepared, params: list | tuple | dict = ()) -> DataFrame | None:
        """Run one statement: SELECT gives a DataFrame that nothing has evaluated yet, anything else None."""
        parsed = statement if isinstance(statement, Prepared) else self._parse(statement)
        return self._run(parsed.statement, self._terms(params))

    def prepare(self, text: str) -> Prepared:
        if text in self.prepared:
            self.prepared.move_to_end(text)
        else:
            self.prepared[text] = self._parse(text)
            if len(self.prepared) > MAX_PREPARED:
                self.prepared.popitem(last=False)
        return self.prepared[text]

    def batch(self, children: list[tuple[str | Prepared, list | tuple | dict]]) -> None:
        """Several mutations, all or none."""
        done = []
        for statement, params in children:
            parsed = statement if isinstance(statement, Prepared) else self._parse(statement)
            if not isinstance(parsed.statement, (n.Insert, n.Update, n.Delete)):
                raise InvalidRequest("Only INSERT, UPDATE and DELETE statements are allowed in batches")
            done.append((parsed.statement, self._terms(params)))
        self._mutations(done, n.Using())

    def _parse(self, text: str) -> Prepared:
        parser = Parser(text)
        return Prepared(text, parser.statement(), parser.binds)

    def _terms(self, params: list | tuple | dict, table: Table | None = None) -> Terms:
        return Terms(params, self.clock, self.generator, table)

    def _space(self, name: n.TableName) -> str | None:
        return name.keyspace or self.current

    def _table(self, name: n.TableName, write: bool = False) -> Table:
        space = self._space(name)
        if space in SYSTEM:
            if write:
                raise InvalidRequest("system keyspaces cannot be modified")
            if found := system.definition(f"{space}.{name.name}"):
                return found
            raise InvalidRequest(f"Table '{space}.{name.name}' does not exist")
        table = self.catalog.table(space, name.name)
        if write and table.mounted:
            raise InvalidRequest(f"Table '{table.full_name}' is mounted and can't be modified")
        return table

    def _run(self, s: object, terms: Terms) -> DataFrame | None:
        if isinstance(s, n.Select):
            return self._select(s, terms)
        if isinstance(s, (n.Insert, n.Update, n.Delete)):
            self._mutations([(s, terms)], n.Using())
        elif isinstance(s, n.Batch):
            if any(c.if_not_exists if isinstance(c, n.Insert) else c.conditional for c in s.children):
                raise InvalidRequest("Conditional statements are not supported in batches")
            self._mutations([(c, terms) for c in s.children], s.using)
        else:
            self._define(s)
            self.store.save_catalog(self.catalog)
        return None

    # SELECT -----------------------------------------------------------------------------------------------

    def _select(self, s: n.Select, terms: Terms) -> DataFrame:
        space = self._space(s.table)
        table = self._table(s.table)
        terms.table = table
        planned = plan(s, table, terms)
        if space in SYSTEM:
            _, frame = system.frame(self.spark, table.full_name, self.catalog)
        else:
            frame = self.frame(table, terms.now_ms, planned.restrictions.partitions)
        return select(self.spark, s, planned, Source(table, frame), terms, self.catalog)

    def frame(self, table: Table, now_ms: int | None = None, partitions: list[tuple] | None = None) -> DataFrame:
        """A table's live rows, static columns merged in; with partitions, at least theirs."""
        if table.mounted:
            return self.mounts[table.full_name]
        self.flush(table)
        shards = None if partitions is None else self.store.shards_of(table, partitions)
        rows, statics = self.store.read(table, shards)
        out = merged(rows, statics, table, self.clock() if now_ms is None else now_ms, self.expire_cells)
        return by_token(out, table) if self.token_order else out

    # mutations --------------------------------------------------------------------------------------------

    def _mutations(self, children: list[tuple[object, Terms]], using: n.Using) -> None:
        """Check and buffer; nothing stays buffered if a child fails."""
        fresh: dict[str, tuple[Table, list[mutate.Segment]]] = {}
        for s, terms in children:
            table = self._table(s.table, write=True)
            terms.table = table
            _, segments = fresh.setdefault(table.full_name, (table, [mutate.Segment()]))
            if isinstance(s, n.Delete):
                mutate.delete(s, table, terms, using, segments)
            else:
                (mutate.insert if isinstance(s, n.Insert) else mutate.update)(s, table, terms, using, segments[-1])
        for name, (table, segments) in fresh.items():
            buffer = self.buffers.setdefault(name, [mutate.Segment()])
            for segment in segments:
                _append(buffer, segment)
            if sum(len(x.rows) + len(x.statics) + (x.erased is not None) * 500 for x in buffer) > MAX_BUFFERED_KEYS:
                self.flush(table)

    def flush(self, table: Table) -> None:
        """Take a table's buffered changes into a new snapshot."""
        segments = [x for x in self.buffers.pop(table.full_name, []) if x.rows or x.statics or x.erased is not None]
        if not segments:
            return
        shards = self.store.shards_of(table, [k for x in segments for k in x.keys()])
        rows, statics = self.store.read(table, shards)
        rows, statics = mutate.take_in(self.spark, table, rows, statics, segments, self._terms(()))
        self.store.write(table, rows, statics, shards)

    def apply_changes(self, name: str, changes: DataFrame) -> None:
        """Upsert a DataFrame of whole rows by key: one keyed merge, however many rows.

        For bulk loads, and for foreachBatch of a stream. A null in a key, or two rows with one key, is refused before anything is written.
        """
        space, _, table_name = name.partition(".")
        table = self._table(n.TableName(space, table_name), write=True)
        self.flush(table)
        keyed = mutate.tokens_of(table, self._own(changes))
        self._check_keys(table, keyed)
        shards = {r[0] for r in keyed.select(self.store.shard_column(table, F.col(mutate.TOKEN))).distinct().collect()}  # at most the number of shards
        rows, statics = self.store.read(table, shards)
        self.store.write(table, mutate.upsert(table, rows, keyed, self.clock() * 1000), statics, shards)

    def _own(self, frame: DataFrame) -> DataFrame:
        """The frame in this engine's session, whose arithmetic wraps, whatever session it was made in."""
        if frame.sparkSession is self.spark:
            return frame
        classic = self.spark._jvm.org.apache.spark.sql.classic.Dataset
        return DataFrame(classic.ofRows(self.spark._jsparkSession, frame._jdf.logicalPlan()), self.spark)

    def _check_keys(self, table: Table, rows: DataFrame) -> None:
        """Counted by key before rows meet, so that one key with very many rows is no burden."""
        keys = [f"`{c.name}`" for c in (*table.partition, *table.clustering)]
        missing = [k for k in keys if k[1:-1] not in rows.columns]
        if missing:
            raise InvalidRequest(f"Missing mandatory PRIMARY KEY part {missing[0][1:-1]}")
        empty = reduce(lambda a, b: a | b, (F.col(k).isNull() for k in keys))
        found = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.sum(empty.cast("long")).alias("empty")).first()
        if found.empty:
            raise InvalidRequest("Invalid null value in a PRIMARY KEY part")
        if (found.most or 0) > 1:
            raise InvalidRequest("Rows of a bulk change must have different PRIMARY KEYs")

    # definitions ------------------------------------------------------------------------------------------

    def _define(self, s: object) -> None:
        catalog = self.catalog
        if isinstance(s, n.Use):
            if s.keyspace not in SYSTEM:
                catalog.keyspace(s.keyspace)
            self.current = s.keyspace
        elif isinstance(s, n.CreateKeyspace):
            catalog.create_keyspace(s)
        elif isinstance(s, n.AlterKeyspace):
            catalog.alter_keyspace(s)
        elif isinstance(s, n.CreateTable):
            self._refuse_system(s.table)
            catalog.create_table(s, self._space(s.table))
        elif isinstance(s, n.AlterTable):
            space = catalog.keyspaces.get(self._space(s.table) or "")
            if s.if_exists and (space is None or s.table.name not in space.tables):
                return
            self._alter(s, self._table(s.table, write=True))
        elif isinstance(s, n.CreateIndex):
            space = self._space(s.table)
            self._refuse_system(s.table)
            catalog.create_index(s, catalog.table(space, s.table.name))
        elif isinstance(s, n.CreateType):
            self._refuse_system(s.name)
            catalog.create_type(s, self._space(s.name))
        elif isinstance(s, n.AlterType):
            self._alter_type(s)
        elif isinstance(s, n.Truncate):
            table = self._table(s.table, write=True)
            self.buffers.pop(table.full_name, None)
            self.store.write(table, mutate.empty_rows(self.spark, table, False), mutate.empty_rows(self.spark, table, True) if table.statics else None)
        elif isinstance(s, n.Drop):
            self._drop(s)

    def _refuse_system(self, name: n.TableName) -> None:
        if self._space(name) in SYSTEM:
            raise InvalidRequest("system keyspaces cannot be modified")

    def _alter(self, s: n.AlterTable, table: Table) -> None:
        self.flush(table)
        rows, statics = self.store.read(table)
        changed = self.catalog.alter_table(s, table)
        if s.action in ("add", "drop"):
            self._reshape(table, rows, statics, changed)

    def _reshape(self, table: Table, rows: DataFrame, statics: DataFrame | None, gone: list[str] = ()) -> None:
        """Bring a snapshot under the table's present columns. Dropped columns' cells go for good."""

        def fitted(frame: DataFrame | None, static: bool) -> DataFrame:
            schema = mutate.stored_schema(table, static)
            if frame is None:
                return mutate.empty_rows(self.spark, table, static)
            return frame.select(*((F.col(f"`{f.name}`") if f.name in frame.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))

        if gone:
            self.store.write(table, fitted(rows, False), fitted(statics, True) if table.statics else None)

    def _alter_type(self, s: n.AlterType) -> None:
        self._refuse_system(s.name)
        space = self._space(s.name)
        self.catalog.keyspace(space)
        users = [t for t in self.catalog.keyspace(space).tables.values() if not t.mounted and any(c.type.mentions(s.name.name) for c in t.columns.values())]
        before = {}
        for table in users:
            self.flush(table)
            before[table.full_name] = self.store.read(table)
        self.catalog.alter_type(s, space)
        for table in users:
            rows, statics = before[table.full_name]
            self.store.write(table, _retyped(rows, mutate.stored_schema(table, False)), _retyped(statics, mutate.stored_schema(table, True)) if statics is not None else None)

    def _drop(self, s: n.Drop) -> None:
        catalog = self.catalog
        if s.kind == "keyspace":
            name = s.name.name
            if name in SYSTEM:
                raise InvalidRequest("system keyspaces cannot be modified")
            if name not in catalog.keyspaces and s.if_exists:
                return
            for table in list(catalog.keyspace(name).tables.values()):
                self._forget(table)
            del catalog.keyspaces[name]
            self.current = None if self.current == name else self.current
            catalog.changed()
            return
        self._refuse_system(s.name)
        space = self._space(s.name)
        if s.kind == "table":
            if s.if_exists and (space not in catalog.keyspaces or s.name.name not in catalog.keyspaces[space].tables):
                return
            table = catalog.table(space, s.name.name)
            self._forget(table)
            del catalog.keyspaces[space].tables[table.name]
            catalog.changed()
        elif s.kind == "index":
            catalog.drop_index(space, s)
        else:
            catalog.drop_type(space, s)

    def _forget(self, table: Table) -> None:
        self.buffers.pop(table.full_name, None)
        self.mounts.pop(table.full_name, None)
        if not table.mounted:
            self.store.drop(table)


def _append(buffer: list[mutate.Segment], segment: mutate.Segment) -> None:
    """Fold a statement's segment into the last one, or begin a new one where a deletion by range parts them."""
    last = buffer[-1]
    if segment.erased is not None or last.erased is not None:
        buffer.append(segment)
        return
    for mine, theirs in ((last.rows, segment.rows), (last.statics, segment.statics)):
        for key, change in theirs.items():
            if key not in mine or change.reset:
                mine[key] = change
                continue
            held = mine[key]
            held.create |= change.create
            held.marker = change.marker if change.create else held.marker
            for name, ops in change.cells.items():
                held.cells.setdefault(name, []).extend(ops)


def _retyped(frame: DataFrame, schema) -> DataFrame:
    """Structs take their fields by place; those that were added are NULL."""

    def fit(col, old, new):
        if isinstance(new, T.StructType):
            parts = [fit(col[f.name], f.dataType, g.dataType).alias(g.name) for f, g in zip(old.fields, new.fields)]  # noqa: B905
            parts += [F.lit(None).cast(g.dataType).alias(g.name) for g in new.fields[len(old.fields) :]]
            return F.when(col.isNotNull(), F.struct(*parts))
        if isinstance(new, T.ArrayType):
            return F.transform(col, lambda x: fit(x, old.elementType, new.elementType))
        if isinstance(new, T.MapType):
            return F.transform_values(col, lambda k, v: fit(v, old.valueType, new.valueType))
        return col.cast(new)

    return frame.select(*(fit(F.col(f"`{g.name}`"), frame.schema[g.name].dataType, g.dataType).alias(g.name) for g in schema.fields))


__all__ = ["UNSET", "Prepared", "Session"]
