"""System tables, made from the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colonnade.plans.catalog import Catalog, Column, Keyspace, Table
from colonnade.plans.types import CqlType

_TEXT, _UUID, _INT, _BOOL, _INET = (CqlType(k) for k in ("text", "uuid", "int", "boolean", "inet"))
_TEXTS, _TEXT_MAP = CqlType("set", (_TEXT,)), CqlType("map", (_TEXT, _TEXT), frozen=True)
_TYPES = CqlType("list", (_TEXT,), frozen=True)
HOST_ID = "00000000-0000-4000-8000-000000000001"
VERSION, CQL_VERSION, PROTOCOL = "4.0.0", "3.4.5", "5"

#: Name -> (partition key, clustering key, other columns). System drivers expect these.
SCHEMAS: dict[str, tuple[dict, dict, dict]] = {
    "system.local": (
        {"key": _TEXT},
        {},
        {"bootstrapped": _TEXT, "cluster_name": _TEXT, "cql_version": _TEXT, "data_center": _TEXT, "host_id": _UUID, "native_protocol_version": _TEXT, "partitioner": _TEXT, "rack": _TEXT, "release_version": _TEXT, "rpc_address": _INET, "schema_version": _UUID, "tokens": _TEXTS},
    ),
    "system.peers": ({"peer": _INET}, {}, {"data_center": _TEXT, "host_id": _UUID, "preferred_ip": _INET, "rack": _TEXT, "release_version": _TEXT, "rpc_address": _INET, "schema_version": _UUID, "tokens": _TEXTS}),
    "system.peers_v2": ({"peer": _INET}, {"peer_port": _INT}, {"data_center": _TEXT, "host_id": _UUID, "native_address": _INET, "native_port": _INT, "rack": _TEXT, "release_version": _TEXT, "schema_version": _UUID, "tokens": _TEXTS}),
    "system_schema.keyspaces": ({"keyspace_name": _TEXT}, {}, {"durable_writes": _BOOL, "replication": _TEXT_MAP}),
    "system_schema.tables": ({"keyspace_name": _TEXT}, {"table_name": _TEXT}, {"comment": _TEXT, "default_time_to_live": _INT, "flags": _TEXTS, "gc_grace_seconds": _INT, "max_index_interval": _INT, "memtable_flush_period_in_ms": _INT, "min_index_interval": _INT}),
    "system_schema.columns": ({"keyspace_name": _TEXT}, {"table_name": _TEXT, "column_name": _TEXT}, {"clustering_order": _TEXT, "kind": _TEXT, "position": _INT, "type": _TEXT}),
    "system_schema.indexes": ({"keyspace_name": _TEXT}, {"table_name": _TEXT, "index_name": _TEXT}, {"kind": _TEXT, "options": _TEXT_MAP}),
    "system_schema.types": ({"keyspace_name": _TEXT}, {"type_name": _TEXT}, {"field_names": _TYPES, "field_types": _TYPES}),
    "system_schema.views": ({"keyspace_name": _TEXT}, {"view_name": _TEXT}, {"base_table_name": _TEXT, "where_clause": _TEXT}),
    "system_schema.triggers": ({"keyspace_name": _TEXT}, {"table_name": _TEXT, "trigger_name": _TEXT}, {"options": _TEXT_MAP}),
    "system_schema.dropped_columns": ({"keyspace_name": _TEXT}, {"table_name": _TEXT, "column_name": _TEXT}, {"kind": _TEXT, "type": _TEXT}),
    "system_schema.functions": ({"keyspace_name": _TEXT}, {"function_name": _TEXT, "argument_types": _TYPES}, {"body": _TEXT, "language": _TEXT, "return_type": _TEXT}),
    "system_schema.aggregates": ({"keyspace_name": _TEXT}, {"aggregate_name": _TEXT, "argument_types": _TYPES}, {"final_func": _TEXT, "state_func": _TEXT, "state_type": _TEXT}),
}


def definition(full_name: str) -> Table | None:
    if full_name not in SCHEMAS:
        return None
    partition, clustering, others = SCHEMAS[full_name]
    columns = {k: Column(k, t, "partition", i) for i, (k, t) in enumerate(partition.items())}
    columns |= {k: Column(k, t, "clustering", i) for i, (k, t) in enumerate(clustering.items())}
    columns |= {k: Column(k, t) for k, t in others.items()}
    space, _, name = full_name.partition(".")
    return Table(space, name, columns, mounted=True)


def _user(catalog: Catalog) -> list[Keyspace]:
    system = [Keyspace(k, {"class": "LocalStrategy"}) for k in ("system", "system_schema")]
    for space in system:
        for full in SCHEMAS:
            if full.startswith(space.name + "."):
                table = definition(full)
                space.tables[table.name] = table
    return [*system, *catalog.keyspaces.values()]


def rows(full_name: str, catalog: Catalog) -> list[dict]:
    spaces = _user(catalog)
    tables = [t for k in spaces for t in k.tables.values()]
    if full_name == "system.local":
        version = f"00000000-0000-4000-8000-{catalog.version & (1 << 48) - 1:012x}"
        return [dict(key="local", bootstrapped="COMPLETED", cluster_name="colonnade", cql_version=CQL_VERSION, data_center="datacenter1", host_id=HOST_ID, native_protocol_version=PROTOCOL, partitioner="org.apache.cassandra.dht.Murmur3Partitioner", rack="rack1", release_version=VERSION, rpc_address=b"\x7f\x00\x00\x01", schema_version=version, tokens=["0"])]
    if full_name == "system_schema.keyspaces":
        return [dict(keyspace_name=k.name, durable_writes=k.durable, replication=k.replication) for k in spaces]
    if full_name == "system_schema.tables":
        return [dict(keyspace_name=t.keyspace, table_name=t.name, comment="", flags=["compound"], default_time_to_live=t.options.get("default_time_to_live", 0), gc_grace_seconds=t.options.get("gc_grace_seconds", 864000), max_index_interval=t.options.get("max_index_interval", 2048), memtable_flush_period_in_ms=t.options.get("memtable_flush_period_in_ms", 0), min_index_interval=t.options.get("min_index_interval", 128)) for t in tables]
    if full_name == "system_schema.columns":
        kinds = {"partition": "partition_key"}
        return [
            dict(keyspace_name=t.keyspace, table_name=t.name, column_name=c.name, clustering_order=("desc" if c.descending else "asc") if c.kind == "clustering" else "none", kind=kinds.get(c.kind, c.kind), position=c.position if c.kind in ("partition", "clustering") else -1, type=str(c.type))
            for t in tables
            for c in t.star
        ]
    if full_name == "system_schema.indexes":
        target = lambda i: i.column if i.kind == "values" else f"{i.kind}({i.column})"
        return [dict(keyspace_name=t.keyspace, table_name=t.name, index_name=i.name, kind="COMPOSITES", options={"target": target(i)}) for t in tables for i in t.indexes.values()]
    if full_name == "system_schema.types":
        return [dict(keyspace_name=k.name, type_name=name, field_names=list(fields), field_types=[str(t) for t in fields.values()]) for k in spaces for name, fields in k.types.items()]
    if full_name == "system_schema.dropped_columns":
        return [dict(keyspace_name=t.keyspace, table_name=t.name, column_name=name, kind="static" if static else "regular", type=kind) for t in tables for name, (kind, static) in t.dropped.items()]
    return []


def frame(spark: SparkSession, full_name: str, catalog: Catalog) -> tuple[Table, DataFrame]:
    from pyspark.sql import types as T

    table = definition(full_name)
    schema = T.StructType([T.StructField(c.name, c.type.spark()) for c in table.star])
    return table, spark.createDataFrame([tuple(r.get(c.name) for c in table.star) for r in rows(full_name, catalog)], schema)


__all__ = ["SCHEMAS", "definition", "frame"]
