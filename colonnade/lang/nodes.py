"""The syntax tree."""

from __future__ import annotations

from dataclasses import dataclass, field

# terms ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    kind: str  # int float text bool null uuid duration
    value: object


@dataclass(frozen=True)
class Bind:
    position: int
    name: str | None = None


@dataclass(frozen=True)
class ListTerm:
    items: tuple


@dataclass(frozen=True)
class SetTerm:
    items: tuple


@dataclass(frozen=True)
class MapTerm:
    pairs: tuple


@dataclass(frozen=True)
class UdtTerm:
    fields: tuple


@dataclass(frozen=True)
class TupleTerm:
    items: tuple


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Hint:
    type: TypeName
    term: object


@dataclass(frozen=True)
class Negate:
    term: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class ColumnTerm:
    name: str


# types ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TypeName:
    name: str
    args: tuple = ()
    keyspace: str | None = None


# relations --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Compare:
    column: str
    op: str
    term: object


@dataclass(frozen=True)
class ElementCompare:
    column: str
    key: object
    op: str
    term: object


@dataclass(frozen=True)
class TupleCompare:
    columns: tuple
    op: str
    term: object  # TupleTerm, or for IN a TupleTerm of terms


@dataclass(frozen=True)
class TokenCompare:
    columns: tuple
    op: str
    term: object


# selectors --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnSelector:
    name: str


@dataclass(frozen=True)
class CountSelector:
    pass


@dataclass(frozen=True)
class CastSelector:
    inner: object
    type: TypeName


@dataclass(frozen=True)
class CallSelector:
    name: str
    args: tuple


@dataclass(frozen=True)
class TermSelector:
    term: object


@dataclass(frozen=True)
class Selected:
    selector: object
    alias: str | None = None


# statements -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TableName:
    keyspace: str | None
    name: str


@dataclass(frozen=True)
class Select:
    table: TableName
    selected: tuple | None  # None: *
    transform: str | None = None  # distinct json
    where: tuple = ()
    group_by: tuple = ()
    order_by: tuple = ()  # (column, descending)
    per_partition: object = None
    limit: object = None
    allow_filtering: bool = False


@dataclass(frozen=True)
class Using:
    ttl: object = None
    timestamp: object = None


@dataclass(frozen=True)
class Insert:
    table: TableName
    names: tuple
    values: tuple
    using: Using = field(default_factory=Using)
    if_not_exists: bool = False
    json: bool = False


@dataclass(frozen=True)
class Target:
    column: str
    key: object = None
    field: str | None = None


@dataclass(frozen=True)
class Update:
    table: TableName
    assignments: tuple  # (Target, term)
    where: tuple
    using: Using = field(default_factory=Using)
    conditional: bool = False


@dataclass(frozen=True)
class Delete:
    table: TableName
    targets: tuple
    where: tuple
    using: Using = field(default_factory=Using)
    conditional: bool = False


@dataclass(frozen=True)
class Batch:
    kind: str
    children: tuple
    using: Using = field(default_factory=Using)


@dataclass(frozen=True)
class Use:
    keyspace: str


@dataclass(frozen=True)
class CreateKeyspace:
    name: str
    options: tuple
    if_not_exists: bool = False


@dataclass(frozen=True)
class AlterKeyspace:
    name: str
    options: tuple
    if_exists: bool = False


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: TypeName
    static: bool = False
    primary: bool = False
    masked: bool = False


@dataclass(frozen=True)
class CreateTable:
    table: TableName
    columns: tuple
    primary_keys: tuple  # each (partition columns, clustering columns)
    options: tuple = ()
    ordering: tuple = ()
    if_not_exists: bool = False


@dataclass(frozen=True)
class AlterTable:
    table: TableName
    action: str  # add drop rename mask with
    columns: tuple = ()
    options: tuple = ()
    if_exists: bool = False
    guard: bool = False  # IF [NOT] EXISTS of the action


@dataclass(frozen=True)
class CreateIndex:
    table: TableName
    column: str
    selector: str | None = None
    name: str | None = None
    if_not_exists: bool = False


@dataclass(frozen=True)
class CreateType:
    name: TableName
    fields: tuple
    if_not_exists: bool = False


@dataclass(frozen=True)
class AlterType:
    name: TableName
    action: str  # add rename
    fields: tuple


@dataclass(frozen=True)
class Drop:
    kind: str  # keyspace table index type
    name: TableName
    if_exists: bool = False


@dataclass(frozen=True)
class Truncate:
    table: TableName
