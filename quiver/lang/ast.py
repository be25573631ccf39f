"""Syntax trees of queries. Plain frozen dataclasses, so that equal expressions compare equal."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Node:
    pass


# expressions -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Literal(Node):
    value: Any


@dataclass(frozen=True)
class Parameter(Node):
    name: str


@dataclass(frozen=True)
class Variable(Node):
    name: str


@dataclass(frozen=True)
class Property(Node):
    owner: Node
    name: str


@dataclass(frozen=True)
class Unary(Node):
    op: str
    operand: Node


@dataclass(frozen=True)
class Binary(Node):
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class IsNull(Node):
    operand: Node
    negated: bool


@dataclass(frozen=True)
class Case(Node):
    subject: Node | None
    branches: tuple[tuple[Node, Node], ...]
    default: Node | None


@dataclass(frozen=True)
class Call(Node):
    name: str
    args: tuple[Node, ...]


@dataclass(frozen=True)
class Aggregate(Node):
    name: str
    arg: Node | None
    distinct: bool = False
    extra: Node | None = None


@dataclass(frozen=True)
class ListOf(Node):
    items: tuple[Node, ...]


@dataclass(frozen=True)
class MapOf(Node):
    items: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class Cast(Node):
    operand: Node
    type: str


@dataclass(frozen=True)
class Exists(Node):
    query: Query


@dataclass(frozen=True)
class ValueOf(Node):
    query: Query


# patterns --------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class NodePattern(Node):
    variable: str | None
    labels: tuple[tuple[str, ...], ...] = ()  # all of: any of
    properties: tuple[tuple[str, Node], ...] = ()
    where: Node | None = None


@dataclass(frozen=True)
class EdgePattern(Node):
    variable: str | None
    labels: tuple[str, ...] = ()  # any of
    properties: tuple[tuple[str, Node], ...] = ()
    where: Node | None = None
    direction: str = "out"  # out, in, both
    quantifier: tuple[int, int | None] | None = None


@dataclass(frozen=True)
class Path(Node):
    elements: tuple[Node, ...]  # node, edge, node, ...
    variable: str | None = None
    mode: str | None = None  # WALK, TRAIL, SIMPLE, ACYCLIC
    shortest: str | None = None  # any, all


# clauses ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Item(Node):
    expression: Node
    alias: str | None = None


@dataclass(frozen=True)
class Sort(Node):
    expression: Node
    descending: bool = False


@dataclass(frozen=True)
class Page(Node):
    order: tuple[Sort, ...] = ()
    limit: Node | None = None
    offset: Node | None = None


@dataclass(frozen=True)
class Match(Node):
    paths: tuple[Path, ...]
    where: Node | None = None
    optional: bool = False
    mandatory: bool = False
    graph: str | None = None
    page: Page = Page()


@dataclass(frozen=True)
class Projection(Node):
    """RETURN and WITH."""

    items: tuple[Item, ...]  # an empty tuple stands for *
    distinct: bool = False
    final: bool = True
    group_by: tuple[Node, ...] = ()
    having: Node | None = None
    where: Node | None = None
    page: Page = Page()


@dataclass(frozen=True)
class Let(Node):
    items: tuple[tuple[str, Node], ...]


@dataclass(frozen=True)
class For(Node):
    variable: str
    source: Node


@dataclass(frozen=True)
class Filter(Node):
    condition: Node


@dataclass(frozen=True)
class Procedure(Node):
    name: str
    args: tuple[Node, ...] = ()
    yields: tuple[Item, ...] | None = None


@dataclass(frozen=True)
class Insert(Node):
    paths: tuple[Path, ...]


@dataclass(frozen=True)
class SetProperty(Node):
    variable: str
    name: str
    value: Node


@dataclass(frozen=True)
class SetAll(Node):
    variable: str
    value: Node


@dataclass(frozen=True)
class SetLabel(Node):
    variable: str
    label: str


@dataclass(frozen=True)
class Update(Node):
    """SET and REMOVE; removing sets a property to null, or takes a label away."""

    items: tuple[Node, ...]
    remove: bool = False


@dataclass(frozen=True)
class Delete(Node):
    variables: tuple[str, ...]
    detach: bool = False


@dataclass(frozen=True)
class Query(Node):
    clauses: tuple[Node, ...]


@dataclass(frozen=True)
class SetOperation(Node):
    op: str  # UNION, INTERSECT, EXCEPT
    all: bool
    left: Node
    right: Node


# catalog ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TypeDeclaration(Node):
    kind: str
    labels: tuple[str, ...]
    properties: tuple[tuple[str, str, bool], ...]
    source: str | None = None
    target: str | None = None


@dataclass(frozen=True)
class CreateGraph(Node):
    name: str
    if_not_exists: bool = False
    types: tuple[TypeDeclaration, ...] = ()
    type_only: bool = False


@dataclass(frozen=True)
class DropGraph(Node):
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class ListGraphs(Node):
    pass


@dataclass(frozen=True)
class CreateIndex(Node):
    name: str
    label: str
    properties: tuple[str, ...]
    unique: bool = False
    if_not_exists: bool = False


@dataclass(frozen=True)
class DropIndex(Node):
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class Transaction(Node):
    action: str


@dataclass(frozen=True)
class Program(Node):
    statements: tuple[Node, ...] = field(default=())


def walk(node: Any):
    """The node and all below it."""
    if isinstance(node, Node):
        yield node
        for name in node.__dataclass_fields__:
            yield from walk(getattr(node, name))
    elif isinstance(node, tuple):
        for x in node:
            yield from walk(x)


def has_aggregate(node: Any) -> bool:
    return any(isinstance(x, Aggregate) for x in walk(node))
