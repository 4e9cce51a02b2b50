"""The constraint graph: hash-consed operator nodes over classes, properties and literals.

It lives on the driver, is built once per set of concepts, and is lowered to a DataFrame plan by
``ontoflow.operators.lower``. Structurally equal nodes are one node, so concepts share their parts.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum


class Kind(Enum):
    CONST = "const"
    ATOMIC = "atomic"
    NOMINAL = "nominal"
    DATATYPE = "datatype"
    NEGATION = "negation"
    HAS_SELF = "has_self"
    EXISTS = "exists"
    EXISTS_TRANSITIVE = "exists_transitive"
    FORALL = "forall"
    MIN_CARD = "min_card"
    MAX_CARD = "max_card"
    EXACT_CARD = "exact_card"
    INTERSECTION = "intersection"
    UNION = "union"
    PATH_STEP = "path_step"


FORWARD, BACKWARD = "forward", "backward"
EDGE_KINDS = frozenset({Kind.EXISTS, Kind.EXISTS_TRANSITIVE, Kind.FORALL, Kind.MIN_CARD, Kind.MAX_CARD, Kind.EXACT_CARD, Kind.PATH_STEP, Kind.HAS_SELF})


@dataclass(frozen=True)
class Node:
    kind: Kind
    children: tuple[int, ...] = ()
    prop: str | None = None
    direction: str = FORWARD
    cls: str | None = None
    node: object = None
    datatype: str | None = None
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False
    k: int | None = None
    mean: bool = False  # INTERSECTION: arithmetic mean instead of minimum
    fuzzy: bool = False  # MIN_CARD: share of k instead of the k-th largest score
    family: tuple[tuple[str, str], ...] = ()  # EXISTS_TRANSITIVE: properties and directions walked
    scale: float | None = None


@dataclass
class Dag:
    """Nodes in an order in which children come first, and named roots."""

    nodes: list[Node] = field(default_factory=list)
    roots: dict[str, int] = field(default_factory=dict)
    _known: dict[Node, int] = field(default_factory=dict, repr=False)

    def add(self, node: Node) -> int:
        if any(c >= len(self.nodes) for c in node.children):
            raise ValueError("a child must be added before its parent")
        if node not in self._known:
            self._known[node] = len(self.nodes)
            self.nodes.append(node)
        return self._known[node]

    def root(self, name: str, node: int) -> "Dag":
        self.roots[name] = node
        return self

    # Leaves

    def const(self, scale: float | None = None) -> int:
        return self.add(Node(Kind.CONST, scale=scale))

    def atomic(self, cls: str, scale: float | None = None) -> int:
        return self.add(Node(Kind.ATOMIC, cls=cls, scale=scale))

    def nominal(self, node: object, scale: float | None = None) -> int:
        if node is None:
            raise ValueError("a nominal needs a node")
        return self.add(Node(Kind.NOMINAL, node=node, scale=scale))

    def datatype(self, datatype: str | None = None, low=None, high=None, low_open=False, high_open=False, scale: float | None = None) -> int:
        return self.add(Node(Kind.DATATYPE, datatype=datatype, low=low, high=high, low_open=low_open, high_open=high_open, scale=scale))

    # Boolean operators

    def negation(self, child: int, scale: float | None = None) -> int:
        return self.add(Node(Kind.NEGATION, (child,), scale=scale))

    def intersection(self, *children: int, mean: bool = False, scale: float | None = None) -> int:
        return self._combined(Kind.INTERSECTION, children, mean, scale)

    def union(self, *children: int, scale: float | None = None) -> int:
        return self._combined(Kind.UNION, children, False, scale)

    def _combined(self, kind, children, mean, scale):
        """Nested members are flattened and repeated ones dropped; one member is that member."""
        flat: list[int] = []
        for c in children:
            inner = self.nodes[c]
            flat += inner.children if inner.kind is kind and not mean and not inner.mean and inner.scale is None else (c,)
        if not mean:
            flat = sorted(set(flat))
        if not flat:
            raise ValueError(f"{kind.value} needs members")
        if len(flat) == 1 and scale is None:
            return flat[0]
        return self.add(Node(kind, tuple(flat), mean=mean, scale=scale))

    # Operators over edges

    def exists(self, prop: str, child: int | None = None, direction: str = FORWARD, scale: float | None = None) -> int:
        return self.add(Node(Kind.EXISTS, (self._child(child),), prop, direction, scale=scale))

    def forall(self, prop: str, child: int, direction: str = FORWARD, scale: float | None = None) -> int:
        return self.add(Node(Kind.FORALL, (child,), prop, direction, scale=scale))

    def exists_transitive(self, prop: str, child: int, direction: str = FORWARD, family=None, scale: float | None = None) -> int:
        walked = tuple(sorted(family or ((prop, direction),)))
        return self.add(Node(Kind.EXISTS_TRANSITIVE, (child,), prop, direction, family=walked, scale=scale))

    def min_card(self, k: int, prop: str, child: int | None = None, direction: str = FORWARD, fuzzy: bool = False, scale: float | None = None) -> int:
        return self.add(Node(Kind.MIN_CARD, (self._child(child),), prop, direction, k=k, fuzzy=fuzzy, scale=scale))

    def max_card(self, k: int, prop: str, child: int | None = None, direction: str = FORWARD, scale: float | None = None) -> int:
        return self.add(Node(Kind.MAX_CARD, (self._child(child),), prop, direction, k=k, scale=scale))

    def exact_card(self, k: int, prop: str, child: int | None = None, direction: str = FORWARD, scale: float | None = None) -> int:
        return self.add(Node(Kind.EXACT_CARD, (self._child(child),), prop, direction, k=k, scale=scale))

    def has_self(self, prop: str, scale: float | None = None) -> int:
        return self.add(Node(Kind.HAS_SELF, prop=prop, scale=scale))

    def path_step(self, prop: str, cls: str, child: int | None = None, direction: str = FORWARD, scale: float | None = None) -> int:
        return self.add(Node(Kind.PATH_STEP, () if child is None else (child,), prop, direction, cls=cls, scale=scale))

    def _child(self, child):
        return self.const() if child is None else child

    # Views

    def merge(self, other: "Dag") -> dict[int, int]:
        """Adds the other's nodes and roots; returns where its nodes are now."""
        place: dict[int, int] = {}
        for i, n in enumerate(other.nodes):
            children = tuple(place[c] for c in n.children)
            if n.kind in (Kind.UNION, Kind.INTERSECTION) and not n.mean:
                children = tuple(sorted(set(children)))
            place[i] = self.add(Node(**{**n.__dict__, "children": children}))
        self.roots.update({k: place[v] for k, v in other.roots.items()})
        return place

    def reachable(self, roots) -> list[int]:
        """The nodes that the roots need, children first."""
        seen: set[int] = set()
        todo = list(roots)
        while todo:
            if (n := todo.pop()) not in seen:
                seen.add(n)
                todo += self.nodes[n].children
        return sorted(seen)

    def layers(self) -> list[list[int]]:
        """Nodes by their distance from the leaves."""
        depth: list[int] = []
        for n in self.nodes:
            depth.append(1 + max((depth[c] for c in n.children), default=-1))
        return [[i for i, d in enumerate(depth) if d == k] for k in range(max(depth, default=-1) + 1)]

    def edge_depth(self) -> list[int]:
        """How many edge operators lie on the longest way down from each node, itself included."""
        depth: list[int] = []
        for n in self.nodes:
            depth.append(max((depth[c] for c in n.children), default=0) + (n.kind in EDGE_KINDS))
        return depth

    def crisp(self) -> list[bool]:
        """Whether a node's scores can only be 0 or 1, taking class weights to be so."""
        out: list[bool] = []
        for n in self.nodes:
            own = n.kind not in (Kind.PATH_STEP,) and not n.mean and not n.fuzzy and n.scale in (None, 1.0)
            out.append(own and all(out[c] for c in n.children))
        return out

    def report(self) -> list[dict]:
        """Of each node: classes and properties named by itself and below it."""
        out: list[dict] = []
        for i, n in enumerate(self.nodes):
            classes = {n.cls} if n.cls else set()
            props = {n.prop} if n.prop else set()
            below = [out[c] for c in n.children]
            out.append({
                "node": i, "kind": n.kind.value, "classes": sorted(classes), "properties": sorted(props),
                "all_classes": sorted(classes.union(*(b["all_classes"] for b in below))),
                "all_properties": sorted(props.union(*(b["all_properties"] for b in below))),
            })
        return out


def path_pattern(steps: list[tuple[str, str]], normalize: bool = True, dag: Dag | None = None) -> tuple[Dag, int]:
    """A chain of path steps (property, class), first step outermost; normalized to at most 1."""
    if not steps:
        raise ValueError("a path needs a step")
    dag = dag or Dag()
    below = None
    for i in range(len(steps) - 1, -1, -1):
        prop, cls = steps[i]
        below = dag.path_step(prop, cls, below, scale=1.0 / len(steps) if normalize and i == 0 else None)
    return dag, below
