"""Schemas on the driver: class expressions, axioms, role box, and what follows from names alone."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass, field

from ..sources.graph import XSD
from ..sources.rdf import OWL, RDF, RDFS, TYPE, Triple, is_literal, literal_parts
from .ir import BACKWARD, FORWARD


@dataclass(frozen=True)
class Expr:
    """A class expression; ``kind`` is one of thing, named, and, or, not, some, only, card, value, one_of, self, data."""

    kind: str
    parts: tuple["Expr", ...] = ()
    name: str | None = None
    prop: str | None = None
    direction: str = FORWARD
    values: tuple[str, ...] = ()
    k: int | None = None
    bound: str | None = None  # card: min, max or exact
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    high_open: bool = False

    def __str__(self) -> str:
        inner = ",".join(sorted(map(str, self.parts))) if self.kind in ("and", "or") else ",".join(map(str, self.parts))
        bits = [self.name, self.prop and f"{self.prop}/{self.direction}", self.bound and f"{self.bound}{self.k}", ",".join(self.values), inner]
        if self.kind == "data":
            bits.append(f"{self.low}{self.low_open}{self.high}{self.high_open}")
        return f"{self.kind}({' '.join(b for b in bits if b)})"

    def classes(self) -> set[str]:
        own = {self.name} if self.kind == "named" else set()
        return own.union(*(p.classes() for p in self.parts))

    def depends_on(self) -> set[str]:
        """The classes whose members can change it, helpers of its unions included."""
        own = {self.name} if self.kind == "named" else {helper_class(self)} if self.kind == "or" else set()
        return own.union(*(p.depends_on() for p in self.parts))

    def properties(self) -> set[str]:
        own = {self.prop} if self.prop else set()
        return own.union(*(p.properties() for p in self.parts))


THING = Expr("thing")


def named(iri: str) -> Expr:
    return THING if iri in (OWL + "Thing", RDFS + "Resource") else Expr("data", name=iri) if iri.startswith(XSD) or iri == RDFS + "Literal" else Expr("named", name=iri)


def helper_class(e: Expr) -> str:
    """The name of the class that stands for a union in a conclusion."""
    return "urn:ontoflow:any:" + hashlib.sha256(str(e).encode()).hexdigest()[:16]


class Unsupported(ValueError):
    """An expression outside the fragment."""


@dataclass
class Schema:
    sub: list[tuple[Expr, Expr]] = field(default_factory=list)
    equivalent: list[tuple[Expr, Expr]] = field(default_factory=list)
    disjoint: list[tuple[str, str]] = field(default_factory=list)
    domains: dict[str, list[Expr]] = field(default_factory=lambda: defaultdict(list))
    ranges: dict[str, list[Expr]] = field(default_factory=lambda: defaultdict(list))
    sub_properties: list[tuple[str, str]] = field(default_factory=list)
    inverses: list[tuple[str, str]] = field(default_factory=list)
    chains: list[tuple[tuple[str, ...], str]] = field(default_factory=list)
    transitive: set[str] = field(default_factory=set)
    functional: set[str] = field(default_factory=set)
    reflexive: set[str] = field(default_factory=set)
    keys: dict[str, tuple[str, ...]] = field(default_factory=dict)
    classes: set[str] = field(default_factory=set)
    different: list[tuple[str, str]] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)

    # Closures over names

    def super_classes(self) -> dict[str, set[str]]:
        """All named superclasses of each class, itself excluded unless it is on a cycle."""
        direct: dict[str, set[str]] = defaultdict(set)
        for a, b in [*self.sub, *self.equivalent, *((b, a) for a, b in self.equivalent)]:
            if a.kind == "named":
                direct[a.name] |= {x.name for x in (b.parts if b.kind == "and" else (b,)) if x.kind == "named"}
        return closed(direct)

    def super_properties(self) -> dict[str, set[str]]:
        direct: dict[str, set[str]] = defaultdict(set)
        for p, q in self.sub_properties:
            direct[p].add(q)
        return closed(direct)

    def family(self, prop: str) -> list[str]:
        """The property and all its subproperties."""
        return [prop, *sorted(p for p, above in self.super_properties().items() if prop in above and p != prop)]

    def conditions(self, cls: str) -> list[Expr]:
        """Every expression that members of the class must meet, by its own axioms."""
        own = {cls} | {b.name for a, b in self.equivalent if a == named(cls) and b.kind == "named"} | {a.name for a, b in self.equivalent if b == named(cls) and a.kind == "named"}
        out: list[Expr] = []
        for c in sorted(own):
            out += [b for a, b in self.sub if a == named(c)]
            out += [b for a, b in self.equivalent if a == named(c) and b.kind != "named"]
            out += [a for a, b in self.equivalent if b == named(c) and a.kind != "named"]
            out += [Expr("not", (named(b if a == c else a),)) for a, b in self.disjoint if c in (a, b)]
        return list(dict.fromkeys(out))

    def required(self, cls: str) -> list[Expr]:
        """The conjuncts of a class and its named superclasses, intersections opened."""
        todo = [e for c in [cls, *sorted(self.super_classes().get(cls, ()))] for e in self.conditions(c)]
        out = []
        while todo:
            e = todo.pop(0)
            todo += e.parts if e.kind == "and" else ()
            out += [] if e.kind == "and" else [e]
        return list(dict.fromkeys(out))

    def complements(self) -> list[tuple[str, str]]:
        """Pairs (A, B) with A equivalent to what isn't B."""
        return [(a.name, b.parts[0].name) for x, y in self.equivalent for a, b in ((x, y), (y, x)) if a.kind == "named" and b.kind == "not" and b.parts[0].kind == "named"]

    def negations(self) -> list[tuple[str, str]]:
        """Pairs that exclude each other: disjoint classes, and subclasses of a complement."""
        out = list(self.disjoint)
        for a, b in self.sub:
            for e in b.parts if b.kind == "and" else (b,):
                if a.kind == "named" and e.kind == "not" and e.parts[0].kind == "named":
                    out.append((a.name, e.parts[0].name))
        return list(dict.fromkeys(out))

    # Rules

    def rules(self) -> list[tuple[Expr, str]]:
        """Sufficient conditions (antecedent, class): what puts a node into a class.

        A union in a conclusion becomes a helper class, which unions in conditions accept and which
        passes on the superclasses that all its members share. Conclusions of other kinds are skipped.
        """
        out: list[tuple[Expr, str]] = []
        helpers: dict[str, Expr] = {}
        above = self.super_classes()

        def conclude(a: Expr, b: Expr):
            if b.kind == "named":
                out.append((a, b.name))
            elif b.kind == "and":
                for x in b.parts:
                    conclude(a, x)
            elif b.kind == "or" and all(x.kind == "named" for x in b.parts):
                h = helper_class(b)
                helpers[h] = b
                out.append((a, h))
            elif b.kind not in ("thing", "data"):
                self.skipped.append(f"{a} -> {b}")

        for a, b in self.sub:
            conclude(a, b)
        for a, b in self.equivalent:
            conclude(a, b)
            conclude(b, a)
        for p, es in self.domains.items():
            for e in es:
                conclude(Expr("some", (THING,), prop=p), e)
        for p, es in self.ranges.items():
            for e in es:
                if e.kind != "data":
                    conclude(Expr("some", (THING,), prop=p, direction=BACKWARD), e)
        for h, e in helpers.items():
            out.append((e, h))
            shared = set.intersection(*({x.name} | above.get(x.name, set()) for x in e.parts))
            out += [(named(h), c) for c in sorted(shared)]
        return [(a, c) for a, c in dict.fromkeys(out) if a != named(c)]

    def relevant(self, targets: list[str]) -> set[str]:
        """Classes from which rules lead to the targets, targets included."""
        rules = self.rules()
        seen, todo = set(), list(targets)
        while todo:
            if (c := todo.pop()) not in seen:
                seen.add(c)
                todo += [x for a, b in rules if b == c for x in a.depends_on()]
        return seen

    def defined_classes(self) -> list[str]:
        return sorted(c for c in self.classes if self.conditions(c))

    @classmethod
    def from_triples(cls, triples: list[Triple]) -> "Schema":
        return _Reader(triples).schema()


def closed(direct: dict[str, set[str]]) -> dict[str, set[str]]:
    """What is reached from each key."""
    out = {}
    for start in direct:
        seen: set[str] = set()
        todo = list(direct[start])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += direct.get(x, ())
        out[start] = seen
    return out


def strongly_connected(graph: dict[str, set[str]]) -> list[list[str]]:
    """Components, those that others depend on first; ``graph`` maps a node to what it depends on."""
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    out: list[list[str]] = []
    for root in sorted(graph):
        if root in index:
            continue
        work = [(root, iter(sorted(graph.get(root, ()))))]
        index[root] = low[root] = len(index)
        stack.append(root)
        while work:
            node, rest = work[-1]
            for x in rest:
                if x not in index:
                    index[x] = low[x] = len(index)
                    stack.append(x)
                    work.append((x, iter(sorted(graph.get(x, ())))))
                    break
                if x in stack:
                    low[node] = min(low[node], index[x])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                    out.append(sorted(part))
    return out


class _Reader:
    """Axioms and expressions from triples."""

    def __init__(self, triples: list[Triple]):
        self.by: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for s, p, o in triples:
            self.by[s][p].append(o)
        self.triples = triples

    def one(self, s: str, p: str) -> str | None:
        return (self.by[s].get(p) or [None])[0] if s in self.by else None

    def items(self, head: str) -> list[str]:
        out = []
        while head and head != RDF + "nil":
            out.append(self.one(head, RDF + "first"))
            head = self.one(head, RDF + "rest")
        return out

    def property(self, term: str) -> tuple[str, str]:
        if not term.startswith("_:"):
            return term, FORWARD
        inner = self.one(term, OWL + "inverseOf")
        if inner is None or inner.startswith("_:"):
            raise Unsupported(f"property {term}")
        return inner, BACKWARD

    def expr(self, term: str) -> Expr:
        if not term.startswith("_:"):
            return named(term)
        for p, kind in ((OWL + "intersectionOf", "and"), (OWL + "unionOf", "or")):
            if head := self.one(term, p):
                parts = tuple(dict.fromkeys(self.expr(x) for x in self.items(head)))
                return parts[0] if len(parts) == 1 else Expr(kind, parts)
        if inner := self.one(term, OWL + "complementOf"):
            return Expr("not", (self.expr(inner),))
        if head := self.one(term, OWL + "oneOf"):
            return Expr("one_of", values=tuple(self.items(head)))
        if datatype := self.one(term, OWL + "onDatatype"):
            return self.facets(datatype, self.one(term, OWL + "withRestrictions"))
        on = self.one(term, OWL + "onProperty")
        if on is None:
            raise Unsupported(f"expression {term}")
        prop, direction = self.property(on)
        for p, kind in ((OWL + "someValuesFrom", "some"), (OWL + "allValuesFrom", "only")):
            if filler := self.one(term, p):
                inner = self.expr(filler)
                if kind == "some" and inner.kind == "one_of" and len(inner.values) == 1:
                    return Expr("value", prop=prop, direction=direction, values=inner.values)
                return Expr(kind, (inner,), prop=prop, direction=direction)
        if (value := self.one(term, OWL + "hasValue")) is not None:
            return Expr("value", prop=prop, direction=direction, values=(value,))
        if (flag := self.one(term, OWL + "hasSelf")) is not None:
            if literal_parts(flag)[0] in ("true", "1"):
                return Expr("self", prop=prop)
            raise Unsupported("hasSelf false")
        filler = self.one(term, OWL + "onClass") or self.one(term, OWL + "onDataRange")
        inner = self.expr(filler) if filler else THING
        for bound in ("min", "max", ""):
            for p in (f"{bound}Cardinality", f"{bound}QualifiedCardinality"):
                if (n := self.one(term, OWL + p[:1].lower() + p[1:])) is not None and int(literal_parts(n)[0]) >= 0:
                    return Expr("card", (inner,), prop=prop, direction=direction, k=int(literal_parts(n)[0]), bound=bound or "exact")
        raise Unsupported(f"restriction {term}")

    def facets(self, datatype: str, head: str | None) -> Expr:
        bounds: dict = {}
        for cell in self.items(head) if head else []:
            for p, values in self.by[cell].items():
                x = float(literal_parts(values[-1])[0])
                side, kind = ("low" if "min" in p else "high"), p.endswith("Exclusive")
                bounds |= {side: x, f"{side}_open": kind}
        return Expr("data", name=datatype, **bounds)

    def schema(self) -> Schema:
        s = Schema()
        for a, p, b in self.triples:
            try:
                self.axiom(s, a, p, b)
            except Unsupported as e:
                s.skipped.append(str(e))
        return s

    def axiom(self, s: Schema, a: str, p: str, b: str):
        if p == RDFS + "subClassOf":
            s.sub.append((self.expr(a), self.expr(b)))
        elif p == OWL + "equivalentClass":
            s.equivalent.append((self.expr(a), self.expr(b)))
        elif p in (OWL + "intersectionOf", OWL + "unionOf", OWL + "oneOf", OWL + "complementOf") and not a.startswith("_:"):
            self.by["_:own"] = defaultdict(list, {p: [b]})
            s.equivalent.append((named(a), self.expr("_:own")))
        elif p == OWL + "disjointWith":
            x, y = self.expr(a), self.expr(b)
            if x.kind == y.kind == "named":
                s.disjoint.append((x.name, y.name))
            else:
                s.sub.append((x, Expr("not", (y,))))
        elif p == RDFS + "domain":
            s.domains[a].append(self.expr(b))
        elif p == RDFS + "range":
            s.ranges[a].append(self.expr(b))
        elif p == RDFS + "subPropertyOf":
            s.sub_properties.append((a, b))
        elif p == OWL + "inverseOf" and not a.startswith("_:"):
            s.inverses.append((a, b))
        elif p == OWL + "propertyChainAxiom":
            s.chains.append((tuple(self.items(b)), a))
        elif p == OWL + "hasKey":
            s.keys[a] = tuple(sorted(self.items(b)))
        elif p == OWL + "differentFrom":
            s.different.append((a, b))
        elif p in (OWL + "members", OWL + "distinctMembers") and OWL + "AllDifferent" in self.by[a][TYPE]:
            own = self.items(b)
            s.different += [(x, y) for i, x in enumerate(own) for y in own[i + 1 :]]
        elif p == TYPE:
            kinds = {OWL + "TransitiveProperty": s.transitive, OWL + "FunctionalProperty": s.functional, OWL + "ReflexiveProperty": s.reflexive}
            if b in kinds:
                kinds[b].add(a)
            elif b in (OWL + "Class", RDFS + "Class") and not a.startswith("_:"):
                s.classes.add(a)
            elif b in (OWL + "AllDisjointClasses", OWL + "SymmetricProperty", OWL + "AsymmetricProperty", OWL + "IrreflexiveProperty", OWL + "InverseFunctionalProperty"):
                s.skipped.append(f"{a} is {b}")


def is_data(e: Expr) -> bool:
    return e.kind == "data" or e.kind == "one_of" and all(map(is_literal, e.values))
