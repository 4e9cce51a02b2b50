"""Compilation of class expressions to constraint graphs.

Role axioms are expanded into the conditions: a restriction on a property holds by way of its
subproperties, of inverses in the other direction, and of chains as nested restrictions. Named
classes stay atomic, so that definitions chain only through materialized memberships.
"""

from __future__ import annotations

from ..sources.rdf import is_literal
from .ir import BACKWARD, FORWARD, Dag, Kind
from .schema import THING, Expr, Schema, Unsupported, helper_class, is_data, named

#: The property that holds negative assertions of another.
DENIED = "urn:ontoflow:denied:"
#: Node kinds under which a score can only rise as memberships are added.
MONOTONE = frozenset({Kind.CONST, Kind.ATOMIC, Kind.NOMINAL, Kind.DATATYPE, Kind.HAS_SELF, Kind.EXISTS, Kind.EXISTS_TRANSITIVE, Kind.MIN_CARD, Kind.INTERSECTION, Kind.UNION, Kind.PATH_STEP})


def flip(direction: str) -> str:
    return BACKWARD if direction == FORWARD else FORWARD


class Compiler:
    """Expressions of one schema as nodes of one constraint graph, each compiled once.

    ``fuzzy`` replaces minima by means and exclusion by agreement; ``denials`` adds to exact values
    that the edge isn't denied; ``helpers`` lets the class that stands for a concluded union meet it.
    """

    def __init__(self, schema: Schema, dag: Dag | None = None, *, fuzzy: bool = False, denials: bool = False, helpers: bool = False, aliases: dict[str, list[str]] | None = None):
        self.schema, self.dag = schema, dag or Dag()
        self.fuzzy, self.denials, self.helpers, self.aliases = fuzzy, denials, helpers, aliases or {}
        self._known: dict[Expr, int] = {}
        self._inverse: dict[str, set[str]] = {}
        for p, q in schema.inverses:
            self._inverse.setdefault(p, set()).add(q)
            self._inverse.setdefault(q, set()).add(p)

    # Expressions

    def expr(self, e: Expr) -> int:
        if e not in self._known:
            self._known[e] = self._compile(e)
        return self._known[e]

    def _compile(self, e: Expr) -> int:
        d = self.dag
        if e.kind == "thing":
            return d.const()
        if e.kind == "named":
            return d.atomic(e.name)
        if e.kind == "data":
            datatype = e.name if e.name and not e.name.endswith(("#Literal",)) else None
            return d.datatype(datatype, e.low, e.high, e.low_open, e.high_open)
        if e.kind == "and":
            return d.intersection(*map(self.expr, e.parts), mean=self.fuzzy)
        if e.kind == "or":
            members = [self.expr(p) for p in e.parts]
            if self.helpers and all(p.kind == "named" for p in e.parts):
                members.append(d.atomic(helper_class(e)))
            return d.union(*members)
        if e.kind == "not":
            return d.negation(self.expr(e.parts[0]))
        if e.kind == "one_of":
            return d.union(*(d.nominal(v) for x in e.values for v in self.aliases.get(x, [x])))
        if e.kind == "self":
            return d.has_self(e.prop)
        if e.kind == "some":
            return self.restriction("some", e.prop, e.direction, self.expr(e.parts[0]))
        if e.kind == "only":
            return self.restriction("only", e.prop, e.direction, self.expr(e.parts[0]))
        if e.kind == "card":
            child = None if e.parts[0] == THING else self.expr(e.parts[0])
            # Cardinalities don't look at other properties: what those entail can't be counted apart.
            return getattr(d, f"{e.bound}_card")(e.k, e.prop, child, e.direction)
        if e.kind == "value":
            target = self.expr(Expr("one_of", values=e.values))
            parts = [self.restriction("some", e.prop, e.direction, target)]
            if e.prop in self.schema.functional:
                parts.append(d.forall(e.prop, target, e.direction))
            if self.denials:
                parts.append(d.negation(d.exists(DENIED + e.prop, target, e.direction)))
            return d.intersection(*parts)
        raise Unsupported(str(e))

    def restriction(self, kind: str, prop: str, direction: str, child: int, seen: frozenset = frozenset()) -> int:
        """Some or only, over every way in which edges of the property come about."""
        d, here = self.dag, seen | {(prop, direction)}
        ways: list[int] = []
        if kind == "some" and prop in self.schema.transitive:
            ways.append(d.exists_transitive(prop, child, direction, [(p, direction) for p in self.schema.family(prop)]))
        else:
            ways.append(d.exists(prop, child, direction) if kind == "some" else d.forall(prop, child, direction))
        for p, q in self.schema.sub_properties:
            if q == prop and (p, direction) not in here:
                ways.append(self.restriction(kind, p, direction, child, here))
        for q in sorted(self._inverse.get(prop, ())):
            if (q, flip(direction)) not in here:
                ways.append(self.restriction(kind, q, flip(direction), child, here))
        for chain, head in self.schema.chains:
            if head == prop and all((p, direction) not in here for p in chain):
                inner = child
                for p in chain if direction == BACKWARD else reversed(chain):
                    inner = self.restriction(kind, p, direction, inner, here)
                ways.append(inner)
        return d.union(*ways) if kind == "some" else d.intersection(*ways)

    # Classes

    def necessary(self, cls: str, *, augment: bool = False) -> int:
        """What members of a class must meet: all its conditions, or its own membership if it has none.

        With ``augment``, evidence for the class is also a property whose domain (or whose inverse's
        range) is the class, and the ranges and domains of such properties must hold.
        """
        conditions = self.schema.conditions(cls)
        fuzzy = [self._agreement(cls, e.parts[0]) if self.fuzzy and e.kind == "not" and e.parts[0].kind == "named" else self.expr(e) for e in conditions]
        base = self.dag.intersection(*fuzzy, mean=self.fuzzy and len(fuzzy) > 1) if fuzzy else self.dag.atomic(cls)
        if not augment:
            return base
        evidence, limits = [base], []
        above = self.schema.super_classes()
        is_for = lambda e: e.kind == "named" and (e.name == cls or cls in above.get(e.name, ()))
        for p, es in sorted(self.schema.domains.items()):
            if any(map(is_for, es)):
                evidence.append(self.restriction("some", p, FORWARD, self.dag.const()))
                limits += [self.restriction("only", p, FORWARD, self.expr(r)) for r in self.schema.ranges.get(p, ())]
        for p, es in sorted(self.schema.ranges.items()):
            if any(is_for(e) or e.kind == "or" and all(map(is_for, e.parts)) for e in es):
                evidence.append(self.restriction("some", p, BACKWARD, self.dag.const()))
                limits += [self.restriction("only", p, BACKWARD, self.expr(r)) for r in self.schema.domains.get(p, ())]
        return self.dag.intersection(self.dag.union(*evidence), *limits)

    def _agreement(self, cls: str, other: Expr) -> int:
        """Fuzzy exclusion: the mean of (C or not D) and (D or not C)."""
        d, a, b = self.dag, self.dag.atomic(cls), self.expr(other)
        return d.intersection(d.union(a, d.negation(b)), d.union(b, d.negation(a)), mean=True)

    def sufficient(self, rules: list[tuple[Expr, str]]) -> dict[str, int]:
        """Of each class, the union of its rules' antecedents; those that aren't monotone are left out."""
        by_class: dict[str, list[int]] = {}
        for antecedent, cls in rules:
            if not supported_antecedent(antecedent):
                self.schema.skipped.append(f"{antecedent} -> {cls}")
                continue
            by_class.setdefault(cls, []).append(self.expr(antecedent))
        return {c: self.dag.union(*own) for c, own in sorted(by_class.items())}

    def monotone(self, root: int) -> bool:
        return all(self.dag.nodes[i].kind in MONOTONE for i in self.dag.reachable([root]))


def supported_antecedent(e: Expr) -> bool:
    """Whether more memberships can only make the expression truer."""
    if e.kind in ("thing", "named", "one_of", "self", "data"):
        return True
    if e.kind == "value":
        return True
    if e.kind in ("and", "or", "some"):
        return all(map(supported_antecedent, e.parts))
    return e.kind == "card" and e.bound == "min" and all(map(supported_antecedent, e.parts))


def requirements(schema: Schema, cls: str) -> tuple[set[str], set[str], list[tuple[str, str]]]:
    """(classes, individuals, functional or exact values (property, value)) that membership requires."""
    classes = {cls} | schema.super_classes().get(cls, set())
    individuals, values = set(), []
    for e in schema.required(cls):
        if e.kind == "named":
            classes |= {e.name} | schema.super_classes().get(e.name, set())
        if e.kind == "one_of" and len(e.values) == 1 and not is_literal(e.values[0]):
            individuals.add(e.values[0])
        if e.kind == "value" and e.direction == FORWARD:
            values.append((e.prop, e.values[0]))
    return classes, individuals, values


def negative_support(schema: Schema, cls: str) -> bool:
    """Whether blockers can show every way in which membership fails: no union among the conditions."""
    return all(e.kind in ("named", "one_of", "value", "not", "data") and len(e.values) <= 1 for e in schema.required(cls))


__all__ = ["Compiler", "DENIED", "helper_class", "is_data", "named", "negative_support", "requirements", "supported_antecedent"]
