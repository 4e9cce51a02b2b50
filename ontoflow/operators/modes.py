"""Run modes over facts and a schema: materialization, admissibility, and their combinations."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import DENIED, Compiler, negative_support, requirements, supported_antecedent
from ..plans.schema import Schema, closed, strongly_connected
from ..sources.graph import Graph
from ..sources.rdf import Facts
from ..storage import materialize
from . import closure, negative
from .closure import NotConverged
from .lower import scores
from .reasoner import SATISFIED, expand_aliases


@dataclass(frozen=True)
class Profile:
    """Which passes run before and around the rules."""

    hierarchy: bool = True
    domain_range: bool = True
    reflexive: bool = True
    roles: bool = False
    same_as: bool = True
    has_key: bool = True
    negative: bool = True
    augment: bool = False


PROFILES = {
    "full": Profile(),
    "light": Profile(hierarchy=False, domain_range=False, reflexive=False, same_as=False, has_key=False, negative=False, augment=True),
    "equality": Profile(hierarchy=False, domain_range=False, reflexive=False, has_key=False, negative=False, augment=True),
    "keys": Profile(hierarchy=False, domain_range=False, reflexive=False, negative=False, augment=True),
    "verified": Profile(hierarchy=False, domain_range=False, reflexive=False, has_key=False, augment=True),
    "roles": Profile(roles=True),
}


@dataclass(frozen=True)
class Prepared:
    """Closed facts over representatives, and the aliases behind them."""

    facts: Facts
    alias: DataFrame | None
    conflicts: DataFrame | None
    schema: Schema
    asserted: DataFrame  # id, cls, before any pass but equality


def _table(spark: SparkSession, rows, *names: str) -> DataFrame:
    import pyarrow as pa

    columns = list(zip(*rows)) or [() for _ in names]
    return spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in columns], names=list(names)))


def plan_passes(schema: Schema, profile: Profile = PROFILES["full"]) -> list[tuple[str, bool, str]]:
    """(pass, whether it runs, why) of each preparation pass, in their order."""
    no = "the profile leaves it out"
    told = [
        ("reflexive", profile.reflexive, len(schema.reflexive), "reflexive properties"),
        ("property_hierarchy", profile.hierarchy, len(schema.sub_properties), "subproperty axioms"),
        ("domain_range", profile.domain_range, len(schema.domains) + len(schema.ranges), "domains and ranges"),
        ("class_hierarchy", profile.hierarchy, sum(map(len, schema.super_classes().values())), "superclasses of named classes"),
        ("same_as", profile.same_as, 1, "equality is up to the data"),
        ("has_key", profile.has_key and profile.same_as, len(schema.keys), "keys"),
        ("roles", profile.roles, len(schema.sub_properties) + len(schema.inverses) + len(schema.chains) + len(schema.transitive), "role axioms"),
    ]
    return [(name, on and n > 0, no if not on else f"{n} {what}" if n != 1 or name != "same_as" else what) for name, on, n, what in told]


def prepare(facts: Facts, schema: Schema, profile: Profile = PROFILES["full"], *, rounds: int = 64) -> Prepared:
    """The passes of a profile, in their order: reflexive, hierarchy, domains and ranges, equality, roles.

    Equality runs until keys join nothing more; NotConverged is raised after ``rounds``.
    """
    g = facts.graph
    spark = g.nodes.sparkSession
    asserted = g.types.select("id", "cls")
    supers = [(c, s) for c, above in schema.super_classes().items() for s in sorted(above - {c})]
    if profile.reflexive and schema.reflexive:
        g = replace(g, reflexive=frozenset(schema.reflexive))
    if profile.hierarchy:
        if rows := [(p, q) for p, above in schema.super_properties().items() for q in sorted(above - {p})]:
            g = replace(g, edges=closure.property_hierarchy(g.edges, _table(spark, rows, "p", "sup")))
    if profile.domain_range:
        domains = [(p, e.name) for p, es in schema.domains.items() for x in es for e in (x.parts if x.kind == "and" else (x,)) if e.kind == "named"]
        ranges = [(p, e.name) for p, es in schema.ranges.items() for x in es for e in (x.parts if x.kind == "and" else (x,)) if e.kind == "named"]
        if domains or ranges:
            literals = g.nodes.where("dt IS NOT NULL").select("id")
            g = g.with_types(closure.domain_range(g.edges, _table(spark, domains, "p", "cls"), _table(spark, ranges, "p", "cls"), literals))
    if profile.hierarchy and supers:
        g = g.with_types(closure.class_hierarchy(g.types, _table(spark, supers, "cls", "sup")))
    alias = conflicts = None
    different = facts.different.select("a", "b")
    if schema.different:
        different = different.union(_table(spark, schema.different, "a", "b"))
    if profile.same_as:
        pairs = facts.same.select("a", "b")
        # Members of a class that is one individual are that individual.
        singles = [(c, v) for c in sorted(schema.classes) for v in requirements(schema, c)[1]]
        if singles:
            one = _table(spark, singles, "cls", "b")
            pairs = pairs.union(g.types.join(one, "cls").select(F.col("id").alias("a"), "b").where("a <> b"))
        for _ in range(rounds):
            alias, conflicts = closure.guarded_components(pairs, different)
            # Facts meet on representatives: a key's class and its values may come from two names of one individual.
            merged = g if alias.isEmpty() else closure.canonicalize(g, alias)
            if not (profile.has_key and schema.keys):
                break
            found = [closure.key_pairs(merged.types, merged.edges, cls, list(props)) for cls, props in sorted(schema.keys.items())]
            if singles:
                found.append(merged.types.join(one, "cls").select(F.col("id").alias("a"), "b").where("a <> b"))
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            new = reduce(DataFrame.union, found).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
            new = materialize(new.join(pairs, ["a", "b"], "left_anti"), "same")
            if new.isEmpty():
                break
            pairs = pairs.union(new)
        else:
            raise NotConverged(f"equality after {rounds} rounds")
        if merged is g:
            alias = None
        g = merged
    if profile.roles:
        edges = closure.role_closure(g.edges, supers=schema.sub_properties, inverses=schema.inverses, chains=schema.chains, transitive=sorted(schema.transitive))
        g = replace(g, edges=edges)
    # What a pass has changed is written once; what is as the source has it is read from there.
    first = facts.graph
    g = Graph(*(materialize(own, name) if own is not was else own for own, was, name in ((g.nodes, first.nodes, "nodes"), (g.edges, first.edges, "edges"), (g.types, first.types, "types"))), g.reflexive)
    moved = facts
    if alias is not None:
        to = lambda df, c: df.join(alias.toDF("_to", c), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        asserted = to(asserted, "id").select("id", "cls").distinct()
        moved = replace(facts, denied_edges=to(to(facts.denied_edges, "src"), "dst").select("p", "src", "dst"), denied_types=to(facts.denied_types, "id").select("id", "cls"))
    # What is said to be different blocks by its own name: an alias in conflict must not hide it.
    return Prepared(replace(moved, graph=g, different=different), alias, conflicts, schema, asserted)


# Materialization


def fixpoint(graph: Graph, roots: dict[str, int], compiler: Compiler, depends: dict[str, set[str]], *, threshold: float = SATISFIED, rounds: int = 64) -> tuple[Graph, DataFrame]:
    """(graph with the memberships added, those added (id, cls)): the least fixpoint of the classes' conditions.

    Classes are taken by strongly connected components, what they depend on first; components without
    a cycle need one pass, and those of one depth share it. Raises NotConverged after ``rounds``.
    """
    # Each pass reads the types twice: from a table, not from however many sources they come.
    graph = replace(graph, types=materialize(graph.types.select("id", "cls", "w"), "types"))
    parts = strongly_connected({c: depends.get(c, set()) & roots.keys() for c in roots})
    level: dict[str, int] = {}
    groups: dict[tuple[int, bool], list[str]] = {}
    for part in parts:
        own = 1 + max((level[x] for c in part for x in depends.get(c, ()) if x in level), default=-1)
        cyclic = len(part) > 1 or part[0] in depends.get(part[0], ())
        level.update(dict.fromkeys(part, own))
        groups.setdefault((own, cyclic), []).extend(part)
    added = []
    for (_, cyclic), classes in sorted(groups.items()):
        columns = [f"r{k}" for k in range(len(classes))]
        names = F.create_map(*(F.lit(x) for pair in zip(columns, classes) for x in pair))
        for _ in range(rounds if cyclic else 1):
            scored = scores(graph, compiler.dag, {r: roots[c] for r, c in zip(columns, classes)})
            found = scored.unpivot("id", columns, "_r", "score").where(F.col("score") >= threshold).select("id", names[F.col("_r")].alias("cls"))
            have = graph.types.where((F.col("w") >= threshold) & F.col("cls").isin(classes)).select("id", "cls")
            # Only what is new is written; the known is read from where it is.
            fresh = materialize(found.join(have, ["id", "cls"], "left_anti"), "fresh")
            if cyclic and fresh.isEmpty():
                break
            added.append(fresh)
            graph = replace(graph, types=graph.types.unionByName(fresh.withColumn("w", F.lit(1.0))))
        else:
            if cyclic:
                raise NotConverged(f"{classes} after {rounds} rounds")
    if not added:
        return graph, graph.types.limit(0).select("id", "cls")
    # A class that was known with a weight under the threshold has it now in full.
    return replace(graph, types=graph.types.groupBy("id", "cls").agg(F.max("w").alias("w"))), reduce(DataFrame.union, added)


def materialize_positive(prepared: Prepared, targets: list[str] | None = None, **options) -> tuple[Graph, DataFrame]:
    """Least fixpoint of the sufficient conditions that lead to the targets, or of all."""
    schema = prepared.schema
    rules = [(a, c) for a, c in schema.rules() if supported_antecedent(a)]
    if targets is not None:
        wanted = schema.relevant(targets)
        rules = [(a, c) for a, c in rules if c in wanted]
    rules, given = _without_given(rules)
    graph = prepared.facts.graph
    if given:
        graph = graph.with_types(closure.class_hierarchy(graph.types, _table(graph.nodes.sparkSession, given, "cls", "sup")))
    compiler = Compiler(schema, helpers=True, aliases=_aliases(prepared, rules))
    roots = compiler.sufficient(rules)
    depends: dict[str, set[str]] = {}
    for a, c in rules:
        depends.setdefault(c, set()).update(a.depends_on())
    before = prepared.facts.graph.types.where(F.col("w") >= SATISFIED).select("id", "cls")
    out, added = fixpoint(graph, roots, compiler, depends, **options)
    return out, added if not given else out.types.where(F.col("w") >= SATISFIED).select("id", "cls").join(before, ["id", "cls"], "left_anti")


def _without_given(rules: list) -> tuple[list, list[tuple[str, str]]]:
    """(rules left, (class, superclass) pairs): rules that only asserted members need.

    Where every condition for C has D among its conjuncts, C's derived members are D's already; what
    C within D adds is for asserted ones, and is done once, ahead. This leaves definitions acyclic.
    """
    by: dict[str, list] = {}
    for a, c in rules:
        by.setdefault(c, []).append(a)
    holds = lambda x, c: c in {p.name for p in (x.parts if x.kind == "and" else (x,)) if p.kind == "named"}
    given: dict[str, set[str]] = {}
    for a, c in rules:
        if a.kind == "named" and by.get(a.name) and all(holds(x, c) for x in by[a.name]):
            given.setdefault(a.name, set()).add(c)
    left = [(a, c) for a, c in rules if not (a.kind == "named" and c in given.get(a.name, ()))]
    return left, [(c, s) for c, above in closed(given).items() for s in sorted(above - {c})]


def materialize_definitions(prepared: Prepared, targets: list[str], **options) -> tuple[Graph, DataFrame]:
    """Least fixpoint of the targets' conditions read as definitions; refuses those that aren't monotone."""
    compiler = Compiler(prepared.schema, aliases=_aliases(prepared, []))
    roots = {c: compiler.necessary(c) for c in targets}
    if bad := [c for c, r in roots.items() if not compiler.monotone(r)]:
        raise ValueError(f"not monotone: {bad}")
    depends = {c: {x for e in prepared.schema.conditions(c) for x in e.classes()} for c in targets}
    return fixpoint(prepared.facts.graph, roots, compiler, depends, **options)


def _aliases(prepared: Prepared, rules) -> dict[str, list[str]]:
    """Representatives of the individuals that the schema names: a small table, by a small table's names."""
    if prepared.alias is None:
        return {}
    schema = prepared.schema
    used: set[str] = set()
    todo = [e for pair in [*schema.sub, *schema.equivalent] for e in pair]
    while todo:
        e = todo.pop()
        used.update(e.values)
        todo += e.parts
    if not used:
        return {}
    wanted = _table(prepared.alias.sparkSession, [(x,) for x in sorted(used)], "member")
    return {r.member: [r.canonical] for r in prepared.alias.join(wanted, "member").collect()}


# Negative evidence


def blockers(prepared: Prepared, types: DataFrame, targets: list[str]) -> tuple[DataFrame, DataFrame]:
    """(blockers (id, cls, blocker), signed types) of the targets."""
    schema, facts = prepared.schema, prepared.facts
    spark = types.sparkSession
    signed = negative.negative_types(types, schema.negations(), schema.complements(), facts.denied_types)
    needs, nominals, functional, exact = [], [], [], []
    for c in targets:
        classes, individuals, values = requirements(schema, c)
        needs += [(c, n) for n in sorted(classes)]
        nominals += [(c, x) for x in sorted(individuals)]
        exact += [(c, p, v) for p, v in values]
        functional += [(c, p, v) for p, v in values if p in schema.functional]
    out = negative.blocked_by_class(signed, _table(spark, needs, "cls", "needs"))
    if nominals:
        own = _table(spark, nominals, "cls", "node")
        out = out.union(negative.blocked_by_nominal(own, facts.different))
    if functional:
        out = out.union(negative.blocked_by_value(_table(spark, functional, "cls", "p", "value"), facts.graph.edges))
    if exact:
        out = out.union(negative.blocked_by_assertion(_table(spark, exact, "cls", "p", "value"), facts.denied_edges))
    return materialize(out.distinct(), "blockers"), signed


# Modes. Each returns (id, cls) or, where named so, more.


def stratified(prepared: Prepared, targets: list[str], *, policy: str = "suppress_derived_keep_asserted", status: bool = False, rounds: int = 64) -> DataFrame:
    """Sufficient conditions to the fixpoint, then blockers and the conflict policy.

    What negative evidence puts into a class (by complements) is fed to the rules again, until that
    changes nothing; NotConverged is raised after ``rounds``.
    """
    asserted = prepared.asserted
    # By a complement, what any class excludes can lead to a target: then no rule is left out.
    leading = None if prepared.schema.complements() else targets
    for _ in range(rounds):
        graph, _ = materialize_positive(prepared, leading)
        blocked, signed = blockers(prepared, graph.types, targets)
        if not prepared.schema.complements():
            break  # nothing else makes a non-membership a membership
        fresh = signed.where("sign = 1").select("id", "cls").join(graph.types, ["id", "cls"], "left_anti")
        if fresh.isEmpty():
            break
        prepared = replace(prepared, facts=replace(prepared.facts, graph=graph.with_types(fresh)))
    else:
        raise NotConverged(f"stratified after {rounds} rounds")
    wanted = F.col("cls").isin(list(targets))
    derived = graph.types.select("id", "cls").where(wanted).join(asserted, ["id", "cls"], "left_anti")
    table = negative.assignment_status(asserted.where(wanted), derived, blocked)
    out = table if status else negative.emit(table, policy)
    return out if prepared.alias is None else expand_aliases(out, prepared.alias)


def admissibility(prepared: Prepared, targets: list[str], *, certify: bool = True, augment: bool = False, materialized: bool = True) -> DataFrame:
    """Members by necessary conditions: memberships are materialized, then the conditions tested once.

    Certification takes away what is blocked.
    """
    graph = materialize_positive(prepared)[0] if materialized else prepared.facts.graph
    found = _necessary_members(prepared, graph, targets, augment)
    if certify:
        found = found.join(blockers(prepared, graph.types, targets)[0], ["id", "cls"], "left_anti")
    return found if prepared.alias is None else expand_aliases(found, prepared.alias)


def _necessary_members(prepared: Prepared, graph: Graph, targets: list[str], augment: bool) -> DataFrame:
    compiler = Compiler(prepared.schema, denials=True, aliases=_aliases(prepared, []))
    denied = prepared.facts.denied_edges.select(F.concat(F.lit(DENIED), "p").alias("p"), "src", "dst")
    graph = replace(graph, edges=graph.edges.select("p", "src", "dst").unionByName(denied))
    roots = {f"r{k}": compiler.necessary(c, augment=augment) for k, c in enumerate(targets)}
    names = F.create_map(*(F.lit(x) for k, c in enumerate(targets) for x in (f"r{k}", c)))
    individuals = graph.nodes.where("dt IS NULL").select("id")
    scored = scores(graph, compiler.dag, roots).join(individuals, "id", "left_semi")
    return scored.unpivot("id", list(roots), "_r", "score").where(F.col("score") >= SATISFIED).select("id", names[F.col("_r")].alias("cls"))


def filtered_admissibility(prepared: Prepared, targets: list[str], *, augment: bool = False, rounds: int = 64) -> DataFrame:
    """The targets' members, thinned until they support each other: conditions are tested with the
    current members asserted, and only who still meets them stays. What is blocked is taken away."""
    graph = materialize_positive(prepared)[0]
    wanted = F.col("cls").isin(list(targets))
    members = materialize(_necessary_members(prepared, graph, targets, augment), "members")
    for _ in range(rounds):
        own = replace(graph, types=graph.types.where(~wanted).unionByName(members.select("id", "cls", F.lit(1.0).alias("w"))))
        again = materialize(_necessary_members(prepared, own, targets, augment).join(members, ["id", "cls"], "left_semi"), "members")
        stable = members.join(again, ["id", "cls"], "left_anti").isEmpty()
        members = again
        if stable:
            out = members.join(blockers(prepared, own.types, targets)[0], ["id", "cls"], "left_anti")
            return out if prepared.alias is None else expand_aliases(out, prepared.alias)
    raise NotConverged(f"filtered admissibility after {rounds} rounds")


def alignment(prepared: Prepared, targets: list[str]) -> DataFrame:
    """(id, cls, score): how well nodes meet the targets' conditions, by means instead of minima."""
    compiler = Compiler(prepared.schema, fuzzy=True, aliases=_aliases(prepared, []))
    roots = {f"r{k}": compiler.necessary(c) for k, c in enumerate(targets)}
    names = F.create_map(*(F.lit(x) for k, c in enumerate(targets) for x in (f"r{k}", c)))
    scored = scores(prepared.facts.graph, compiler.dag, roots)
    out = scored.unpivot("id", list(roots), "_r", "score").select("id", names[F.col("_r")].alias("cls"), "score")
    return out if prepared.alias is None else expand_aliases(out, prepared.alias)


def resolve_targets(schema: Schema, wanted: list[str]) -> tuple[list[str], dict[str, str]]:
    """(classes, {skipped class: why}): ``all-named-classes``, ``all-defined-classes``, or IRIs."""
    out: list[str] = []
    skipped: dict[str, str] = {}
    for w in wanted:
        out += sorted(schema.classes) if w == "all-named-classes" else schema.defined_classes() if w == "all-defined-classes" else [w]
    depends = {c: {x for e in schema.conditions(c) for x in e.classes()} for c in schema.classes}
    cyclic = {c for part in strongly_connected(depends) if len(part) > 1 or part[0] in depends.get(part[0], ()) for c in part}
    kept = []
    for c in dict.fromkeys(out):
        compiler = Compiler(schema)
        try:
            root = compiler.necessary(c)
        except ValueError as e:
            skipped[c] = str(e)
            continue
        only_disjoint = all(e.kind == "not" and e.parts[0].kind == "named" for e in schema.conditions(c))
        if c in cyclic and not compiler.monotone(root) and not only_disjoint:
            skipped[c] = "a cycle through negation"
            continue
        kept.append(c)
    return kept, skipped


def support(schema: Schema, targets: list[str]) -> dict[str, bool]:
    """Whether the negative side of each target is complete."""
    return {c: negative_support(schema, c) for c in targets}
