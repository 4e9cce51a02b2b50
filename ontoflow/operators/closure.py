"""Closures over a graph's facts: hierarchies, domains and ranges, roles, equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


class NotConverged(RuntimeError):
    """A loop reached its round limit before nothing changed."""


# One-pass closures. The axiom tables come closed from the schema, so that one join is enough.


def class_hierarchy(types: DataFrame, supers: DataFrame) -> DataFrame:
    """types (id, cls) with those of all superclasses; ``supers`` (cls, sup) is transitive."""
    more = types.select("id", "cls").join(supers, "cls").select("id", F.col("sup").alias("cls"))
    return types.select("id", "cls").unionByName(more).distinct()


def property_hierarchy(edges: DataFrame, supers: DataFrame) -> DataFrame:
    """edges (p, src, dst) with those of all superproperties; ``supers`` (p, sup) is transitive."""
    more = edges.join(supers, "p").select(F.col("sup").alias("p"), "src", "dst")
    return edges.select("p", "src", "dst").unionByName(more).distinct()


def domain_range(edges: DataFrame, domains: DataFrame, ranges: DataFrame, literals: DataFrame | None = None) -> DataFrame:
    """types (id, cls) that domains (p, cls) and ranges (p, cls) give to the ends of edges.

    Literals (id) are typed by no axiom.
    """
    out = edges.join(domains, "p").select(F.col("src").alias("id"), "cls")
    out = out.unionByName(edges.join(ranges, "p").select(F.col("dst").alias("id"), "cls")).distinct()
    return out if literals is None else out.join(literals, "id", "left_anti")


def reflexive_edges(nodes: DataFrame, properties: list[str]) -> DataFrame:
    """(x p x) for every node that isn't a literal, of each property."""
    own = nodes.where("dt IS NULL").select("id")
    return own.select(F.explode(F.array(*map(F.lit, properties))).alias("p"), F.col("id").alias("src"), F.col("id").alias("dst"))


def inverse_edges(edges: DataFrame, inverses: DataFrame) -> DataFrame:
    """Edges with those that inverse pairs (p, q) give in either direction."""
    both = inverses.select("p", "q").unionByName(inverses.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct()
    more = edges.join(both, "p").select(F.col("q").alias("p"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("p", "src", "dst").unionByName(more).distinct()


def role_closure(edges: DataFrame, *, supers: list[tuple[str, str]] = (), inverses: list[tuple[str, str]] = (), chains: list[tuple[tuple[str, ...], str]] = (), transitive: list[str] = (), rounds: int = 64) -> DataFrame:
    """All edges that the role axioms entail, semi-naively: each round joins what is new.

    A chain is tried with the new edges at each of its places and all known ones at the others; a
    transitive property is the chain of itself with itself. Only the properties that axioms name are
    looked at. Raises NotConverged after ``rounds``.
    """
    chains = [*chains, *(((p, p), p) for p in transitive)]
    inverses = [*inverses, *((q, p) for p, q in inverses)]
    used = {p for p, _ in supers} | {p for p, _ in inverses} | {p for c, _ in chains for p in c}
    known = materialize(edges.select("p", "src", "dst").distinct(), "roles")
    fresh = known.where(F.col("p").isin(*used)) if used else None
    for _ in range(rounds):
        if fresh is None or fresh.isEmpty():
            return known
        parts = []
        for p, q in supers:
            parts.append(fresh.where(F.col("p") == p).select(F.lit(q).alias("p"), "src", "dst"))
        for p, q in inverses:
            parts.append(fresh.where(F.col("p") == p).select(F.lit(q).alias("p"), F.col("dst").alias("src"), F.col("src").alias("dst")))
        for chain, head in chains:
            for place in range(len(chain)):
                walk = None
                for k, p in enumerate(chain):
                    own = (fresh if k == place else known).where(F.col("p") == p).select(F.col("src").alias(f"x{k}"), F.col("dst").alias(f"x{k + 1}"))
                    walk = own if walk is None else walk.join(own, f"x{k}").select("x0", f"x{k + 1}").distinct()
                parts.append(walk.select(F.lit(head).alias("p"), F.col("x0").alias("src"), F.col(f"x{len(chain)}").alias("dst")))
        found = parts[0]
        for p in parts[1:]:
            found = found.unionByName(p)
        # Only what is new is written; the known is read from where it is.
        fresh = materialize(found.distinct().join(known, ["p", "src", "dst"], "left_anti"), "roles-fresh")
        known = known.unionByName(fresh)
    raise NotConverged(f"role closure after {rounds} rounds")


# Equality


def components(pairs: DataFrame) -> DataFrame:
    """alias (canonical, member) of all nodes in ``pairs`` (a, b): each component's smallest node.

    Rounds of taking the smallest label around, then the label's own label, so that their number is
    about the logarithm of a chain's length.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("node", "other").where("node IS NOT NULL AND other IS NOT NULL").distinct()
    both = materialize(both, "equal")
    labels = materialize(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("label")), "labels")
    while True:
        around = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        nearer = labels.join(around, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        step = nearer.join(labels.toDF("label", "far"), "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "was")
        step = materialize(step, "labels")
        labels = step.select("node", "label")
        if step.where("label <> was").isEmpty():
            return labels.select(F.col("label").alias("canonical"), F.col("node").alias("member"))


def guarded_components(pairs: DataFrame, different: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, conflicts): pairs said to be different aren't joined directly; where others join them, that is a conflict.

    ``conflicts`` (a, b, canonical) are the pairs of ``different`` (a, b) in one component.
    """
    no = different.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    alias = components(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(no, ["a", "b"], "left_anti"))
    one = no.join(alias.toDF("canonical", "a"), "a")
    conflicts = one.join(alias.toDF("other", "b"), "b").where("canonical = other").select("a", "b", "canonical")
    return alias, conflicts


def key_pairs(types: DataFrame, edges: DataFrame, cls: str, properties: list[str], alias: DataFrame | None = None) -> DataFrame:
    """(a, b): the first member of each group of members of ``cls`` with the same key, with each other.

    A key is the set of values of every property; who lacks one has no key. Values are compared by
    their representatives under ``alias``. Groups are made by the key itself, never by pairs.
    """
    members = types.where(F.col("cls") == cls).select("id").distinct()
    values = edges.where(F.col("p").isin(*properties)).select("p", F.col("src").alias("id"), F.col("dst").alias("v")).join(members, "id", "left_semi")
    if alias is not None:
        values = values.join(alias.toDF("canonical", "v"), "v", "left").withColumn("v", F.coalesce("canonical", "v"))
    sets = values.groupBy("id", "p").agg(F.sort_array(F.collect_set("v")).alias("vs"))
    keys = sets.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("p", "vs"))).alias("key")).where(F.size("key") == len(properties))
    # Long keys are compared by a digest of 256 bits.
    keys = keys.select("id", F.sha2(F.to_json(F.struct("key")), 256).alias("key"))
    first = keys.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(first, "key").where("id <> a").select("a", F.col("id").alias("b"))


def canonicalize(graph, alias: DataFrame):
    """The graph over representatives: ids replaced, repeated facts dropped, known literal values first."""
    from dataclasses import replace

    def to(df, column):
        renamed = alias.select(F.col("member").alias(column), F.col("canonical").alias("_to"))
        return df.join(renamed, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

    nodes = to(graph.nodes, "id").groupBy("id").agg(F.min("dt").alias("dt"), F.min("num").alias("num"))
    edges = to(to(graph.edges, "src"), "dst").select("p", "src", "dst").distinct()
    types = to(graph.types, "id").groupBy("id", "cls").agg(F.max("w").alias("w"))
    return replace(graph, nodes=nodes, edges=edges, types=types)


def expand_equal(types: DataFrame, edges: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """types and edges copied to all members of each component."""

    def to(df, column):
        canonical = df.join(alias.select(F.col("member").alias(column), F.col("canonical").alias("_c")), column, "left")
        group = alias.select(F.col("canonical").alias("_c"), F.col("member").alias("_m"))
        return canonical.join(group, "_c", "left").withColumn(column, F.coalesce("_m", column)).drop("_c", "_m")

    return to(types.select("id", "cls"), "id").select("id", "cls").distinct(), to(to(edges.select("p", "src", "dst"), "src"), "dst").select("p", "src", "dst").distinct()
