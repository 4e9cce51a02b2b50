"""Typed path patterns as joins: whole walks, and walks whole except for their types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.graph import Graph


def exact_paths(graph: Graph, steps: list[tuple[str, str]]) -> DataFrame:
    """id of the nodes from which a walk over all steps exists, each hop's end in the step's class.

    Taken from the last step backwards, so that only distinct nodes, never walks, are carried. Both
    sides are distinct, so inner joins do; semi-joins would be pushed into every member of the types'
    union, and the plan would double at each step.
    """
    if not steps:
        raise ValueError("a path needs a step")
    able = None
    for prop, cls in reversed(steps):
        ends = graph.types.where((F.col("cls") == cls) & (F.col("w") > 0)).select(F.col("id").alias("n")).distinct()
        if able is not None:
            ends = ends.join(able, "n")
        able = graph.edge(prop).join(ends, "n").select(F.col("r").alias("n")).distinct()
    return able.select(F.col("n").alias("id"))


def partial_paths(graph: Graph, steps: list[tuple[str, str]]) -> DataFrame:
    """(id, score) of all nodes: the best share of class matches over walks that take every step.

    Every hop's end must have some type; a node without such a walk scores 0.
    """
    if not steps:
        raise ValueError("a path needs a step")
    typed = graph.types.where("w > 0")
    best = None
    for prop, cls in reversed(steps):
        ends = typed.groupBy(F.col("id").alias("n")).agg(F.max((F.col("cls") == cls).cast("long")).alias("hit"))
        if best is not None:
            ends = ends.join(best, "n").select("n", (F.col("hit") + F.col("more")).alias("hit"))
        best = graph.edge(prop).join(ends, "n").groupBy(F.col("r").alias("n")).agg(F.max("hit").alias("more"))
    found = best.select(F.col("n").alias("id"), (F.col("more").cast("double") / F.lit(float(len(steps)))).alias("score"))
    return graph.nodes.select("id").join(found, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))


def path_sparql(steps: list[tuple[str, str]], partial: bool = False) -> str:
    """The pattern as a SPARQL query: nodes with a whole walk, or each node's best share of matches."""
    if not steps:
        raise ValueError("a path needs a step")
    hops = [("?v" if i == 0 else f"?x{i}", prop, f"?x{i + 1}", cls) for i, (prop, cls) in enumerate(steps)]
    if not partial:
        lines = [x for s, p, o, c in hops for x in (f"  {s} <{p}> {o} .", f"  {o} a <{c}> .")]
        return "SELECT DISTINCT ?v WHERE {\n" + "\n".join(lines) + "\n}"
    lines = [x for i, (s, p, o, c) in enumerate(hops) for x in (f"    {s} <{p}> {o} . {o} a ?t{i} .", f"    BIND(IF(EXISTS {{ {o} a <{c}> }}, 1, 0) AS ?m{i})")]
    total = " + ".join(f"?m{i}" for i in range(len(hops)))
    return f"SELECT ?v (MAX(COALESCE(?m, 0)) / {float(len(hops))} AS ?score) WHERE {{\n  ?v ?any ?thing .\n  OPTIONAL {{\n" + "\n".join(lines) + f"\n    BIND({total} AS ?m)\n  }}\n}} GROUP BY ?v"
