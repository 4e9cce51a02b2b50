"""Why a node scores what it does for a concept: decisive children, witnesses and blockers."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ir import Dag, Kind
from ..sources.graph import Graph
from ..storage import materialize
from .lower import scores

TIE = 1e-6
MOST = 5


@dataclass
class Reason:
    node: object
    dag_node: int
    kind: str
    score: float
    neighbours: list = field(default_factory=list)  # (neighbour, score) that decide
    path: list = field(default_factory=list)  # EXISTS_TRANSITIVE: a shortest way to a witness
    children: list["Reason"] = field(default_factory=list)

    def lines(self, depth: int = 0) -> list[str]:
        own = f"{'  ' * depth}{self.kind} of {self.node}: {self.score:g}" + (f" by {', '.join(str(n) for n, _ in self.neighbours)}" if self.neighbours else "")
        return [own, *(x for c in self.children for x in c.lines(depth + 1))]


def explain(graph: Graph, dag: Dag, root: int, node) -> Reason:
    """Replays the graph's part below ``root`` for one node.

    All operators are scored once for all nodes and written down; then each step reads a node's own
    row, or its neighbours'. Ties within 1e-6 are told, five at most.
    """
    needed = dag.reachable([root])
    table = materialize(scores(graph, dag, {f"n{i}": i for i in needed}), "explain")

    def value(i: int, of) -> float:
        row = table.where(F.col("id") == F.lit(of)).select(f"n{i}").first()
        return float(row[0]) if row else 0.0

    def walk(i: int, of) -> Reason:
        n = dag.nodes[i]
        out = Reason(of, i, n.kind.value, value(i, of))
        if n.kind in (Kind.NEGATION, Kind.UNION, Kind.INTERSECTION):
            own = [(c, value(c, of)) for c in n.children]
            if n.kind is not Kind.NEGATION and not n.mean:
                best = (max if n.kind is Kind.UNION else min)(v for _, v in own)
                own = [(c, v) for c, v in own if abs(v - best) <= TIE]
            out.children = [walk(c, of) for c, _ in own[:MOST]]
        elif n.kind in (Kind.EXISTS, Kind.FORALL, Kind.MIN_CARD, Kind.MAX_CARD, Kind.EXACT_CARD, Kind.PATH_STEP):
            edges = graph.edge(n.prop, n.direction).where(F.col("r") == F.lit(of)).select(F.col("n").alias("id"))
            if not n.children:
                found = [(r.id, None) for r in edges.orderBy("id").limit(MOST).collect()]
                out.neighbours = found
                return out
            child = n.children[0]
            near = edges.join(table.select("id", F.col(f"n{child}").alias("s")), "id")
            rising = n.kind is Kind.FORALL
            first = near.orderBy(F.asc("s") if rising else F.desc("s"), "id").limit(max(MOST, (n.k or 0) + 1)).collect()
            keep = [r for r in first if n.kind not in (Kind.EXISTS, Kind.FORALL) or abs(r.s - first[0].s) <= TIE][:MOST]
            out.neighbours = [(r.id, r.s) for r in keep]
            out.children = [walk(child, r.id) for r in keep[:1]]
        elif n.kind is Kind.EXISTS_TRANSITIVE:
            out.path = witness_path(graph, n.family, table.where(F.abs(F.col(f"n{n.children[0]}") - out.score) <= TIE).select("id"), of) if out.score > 0 else []
        return out

    return walk(root, node)


def witness_path(graph: Graph, family, witnesses: DataFrame, start, hops: int = 1000) -> list:
    """A shortest way of one edge or more from ``start`` to a witness; breadth first, a join per hop."""
    edges = None
    for prop, direction in family:
        own = graph.edge(prop, direction)
        edges = own if edges is None else edges.unionByName(own)
    spark = graph.nodes.sparkSession
    kind = graph.nodes.schema["id"].dataType
    front = spark.createDataFrame([(start,)], f"id {kind.simpleString()}")
    seen, steps = front, []
    for _ in range(hops):
        nxt = front.join(edges, front.id == edges.r).groupBy("n").agg(F.min("r").alias("via")).select(F.col("n").alias("id"), "via")
        if len(steps):
            nxt = nxt.join(seen, "id", "left_anti")
        nxt = materialize(nxt, "hop")
        steps.append(nxt)
        if hit := nxt.join(witnesses, "id").orderBy("id").first():
            way = [hit.id]
            for step in reversed(steps):
                way.append(step.where(F.col("id") == F.lit(way[-1])).first().via)
            return way[::-1]
        if nxt.isEmpty():
            return []
        front = nxt.select("id")
        seen = materialize(seen.union(front), "seen")
    return []


def best_witness(graph: Graph, prop: str, direction: str, child: DataFrame) -> DataFrame:
    """(id, witness, score) of every node with a neighbour: its best neighbour by ``child`` (id, score), ties to the smaller id."""
    near = graph.edge(prop, direction).join(child.select(F.col("id").alias("n"), "score"), "n")
    best = near.groupBy("r").agg(F.max(F.struct("score", (-F.col("n")).alias("m"))).alias("b"))
    return best.select(F.col("r").alias("id"), (-F.col("b.m")).alias("witness"), F.col("b.score").alias("score"))
