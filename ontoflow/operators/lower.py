"""Lowering of a constraint graph to one DataFrame plan.

Row-local operators (leaves, boolean algebra, scaling) are column expressions. Operators over edges
are taken level by level, and all of a level that share a property and direction are served by one
join of the edges with the level's child columns and one grouped aggregation; so the number of
exchanges is that of (level, property, direction), not of operators. Where every operator of such a
step scores 0 without a scoring neighbour, neighbours that score 0 are left out before the join.

Absent rows have defaults (0, or 1 for what holds vacuously), so results are joined from the left.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp, greatest_of, in_interval, least_of, mean_of, share_of
from ..plans.ir import Dag, Kind, Node
from ..sources.graph import Graph
from ..storage import materialize

#: Levels of edge operators after which the plan so far is written down.
CUT_AFTER = 8


def scores(graph: Graph, dag: Dag, roots: dict[str, int] | None = None, *, similarity: DataFrame | None = None, sim_agg: str = "max", strict_scale: bool = False) -> DataFrame:
    """One row per node of the graph: id and a score column per root.

    ``similarity`` (cls, target, s) makes an atomic class score the largest, or with ``sim_agg="sum"``
    the summed, weight times similarity; path steps never use it. With ``strict_scale`` a fuzzy
    cardinality ignores its scale factor.
    """
    roots = dag.roots if roots is None else roots
    if len(roots) == 1 and (chain := _path_chain(graph, dag, next(iter(roots.values())))):
        return _path_scores(graph, chain).withColumnRenamed("score", next(iter(roots)))
    needed = dag.reachable(roots.values())
    nodes, depth, crisp = dag.nodes, dag.edge_depth(), dag.crisp()
    atomic = {nodes[i].cls for i in needed if nodes[i].kind is Kind.ATOMIC}
    stepped = {nodes[i].cls for i in needed if nodes[i].kind is Kind.PATH_STEP}
    frame = graph.nodes.select("id", "dt", "num")
    plain = atomic | stepped if similarity is None else stepped
    names = {c: f"_c{k}" for k, c in enumerate(sorted(plain))}
    if names:
        frame = _with_classes(frame, graph.types, names)
    similar = {c: f"_s{k}" for k, c in enumerate(sorted(atomic))} if similarity is not None else {}
    if similar:
        frame = _with_similar(frame, graph.types, similarity, similar, sim_agg)
    done: set[int] = set()
    exprs: dict[int, Column] = {}

    def score(i: int) -> Column:
        if i in done:
            return F.col(f"_n{i}")
        if i not in exprs:
            n = nodes[i]
            e = _local(n, [score(c) for c in n.children], similar or names)
            exprs[i] = e if n.scale is None else e * F.lit(float(n.scale))
        return exprs[i]

    levels = sorted({depth[i] for i in needed if _over_edges(nodes[i])})
    for at, level in enumerate(levels):
        steps = defaultdict(list)
        for i in needed:
            n = nodes[i]
            if depth[i] == level and _over_edges(n):
                steps[_step_key(n)].append(i)
        exprs.clear()
        below = frame
        for key in sorted(steps, key=str):
            frame = _with_edges(graph, below, frame, key, steps[key], nodes, crisp, score, names, strict_scale)
        done.update(i for own in steps.values() for i in own)
        if (at + 1) % CUT_AFTER == 0 and at + 1 < len(levels):
            frame = materialize(frame, "scores")
    exprs.clear()
    return frame.select("id", *(score(i).cast("double").alias(name) for name, i in roots.items()))


def _path_chain(graph: Graph, dag: Dag, root: int) -> list[Node]:
    """The steps of a root that is nothing but a path, innermost first; empty if it is more."""
    chain = []
    while True:
        n = dag.nodes[root]
        if n.kind is not Kind.PATH_STEP or n.prop in graph.reflexive or n.scale is not None and n.scale <= 0:
            return []
        chain.append(n)
        if not n.children:
            return chain[::-1]
        root = n.children[0]


def _path_scores(graph: Graph, chain: list[Node]) -> DataFrame:
    """id and score of every node for a path alone: each step carries only nodes that score, not all."""
    reached = None
    for k, n in enumerate(chain, 1):
        near = graph.types.where(F.col("cls") == n.cls).groupBy("id").agg(F.max("w").alias("w"))
        if reached is not None:
            near = near.join(reached, "id", "full").select("id", (F.coalesce("w", F.lit(0.0)) + F.coalesce("v", F.lit(0.0))).alias("w"))
        near = near.where("w > 0").select(F.col("id").alias("n"), "w")
        factor = F.lit(1.0 if n.scale is None else float(n.scale))
        reached = graph.edge(n.prop, n.direction).join(near, "n").groupBy(F.col("r").alias("id")).agg((F.max("w") * factor).alias("v"))
        if k % CUT_AFTER == 0 and k < len(chain):
            reached = materialize(reached, "path")
    return graph.nodes.select("id").join(reached, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).cast("double").alias("score"))


def _over_edges(n: Node) -> bool:
    return n.kind in (Kind.EXISTS, Kind.FORALL, Kind.MIN_CARD, Kind.MAX_CARD, Kind.EXACT_CARD, Kind.PATH_STEP, Kind.HAS_SELF, Kind.EXISTS_TRANSITIVE)


def _step_key(n: Node):
    if n.kind is Kind.EXISTS_TRANSITIVE:
        return ("transitive", n.family, n.children[0])
    if n.kind is Kind.HAS_SELF:
        return ("self", n.prop, "")
    return ("step", n.prop, n.direction)


def _with_classes(frame, types, names):
    wide = types.where(F.col("cls").isin(*names)).groupBy("id").agg(*(F.max(F.when(F.col("cls") == c, F.col("w"))).alias(a) for c, a in names.items()))
    return frame.join(wide, "id", "left").fillna(0.0, list(names.values()))


def _with_similar(frame, types, similarity, names, how):
    known = similarity.where(F.col("target").isin(*names))
    both = types.join(known, "cls").withColumn("v", F.col("w") * F.col("s"))
    agg = F.sum if how == "sum" else F.max
    wide = both.groupBy("id").agg(*(agg(F.when(F.col("target") == c, F.col("v"))).alias(a) for c, a in names.items()))
    return frame.join(wide, "id", "left").fillna(0.0, list(names.values()))


def _local(n: Node, children: list[Column], names: dict[str, str]) -> Column:
    if n.kind is Kind.CONST:
        return F.lit(1.0)
    if n.kind is Kind.ATOMIC:
        return F.col(names[n.cls])
    if n.kind is Kind.NOMINAL:
        return (F.col("id") == F.lit(n.node)).cast("double")
    if n.kind is Kind.DATATYPE:
        # Literals have a datatype; numbers that aren't known, or are NaN, meet no bound.
        ok = F.col("dt") == n.datatype if n.datatype is not None else F.col("dt").isNotNull()
        if n.low is not None or n.high is not None:
            ok &= in_interval(F.col("num"), n.low, n.high, n.low_open, n.high_open)
        return F.coalesce(ok.cast("double"), F.lit(0.0))
    if n.kind is Kind.NEGATION:
        return 1.0 - children[0]
    if n.kind is Kind.INTERSECTION and n.mean:
        return mean_of(children)
    if n.kind is Kind.INTERSECTION:
        return least_of(children)
    if n.kind is Kind.UNION:
        return greatest_of(children)
    raise NotImplementedError(n.kind)


def _zero_without(n: Node) -> bool:
    """Whether a node scores 0 unless a neighbour scores more than 0."""
    return n.kind in (Kind.EXISTS, Kind.PATH_STEP) or n.kind is Kind.MIN_CARD and n.k > 0


def _with_edges(graph: Graph, below: DataFrame, frame: DataFrame, key, own: list[int], nodes, crisp, score, names, strict_scale) -> DataFrame:
    if key[0] == "self":
        factors = {i: F.lit(1.0 if nodes[i].scale is None else float(nodes[i].scale)) for i in own}
        if key[1] in graph.reflexive:
            return frame.withColumns({f"_n{i}": factors[i] for i in own})
        loops = graph.edges.where((F.col("p") == key[1]) & (F.col("src") == F.col("dst"))).select(F.col("src").alias("id")).distinct()
        joined = frame.join(loops.withColumn("_hit", F.lit(1.0)), "id", "left")
        return joined.withColumns({f"_n{i}": F.coalesce("_hit", F.lit(0.0)) * factors[i] for i in own}).drop("_hit")
    if key[0] == "transitive":
        reached = _transitive(graph, below.select("id", score(key[2]).alias("v")), key[1])
        joined = frame.join(reached, "id", "left")
        return joined.withColumns({f"_n{i}": F.coalesce("best", F.lit(0.0)) * F.lit(1.0 if nodes[i].scale is None else float(nodes[i].scale)) for i in own}).drop("best")

    edges = graph.edge(key[1], key[2])
    if key[1] in graph.reflexive:
        loops = below.select(F.col("id").alias("r"), F.col("id").alias("n"))
        edges = edges.unionByName(loops).distinct()

    def child(n: Node) -> Column:
        inner = score(n.children[0]) if n.children else F.lit(0.0)
        return F.col(names[n.cls]) + inner if n.kind is Kind.PATH_STEP else inner

    free = lambda n: n.kind is not Kind.PATH_STEP and nodes[n.children[0]].kind is Kind.CONST
    sources: dict[int, str] = {}
    columns: dict[str, Column] = {}
    for i in own:
        n = nodes[i]
        if not free(n):
            name = f"_p{i}" if n.kind is Kind.PATH_STEP else f"_v{n.children[0]}"
            columns[name] = child(n)
            sources[i] = name
    if columns:
        near = below.select(F.col("id").alias("n"), *(c.alias(a) for a, c in columns.items()))
        if all(_zero_without(nodes[i]) for i in own) and len(sources) == len(own):
            some = F.lit(False)
            for a in columns:
                some = some | (F.col(a) > 0)
            near = near.where(some)
            met = edges.join(near, "n")
        else:
            met = edges.join(near, "n", "left").fillna(0.0, list(columns))
    else:
        met = edges

    aggs, result, ranked = {}, {}, []
    for i in own:
        n = nodes[i]
        v = F.col(sources[i]) if i in sources else F.lit(1.0)
        if n.kind in (Kind.EXISTS, Kind.PATH_STEP):
            aggs[f"_a{i}"] = F.max(v)
            result[i] = F.coalesce(f"_a{i}", F.lit(0.0))
        elif n.kind is Kind.FORALL:
            aggs[f"_a{i}"] = F.min(v)
            result[i] = F.coalesce(f"_a{i}", F.lit(1.0))
        elif n.fuzzy:
            if n.kind is not Kind.MIN_CARD:
                raise NotImplementedError("only a minimum cardinality can be fuzzy")
            aggs[f"_a{i}"] = F.count_if(v > 0)
            result[i] = share_of(F.coalesce(f"_a{i}", F.lit(0)), n.k)
        elif i not in sources or crisp[n.children[0]]:
            aggs[f"_a{i}"] = F.count_if(v > 0)
            result[i] = _cardinality(n, lambda k, a=f"_a{i}": (F.coalesce(a, F.lit(0)) >= k).cast("double"))
        else:
            ranked.append(i)
            result[i] = _cardinality(n, lambda k, i=i: clamp(F.coalesce(f"_k{i}_{k}", F.lit(0.0))))
    if aggs:
        frame = frame.join(met.groupBy(F.col("r").alias("id")).agg(*(c.alias(a) for a, c in aggs.items())), "id", "left")
    for i in ranked:
        # The k-th largest by rank, not from collected lists: a node with many edges keeps k rows.
        wanted = {Kind.MIN_CARD: {nodes[i].k}, Kind.MAX_CARD: {nodes[i].k + 1}, Kind.EXACT_CARD: {nodes[i].k, nodes[i].k + 1}}[nodes[i].kind] - {0}
        if not wanted or max(wanted) <= 0:
            continue
        place = F.row_number().over(Window.partitionBy("r").orderBy(F.desc(sources[i])))
        top = met.select("r", sources[i]).withColumn("_k", place).where(F.col("_k") <= max(wanted))
        kth = top.groupBy(F.col("r").alias("id")).agg(*(F.max(F.when(F.col("_k") == k, F.col(sources[i]))).alias(f"_k{i}_{k}") for k in sorted(wanted)))
        frame = frame.join(kth, "id", "left")
    scaled = {f"_n{i}": e if nodes[i].scale is None or nodes[i].fuzzy and strict_scale else e * F.lit(float(nodes[i].scale)) for i, e in result.items()}
    drop = [*aggs, *(c for c in frame.columns if c.startswith("_k"))]
    return frame.withColumns(scaled).drop(*drop)


def _cardinality(n: Node, at_least) -> Column:
    low = at_least(n.k) if n.k > 0 else F.lit(1.0)
    if n.kind is Kind.MIN_CARD:
        return low
    high = 1.0 - (at_least(n.k + 1) if n.k + 1 > 0 else F.lit(1.0))
    return high if n.kind is Kind.MAX_CARD else F.least(low, high)


def _transitive(graph: Graph, value: DataFrame, family: tuple[tuple[str, str], ...]) -> DataFrame:
    """(id, best): the largest value over nodes reached by one or more edges of the family.

    A frontier loop: only nodes whose best rose go on to their predecessors, so pairs of the closure
    are never made. Each round is written to the shared folder.
    """
    edges = None
    for prop, direction in family:
        own = graph.edge(prop, direction)
        edges = own if edges is None else edges.unionByName(own)
    edges = materialize(edges.distinct(), "reach-edges")
    first = edges.join(value.where("v > 0"), edges.n == value.id).groupBy(F.col("r").alias("id")).agg(F.max("v").alias("best"))
    best = materialize(first.withColumn("fresh", F.lit(True)), "reach")
    while True:
        fresh = best.where("fresh").select(F.col("id").alias("n"), F.col("best").alias("v"))
        if fresh.isEmpty():
            return best.select("id", "best")
        came = edges.join(fresh, "n").groupBy(F.col("r").alias("id")).agg(F.max("v").alias("came"))
        both = best.select("id", "best").join(came, "id", "full")
        rose = F.coalesce(F.col("came") > F.coalesce("best", F.lit(0.0)), F.lit(False))
        best = materialize(both.select("id", F.greatest("best", "came").alias("best"), rose.alias("fresh")), "reach")
