import random

import pytest
from interpreter import evaluate

from ontoflow.operators.lower import scores
from ontoflow.operators.paths import exact_paths, partial_paths, path_sparql
from ontoflow.operators.reasoner import Reasoner, expand_aliases
from ontoflow.plans.ir import BACKWARD, Dag, Kind, path_pattern
from ontoflow.sources.graph import Graph


def graph(spark, nodes, edges, types, reflexive=frozenset()):
    n = spark.createDataFrame([(i, dt, num) for i, (dt, num) in nodes.items()], "id long, dt string, num double")
    e = spark.createDataFrame(list(edges), "p string, src long, dst long")
    t = spark.createDataFrame([(i, c, w) for (i, c), w in types.items()], "id long, cls string, w double")
    return Graph(n, e, t, frozenset(reflexive))


def run(spark, dag, roots, nodes, edges, types, reflexive=frozenset(), **kw):
    rows = scores(graph(spark, nodes, edges, types, reflexive), dag, roots, **kw).collect()
    return {r.id: r for r in rows}


def plain(n):
    return {i: (None, None) for i in range(n)}


def test_parts(spark):
    d = Dag()
    got = run(spark, d, {"x": d.exists("hasPart", d.atomic("Wheel"))}, plain(4), [("hasPart", 0, 1), ("hasPart", 0, 2), ("hasPart", 3, 2)], {(1, "Wheel"): 1.0, (2, "Wheel"): 1.0})
    assert [got[i].x for i in range(4)] == [1, 0, 0, 1]


def test_two_steps_and_dead_end(spark):
    edges = [("p0", 0, 2), ("p0", 1, 3), ("p1", 2, 4), ("p1", 3, 5)]
    types = {(2, "Mid"): 1.0, (3, "Mid"): 1.0, (4, "End"): 1.0}
    steps = [("p0", "Mid"), ("p1", "End")]
    d, root = path_pattern(steps)
    got = run(spark, d, {"x": root}, plain(6), edges, types)
    assert [got[i].x for i in range(6)] == [1, 0.5, 0, 0, 0, 0]
    dead = graph(spark, plain(2), [("p0", 0, 1)], {(1, "Mid"): 1.0})
    assert {r.id: r.x for r in scores(dead, d, {"x": root}).collect()}[0] == 0.5
    assert {r.id: r.score for r in partial_paths(dead, steps).collect()}[0] == 0.0
    whole = graph(spark, plain(6), edges, types)
    assert [r.id for r in exact_paths(whole, steps).collect()] == [0]
    assert "?x2 a <End>" in path_sparql(steps)
    for f in (lambda: path_pattern([]), lambda: exact_paths(whole, []), lambda: path_sparql([])):
        with pytest.raises(ValueError):
            f()


def test_kth_largest_and_vacuous(spark):
    d = Dag()
    half = lambda c: d.atomic(c)
    c = d.intersection(half("a"), half("b"), mean=True)
    roots = {"min2": d.min_card(2, "p", c), "max2": d.max_card(2, "p", c), "eq2": d.exact_card(2, "p", c), "min0": d.min_card(0, "p", c), "min4": d.min_card(4, "p", c), "fuzzy4": d.min_card(4, "p", c, fuzzy=True)}
    roots |= {"some": d.exists("p"), "all": d.forall("p", c), "min1": d.min_card(1, "p"), "max0": d.max_card(0, "p"), "eq0": d.exact_card(0, "p")}
    types = {(1, "a"): 0.9, (1, "b"): 0.9, (2, "a"): 0.8, (3, "b"): 0.8}
    got = run(spark, d, roots, plain(4), [("p", 0, 1), ("p", 0, 2), ("p", 0, 3)], types)
    for name, x in {"min2": 0.4, "max2": 0.6, "eq2": 0.4, "min0": 1, "min4": 0, "fuzzy4": 0.75}.items():
        assert got[0][name] == pytest.approx(x), name
    assert [got[1][n] for n in ("some", "all", "min1", "max0", "eq0")] == [0, 1, 0, 1, 1]


def test_similarity_sum_and_max(spark):
    d = Dag()
    g = graph(spark, plain(1), [], {(0, "Sub"): 1.0, (0, "Super"): 1.0})
    s = spark.createDataFrame([("Sub", "Super", 1.0), ("Super", "Super", 1.0)], "cls string, target string, s double")
    for how, x in (("sum", 2.0), ("max", 1.0)):
        assert scores(g, d, {"x": d.atomic("Super")}, similarity=s, sim_agg=how).first().x == x


def test_errors():
    d = Dag()
    with pytest.raises(ValueError):
        d.nominal(None)
    with pytest.raises(ValueError):
        d.intersection()
    assert d.union(d.atomic("a"), d.union(d.atomic("b"), d.atomic("a"))) == d.union(d.atomic("b"), d.atomic("a"))
    assert d.intersection(d.atomic("a")) == d.atomic("a")


def random_dag(rng, size=24):
    d = Dag()
    ids = [d.const(), *(d.atomic(f"c{k}") for k in range(3)), d.nominal(rng.randrange(8)), d.datatype("int", low=2, high_open=True, high=7), d.datatype()]
    for _ in range(size):
        pick = lambda: rng.choice(ids)
        p, direction = f"p{rng.randrange(3)}", rng.choice(["forward", BACKWARD])
        ids.append(rng.choice([
            lambda: d.negation(pick()), lambda: d.intersection(pick(), pick()), lambda: d.intersection(pick(), pick(), pick(), mean=True), lambda: d.union(pick(), pick()),
            lambda: d.exists(p, pick(), direction), lambda: d.forall(p, pick(), direction), lambda: d.min_card(rng.randrange(4), p, pick(), direction),
            lambda: d.max_card(rng.randrange(3), p, pick(), direction), lambda: d.exact_card(rng.randrange(3), p, pick(), direction),
            lambda: d.min_card(3, p, pick(), direction, fuzzy=True), lambda: d.has_self(p), lambda: d.exists(p, pick(), direction, scale=0.5),
        ])())
    return d


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs_against_the_interpreter(spark, seed):
    rng = random.Random(seed)
    nodes = {i: ("int", float(i)) if i % 4 == 3 else (None, None) for i in range(9)}
    edges = list({(f"p{rng.randrange(3)}", rng.randrange(9), rng.randrange(9)) for _ in range(22)})
    types = {(rng.randrange(9), f"c{rng.randrange(3)}"): rng.choice([1.0, 0.5]) for _ in range(12)}
    d = random_dag(rng)
    if seed == 0:
        d.exists_transitive("p0", d.atomic("c1"))
        d.path_step("p1", "c0", d.path_step("p2", "c1"), BACKWARD)
    roots = {f"n{i}": i for i, n in enumerate(d.nodes) if d.edge_depth()[i] <= 4}
    reflexive = frozenset({"p2"}) if seed == 1 else frozenset()
    crisp = all(w == 1.0 for w in types.values())
    if not crisp:  # counting needs memberships of 0 or 1
        types = dict.fromkeys(types, 1.0)
    got = run(spark, d, roots, nodes, edges, types, reflexive)
    want = evaluate(d, nodes, edges, types, reflexive)
    for name, i in roots.items():
        for v in nodes:
            assert got[v][name] == pytest.approx(want[i][v]), (name, d.nodes[i], v)


def random_graph_of(rng, n=9, edges=22):
    nodes = {i: ("int", float(i)) if i % 4 == 3 else (None, None) for i in range(n)}
    return nodes, list({(f"p{rng.randrange(3)}", rng.randrange(n), rng.randrange(n)) for _ in range(edges)}), {(rng.randrange(n), f"c{rng.randrange(3)}"): 1.0 for _ in range(12)}


def test_scale_of_every_kind(spark):
    rng = random.Random(9)
    nodes, edges, types = random_graph_of(rng)
    d = Dag()
    a, b = d.atomic("c0"), d.atomic("c1")
    for x in (0.0, 0.5):
        d.const(scale=x), d.atomic("c2", scale=x), d.nominal(3, scale=x), d.datatype("int", scale=x), d.negation(a, scale=x), d.intersection(a, b, scale=x), d.union(a, b, scale=x)
        d.exists("p0", a, scale=x), d.forall("p0", a, scale=x), d.exists_transitive("p0", a, scale=x), d.min_card(1, "p0", a, scale=x), d.max_card(1, "p0", a, scale=x)
        d.exact_card(1, "p0", a, scale=x), d.min_card(2, "p0", a, fuzzy=True, scale=x), d.has_self("p0", scale=x), d.has_self("p2", scale=x), d.path_step("p1", "c0", scale=x)
    assert {n.kind for n in d.nodes if n.scale == 0.0} == set(Kind)
    got = run(spark, d, {f"n{i}": i for i in range(len(d.nodes))}, nodes, edges, types, frozenset({"p2"}))
    want = evaluate(d, nodes, edges, types, frozenset({"p2"}))
    for i, n in enumerate(d.nodes):
        for v in nodes:
            assert got[v][f"n{i}"] == pytest.approx(want[i][v]), (n, v)


def test_a_path_alone_is_that_of_its_definition(spark):
    rng = random.Random(3)
    nodes, edges, types = random_graph_of(rng, 12, 40)
    for length in (1, 3, 10):
        d, root = path_pattern([(f"p{rng.randrange(3)}", f"c{rng.randrange(4)}") for _ in range(length)])
        got = run(spark, d, {"score": root}, nodes, edges, types, frozenset())
        want = evaluate(d, nodes, edges, types)[root]
        assert {v: got[v]["score"] for v in nodes} == pytest.approx(want)


def test_reasoner(spark):
    d = Dag()
    d.root("x", d.exists("p", d.atomic("c"))).root("y", d.atomic("c"))
    r = Reasoner(graph(spark, plain(3), [("p", 0, 1)], {(1, "c"): 1.0})).add_all(d)
    assert [(a.id, a.score) for a in r.top_k_for_concept("x", 10).collect()] == [(0, 1.0), (1, 0.0), (2, 0.0)]
    assert {(a.id, a.concept) for a in r.members().collect()} == {(0, "x"), (1, "y")}
    assert [a.concept for a in r.top_k_for_nodes(1).orderBy("id").collect()] == ["x", "y", "x"]
    with pytest.raises(KeyError):
        r.top_k_for_concept("none", 1)
    r.apply_type_updates(spark.createDataFrame([(0, "c")], "id long, cls string"))
    assert [a.id for a in r.satisfying("y").orderBy("id").collect()] == [0, 1]
    alias = spark.createDataFrame([(0, 0), (0, 7)], "canonical long, member long")
    assert {a.id for a in expand_aliases(r.satisfying("x"), alias).collect()} == {0, 7}


def test_merge_shares_nodes():
    a, b = Dag(), Dag()
    a.root("a", a.exists("p", a.atomic("c")))
    b.root("b", b.exists("p", b.atomic("c")))
    a.merge(b)
    assert a.roots["a"] == a.roots["b"] and len(a.nodes) == 2
    assert a.layers() == [[0], [1]] and a.report()[1]["all_classes"] == ["c"]
    assert {n.kind for n in a.nodes} == {Kind.ATOMIC, Kind.EXISTS}
