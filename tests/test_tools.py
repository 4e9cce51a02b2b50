from ontoflow.operators.modes import PROFILES, plan_passes
from ontoflow.operators.paths import path_sparql
from ontoflow.plans.schema import Schema, named
from ontoflow.profiling import Profiler


def test_profiler_nests():
    p = Profiler("run")
    with p.step("a"):
        with p.step("b", rows=3):
            pass
    rows = p.root.rows()
    assert [(r["depth"], r["name"]) for r in rows] == [(0, "run"), (1, "a"), (2, "b")] and rows[2]["rows"] == 3
    assert rows[1]["ms"] >= rows[2]["ms"] and abs(rows[0]["ms"] - rows[1]["ms"]) < 1e-6


def test_passes_and_reasons():
    s = Schema()
    s.sub.append((named("A"), named("B")))
    full = {n: on for n, on, _ in plan_passes(s)}
    assert full == {"reflexive": False, "property_hierarchy": False, "domain_range": False, "class_hierarchy": True, "same_as": True, "has_key": False, "roles": False}
    assert all(not on for _, on, _ in plan_passes(s, PROFILES["light"]))


def test_sparql_texts():
    assert path_sparql([("p", "A"), ("q", "B")]).count(" a <") == 2
    text = path_sparql([("p", "A"), ("q", "B")], partial=True)
    assert "?m0 + ?m1" in text and "/ 2.0" in text and "GROUP BY ?v" in text
