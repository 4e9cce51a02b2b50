"""Queries over the star schema's graph, one or more for each operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.lower import scores
from .operators.paths import exact_paths, partial_paths
from .operators.reasoner import Reasoner
from .plans.ir import BACKWARD, Dag, path_pattern
from .sources.graph import KINDS, XSD, star_graph

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _id(kind: str, column: str) -> str:
    return f"({KINDS[kind]}000000000000 + {column})::BIGINT"


# SQL of nodes, edges and class members.
ORDERS = f"(SELECT {_id('order', 'o_orderkey')} AS id, * FROM orders)"
CUSTOMERS = f"(SELECT {_id('customer', 'c_custkey')} AS id, * FROM customer)"
PLACED = f"(SELECT {_id('order', 'o_orderkey')} AS src, {_id('customer', 'o_custkey')} AS dst, o_orderpriority, o_orderstatus FROM orders)"
HAS_PART = f"(SELECT DISTINCT {_id('order', 'l_orderkey')} AS src, {_id('part', 'l_partkey')} AS dst FROM lineitem)"
HAS_SUPPLIER = f"(SELECT DISTINCT {_id('order', 'l_orderkey')} AS src, {_id('supplier', 'l_suppkey')} AS dst FROM lineitem)"
PARTS = f"(SELECT {_id('part', 'p_partkey')} AS id, * FROM part)"
CO = f"(SELECT id FROM {CUSTOMERS} UNION ALL SELECT id FROM {ORDERS})"
CO_GEO = f"(SELECT id FROM {CO} UNION ALL SELECT {_id('nation', 'n_nationkey')} FROM nation UNION ALL SELECT {_id('region', 'r_regionkey')} FROM region)"
OP = f"(SELECT id FROM {ORDERS} UNION ALL SELECT id FROM {PARTS})"


def _per_node(nodes: str, found: str, default: str = "0.0", **columns: str) -> str:
    """All nodes, with columns of ``found`` (id, ...) or the default."""
    cols = ", ".join(f"coalesce(f.{c}, {default})::DOUBLE AS {c}" for c in columns or {"score": ""})
    return f"SELECT n.id, {cols} FROM {nodes} n LEFT JOIN ({found}) f USING (id)"


def _customers_orders(spark, sf_dir, **kw):
    return star_graph(spark, sf_dir, ["customer", "orders"], **kw)


def _one(graph, dag: Dag, root: int, name: str = "score") -> DataFrame:
    return scores(graph, dag, {name: root})


# Edge operators


@query("exists_urgent_customer", f"""SELECT n.id, coalesce(f.s, 0)::DOUBLE * (n.kind = 'c')::INT AS score
FROM (SELECT id, 'c' AS kind FROM {CUSTOMERS} UNION ALL SELECT id, 'o' FROM {ORDERS}) n
LEFT JOIN (SELECT dst AS id, max((o_orderpriority = '1-URGENT')::INT) AS s FROM {PLACED} GROUP BY 1) f USING (id)""")
def exists_urgent_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an urgent order: Customer and some order placed by it of class 1-URGENT."""
    d = Dag()
    root = d.intersection(d.atomic("Customer"), d.exists("placedBy", d.atomic("1-URGENT"), BACKWARD))
    return _one(_customers_orders(spark, sf_dir), d, root)


_AMERICA = f"""SELECT {_id('order', 'o_orderkey')} AS id, 1.0 AS score FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA'"""


@query("exists_forward_nested", _per_node(CO_GEO, _AMERICA))
def exists_forward_nested(spark, sf_dir):
    d = Dag()
    root = d.exists("placedBy", d.exists("custNation", d.exists("nationRegion", d.atomic("AMERICA"))))
    return _one(star_graph(spark, sf_dir, ["customer", "orders", "nation", "region"]), d, root)


@query("forall_parts_small", _per_node(OP, f"SELECT src AS id, min((p_size <= 45)::INT) AS score FROM {HAS_PART} e JOIN {PARTS} p ON p.id = e.dst GROUP BY 1", "1.0") + f""" WHERE n.id >= {KINDS['order']}000000000000""")
def forall_parts_small(spark, sf_dir):
    """Orders all of whose parts are of size 45 or less; those without parts hold vacuously."""
    d = Dag()
    small = d.exists("hasSize", d.datatype(XSD + "integer", high=45))
    graph = star_graph(spark, sf_dir, ["orders", "part"], literals=["size"])
    return _one(graph, d, d.forall("hasPart", small)).where(f"id >= {KINDS['order']}000000000000 AND id < {KINDS['event']}000000000000")


@query("has_self", _per_node(f"(SELECT {_id('nation', 'n_nationkey')} AS id FROM nation UNION ALL SELECT {_id('supplier', 's_suppkey')} FROM supplier)", f"SELECT {_id('nation', 'n_nationkey')} AS id, 1.0 AS score FROM nation WHERE n_nationkey % 3 = 0"))
def has_self(spark, sf_dir):
    """Self loops of a derived edge set: nations linked to themselves where their key is divisible by 3."""
    g = star_graph(spark, sf_dir, ["nation", "supplier"])
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.lit(KINDS["nation"] * 10**12) + F.col("n_nationkey")).alias("src"), "n_nationkey")
    loops = nation.select(F.lit("near").alias("p"), "src", F.when(F.col("n_nationkey") % 3 == 0, F.col("src")).otherwise(F.col("src") + 1).alias("dst"))
    d = Dag()
    return _one(g.with_edges(loops), d, d.has_self("near"))


def _card(kind: str, k: int, qualified: bool):
    def run(spark, sf_dir):
        d = Dag()
        child = d.atomic("1-URGENT") if qualified else None
        return _one(_customers_orders(spark, sf_dir), d, getattr(d, f"{kind}_card")(k, "placedBy", child, BACKWARD))

    return run


def _card_sql(kind: str, k: int, qualified: bool) -> str:
    n = "sum((o_orderpriority = '1-URGENT')::INT)" if qualified else "count(*)"
    low, high = f"(coalesce(c, 0) >= {k})", f"(coalesce(c, 0) <= {k})"
    test = {"min": low, "max": high, "exact": f"({low} AND {high})"}[kind]
    return f"SELECT n.id, {test}::INT::DOUBLE AS score FROM {CO} n LEFT JOIN (SELECT dst AS id, {n} AS c FROM {PLACED} GROUP BY 1) f USING (id)"


for _kind in ("min", "max", "exact"):
    for _k, _q in ((0, True), (3, True), (10, False)):
        _name = f"{_kind}_card_{_k}_{'qualified' if _q else 'unqualified'}"
        query(_name, _card_sql(_kind, _k, _q))(_card(_kind, _k, _q))

# A neighbour's score that isn't 0 or 1: the mean of two memberships.
_MEAN = "((o_orderpriority = '1-URGENT')::INT + (o_orderstatus = 'O')::INT)::DOUBLE / 2.0"


def _mean(d: Dag) -> int:
    return d.intersection(d.atomic("1-URGENT"), d.atomic("O"), mean=True)


@query("cardinality_scores", f"""WITH k AS (SELECT dst AS id, list_reverse_sort(list({_MEAN})) AS s FROM {PLACED} GROUP BY 1)
SELECT n.id, coalesce(s[4], 0)::DOUBLE AS at_least, 1 - coalesce(s[5], 0)::DOUBLE AS at_most, least(coalesce(s[4], 0), 1 - coalesce(s[5], 0))::DOUBLE AS exactly FROM {CO} n LEFT JOIN k USING (id)""")
def cardinality_scores(spark, sf_dir):
    """The k-th largest neighbour score, for scores between 0 and 1."""
    d = Dag()
    roots = {"at_least": d.min_card(4, "placedBy", _mean(d), BACKWARD), "at_most": d.max_card(4, "placedBy", _mean(d), BACKWARD), "exactly": d.exact_card(4, "placedBy", _mean(d), BACKWARD)}
    return scores(_customers_orders(spark, sf_dir), d, roots)


@query("min_card_fuzzy", f"SELECT n.id, least(coalesce(c, 0) / 4.0::DOUBLE, 1.0)::DOUBLE AS score FROM {CO} n LEFT JOIN (SELECT dst AS id, sum(({_MEAN} > 0)::INT) AS c FROM {PLACED} GROUP BY 1) f USING (id)")
def min_card_fuzzy(spark, sf_dir):
    d = Dag()
    return _one(_customers_orders(spark, sf_dir), d, d.min_card(4, "placedBy", _mean(d), BACKWARD, fuzzy=True))


@query("card_set_and_bag", f"""SELECT n.id, (coalesce(a.c, 0) >= 5)::INT::DOUBLE AS as_set, (coalesce(b.c, 0) >= 5)::INT::DOUBLE AS as_bag FROM {ORDERS} n
LEFT JOIN (SELECT src AS id, count(*) AS c FROM {HAS_SUPPLIER} GROUP BY 1) a USING (id)
LEFT JOIN (SELECT {_id('order', 'l_orderkey')} AS id, count(*) AS c FROM lineitem GROUP BY 1) b USING (id)""")
def card_set_and_bag(spark, sf_dir):
    """At least five suppliers of an order, edges taken as a set and as a bag."""
    d = Dag()
    root = d.min_card(5, "hasSupplier")
    low, high = KINDS["order"] * 10**12, KINDS["event"] * 10**12
    out = [scores(star_graph(spark, sf_dir, ["orders", "supplier"], bag=b), d, {n: root}).where((F.col("id") >= low) & (F.col("id") < high)) for b, n in ((False, "as_set"), (True, "as_bag"))]
    return out[0].join(out[1], "id")


# Boolean algebra and leaves

_BOOL = f"""SELECT n.id, coalesce(u, 0)::DOUBLE AS u, coalesce(o, 0)::DOUBLE AS o FROM {CO} n
LEFT JOIN (SELECT id, (o_orderpriority = '1-URGENT')::INT AS u, (o_orderstatus = 'O')::INT AS o FROM {ORDERS}) f USING (id)"""


@query("boolean_algebra", f"SELECT id, 1 - u AS negation, least(u, o) AS intersection_min, (u + o) / 2.0::DOUBLE AS intersection_mean, greatest(u, o) AS union_max FROM ({_BOOL})")
def boolean_algebra(spark, sf_dir):
    d = Dag()
    u, o = d.atomic("1-URGENT"), d.atomic("O")
    return scores(_customers_orders(spark, sf_dir), d, {"negation": d.negation(u), "intersection_min": d.intersection(u, o), "intersection_mean": d.intersection(u, o, mean=True), "union_max": d.union(u, o)})


@query("nominal", f"SELECT id, (id = {_id('customer', '5')})::INT::DOUBLE AS score FROM {CO}")
def nominal(spark, sf_dir):
    d = Dag()
    return _one(_customers_orders(spark, sf_dir), d, d.nominal(KINDS["customer"] * 10**12 + 5))


@query("datatype_range", f"""SELECT id, (v >= 0 AND v < 5000)::INT::DOUBLE AS half_open, (v > 0 AND v <= 5000)::INT::DOUBLE AS other_half, 1.0::DOUBLE AS any_literal
FROM (SELECT {_id('customer', 'c_custkey')} AS id, c_acctbal AS v FROM customer)""")
def datatype_range(spark, sf_dir):
    d = Dag()
    some = lambda **kw: d.exists("hasBalance", d.datatype(XSD + "double", **kw))
    roots = {"half_open": some(low=0, high=5000, high_open=True), "other_half": some(low=0, high=5000, low_open=True), "any_literal": d.exists("hasBalance", d.datatype())}
    low, high = KINDS["customer"] * 10**12, KINDS["supplier"] * 10**12
    return scores(star_graph(spark, sf_dir, ["customer"], literals=["balance"]), d, roots).where((F.col("id") >= low) & (F.col("id") < high))


@query("const_and_scale", f"SELECT id, 1.0::DOUBLE AS const, u * 0.25::DOUBLE AS scaled, coalesce(f.s, 0) * 0.5::DOUBLE AS scaled_edge FROM ({_BOOL}) LEFT JOIN (SELECT dst AS id, max((o_orderpriority = '1-URGENT')::INT)::DOUBLE AS s FROM {PLACED} GROUP BY 1) f USING (id)")
def const_and_scale(spark, sf_dir):
    d = Dag()
    return scores(_customers_orders(spark, sf_dir), d, {"const": d.const(), "scaled": d.atomic("1-URGENT", scale=0.25), "scaled_edge": d.exists("placedBy", d.atomic("1-URGENT"), BACKWARD, scale=0.5)})


def _similarity(spark):
    import pyarrow as pa

    rows = [("1-URGENT", "Pressing", 1.0), ("2-HIGH", "Pressing", 0.75), ("O", "Pressing", 0.5)]
    return spark.createDataFrame(pa.table([*map(pa.array, zip(*rows))], names=["cls", "target", "s"]))


def _similar(how: str):
    def run(spark, sf_dir):
        d = Dag()
        return scores(_customers_orders(spark, sf_dir), d, {"score": d.atomic("Pressing")}, similarity=_similarity(spark), sim_agg=how)

    return run


_SIM = "CASE o_orderpriority WHEN '1-URGENT' THEN 1.0 WHEN '2-HIGH' THEN 0.75 ELSE 0 END::DOUBLE"
_SIM_O = "CASE o_orderstatus WHEN 'O' THEN 0.5 ELSE 0 END::DOUBLE"
query("similarity_sum", _per_node(CO, f"SELECT id, {_SIM} + {_SIM_O} AS score FROM {ORDERS}"))(_similar("sum"))
query("similarity_max", _per_node(CO, f"SELECT id, greatest({_SIM}, {_SIM_O}) AS score FROM {ORDERS}"))(_similar("max"))

_TURNS = f"(SELECT {_id('turn', 'conv_id * 1000 + turn')} AS id, conv_id, turn, role FROM conversations)"


@query("transitive_exists_next_turn", f"""SELECT a.id, max(coalesce((b.role = 'user')::INT, 0))::DOUBLE AS score
FROM {_TURNS} a LEFT JOIN {_TURNS} b ON a.conv_id = b.conv_id AND b.turn > a.turn
  AND (SELECT count(*) FROM conversations m WHERE m.conv_id = a.conv_id AND m.turn > a.turn AND m.turn <= b.turn) = b.turn - a.turn GROUP BY 1""")
def transitive_exists_next_turn(spark, sf_dir):
    """Turns that a user's turn follows, any number of turns later."""
    d = Dag()
    return _one(star_graph(spark, sf_dir, ["conversations"]), d, d.exists_transitive("nextTurn", d.atomic("user")))


# Results


def _five(spark, sf_dir) -> Reasoner:
    d = Dag()
    d.root("urgent", d.exists("placedBy", d.atomic("1-URGENT"), BACKWARD))
    d.root("all_open", d.forall("placedBy", d.atomic("O"), BACKWARD))
    d.root("many", d.min_card(12, "placedBy", None, BACKWARD))
    d.root("mean", d.exists("placedBy", _mean(d), BACKWARD))
    d.root("few_urgent", d.max_card(1, "placedBy", d.atomic("1-URGENT"), BACKWARD))
    return Reasoner(star_graph(spark, sf_dir, ["customer", "orders"])).add_all(d)


_FIVE = f"""SELECT n.id, coalesce(urgent, 0)::DOUBLE AS urgent, coalesce(all_open, 1)::DOUBLE AS all_open, (coalesce(c, 0) >= 12)::INT::DOUBLE AS many,
coalesce(m, 0)::DOUBLE AS mean, (coalesce(u, 0) <= 1)::INT::DOUBLE AS few_urgent FROM {CO} n LEFT JOIN (
SELECT dst AS id, max((o_orderpriority = '1-URGENT')::INT) AS urgent, min((o_orderstatus = 'O')::INT) AS all_open, count(*) AS c, max({_MEAN}) AS m, sum((o_orderpriority = '1-URGENT')::INT) AS u
FROM {PLACED} GROUP BY 1) f USING (id)"""
_FIVE_LONG = f"(UNPIVOT ({_FIVE}) ON urgent, all_open, many, mean, few_urgent INTO NAME concept VALUE score)"


@query("super_dag_many_concepts", f"SELECT id, concept, score FROM {_FIVE_LONG}")
def super_dag_many_concepts(spark, sf_dir):
    """Five concepts over one property: one join and one aggregation serve them all."""
    return _five(spark, sf_dir).long()


@query("topk_nodes", f"SELECT id, mean AS score FROM ({_FIVE}) ORDER BY score DESC, id LIMIT 25")
def topk_nodes(spark, sf_dir):
    return _five(spark, sf_dir).top_k_for_concept("mean", 25)


@query("topk_concepts", f"SELECT id, concept, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, concept) AS rank FROM {_FIVE_LONG}) WHERE rank <= 2")
def topk_concepts(spark, sf_dir):
    return _five(spark, sf_dir).top_k_for_nodes(2)


@query("satisfying", f"SELECT id FROM ({_FIVE}) WHERE few_urgent >= 0.999")
def satisfying(spark, sf_dir):
    return _five(spark, sf_dir).satisfying("few_urgent")


@query("threshold_members", f"SELECT concept, count(*)::BIGINT AS members FROM {_FIVE_LONG} WHERE score >= 0.5 GROUP BY 1")
def threshold_members(spark, sf_dir):
    return _five(spark, sf_dir).members(0.5).groupBy("concept").agg(F.count("*").alias("members"))


# Paths

_STEPS = [("placedBy", "BUILDING"), ("custNation", "Nation"), ("nationRegion", "ASIA")]
_WALK = f"""SELECT {_id('order', 'o_orderkey')} AS id, ((c_mktsegment = 'BUILDING')::INT + 1 + (r_name = 'ASIA')::INT)::DOUBLE AS m
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
_GEO = ["customer", "orders", "nation", "region"]


@query("path_dag", _per_node(CO_GEO, f"SELECT id, m * (1.0::DOUBLE / 3) AS score FROM ({_WALK})"))
def path_dag(spark, sf_dir):
    """Path steps score the best walk, complete or not (here walks are of three hops or none)."""
    dag, root = path_pattern(_STEPS)
    return _one(star_graph(spark, sf_dir, _GEO), dag, root)


@query("path_dag_dead_ends", f"""SELECT n.id, coalesce(s, 0) * (1.0::DOUBLE / 2) AS score FROM {CO_GEO} n LEFT JOIN (
SELECT id, max(w + more)::DOUBLE AS s FROM (SELECT dst AS id, (o_orderstatus = 'F')::INT AS w, 0 AS more FROM {PLACED}) GROUP BY 1) f USING (id)""")
def path_dag_dead_ends(spark, sf_dir):
    """A walk that can't take its second step keeps the credit of its first."""
    dag = Dag()
    below = dag.path_step("nowhere", "Nation")
    return _one(star_graph(spark, sf_dir, _GEO), dag, dag.path_step("placedBy", "F", below, BACKWARD, scale=0.5))


@query("path_exact", f"SELECT id FROM ({_WALK}) WHERE m = 3")
def path_exact(spark, sf_dir):
    return exact_paths(star_graph(spark, sf_dir, _GEO), _STEPS)


@query("path_sparql_partial", _per_node(CO_GEO, f"SELECT id, m / 3.0::DOUBLE AS score FROM ({_WALK})"))
def path_sparql_partial(spark, sf_dir):
    """The best share of matches over walks that take every step."""
    return partial_paths(star_graph(spark, sf_dir, _GEO), _STEPS)


# Closures

from .operators import closure, negative  # noqa: E402


def _table(spark, rows: list[tuple], *names: str) -> DataFrame:
    import pyarrow as pa

    return spark.createDataFrame(pa.table([*map(pa.array, zip(*rows))], names=list(names)))


_NATION_EDGES = f"""(SELECT 'custNation' AS p, {_id('customer', 'c_custkey')} AS src, {_id('nation', 'c_nationkey')} AS dst FROM customer
UNION ALL SELECT 'suppNation', {_id('supplier', 's_suppkey')}, {_id('nation', 's_nationkey')} FROM supplier
UNION ALL SELECT 'nationRegion', {_id('nation', 'n_nationkey')}, {_id('region', 'n_regionkey')} FROM nation)"""
_ORDER_TYPES = f"""(SELECT id, 'Order' AS cls FROM {ORDERS} UNION ALL SELECT id, o_orderpriority FROM {ORDERS} UNION ALL SELECT id, o_orderstatus FROM {ORDERS}
UNION ALL SELECT id, 'Customer' FROM {CUSTOMERS} UNION ALL SELECT id, c_mktsegment FROM {CUSTOMERS})"""
_SUPERS = [("1-URGENT", "Pressing"), ("2-HIGH", "Pressing"), ("Order", "Document"), ("Customer", "Party"), ("1-URGENT", "Thing"), ("2-HIGH", "Thing")]
_SUPERS_SQL = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SUPERS) + ") s(cls, sup)"


@query("subclass_closure", f"SELECT id, cls FROM {_ORDER_TYPES} UNION SELECT t.id, sup FROM {_ORDER_TYPES} t JOIN {_SUPERS_SQL} USING (cls)")
def subclass_closure(spark, sf_dir):
    return closure.class_hierarchy(_customers_orders(spark, sf_dir).types, _table(spark, _SUPERS, "cls", "sup"))


@query("subproperty_closure", f"SELECT p, src, dst FROM {_NATION_EDGES} UNION SELECT 'locatedIn', src, dst FROM {_NATION_EDGES}")
def subproperty_closure(spark, sf_dir):
    supers = [(p, "locatedIn") for p in ("custNation", "suppNation", "nationRegion")]
    g = star_graph(spark, sf_dir, ["customer", "supplier", "nation", "region"])
    return closure.property_hierarchy(g.edges, _table(spark, supers, "p", "sup"))


@query("domain_range", f"SELECT src AS id, 'Buyer' AS cls FROM {_NATION_EDGES} WHERE p = 'custNation' UNION SELECT dst, 'Market' FROM {_NATION_EDGES} WHERE p = 'custNation' UNION SELECT dst, 'Area' FROM {_NATION_EDGES} WHERE p = 'nationRegion'")
def domain_range(spark, sf_dir):
    g = star_graph(spark, sf_dir, ["customer", "supplier", "nation", "region"], literals=["balance"])
    ranges = [("custNation", "Market"), ("nationRegion", "Area"), ("hasBalance", "Amount")]
    return closure.domain_range(g.edges, _table(spark, [("custNation", "Buyer")], "p", "cls"), _table(spark, ranges, "p", "cls"), g.nodes.where("dt IS NOT NULL").select("id"))


@query("reflexive", f"SELECT p, id AS src, id AS dst FROM {CUSTOMERS}, (VALUES ('knows'), ('near')) v(p)")
def reflexive(spark, sf_dir):
    return closure.reflexive_edges(star_graph(spark, sf_dir, ["customer"], literals=["balance"]).nodes, ["knows", "near"])


@query("inverse", f"SELECT 'placedBy' AS p, src, dst FROM {PLACED} UNION SELECT 'customerOrder', dst, src FROM {PLACED}")
def inverse(spark, sf_dir):
    return closure.inverse_edges(_customers_orders(spark, sf_dir).edges, _table(spark, [("placedBy", "customerOrder")], "p", "q"))


@query("chain", f"SELECT 'orderNation' AS p, {_id('order', 'o_orderkey')} AS src, {_id('nation', 'c_nationkey')} AS dst FROM orders JOIN customer ON o_custkey = c_custkey")
def chain(spark, sf_dir):
    g = star_graph(spark, sf_dir, ["customer", "orders", "nation"])
    return closure.role_closure(g.edges, chains=[(("placedBy", "custNation"), "orderNation")]).where("p = 'orderNation'")


@query("transitive_role_closure", f"""WITH RECURSIVE base AS (SELECT src, dst FROM {_NATION_EDGES}), t(src, dst) AS (SELECT src, dst FROM base UNION SELECT t.src, b.dst FROM t JOIN base b ON t.dst = b.src)
SELECT 'locatedIn' AS p, src, dst FROM t UNION ALL SELECT p, src, dst FROM {_NATION_EDGES}""")
def transitive_role_closure(spark, sf_dir):
    g = star_graph(spark, sf_dir, ["customer", "supplier", "nation", "region"])
    return closure.role_closure(g.edges, supers=[(p, "locatedIn") for p in ("custNation", "suppNation", "nationRegion")], transitive=["locatedIn"])


# Equality: documents with equal texts are one; so are neighbours of a chain by id modulo 50.

_DOC = _id("document", "doc_id")


def _doc_edges(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    node = (F.lit(KINDS["document"] * 10**12) + F.col("doc_id")).alias("src")
    text = docs.select(F.lit("text").alias("p"), node, F.sha2("text", 256).alias("dst"))
    types = docs.select(node.alias("id"), F.lit("Document").alias("cls"))
    return types, text


@query("haskey_groups", f"SELECT min({_DOC}) OVER (PARTITION BY text) AS canonical, {_DOC} AS member FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def haskey_groups(spark, sf_dir):
    """Documents have their text as key."""
    return closure.components(closure.key_pairs(*_doc_edges(spark, sf_dir), "Document", ["text"]))


@query("sameas_components", f"SELECT min(id) OVER (PARTITION BY k // 50) AS canonical, id AS member FROM (SELECT {_id('customer', 'c_custkey')} AS id, c_custkey AS k FROM customer) QUALIFY count(*) OVER (PARTITION BY k // 50) > 1")
def sameas_components(spark, sf_dir):
    """Chains of 50 customers, each said to be the same as the next."""
    k = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    node = lambda c: F.lit(KINDS["customer"] * 10**12) + c
    last = F.col("c_custkey") % 50 == 49
    pairs = k.where(~last).select(node(F.col("c_custkey")).alias("a"), node(F.col("c_custkey") + 1).alias("b")).join(k.select(node(F.col("c_custkey")).alias("b")), "b", "left_semi")
    return closure.components(pairs)


_GROUPS = f"(SELECT min({_DOC}) OVER (PARTITION BY text) AS canonical, {_DOC} AS member, lang FROM documents)"


@query("sameas_expand", f"SELECT DISTINCT m.member AS id, o.lang AS cls FROM {_GROUPS} m JOIN {_GROUPS} o ON m.canonical = o.canonical WHERE o.lang IS NOT NULL UNION SELECT member, 'Document' FROM {_GROUPS}")
def sameas_expand(spark, sf_dir):
    """Every document gets the classes of all that are the same."""
    g = star_graph(spark, sf_dir, ["documents"])
    return closure.expand_equal(g.types, g.edges, haskey_groups(spark, sf_dir))[0]


@query("sameas_canonical", f"SELECT DISTINCT canonical AS id, lang AS cls, 1.0::DOUBLE AS w FROM {_GROUPS} WHERE lang IS NOT NULL UNION SELECT canonical, 'Document', 1.0::DOUBLE FROM {_GROUPS}")
def sameas_canonical(spark, sf_dir):
    return closure.canonicalize(star_graph(spark, sf_dir, ["documents"]), haskey_groups(spark, sf_dir)).types


# Negative evidence


@query("negative_closure_complement", f"""SELECT DISTINCT id, cls, sign FROM (
SELECT id, cls, 1 AS sign FROM {_ORDER_TYPES} UNION ALL SELECT id, 'Open', -1 FROM {ORDERS} WHERE o_orderstatus = 'F'
UNION ALL SELECT id, 'F', -1 FROM {ORDERS} WHERE o_orderstatus = 'O' UNION ALL SELECT id, 'O', -1 FROM {ORDERS} WHERE o_orderstatus = 'F'
UNION ALL SELECT id, 'Closed', 1 FROM {ORDERS} WHERE o_orderstatus = 'F')""")
def negative_closure_complement(spark, sf_dir):
    """F and O are disjoint, F and Open as well, and Open is what isn't Closed."""
    g = _customers_orders(spark, sf_dir)
    none = g.types.select("id", "cls").limit(0)
    return negative.negative_types(g.types, [("F", "O"), ("F", "Open")], [("Open", "Closed")], none)


def _status(spark, sf_dir) -> DataFrame:
    """Pressing customers: derived from an urgent order, asserted for BUILDING, blocked for MACHINERY."""
    g = _customers_orders(spark, sf_dir)
    d = Dag()
    d.root("Pressing", d.exists("placedBy", d.atomic("1-URGENT"), BACKWARD))
    derived = Reasoner(g).add_all(d).members().select("id", F.col("concept").alias("cls"))
    asserted = g.types.where("cls = 'BUILDING'").select("id", F.lit("Pressing").alias("cls"))
    pairs = [("MACHINERY", "Pressing"), ("FURNITURE", "Calm")]
    none = g.types.select("id", "cls").limit(0)
    signed = negative.negative_types(g.types.where("cls IN ('MACHINERY', 'FURNITURE')"), pairs, [], none)
    blockers = negative.blocked_by_class(signed, _table(spark, [("Pressing", "Pressing")], "cls", "needs"))
    return negative.assignment_status(asserted, derived, blockers)


_STATUS = f"""(SELECT id, 'Pressing' AS cls, asserted, derived, blocked, blocked AND (asserted OR derived) AS conflicted, CASE WHEN blocked THEN ['not:Pressing'] ELSE []::VARCHAR[] END AS blockers FROM (
SELECT c.id, c_mktsegment = 'BUILDING' AS asserted, coalesce(u, false) AS derived, c_mktsegment = 'MACHINERY' AS blocked FROM {CUSTOMERS} c
LEFT JOIN (SELECT dst AS id, bool_or(o_orderpriority = '1-URGENT') AS u FROM {PLACED} GROUP BY 1) f USING (id)) WHERE asserted OR derived OR blocked)"""


@query("assignment_status", f"SELECT * FROM {_STATUS}")
def assignment_status(spark, sf_dir):
    return _status(spark, sf_dir)


@query("policy_report", f"SELECT id, cls FROM {_STATUS} WHERE asserted OR derived")
def policy_report(spark, sf_dir):
    return negative.emit(_status(spark, sf_dir), "report_only")


@query("policy_suppress", f"SELECT id, cls FROM {_STATUS} WHERE asserted OR derived AND NOT blocked")
def policy_suppress(spark, sf_dir):
    return negative.emit(_status(spark, sf_dir))


@query("differentfrom_blockers", f"SELECT DISTINCT id, 'First' AS cls, 'different:{KINDS['customer']}000000000001' AS blocker FROM {CUSTOMERS} WHERE c_mktsegment = 'BUILDING' AND c_custkey <> 1")
def differentfrom_blockers(spark, sf_dir):
    """Customers of BUILDING are all different from customer 1."""
    one = KINDS["customer"] * 10**12 + 1
    different = star_graph(spark, sf_dir, ["customer"]).types.where(f"cls = 'BUILDING' AND id <> {one}").select(F.col("id").alias("a"), F.lit(one).alias("b"))
    return negative.blocked_by_nominal(_table(spark, [("First", one)], "cls", "node"), different).where(f"id <> {one}")


@query("functional_blockers", f"SELECT DISTINCT {_id('customer', 'c_custkey')} AS id, 'OfNation3' AS cls, 'value:custNation' AS blocker FROM customer WHERE c_nationkey <> 3")
def functional_blockers(spark, sf_dir):
    g = star_graph(spark, sf_dir, ["customer", "nation"])
    return negative.blocked_by_value(_table(spark, [("OfNation3", "custNation", KINDS["nation"] * 10**12 + 3)], "cls", "p", "value"), g.edges)


@query("negprop_blockers", f"SELECT DISTINCT {_id('customer', 'c_custkey')} AS id, 'OfNation3' AS cls, 'denied:custNation' AS blocker FROM customer WHERE c_nationkey = 3 AND c_custkey % 2 = 0")
def negprop_blockers(spark, sf_dir):
    """Every second customer is said not to be of its nation."""
    g = star_graph(spark, sf_dir, ["customer", "nation"])
    denied = g.edges.where("p = 'custNation' AND src % 2 = 0")
    return negative.blocked_by_assertion(_table(spark, [("OfNation3", "custNation", KINDS["nation"] * 10**12 + 3)], "cls", "p", "value"), denied)


# Rules and modes, over a small schema of the star schema's graph

from .operators import explain as explaining  # noqa: E402
from .operators import modes  # noqa: E402
from .plans.schema import THING, Expr, Schema, named  # noqa: E402
from .sources.rdf import Facts  # noqa: E402


def _schema() -> Schema:
    """Urgent customers by their orders, their nations by them, regions by those; and what excludes what."""
    s = Schema()
    some = lambda p, e, d="forward": Expr("some", (e,), prop=p, direction=d)
    s.equivalent += [
        (named("Urgent"), Expr("and", (named("Customer"), some("placedBy", named("1-URGENT"), BACKWARD)))),
        (named("BusyNation"), Expr("and", (named("Nation"), some("custNation", Expr("and", (named("Urgent"), named("BUILDING"))), BACKWARD)))),
        (named("BusyRegion"), Expr("and", (named("Region"), some("nationRegion", named("BusyNation"), BACKWARD)))),
    ]
    s.sub += [(named("Urgent"), named("Watched")), (named("Steady"), Expr("and", (named("Customer"), Expr("only", (named("O"),), prop="placedBy", direction=BACKWARD))))]
    s.disjoint.append(("MACHINERY", "Urgent"))
    s.classes |= {"Urgent", "BusyNation", "BusyRegion", "Watched", "Steady"}
    return s


def _prepared(spark, sf_dir) -> modes.Prepared:
    g = star_graph(spark, sf_dir, _GEO)
    pairs = g.types.limit(0)
    none = pairs.select(F.col("id").alias("a"), F.col("id").alias("b"))
    facts = Facts(g, none, none, g.edges.limit(0), pairs.select("id", "cls"))
    return modes.prepare(facts, _schema(), modes.Profile(same_as=False, has_key=False))


_URGENT = f"(SELECT c.id, c.c_mktsegment, c.c_nationkey FROM {CUSTOMERS} c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderpriority = '1-URGENT'))"
_BUSY = f"(SELECT DISTINCT n_nationkey, n_regionkey FROM nation JOIN {_URGENT} u ON u.c_nationkey = n_nationkey WHERE u.c_mktsegment = 'BUILDING')"
_FIX = f"""SELECT id, 'Urgent' AS cls FROM {_URGENT} UNION ALL SELECT id, 'Watched' FROM {_URGENT}
UNION ALL SELECT {_id('nation', 'n_nationkey')}, 'BusyNation' FROM {_BUSY} UNION ALL SELECT DISTINCT {_id('region', 'n_regionkey')}, 'BusyRegion' FROM {_BUSY}"""


@query("sufficient_fixpoint_acyclic", _FIX)
def sufficient_fixpoint_acyclic(spark, sf_dir):
    """Three levels of rules, a pass each."""
    return modes.materialize_positive(_prepared(spark, sf_dir))[1]


@query("sufficient_fixpoint_scc", f"""WITH RECURSIVE t(id, cls) AS (
SELECT id, 'Even' FROM {_TURNS} WHERE turn = 0 UNION
SELECT n.id, CASE t.cls WHEN 'Even' THEN 'Odd' ELSE 'Even' END FROM t JOIN {_TURNS} a ON a.id = t.id JOIN {_TURNS} n ON n.conv_id = a.conv_id AND n.turn = a.turn + 1)
SELECT id, cls FROM t UNION SELECT id, 'First' FROM {_TURNS} WHERE turn = 0""")
def sufficient_fixpoint_scc(spark, sf_dir):
    """Even and odd turns define each other from the first turn on."""
    s = Schema()
    back = lambda e: Expr("some", (named(e),), prop="nextTurn", direction=BACKWARD)
    s.sub += [(named("First"), named("Even")), (back("Even"), named("Odd")), (back("Odd"), named("Even"))]
    g = star_graph(spark, sf_dir, ["conversations"])
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("turn = 0")
    first = turns.select((F.lit(KINDS["turn"] * 10**12) + F.col("conv_id") * 1000).alias("id"), F.lit("First").alias("cls"))
    none = g.types.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    facts = Facts(g.with_types(first), none, none, g.edges.limit(0), g.types.limit(0).select("id", "cls"))
    prepared = modes.prepare(facts, s, modes.Profile(same_as=False, has_key=False, hierarchy=False))
    added = modes.materialize_positive(prepared)[1]
    return added.union(first.select("id", "cls"))


@query("stratified", f"SELECT id, cls FROM ({_FIX}) WHERE NOT (cls = 'Urgent' AND id IN (SELECT id FROM {CUSTOMERS} WHERE c_mktsegment = 'MACHINERY')) AND cls <> 'Watched'")
def stratified(spark, sf_dir):
    """Rules to the fixpoint; urgent customers of MACHINERY are blocked."""
    return modes.stratified(_prepared(spark, sf_dir), ["Urgent", "BusyNation", "BusyRegion"])


_STEADY = f"SELECT id, 'Steady' AS cls FROM {CUSTOMERS} c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c.c_custkey AND o_orderstatus <> 'O')"


@query("admissibility", f"{_STEADY} UNION ALL SELECT id, 'Urgent' FROM {_URGENT} WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT {_id('nation', 'n_nationkey')}, 'BusyNation' FROM {_BUSY}")
def admissibility(spark, sf_dir):
    return modes.admissibility(_prepared(spark, sf_dir), ["Steady", "Urgent", "BusyNation"])


@query("filtered_admissibility", f"{_STEADY} UNION ALL SELECT id, 'Urgent' FROM {_URGENT} WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT {_id('nation', 'n_nationkey')}, 'BusyNation' FROM {_BUSY}")
def filtered_admissibility(spark, sf_dir):
    return modes.filtered_admissibility(_prepared(spark, sf_dir), ["Steady", "Urgent", "BusyNation"])


@query("alignment_fuzzy", f"""SELECT n.id, 'Urgent' AS cls, ((((n.kind = 'c')::INT::DOUBLE + coalesce(f.s, 0)::DOUBLE) / 2.0::DOUBLE) + ((1 - (n.seg = 'MACHINERY')::INT)::DOUBLE + 1) / 2.0::DOUBLE) / 3.0::DOUBLE AS score
FROM (SELECT id, 'c' AS kind, c_mktsegment AS seg FROM {CUSTOMERS} UNION ALL SELECT id, 'o', '' FROM {ORDERS} UNION ALL SELECT {_id('nation', 'n_nationkey')}, 'n', '' FROM nation UNION ALL SELECT {_id('region', 'r_regionkey')}, 'r', '' FROM region) n
LEFT JOIN (SELECT dst AS id, max((o_orderpriority = '1-URGENT')::INT) AS s FROM {PLACED} GROUP BY 1) f USING (id)""")
def alignment_fuzzy(spark, sf_dir):
    """Conditions by means; exclusion from a class by agreement with its absence."""
    return modes.alignment(_prepared(spark, sf_dir), ["Urgent"])


@query("definitional_fixpoint", f"SELECT id, cls FROM ({_FIX}) WHERE cls IN ('BusyNation', 'BusyRegion')")
def definitional_fixpoint(spark, sf_dir):
    prepared = _prepared(spark, sf_dir)
    from dataclasses import replace

    graph = modes.materialize_positive(prepared, ["Urgent"])[0]
    return modes.materialize_definitions(replace(prepared, facts=replace(prepared.facts, graph=graph)), ["BusyNation", "BusyRegion"])[1]


@query("explain_witness", f"SELECT id, witness, score FROM (SELECT dst AS id, src AS witness, {_MEAN} AS score, row_number() OVER (PARTITION BY dst ORDER BY {_MEAN} DESC, src) AS k FROM {PLACED}) WHERE k = 1")
def explain_witness(spark, sf_dir):
    """Of each customer, the order that decides its best score."""
    g = _customers_orders(spark, sf_dir)
    d = Dag()
    return explaining.best_witness(g, "placedBy", BACKWARD, scores(g, d, {"score": _mean(d)}))


@query("bgp_triples", f"SELECT DISTINCT {_id('order', 'o_orderkey')}::VARCHAR AS o, n_nationkey::BIGINT + {KINDS['nation']}000000000000 || '' AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'")
def bgp_triples(spark, sf_dir):
    """Urgent orders and their customers' nations, as a pattern over triples."""
    from .operators.bgp import match
    from .sources.rdf import TYPE, graph_triples

    t = graph_triples(star_graph(spark, sf_dir, ["customer", "orders", "nation"]))
    return match(t, [("?o", TYPE, "1-URGENT"), ("?o", "placedBy", "?c"), ("?c", "custNation", "?n")], ["o", "n"])


@query("members_agreement", f"""WITH f AS (SELECT DISTINCT dst AS id FROM {PLACED} WHERE o_orderpriority = '1-URGENT'), e AS (SELECT id FROM {CUSTOMERS} WHERE c_acctbal > 0)
SELECT 'Urgent' AS cls, tp, fp, fn, tp::DOUBLE / (tp + fp)::DOUBLE AS precision, tp::DOUBLE / (tp + fn)::DOUBLE AS recall FROM (
SELECT (SELECT count(*) FROM f JOIN e USING (id)) AS tp, (SELECT count(*) FROM f WHERE id NOT IN (SELECT id FROM e)) AS fp, (SELECT count(*) FROM e WHERE id NOT IN (SELECT id FROM f)) AS fn)""")
def members_agreement(spark, sf_dir):
    """How far urgent customers are those with a balance over 0."""
    from .operators.metrics import agreement

    found = exists_urgent_customer(spark, sf_dir).where("score >= 0.999").select("id", F.lit("Urgent").alias("cls"))
    rich = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select((F.lit(KINDS["customer"] * 10**12) + F.col("c_custkey")).alias("id"), F.lit("Urgent").alias("cls"))
    return agreement(found, rich)


_STAR = "urn:star:"
#: The rules of ``_schema`` as an ontology.
_TURTLE = f"""@prefix : <{_STAR}> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .
:Urgent a owl:Class ; owl:disjointWith :MACHINERY ; owl:equivalentClass [ owl:intersectionOf ( :Customer
    [ a owl:Restriction ; owl:onProperty [ owl:inverseOf :placedBy ] ; owl:someValuesFrom :1-URGENT ] ) ] .
:BusyNation a owl:Class ; owl:equivalentClass [ owl:intersectionOf ( :Nation
    [ a owl:Restriction ; owl:onProperty [ owl:inverseOf :custNation ] ; owl:someValuesFrom [ owl:intersectionOf ( :Urgent :BUILDING ) ] ] ) ] .
:BusyRegion a owl:Class ; owl:equivalentClass [ owl:intersectionOf ( :Region
    [ a owl:Restriction ; owl:onProperty [ owl:inverseOf :nationRegion ] ; owl:someValuesFrom :BusyNation ] ) ] .
"""


@query("rdf_memberships", f"SELECT '{_STAR}' || id AS id, '{_STAR}' || cls AS cls FROM ({_FIX}) WHERE NOT (cls = 'Urgent' AND id IN (SELECT id FROM {CUSTOMERS} WHERE c_mktsegment = 'MACHINERY')) AND cls <> 'Watched'")
def rdf_memberships(spark, sf_dir):
    """From files to memberships: N-Triples of the star graph, a Turtle ontology, rules and what they exclude."""
    import posixpath
    import uuid

    from .sources.rdf import TYPE, graph_triples, load_facts, parse_turtle, write_ntriples
    from .storage import shared_root

    path = posixpath.join(shared_root(spark), f"triples-{uuid.uuid4().hex}")
    named = lambda c: F.concat(F.lit(_STAR), c).alias(c)
    property_ = F.when(F.col("p") == TYPE, F.col("p")).otherwise(F.concat(F.lit(_STAR), "p")).alias("p")
    write_ntriples(graph_triples(star_graph(spark, sf_dir, _GEO)).select(named("s"), property_, named("o")), path)
    prepared = modes.prepare(load_facts(spark, path), Schema.from_triples(parse_turtle(_TURTLE)), modes.Profile(same_as=False, has_key=False))
    return modes.stratified(prepared, [f"{_STAR}{c}" for c in ("Urgent", "BusyNation", "BusyRegion")])


def _scaled(d: Dag, x: float) -> dict[str, int]:
    """A node of every kind with a scale factor."""
    urgent = d.atomic("1-URGENT")
    return {
        "const_": d.const(scale=x), "atomic_": d.atomic("Customer", scale=x), "negation_": d.negation(d.atomic("Customer"), scale=x),
        "union_": d.union(d.atomic("Customer"), urgent, scale=x), "inter_": d.intersection(d.atomic("Customer"), d.exists("placedBy", direction=BACKWARD), scale=x),
        "exists_": d.exists("placedBy", urgent, BACKWARD, scale=x), "forall_": d.forall("placedBy", urgent, BACKWARD, scale=x),
        "min_": d.min_card(2, "placedBy", urgent, BACKWARD, scale=x), "max_": d.max_card(2, "placedBy", urgent, BACKWARD, scale=x),
        "exact_": d.exact_card(2, "placedBy", urgent, BACKWARD, scale=x), "reach_": d.exists_transitive("placedBy", urgent, BACKWARD, scale=x),
        "self_": d.has_self("placedBy", scale=x),
    }


def _scaled_sql(x: float) -> str:
    n = "coalesce(u, 0)"
    as_ = lambda e: f"(({e})::INT * {x})::DOUBLE"
    return ", ".join(f"{as_(e)} AS {name}{str(x).replace('.', '')}" for name, e in {
        "const_": "TRUE", "atomic_": "c", "negation_": "NOT c", "union_": "c OR o", "inter_": "c AND coalesce(t, 0) > 0", "exists_": f"{n} > 0",
        "forall_": f"coalesce(t, 0) = {n}", "min_": f"{n} >= 2", "max_": f"{n} <= 2", "exact_": f"{n} = 2", "reach_": f"{n} > 0", "self_": "FALSE",
    }.items())


@query("scale_all_kinds", f"""SELECT id, {_scaled_sql(0.5)}, {_scaled_sql(0.0)} FROM (
SELECT id, TRUE AS c, FALSE AS o FROM {CUSTOMERS} UNION ALL SELECT id, FALSE, o_orderpriority = '1-URGENT' FROM {ORDERS})
LEFT JOIN (SELECT dst AS id, count(*) AS t, count(*) FILTER (o_orderpriority = '1-URGENT') AS u FROM {PLACED} GROUP BY 1) USING (id)""")
def scale_all_kinds(spark, sf_dir):
    """Every kind of node with the scale factors one half and zero."""
    g = _customers_orders(spark, sf_dir)
    d = Dag()
    for x in (0.5, 0.0):
        for name, node in _scaled(d, x).items():
            d.root(f"{name}{str(x).replace('.', '')}", node)
    return scores(g, d)


__all__ = ["THING", "oracle_sql", "queries"]
