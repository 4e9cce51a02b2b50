"""Knowledge graphs as DataFrames, and the mapping of star-schema tables to one."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"


@dataclass(frozen=True)
class Graph:
    """nodes(id, dt, num), edges(p, src, dst), types(id, cls, w); literals are nodes with a datatype."""

    nodes: DataFrame
    edges: DataFrame
    types: DataFrame
    reflexive: frozenset[str] = field(default_factory=frozenset)

    def with_types(self, more: DataFrame) -> "Graph":
        """The graph with memberships (id, cls) of weight 1 added."""
        added = more.select("id", "cls", F.lit(1.0).alias("w"))
        both = self.types.select("id", "cls", "w").unionByName(added)
        return replace(self, types=both.groupBy("id", "cls").agg(F.max("w").alias("w")))

    def with_edges(self, more: DataFrame) -> "Graph":
        return replace(self, edges=self.edges.select("p", "src", "dst").unionByName(more.select("p", "src", "dst")).distinct())

    def edge(self, prop: str, direction: str = "forward") -> DataFrame:
        """(r, n): the side reduced to, and the neighbour's."""
        r, n = ("src", "dst") if direction == "forward" else ("dst", "src")
        return self.edges.where(F.col("p") == prop).select(F.col(r).alias("r"), F.col(n).alias("n"))


#: Node ids of star-schema rows: the kind's number times 10^12, plus the key.
KINDS = {"region": 1, "nation": 2, "customer": 3, "supplier": 4, "part": 5, "order": 6, "event": 7, "user": 8, "document": 9, "turn": 10, "balance": 21, "price": 22, "size": 23, "retail": 24, "value": 25}
_SPAN = 10**12


def key(kind: str, column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return F.lit(KINDS[kind] * _SPAN) + c.cast("long")


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def star_graph(spark: SparkSession, sf_dir: str, tables: Iterable[str], *, literals: Iterable[str] = (), bag: bool = False) -> Graph:
    """The graph hidden in the star schema, over the tables named.

    Nodes are rows of ``tables`` (region, nation, customer, supplier, part, orders, events, documents,
    conversations) and the literals named (balance, price, size, retail, value). Properties appear
    where both ends do; hasPart and hasSupplier come from lineitem, as a set or as a bag. Only the
    columns used are read.
    """
    tables, literals = set(tables), set(literals)
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nodes, edges, types = [], [], []

    def add(df, kind, column, classes):
        nodes.append(df.select(key(kind, column).alias("id"), F.lit(None).cast("string").alias("dt"), F.lit(None).cast("double").alias("num")))
        for c in classes:
            c = F.lit(c) if isinstance(c, str) else c
            types.append(df.select(key(kind, column).alias("id"), c.alias("cls")).where("cls IS NOT NULL"))

    def link(prop, df, src, dst, repeated=False):
        pairs = df.select(src.alias("src"), dst.alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
        if repeated and not bag:  # only where the table's key isn't the edge's source
            pairs = pairs.distinct()
        edges.append(pairs.select(F.lit(prop).alias("p"), "src", "dst"))

    def literal(df, kind, prop, subject, value, datatype):
        there = key(kind, subject[1])
        nodes.append(df.select(there.alias("id"), F.lit(XSD + datatype).alias("dt"), F.col(value).cast("double").alias("num")))
        link(prop, df, key(*subject), there)

    if "region" in tables:
        add(read("region"), "region", "r_regionkey", ["Region", F.col("r_name")])
    if "nation" in tables:
        add(t := read("nation"), "nation", "n_nationkey", ["Nation"])
        if "region" in tables:
            link("nationRegion", t, key("nation", "n_nationkey"), key("region", "n_regionkey"))
    if "customer" in tables:
        add(t := read("customer"), "customer", "c_custkey", ["Customer", F.col("c_mktsegment")])
        if "nation" in tables:
            link("custNation", t, key("customer", "c_custkey"), key("nation", "c_nationkey"))
        if "balance" in literals:
            literal(t, "balance", "hasBalance", ("customer", "c_custkey"), "c_acctbal", "double")
    if "supplier" in tables:
        add(t := read("supplier"), "supplier", "s_suppkey", ["Supplier"])
        if "nation" in tables:
            link("suppNation", t, key("supplier", "s_suppkey"), key("nation", "s_nationkey"))
    if "part" in tables:
        add(t := read("part"), "part", "p_partkey", ["Part", F.col("p_brand")])
        if "size" in literals:
            literal(t, "size", "hasSize", ("part", "p_partkey"), "p_size", "integer")
    if "orders" in tables:
        add(t := read("orders"), "order", "o_orderkey", ["Order", F.col("o_orderstatus"), F.col("o_orderpriority")])
        if "customer" in tables:
            link("placedBy", t, key("order", "o_orderkey"), key("customer", "o_custkey"))
        if "price" in literals:
            literal(t, "price", "hasPrice", ("order", "o_orderkey"), "o_totalprice", "double")
        lines = read("lineitem")
        if "part" in tables:
            link("hasPart", lines, key("order", "l_orderkey"), key("part", "l_partkey"), True)
        if "supplier" in tables:
            link("hasSupplier", lines, key("order", "l_orderkey"), key("supplier", "l_suppkey"), True)
    if "events" in tables:
        from pyspark.sql import Window

        add(t := read("events"), "event", "event_id", ["Event", F.col("event_type")])
        in_order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        link("nextEvent", t.withColumn("_next", F.lead("event_id").over(in_order)), key("event", "event_id"), key("event", "_next"))
        users = t.select("user_id").distinct()
        add(users, "user", "user_id", ["User"])
        link("byUser", t, key("event", "event_id"), key("user", "user_id"))
    if "documents" in tables:
        add(t := read("documents"), "document", "doc_id", ["Document", F.col("lang")])
    if "conversations" in tables:
        t = read("conversations").withColumn("_k", F.col("conv_id") * 1000 + F.col("turn"))
        add(t, "turn", "_k", ["Turn", F.col("role")])
        link("nextTurn", t, key("turn", "_k"), key("turn", F.col("_k") + 1))
        ids = nodes[-1].select(F.col("id").alias("dst"))
        edges.append(edges.pop().join(ids, "dst", "left_semi").select("p", "src", "dst"))
    empty = "p string, src long, dst long"
    joined = _union(edges) if edges else spark.createDataFrame([], empty)
    typed = _union(types).withColumn("w", F.lit(1.0))
    return Graph(_union(nodes), joined, typed)
