"""Concepts over a graph: scores of all at once, best nodes, best concepts, satisfying nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..plans.ir import Dag
from ..sources.graph import Graph
from .lower import scores

SATISFIED = 0.999


class Reasoner:
    """Named concepts, merged into one constraint graph and scored by one plan."""

    def __init__(self, graph: Graph, **options):
        self.graph, self.dag, self.options = graph, Dag(), options
        self._scores: DataFrame | None = None

    def add(self, name: str, dag: Dag, root: int | None = None) -> "Reasoner":
        place = self.dag.merge(Dag(dag.nodes))
        self.dag.root(name, place[dag.roots[name] if root is None else root])
        self._scores = None
        return self

    def add_all(self, dag: Dag) -> "Reasoner":
        """Every root of ``dag`` as a concept."""
        self.dag.merge(dag)
        self._scores = None
        return self

    def clear(self) -> None:
        self.dag, self._scores = Dag(), None

    def scores(self) -> DataFrame:
        """id and a column per concept."""
        if self._scores is None:
            self._scores = scores(self.graph, self.dag, **self.options)
        return self._scores

    def long(self) -> DataFrame:
        """(id, concept, score)."""
        names = list(self.dag.roots)
        return self.scores().unpivot("id", names, "concept", "score")

    def top_k_for_concept(self, concept: str, k: int) -> DataFrame:
        """The k best nodes, ties to the smaller id; all nodes if k is larger."""
        if concept not in self.dag.roots:
            raise KeyError(concept)
        return self.scores().select("id", F.col(concept).alias("score")).orderBy(F.desc("score"), "id").limit(k)

    def top_k_for_nodes(self, k: int, nodes: DataFrame | None = None) -> DataFrame:
        """Of each node, or each of ``nodes`` (id), its k best concepts: id, concept, score, rank."""
        rows = self.long() if nodes is None else self.long().join(nodes, "id", "left_semi")
        place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "concept"))
        return rows.withColumn("rank", place).where(F.col("rank") <= k)

    def satisfying(self, concept: str, threshold: float = SATISFIED) -> DataFrame:
        if concept not in self.dag.roots:
            raise KeyError(concept)
        return self.scores().where(F.col(concept) >= threshold).select("id")

    def members(self, threshold: float = SATISFIED) -> DataFrame:
        """(id, concept, score) of all pairs at the threshold."""
        return self.long().where(F.col("score") >= threshold)

    def apply_type_updates(self, more: DataFrame) -> None:
        """Adds memberships (id, cls) to the graph."""
        self.graph, self._scores = self.graph.with_types(more), None


def expand_aliases(result: DataFrame, alias: DataFrame) -> DataFrame:
    """Gives every alias (canonical, member) the rows of its canonical node."""
    others = result.join(alias.where("canonical <> member"), result.id == alias.canonical).drop("id", "canonical").withColumnRenamed("member", "id")
    return result.unionByName(others)
