"""Memberships that arrive as a stream: each batch is added to a graph and concepts are scored anew.

The engine's own operators are over whole graphs; this is the way in for facts that arrive over time.
Types seen so far are kept as a table in the shared folder, so that a restarted query goes on from
there. A batch that is delivered twice adds nothing.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lower import scores
from ..plans.ir import Dag
from ..sources.graph import Graph


def score_stream(graph: Graph, dag: Dag, updates: DataFrame, folder: str, *, threshold: float = 0.999, **trigger) -> StreamingQuery:
    """Starts a query over a stream of memberships (id, cls).

    After each batch ``folder/members`` has a new directory ``batch=<n>`` with (id, concept, score) of
    all pairs at the threshold; ``folder/types`` has the batches' memberships.
    """
    spark = graph.nodes.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        batch.select("id", "cls").distinct().write.mode("overwrite").parquet(f"{folder}/types/batch={number}")
        seen = spark.read.schema("id long, cls string, batch long" if dict(graph.types.dtypes)["id"] == "bigint" else "id string, cls string, batch long").parquet(f"{folder}/types")
        own = replace(graph, types=graph.with_types(seen.where(F.col("batch") <= number)).types)
        found = scores(own, dag).unpivot("id", list(dag.roots), "concept", "score").where(F.col("score") >= threshold)
        found.write.mode("overwrite").parquet(f"{folder}/members/batch={number}")

    return updates.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/progress").trigger(**(trigger or {"availableNow": True})).start()
