"""Random graphs and paths: uniform edges for each property, one class for each node."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import Graph


def random_graph(spark: SparkSession, nodes: int, properties: int, classes: int, degree: float, seed: int = 0) -> Graph:
    """A bag of ``nodes * degree`` edges for each property, ends drawn independently, by seeded hashes.

    A row's values depend on its number and the seed only, so that a lost task makes them again.
    """
    draw = lambda n, *by: F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(n))
    per = int(nodes * degree)
    rows = spark.range(per * properties)
    edges = rows.select(F.concat(F.lit("p"), (F.col("id") % properties).cast("string")).alias("p"), draw(nodes, "id", F.lit("src")).alias("src"), draw(nodes, "id", F.lit("dst")).alias("dst"))
    ids: DataFrame = spark.range(nodes)
    types = ids.select("id", F.concat(F.lit("c"), draw(classes, "id", F.lit("cls")).cast("string")).alias("cls"), F.lit(1.0).alias("w"))
    return Graph(ids.select("id", F.lit(None).cast("string").alias("dt"), F.lit(None).cast("double").alias("num")), edges, types)


def random_path(steps: int, properties: int, classes: int, seed: int = 0) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    return [(f"p{rng.randrange(properties)}", f"c{rng.randrange(classes)}") for _ in range(steps)]
