"""Agreement of memberships with expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def agreement(found: DataFrame, expected: DataFrame) -> DataFrame:
    """cls, tp, fp, fn, precision and recall (null without a denominator), from memberships (id, cls)."""
    both = found.select("id", "cls", F.lit(1).alias("f"), F.lit(0).alias("e")).unionByName(expected.select("id", "cls", F.lit(0).alias("f"), F.lit(1).alias("e")))
    pairs = both.groupBy("id", "cls").agg(F.max("f").alias("f"), F.max("e").alias("e"))
    out = pairs.groupBy("cls").agg(F.count_if((F.col("f") == 1) & (F.col("e") == 1)).alias("tp"), F.count_if(F.col("e") == 0).alias("fp"), F.count_if(F.col("f") == 0).alias("fn"))
    share = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp").cast("double") / (F.col("tp") + F.col(other)).cast("double"))
    return out.select("cls", "tp", "fp", "fn", share("fp").alias("precision"), share("fn").alias("recall"))
