"""Class-membership scoring and materialization over typed knowledge graphs, on Spark DataFrames."""
