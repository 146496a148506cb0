"""Table statistics by a Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_statistics(df: DataFrame) -> DataFrame:
    """num_recs and the customary guess of distinct values that goes with it, as longs in one row."""
    return df.agg(F.count(F.lit(1)).alias("num_recs")).withColumn("distinct_est", 1 + F.floor(F.col("num_recs") / 3))
