"""python -m tessera FOLDER: queries in Spark's SQL over a database's tables, a line each, until exit or the end of input."""

from __future__ import annotations

import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .sources import Database, display_sizes, result_rows


def show(df: DataFrame) -> int:
    """Print all rows, fetched partition by partition, and how many there are."""
    widths = [max(w, 1 + len(n)) for n, w in display_sizes(df).items()]
    line = lambda values: " ".join(str(v).rjust(w) for v, w in zip(values, widths))
    print(line(df.columns), line("-" * w for w in widths), sep="\n")
    n = 0
    for row in result_rows(df):
        print(line(row))
        n += 1
    print(f"{n} row{'' if n == 1 else 's'}")
    return n


def main(folder: str) -> None:
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    tx = Database(spark, folder).begin()
    for line in sys.stdin:
        line = line.strip().rstrip(";")
        if line == "exit":
            break
        if line:
            try:
                show(tx.query(line))
            except (PySparkException, ValueError) as e:
                print(f"SQL Exception: {line}: {e}")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) == 2 else sys.exit(__doc__))
