"""Connected components of an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.session import work_dir


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component for every node of an edge; component is the least node reachable. Nodes are of any type with an order.

    Each round hangs a node's higher neighbours under its least one, then its lower ones; no round has more edges than
    the one before, and a few more rounds than the longest path has bits suffice. Minima are partly aggregated, joins of
    very common nodes are split by Spark at run time. Each round is stored.
    """
    spark = edges.sparkSession

    def stored(df: DataFrame) -> DataFrame:
        path = work_dir(spark, "edges")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stored(down.where("u <> v").distinct())
        # settled when no node has two edges down, or one down and another from above
        ends = now.groupBy(F.col("u").alias("x")).agg(F.count("*").alias("n"))
        if ends.where("n > 1").isEmpty() and now.select(F.col("v").alias("x")).join(ends, "x", "left_semi").isEmpty():
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
