"""Order over tables of any size: exact ranks in groups, and the nearest value on either side.

Rows are range-partitioned and stored with the number of their range. What crosses ranges is then a small table with a
row for each range (and group): how many rows stand before, or the outermost values of the ranges on either side.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.session import work_dir

_BACK, _ON = Window.unboundedPreceding, Window.unboundedFollowing


def in_ranges(df: DataFrame, by: list[str], name: str = "ranges") -> DataFrame:
    """The rows, stored, and ``_p``, the number of their range of ``by``; ranges follow the order of ``by``."""
    path = work_dir(df.sparkSession, name)
    df = df.repartitionByRange(*by).withColumn("_p", F.spark_partition_id())
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def at_ranks(df: DataFrame, keys: list[str], column: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, a column for each name of ``ranks``, known: values at index ``rank(known)`` of a group's sorted values.

    ``known`` counts a group's values that are not null; groups without any give no row. Values are counted first and
    stored in ranges by (keys, value). A rank falls into one range of its group, found from the ranges' sizes; only that
    range's values are cumulated. So no group is gathered or sorted in one task, however large it is.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    stored = in_ranges(counted, [*keys, "_v"], "ranks")
    sizes = stored.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
    group = Window.partitionBy(*keys)
    sizes = sizes.select("*", F.sum("_s").over(group.orderBy("_p")).alias("_upto"), F.sum("_s").over(group).alias("known"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("known")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    sizes = sizes.withColumn("_a", asked).where((F.col("_upto") > F.col("_a.rank")) & (F.col("_upto") - F.col("_s") <= F.col("_a.rank")))
    own = [F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_p"])]
    sizes = sizes.select(*own, "known", F.col("_a.name").alias("_name"), (F.col("_a.rank") - F.col("_upto") + F.col("_s")).alias("_local"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, "_p"])])
    hit = stored.join(sizes, same).select(*keys, "_p", "known", "_name", "_local", "_v", "_c")
    inside = Window.partitionBy(*keys, "_p", "_name").orderBy("_v")
    hit = hit.withColumn("_upto", F.sum("_c").over(inside)).where((F.col("_upto") > F.col("_local")) & (F.col("_upto") - F.col("_c") <= F.col("_local")))
    return hit.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in ranks], F.max("known").alias("known"))


def at_rank(df: DataFrame, keys: list[str], column: str, rank: Callable[[Column], Column]) -> DataFrame:
    """keys, value, known: one rank of ``at_ranks``."""
    return at_ranks(df, keys, column, {"value": rank})


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """round(q * (n - 1)), half to even."""
    return lambda n: F.bround(q * (n - 1))


def floor_rank(q: float) -> Callable[[Column], Column]:
    """int(q * n), the last at most; for q = 0.5 the upper median."""
    return lambda n: F.least(n - 1, F.floor(q * n))


def linear(low: str, high: str, rank: Column) -> Column:
    """Between the values at floor(rank) and ceil(rank)."""
    return F.col(low) + (F.col(high) - F.col(low)) * (rank - F.floor(rank))


def nearest(left: DataFrame, right: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Every left row with the right value nearest to its key, at any distance (ties: the smaller value).

    Keys and values are merged in one order, dealt in ranges: within its range a key sees the value before and the one
    behind it, and where there is none the outermost of the ranges on either side, of a table with a row for each range.
    Equal keys are spread over ranges by a hash of the row. A null or NaN key, or an empty right side, gives null.
    """
    values = right.select(F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x")).distinct()
    row = F.struct(*[F.col(c) for c in left.columns])
    keys = left.select(F.col(key).cast("double").alias("_x"), F.lit(None).cast("double").alias("_v"), F.xxhash64(*[F.col(c) for c in left.columns]).alias("_h"), row.alias("_row"), F.lit(True).alias("_own"))
    stands = values.select("_x", F.col("_x").alias("_v"), F.lit(None).cast("long").alias("_h"), F.lit(None).cast(keys.schema["_row"].dataType).alias("_row"), F.lit(False).alias("_own"))
    merged = in_ranges(keys.unionByName(stands), ["_x", "_h"], "nearest")
    each = merged.groupBy("_p").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    w = Window.orderBy("_p")  # a row for each range
    each = each.select("_p", F.max("_hi").over(w.rowsBetween(_BACK, -1)).alias("_under"), F.min("_lo").over(w.rowsBetween(1, _ON)).alias("_over"))
    w = Window.partitionBy("_p").orderBy("_x", "_h")
    near = merged.join(F.broadcast(each), "_p")
    near = near.withColumn("_under", F.coalesce(F.last("_v", True).over(w.rowsBetween(_BACK, 0)), "_under"))
    near = near.withColumn("_over", F.coalesce(F.first("_v", True).over(w.rowsBetween(0, _ON)), "_over")).where("_own")
    under, over, x = F.col("_under"), F.col("_over"), F.col("_x")
    best = F.when(over.isNull() | (x - under <= over - x), under).otherwise(over)
    return near.select("_row.*", F.when(x.isNotNull() & ~F.isnan(x), best).alias(out))


def previous(df: DataFrame, group: str, order: str, columns: list[str], width: int = 1000) -> DataFrame:
    """``df`` and a struct ``_before`` of the columns of the row before, by a whole-number ``order`` within each group.

    Rows are windowed by group and block of ``width`` numbers; a block's first row gets the last one of the nearest block
    before that has any, which is handed on by a table of block numbers. So a group of any size is dealt over tasks, and
    no row's columns go through a window of its whole group. Null orders stand apart, before nothing.
    """
    df = df.withColumn("_b", F.floor(F.col(order) / width))
    row = F.struct(order, *columns)
    ends = df.where("_b is not null").groupBy(group, "_b").agg(F.max_by(row, order).alias("_end"))
    numbers = df.where("_b is not null").groupBy(group, "_b").agg(F.lit(1).alias("_one"))
    follows = numbers.withColumn("_next", F.lead("_b").over(Window.partitionBy(group).orderBy("_b"))).where("_next is not null")
    follows = follows.select(F.col(group).alias("_g"), F.col("_b").alias("_c"), "_next")
    ends = ends.join(follows, ends[group].eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c"))).select(F.col("_g"), F.col("_next").alias("_c"), "_end")
    w = Window.partitionBy(group, "_b").orderBy(order)
    df = df.withColumn("_before", F.lag(row).over(w)).withColumn("_k", F.row_number().over(w))
    df = df.join(ends, df[group].eqNullSafe(ends["_g"]) & (F.col("_b") == F.col("_c")) & (F.col("_k") == 1), "left")
    return df.withColumn("_before", F.when(F.col(order).isNotNull(), F.coalesce("_before", "_end"))).drop("_b", "_g", "_c", "_end", "_k")
