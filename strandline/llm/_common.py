"""What the corpus operators share: the shared folder, stage tables, packed blocks and components."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows stay below so many bytes.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Where the session names none, a local one is set, which only a local master can use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stage(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Writes a step to the shared folder and reads it again, so a lost executor costs one step at most.

    The folder is added to ``paths``, for ``discard`` once what is made of it is stored as well.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    if paths is not None:
        paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored steps that no later step reads."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.clear()


def stage_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """As ``stage``, in buckets of ``key``: joins on it later shuffle the other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    df.write.bucketBy(parts(spark), key).option("path", shared_dir(spark, name)).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved now, so that the name can go; the files stay
    spark.sql(f"drop table {table}")
    return out


def bounded(df: DataFrame, row_bytes: int | Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks ``df``, a stored table, for broadcast if its rows fit the limit; else Spark shuffles it.

    ``row_bytes`` is what a row takes: a number, or a column to sum for rows of any size.
    """
    size = df.count() * row_bytes if isinstance(row_bytes, int) else df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def hot_keys(df: DataFrame, keys: list[str], weight: Column, least: int, per_part: float = 2.0) -> tuple[DataFrame, int]:
    """(keys, fans of those that hold more than a share of a partition, the limit): stored, at most 2 per partition by count.

    The limit is the whole weight over ``per_part`` partitions' worth, ``least`` at least; fans is how many tasks a key
    needs so that each gets about the limit.
    """
    sizes = df.groupBy(*keys).agg(F.sum(weight).alias("_size"))
    sizes = stage(sizes, "sizes")
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    limit = max(least, int(total / (per_part * parts(df.sparkSession))))
    hot = sizes.where(F.col("_size") > limit).select(*keys, F.ceil(F.col("_size") / limit).cast("int").alias("fans"))
    return stage(hot, "hot"), limit


def spread_join(big: DataFrame, one: DataFrame, keys: list[str], salt: Column, how: str = "left") -> DataFrame:
    """``big.join(one, keys)`` where ``one`` has a row for each key: a key of very many rows is dealt over tasks by ``salt``.

    The few such keys are counted first; their rows of ``one`` are repeated for each task.
    """
    hot, _ = hot_keys(big, keys, F.lit(1), 256)
    small = bounded(hot, 8 * len(keys) + 8)
    fans = F.coalesce("fans", F.lit(1))
    left = big.join(small, keys, "left").withColumn("_salt", F.pmod(salt, fans).cast("int")).drop("fans")
    right = one.join(small, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), fans - 1))).drop("fans")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def tidy() -> None:
    """Gives memory that is free inside this process back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(f: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f`` for mapInArrow, so that a worker which waits for its next task does not hold what the last one used."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            tidy()

    return run


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Rows go to Python workers in batches of about ``size`` bytes, where the session keeps Spark's 64 MB.

    A task holds each batch outside the heap, next to the worker's own copy.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(name, f"{size}b")


def parts(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _fanned(edges: DataFrame, one: DataFrame, fans: int = 8) -> DataFrame:
    """``edges.join(one, "u")``, a node's edges dealt over several tasks; ``one`` has a row of a few bytes for each node."""
    left = edges.withColumn("_fan", F.pmod(F.xxhash64("v"), F.lit(fans)).cast("int"))
    right = one.withColumn("_fan", F.explode(F.sequence(F.lit(0), F.lit(fans - 1))))
    return left.join(right, ["u", "_fan"]).drop("_fan")


def edges_to_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternates large-star and small-star steps. Each keeps an edge list no longer than the one before, finds
    minima by partial aggregation and so needs no node's neighbours in one place. The rows of each step are stored.
    """
    now = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    while not now.isEmpty():
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _fanned(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _fanned(large, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        now = stage(small, "edges")
        # done when every node has one edge down, or only edges from above
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(
            now.select(F.col("v").alias("node"), F.lit(0).alias("down")).distinct()
        )
        unsettled = ends.groupBy("node").agg(F.sum("down").alias("down"), F.count("*").alias("n"))
        if unsettled.where("down > 1 or (down = 1 and n > 1)").isEmpty():
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def spread(total: int, each: int, least: int) -> int:
    """Number of buckets so that one holds about ``each`` of ``total``."""
    return max(least, math.ceil(total / each))


def cut(values: np.ndarray, key: np.ndarray, n: int) -> Iterable[tuple[int, np.ndarray]]:
    """(bucket, its values) for each bucket that has some; the order within a bucket is kept."""
    order = np.argsort(key, kind="stable")
    edges = np.searchsorted(key[order], np.arange(n + 1))
    values = values[order]
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), values[edges[k] : edges[k + 1]]
