"""Loading tables and reading events as tracks: ordered observations of one user, some of them missing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_frame(track: str = "track", frame: str = "frame") -> WindowSpec:
    return Window.partitionBy(track).orderBy(frame)


def whole(track: str = "track") -> WindowSpec:
    return Window.partitionBy(track)


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track, frame (from 0), kind, raw, v (null where the observation is missing: an error event), props."""
    events = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("track"), (F.row_number().over(order) - 1).alias("frame"), F.col("event_type").alias("kind"),
        F.col("value").alias("raw"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"), "props",
    )


#: The same rows in SQL, to stand before a query's own parts.
TRACKS = """
t as (select user_id as track, row_number() over (partition by user_id order by ts, event_id) - 1 as frame,
  event_type as kind, value as raw, case when event_type <> 'error' then value end as v, props from events)
"""


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; a temporary one only where the session names none, on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
