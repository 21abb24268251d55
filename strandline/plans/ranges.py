"""Overlapping ranges over frames, their joins and merges, resampling and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.plans.ordered import nearest
from strandline.session import TRACKS, by_frame, table, tracks


def windows(totals: DataFrame, size: int, overlap: int, policy: str = "cover") -> DataFrame:
    """chunk, start, end (exclusive) for each row's ``total``.

    tail: a window at every stride before the end, also one that only repeats the last; ceil: as many as are needed,
    ceil((total - overlap) / stride); cover: stops with the first window that reaches the end. Ends are cut to the total.
    """
    stride = size - overlap
    n = {
        "tail": F.ceil(F.col("total") / stride),
        "ceil": F.greatest(F.lit(1), F.ceil((F.col("total") - overlap) / stride)),
        "cover": F.when(F.col("total") <= size, 1).otherwise(F.ceil((F.col("total") - size) / stride) + 1),
    }[policy].cast("int")
    out = totals.withColumn("chunk", F.explode(F.sequence(F.lit(0), n - 1)))
    return out.withColumn("start", F.col("chunk") * stride).withColumn("end", F.least(F.col("chunk") * stride + size, "total"))


def range_join(points: DataFrame, ranges: DataFrame, on: list[str], point: str, width: int) -> DataFrame:
    """Points in half-open ranges [start, end), as an equi-join: a range is listed under each block of ``width`` it meets.

    So long tracks spread over tasks by block, and no nested loop is planned.
    """
    first, last = F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)
    listed = ranges.where("end > start").withColumn("block", F.explode(F.sequence(first, last)))
    keyed = points.withColumn("block", F.floor(F.col(point) / width))
    inside = (F.col(point) >= F.col("start")) & (F.col(point) < F.col("end"))
    return keyed.join(listed, [*on, "block"]).where(inside).drop("block")


def crossfade(parts: DataFrame, value: str, on: list[str], place: str) -> DataFrame:
    """Merges overlapping parts: each row's weight rises over its overlap with the part before and falls over the next."""
    up = F.when(F.col("over_left") > 0, F.least(F.lit(1.0), (F.col("from_start") + 1) / (F.col("over_left") + 1))).otherwise(1.0)
    down = F.when(F.col("over_right") > 0, F.least(F.lit(1.0), (F.col("to_end") + 1) / (F.col("over_right") + 1))).otherwise(1.0)
    weighted = parts.withColumn("_w", up * down)
    g = weighted.groupBy(*on, place).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value), F.count("*").alias("n_parts"))
    return g


def latent_frames(n: Column) -> Column:
    """1 + (n - 1) div 4 compressed frames; 0 for none."""
    return F.when(n <= 0, 0).otherwise(F.floor((n - 1) / 4) + 1)


def align_down(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((n - 1) / 4) * 4 + 1)


def align_up(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil((n - 1) / 4) * 4 + 1)


def snap(origin: Column, size: Column, grid: int) -> tuple[Column, Column]:
    """Origin floored and end ceiled to a grid."""
    low = F.floor(origin / grid) * grid
    return low, F.ceil((origin + size) / grid) * grid - low


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("track")).agg(F.count("*").alias("total"))


def _window_query(policy: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        w = windows(_totals(spark, sf_dir), 24, 8, policy)
        return w.select("track", "chunk", "start", "end", (F.col("end") - F.col("start")).alias("frames"), latent_frames(F.col("end") - F.col("start")).alias("latent"))

    n = {
        "tail": "ceil(total / 16.0)", "ceil": "greatest(1, ceil((total - 8) / 16.0))",
        "cover": "case when total <= 24 then 1 else ceil((total - 24) / 16.0) + 1 end",
    }[policy]
    sql = f"""
with c as (select user_id track, count(*) total from events group by 1), w as (select track, total, unnest(generate_series(0, ({n})::int - 1)) chunk from c),
e as (select track, chunk, chunk * 16 as start, least(chunk * 16 + 24, total) as "end" from w)
select track, chunk, start, "end", "end" - start as frames, case when "end" - start <= 0 then 0 else floor(("end" - start - 1) / 4.0) + 1 end as latent from e
"""
    return build, sql


def chunk_slice_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).select("track", "frame", "raw")
    joined = range_join(t, windows(_totals(spark, sf_dir), 24, 8), ["track"], "frame", 24)
    g = joined.groupBy("track", "chunk")
    return g.agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"), F.round(F.avg("raw") + 1e-9, 4).alias("mean"))


CHUNK_SLICE = f"""
with {TRACKS}, c as (select track, count(*) total from t group by 1), w as (select track, total, unnest(generate_series(0, (case when total <= 24 then 1 else ceil((total - 24) / 16.0) + 1 end)::int - 1)) chunk from c)
select t.track, chunk, count(*) n, min(frame) as first, max(frame) as last, round(avg(raw) + 1e-9, 4) as mean
from t join w on t.track = w.track and frame >= chunk * 16 and frame < least(chunk * 16 + 24, total) group by 1, 2
"""


def chunk_crossfade_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices each track, shifts each slice by its number, and merges the slices with weights over their overlaps."""
    t = tracks(spark, sf_dir).select("track", "frame", "raw")
    w = windows(_totals(spark, sf_dir), 24, 8)
    w = w.withColumn("last", F.max("chunk").over(Window.partitionBy("track")))
    j = range_join(t, w, ["track"], "frame", 24)
    after = (F.col("chunk") + 1) * 16
    p = j.select(
        "track", "frame", (F.col("raw") + F.col("chunk")).alias("x"),
        F.when(F.col("chunk") > 0, 8).otherwise(0).alias("over_left"),
        F.when(F.col("chunk") < F.col("last"), F.col("end") - after).otherwise(0).alias("over_right"),
        (F.col("frame") - F.col("start")).alias("from_start"), (F.col("end") - 1 - F.col("frame")).alias("to_end"),
    )
    return crossfade(p, "x", ["track"], "frame").select("track", "frame", F.round(F.col("x") + 1e-9, 4).alias("x"), "n_parts")


CHUNK_CROSSFADE = f"""
with {TRACKS}, c as (select track, count(*) total from t group by 1), n as (select track, total, (case when total <= 24 then 1 else ceil((total - 24) / 16.0) + 1 end)::int n from c),
w as (select track, total, n, unnest(generate_series(0, n - 1)) chunk from n),
p as (select t.track, frame, raw + chunk x, frame - chunk * 16 fs, least(chunk * 16 + 24, total) - 1 - frame te, case when chunk > 0 then 8 else 0 end ol,
  case when chunk < n - 1 then least(chunk * 16 + 24, total) - (chunk + 1) * 16 else 0 end o_r
  from t join w on t.track = w.track and frame >= chunk * 16 and frame < least(chunk * 16 + 24, total)),
q as (select track, frame, x, case when ol > 0 then least(1.0, (fs + 1)::double / (ol + 1)) else 1.0 end * case when o_r > 0 then least(1.0, (te + 1)::double / (o_r + 1)) else 1.0 end w from p)
select track, frame, round(sum(w * x) / sum(w) + 1e-9, 4) as x, count(*) n_parts from q group by 1, 2
"""


def window_overlap_optimizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths and overlaps of 4n + 1 frames whose boundaries lie nearest to those of a reference grid, best first."""
    grid = spark.range(17, 82, 4).select(F.col("id").alias("length")).crossJoin(spark.range(4, 33, 4).select(F.col("id").alias("overlap")))
    grid = grid.where("overlap < length / 2")
    own = grid.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(480), (F.col("length") - F.col("overlap")).cast("int"))))
    reference = F.sequence(F.lit(0), F.lit(480), F.lit(65))
    own = own.withColumn("d", F.array_min(F.transform(reference, lambda r: F.abs(r - F.col("at")))))
    g = own.groupBy("length", "overlap").agg(F.avg("d").alias("mean"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.round("mean", 6), F.desc("length"), "overlap"))
    return g.select("length", "overlap", "n", F.round("mean", 6).alias("mean"), rank.alias("rank")).where("rank <= 10")


WINDOW_OVERLAP_OPTIMIZER = """
with g as (select l as length, o as overlap from generate_series(17, 81, 4) a(l), generate_series(4, 32, 4) b(o) where o < l / 2.0),
a as (select *, unnest(generate_series(0, 480, length - overlap)) pos from g),
d as (select length, overlap, (select min(abs(r - pos)) from generate_series(0, 480, 65) x(r)) d from a),
m as (select length, overlap, count(*) n, round(avg(d), 6) mean from d group by 1, 2)
select *, row_number() over (order by mean, length desc, overlap) rank from m qualify rank <= 10
"""


def nearest_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each customer balance the nearest supplier balance."""
    left = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return nearest(left, table(spark, sf_dir, "supplier").select("s_acctbal"), "c_acctbal", "s_acctbal", "nearest")


NEAREST_LOOKUP = """
with p as (select c_custkey, c_acctbal, s_acctbal, row_number() over (partition by c_custkey order by abs(c_acctbal - s_acctbal), s_acctbal) k
  from customer, (select distinct s_acctbal from supplier))
select c_custkey, c_acctbal, s_acctbal as nearest from p where k = 1
"""


def _resampled(t: DataFrame, factor: float) -> DataFrame:
    """track, out, i, pos, a, b: the slowed track's frames, n' = (n - 1) * factor + 1 of them, between frame i (a) and the next (b).

    Each frame lists the outputs from itself on to before the next one, so nothing is joined: rows listed by track have a
    size that Spark takes for that of the tracks, and were sent through the driver to every task.
    """
    w = by_frame()
    after = F.lead("frame").over(w)
    t = t.select("track", F.col("frame").alias("i"), F.col("raw").alias("a"), F.when(after.isNull(), F.col("raw")).otherwise(F.lead("raw").over(w)).alias("b"), F.coalesce(after, "frame").alias("_to"))
    listed = F.sequence(F.floor(F.col("i") * factor).cast("bigint"), F.floor(F.col("_to") * factor).cast("bigint"))
    out = t.withColumn("out", F.explode(listed)).withColumn("pos", F.col("out") / factor)
    return out.where(F.floor("pos") == F.col("i")).drop("_to")


def resample_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third frame of each track (a retimed track brought back)."""
    return tracks(spark, sf_dir).where(F.pmod("frame", F.lit(3)) == 0).select("track", (F.col("frame") / 3).cast("long").alias("out"), "raw")


RESAMPLE_SELECT = f"with {TRACKS} select track, frame // 3 as out, raw from t where frame % 3 = 0"


def resample_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track at 2.5 times its frames, linear between neighbours."""
    p = _resampled(tracks(spark, sf_dir).where("track is not null").select("track", "frame", "raw"), 2.5)
    return p.select("track", "out", F.round(F.col("a") + (F.col("b") - F.col("a")) * (F.col("pos") - F.col("i")) + 1e-9, 4).alias("x"))


RESAMPLE_LERP = f"""
with {TRACKS}, n as (select track, max(frame) as last from t group by 1), o as (select track, last, unnest(generate_series(0, floor(last * 2.5)::bigint)) as out from n),
p as (select *, out / 2.5 pos, floor(out / 2.5)::bigint i, least(floor(out / 2.5)::bigint + 1, last) j from o)
select p.track, p.out, round(a.raw + (b.raw - a.raw) * (pos - i) + 1e-9, 4) as x from p join t a on a.track = p.track and a.frame = i join t b on b.track = p.track and b.frame = j
"""


def sample_n_of_m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight frames of each track: evenly by step, endpoints included, and middles of eight parts."""
    n, k = F.col("total"), 8
    t = _totals(spark, sf_dir).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return t.select(
        "track", F.col("i").alias("pick"), F.least(F.floor(F.col("i") * F.ceil(n / k)), n - 1).alias("by_step"),
        F.bround(F.col("i") * (n - 1) / (k - 1)).cast("long").alias("endpoints"), F.floor((F.col("i") + 0.5) * n / k).alias("middle"),
    )


SAMPLE_N_OF_M = """
with c as (select user_id track, count(*) total from events group by 1), i as (select track, total, unnest(generate_series(0, 7)) i from c)
select track, i as pick, least(i * ceil(total / 8.0), total - 1)::bigint as by_step, round_even(i * (total - 1) / 7.0, 0)::bigint as endpoints, floor((i + 0.5) * total / 8.0)::bigint as middle from i
"""


def frame_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of each track as video and compressed frames, aligned to 4n + 1 both ways, and a snapped box."""
    low, size = snap(F.pmod("track", F.lit(97)) - 50, F.col("total"), 16)
    n = F.col("total")
    return _totals(spark, sf_dir).select("track", "total", latent_frames(n).alias("latent"), align_down(n).alias("down"), align_up(n).alias("up"), low.alias("low"), size.alias("size"), ((n - 1) * 3 + 1).alias("slowed"))


FRAME_ALIGNMENT = """
with c as (select user_id track, count(*) total from events group by 1)
select track, total, floor((total - 1) / 4.0)::bigint + 1 as latent, greatest(1, floor((total - 1) / 4.0)::bigint * 4 + 1) as down, greatest(1, ceil((total - 1) / 4.0)::bigint * 4 + 1) as up,
  floor((track % 97 - 50) / 16.0)::bigint * 16 as low, ceil((track % 97 - 50 + total) / 16.0)::bigint * 16 - floor((track % 97 - 50) / 16.0)::bigint * 16 as size, (total - 1) * 3 + 1 as slowed from c
"""


def skipped_frames_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed frames (every kind but errors, value doubled) joined back; skipped ones keep the original."""
    t = tracks(spark, sf_dir)
    done = t.where("v is not null").select("track", "frame", (F.col("v") * 2).alias("new"))
    j = t.join(done, ["track", "frame"], "left")
    return j.groupBy("track").agg(F.count("new").alias("processed"), F.count_if(F.col("new").isNull()).alias("kept"), F.round(F.sum(F.coalesce("new", "raw")), 2).alias("sum"))


SKIPPED_FRAMES_MERGE = f"with {TRACKS} select track, count(v) processed, count_if(v is null) as kept, round(sum(coalesce(v * 2, raw)), 2) as sum from t group by 1"


def nearest_tracked_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each frame the nearest frame that has an observation, the earlier on a tie."""
    w = by_frame()
    at = F.when(F.col("v").isNotNull(), F.col("frame"))
    t = tracks(spark, sf_dir).withColumn("a", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("b", F.first(at, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    near = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull() | (F.col("frame") - F.col("a") <= F.col("b") - F.col("frame")), F.col("a")).otherwise(F.col("b"))
    return t.select("track", "frame", near.alias("nearest"))


NEAREST_TRACKED_FRAME = f"""
with {TRACKS}, n as (select track, frame, last_value(case when v is not null then frame end ignore nulls) over (partition by track order by frame rows between unbounded preceding and current row) a,
  first_value(case when v is not null then frame end ignore nulls) over (partition by track order by frame rows between current row and unbounded following) b from t)
select track, frame, case when a is null then b when b is null or frame - a <= b - frame then a else b end as nearest from n
"""

QUERIES = {
    "chunk_windows_tail": _window_query("tail"),
    "chunk_windows_ceil": _window_query("ceil"),
    "chunk_windows_cover": _window_query("cover"),
    "chunk_slice_range_join": (chunk_slice_range_join, CHUNK_SLICE),
    "chunk_crossfade_merge": (chunk_crossfade_merge, CHUNK_CROSSFADE),
    "window_overlap_optimizer": (window_overlap_optimizer, WINDOW_OVERLAP_OPTIMIZER),
    "nearest_lookup": (nearest_lookup, NEAREST_LOOKUP),
    "resample_select": (resample_select, RESAMPLE_SELECT),
    "resample_lerp": (resample_lerp, RESAMPLE_LERP),
    "sample_n_of_m": (sample_n_of_m, SAMPLE_N_OF_M),
    "frame_alignment": (frame_alignment, FRAME_ALIGNMENT),
    "skipped_frames_merge": (skipped_frames_merge, SKIPPED_FRAMES_MERGE),
    "nearest_tracked_frame": (nearest_tracked_frame, NEAREST_TRACKED_FRAME),
}
