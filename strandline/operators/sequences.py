"""Operators over ordered observations of a track that windows express: fills, gaps, deltas, runs, peaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from strandline.operators.solvers import linear
from strandline.plans.ordered import at_rank, at_ranks, floor_rank
from strandline.session import TRACKS, by_frame, tracks, whole

_BACK = Window.unboundedPreceding
_ON = Window.unboundedFollowing


def fill(df: DataFrame, column: str = "v", out: str = "filled") -> DataFrame:
    """Last valid value, and in a leading gap the next; null only where a whole track is."""
    w = by_frame()
    last = F.last(column, True).over(w.rowsBetween(_BACK, 0))
    return df.withColumn(out, F.coalesce(last, F.first(column, True).over(w.rowsBetween(0, _ON))))


def interpolate(df: DataFrame, column: str = "v", out: str = "filled") -> DataFrame:
    """Linear between the nearest valid neighbours; the ends repeat the outermost valid value."""
    w = by_frame()
    at = F.when(F.col(column).isNotNull(), F.col("frame"))
    back, on = w.rowsBetween(_BACK, 0), w.rowsBetween(0, _ON)
    df = df.select(
        "*", F.last(column, True).over(back).alias("_a"), F.last(at, True).over(back).alias("_i"),
        F.first(column, True).over(on).alias("_b"), F.first(at, True).over(on).alias("_j"),
    )
    between = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("frame") - F.col("_i")) / (F.col("_j") - F.col("_i"))
    value = F.when(F.col("_a").isNull(), F.col("_b")).when(F.col("_b").isNull() | (F.col("_i") == F.col("_j")), F.col("_a"))
    return df.withColumn(out, value.otherwise(between)).drop("_a", "_b", "_i", "_j")


def ema(df: DataFrame, column: str, out: str, alpha: float = 0.3, backward: bool = False, dealt: bool = False) -> DataFrame:
    """y = alpha * x + (1 - alpha) * y before; the first value stands as it is, a missing one repeats y.

    A linear recursion, scanned in batches that hand on one number; see ``solvers.linear``.
    """
    valid = F.col(column).isNotNull()
    df = df.withColumns({"_a": F.when(valid, 1 - alpha), "_b": alpha * F.col(column), "_s": F.col(column)})
    return linear(df, "_a", "_b", out, backward, "_s", dealt).drop("_a", "_b", "_s")


def weighted_window(df: DataFrame, column: str, out: str, weights: list[float]) -> DataFrame:
    """Sum of neighbours by weight, an odd number of them around each frame; the ends are repeated."""
    reach, w = len(weights) // 2, by_frame()
    first, last = F.first(column).over(whole_in_order()), F.last(column).over(whole_in_order())
    total = F.lit(0.0)
    for k, x in zip(range(-reach, reach + 1), weights, strict=True):
        there = F.lead(column, k).over(w) if k > 0 else F.lag(column, -k).over(w) if k else F.col(column)
        total = total + x * F.coalesce(there, last if k > 0 else first)
    return df.withColumn(out, total)


def whole_in_order() -> WindowSpec:
    return by_frame().rowsBetween(_BACK, _ON)


def median_window(df: DataFrame, column: str, out: str, reach: int = 2) -> DataFrame:
    """Median of a frame and its ``reach`` neighbours on either side; the ends are repeated."""
    w = by_frame()
    first, last = F.first(column).over(whole_in_order()), F.last(column).over(whole_in_order())
    near = [F.coalesce(F.lag(column, k).over(w), first) for k in range(reach, 0, -1)] + [F.col(column)]
    near += [F.coalesce(F.lead(column, k).over(w), last) for k in range(1, reach + 1)]
    return df.withColumn(out, F.element_at(F.array_sort(F.array(*near)), reach + 1))


def islands(df: DataFrame, condition: Column, out: str = "run") -> DataFrame:
    """Rows that meet a condition, with a number that consecutive frames share."""
    kept = df.where(condition)
    return kept.withColumn(out, F.col("frame") - F.row_number().over(by_frame()))


def runs(df: DataFrame, condition: Column) -> DataFrame:
    """First and last frame of each stretch of consecutive frames that meet a condition."""
    found = islands(df, condition).groupBy("track", "run")
    return found.agg(F.min("frame").alias("first"), F.max("frame").alias("last"), F.count("*").alias("n")).drop("run")


def rescue_short_gaps(df: DataFrame, longest: int = 2, least: float = 0.5, column: str = "vis", out: str = "rescued") -> DataFrame:
    """Raises stretches below ``least`` of at most ``longest`` frames to it."""
    low = F.coalesce(F.col(column) < least, F.lit(True))
    stretch = F.sum(F.when(low, 0).otherwise(1)).over(by_frame().rowsBetween(_BACK, 0))
    df = df.withColumn("_low", low).withColumn("_s", stretch)
    n = F.sum(F.col("_low").cast("int")).over(Window.partitionBy("track", "_s"))
    return df.withColumn(out, F.when(F.col("_low") & (n <= longest), F.lit(least)).otherwise(F.col(column))).drop("_low", "_s")


def reject_anomalies(df: DataFrame, threshold: float = 1.5, column: str = "v", out: str = "clean") -> DataFrame:
    """Drops values whose size or jump is off the track's upper median by more than ``threshold``, then fills.

    The score is the larger of |v - median| / median and the jump from the previous valid value over the median's root.
    Tracks with fewer than three valid values keep theirs.
    """
    w = by_frame()
    previous = F.last(column, True).over(w.rowsBetween(_BACK, -1))
    middle = at_rank(df, ["track"], column, lambda n: F.floor(n / 2))
    middle = middle.select(F.col("track").alias("_t"), F.col("value").alias("_m"), F.col("known").alias("_n"))
    df = df.join(middle, F.col("track").eqNullSafe(F.col("_t")), "left").drop("_t")
    df = df.withColumn("_jump", F.abs(F.col(column) - previous))
    score = F.greatest(
        F.abs(F.col(column) - F.col("_m")) / F.greatest("_m", F.lit(1e-6)),
        F.coalesce("_jump", F.lit(0.0)) / F.sqrt(F.greatest("_m", F.lit(1e-6))),
    )
    bad = (F.col("_n") >= 3) & (score > threshold)
    return fill(df.withColumn("_v", F.when(~F.coalesce(bad, F.lit(False)), F.col(column))), "_v", out).drop("_m", "_n", "_jump", "_v")


def moving_average(df: DataFrame, half: int = 2, column: str = "filled", out: str = "smooth") -> DataFrame:
    """Centred mean of 2 * half + 1 values, where the first and last value stand for those beyond the ends."""
    w = by_frame()
    n = F.count("*").over(whole())
    first = F.first(column).over(w.rowsBetween(_BACK, _ON))
    last = F.last(column).over(w.rowsBetween(_BACK, _ON))
    before = F.greatest(F.lit(half) - F.col("frame"), F.lit(0))
    after = F.greatest(F.col("frame") + half - (n - 1), F.lit(0))
    inside = F.sum(column).over(w.rowsBetween(-half, half))
    return df.withColumn(out, (inside + before * first + after * last) / (2 * half + 1))


def local_maxima(df: DataFrame, column: str = "filled") -> DataFrame:
    """Frames above both neighbours, with the central difference there."""
    w = by_frame()
    df = df.select("*", F.lag(column).over(w).alias("_a"), F.lead(column).over(w).alias("_b"))
    top = df.where((F.col(column) > F.col("_a")) & (F.col(column) > F.col("_b")))
    return top.withColumn("gradient", (F.col("_b") - F.col("_a")) / 2).drop("_a", "_b")


def consensus(df: DataFrame, radius: int = 2, off: float = 0.5, column: str = "v", out: str = "stable") -> DataFrame:
    """Replaces missing values, and those off the median of their neighbourhood by more than its share ``off``."""
    near = F.sort_array(F.collect_list(column).over(by_frame().rowsBetween(-radius, radius)))
    n = F.size(near)
    middle = (F.get(near, F.floor((n - 1) / 2).cast("int")) + F.get(near, F.floor(n / 2).cast("int"))) / 2
    bad = F.col(column).isNull() | (F.abs(F.col(column) - middle) > off * F.abs(middle))
    return df.withColumn(out, F.when(bad, middle).otherwise(F.col(column)))


def bucket(value: Column, limits: list[float], labels: list[str]) -> Column:
    """Label of the first limit that the value is below, else the last label; null for null."""
    out = F.when(value.isNull(), None)
    for limit, label in zip(limits, labels, strict=False):
        out = out.when(value < limit, label)
    return out.otherwise(labels[-1])


# queries


def shot_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir)
    t = t.withColumn("d", F.abs(F.col("raw") - F.lag("raw").over(by_frame())))
    g = t.groupBy("track").agg(
        F.count("*").alias("n_frames"), F.count("v").alias("n_present"), F.avg("raw").alias("mean"),
        F.stddev_pop("raw").alias("std"), F.avg("d").alias("motion"), F.max("raw").alias("peak"),
    )
    level = bucket(F.col("mean"), [100, 180], ["dark", "mid", "bright"])
    moves = bucket(F.col("motion"), [60, 120], ["static", "moderate", "fast"])
    sparse = F.when(F.col("n_present") < 0.8 * F.col("n_frames"), "sparse")
    return g.select(
        "track", "n_frames", "n_present", *[F.round(F.col(c) + 1e-9, 4).alias(c) for c in ("mean", "std", "motion", "peak")],
        F.array_join(F.array_compact(F.array(level, moves, sparse)), ",").alias("tags"),
    )


SHOT_FINGERPRINT = f"""
with {TRACKS}, d as (select *, abs(raw - lag(raw) over (partition by track order by frame)) as d from t),
g as (select track, count(*) n_frames, count(v) n_present, avg(raw) mean, stddev_pop(raw) std, avg(d) motion, max(raw) peak from d group by 1)
select track, n_frames, n_present, round(mean + 1e-9, 4) mean, round(std + 1e-9, 4) std, round(motion + 1e-9, 4) motion, round(peak + 1e-9, 4) peak,
  concat_ws(',', case when mean < 100 then 'dark' when mean < 180 then 'mid' else 'bright' end,
    case when motion is null then null when motion < 60 then 'static' when motion < 120 then 'moderate' else 'fast' end,
    case when n_present < 0.8 * n_frames then 'sparse' end) as tags
from g
"""


def threshold_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    label = bucket(F.col("o_totalprice"), [50_000, 150_000, 300_000], ["low", "mid", "high", "top"])
    g = orders.groupBy("o_orderpriority", label.alias("bucket"))
    return g.agg(F.count("*").alias("n"), F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))


THRESHOLD_BUCKETS = """
select o_orderpriority, case when o_totalprice < 50000 then 'low' when o_totalprice < 150000 then 'mid'
  when o_totalprice < 300000 then 'high' when o_totalprice is not null then 'top' end as bucket,
  count(*) as n, min(o_totalprice) as least, max(o_totalprice) as most from orders group by 1, 2
"""


def motion_delta_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = tracks(spark, sf_dir).withColumn("d", F.abs(F.col("raw") - F.lag("raw").over(by_frame())))
    r = at_ranks(d, ["track"], "d", {"p95": floor_rank(0.95), "median": floor_rank(0.5)})
    g = d.groupBy("track").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))
    g = g.join(r.select(F.col("track").alias("_t"), "p95", "median"), F.col("track").eqNullSafe(F.col("_t")), "left")
    return g.select(
        "track", F.col("n").cast("int").alias("n"), F.round(F.col("mean") + 1e-9, 4).alias("mean"), F.round(F.col("std") + 1e-9, 4).alias("std"),
        F.round("p95", 4).alias("p95"), F.round("median", 4).alias("median"),
    )


MOTION_DELTA_STATS = f"""
with {TRACKS}, d as (select *, abs(raw - lag(raw) over (partition by track order by frame)) as d from t),
g as (select track, list(d order by d) filter (where d is not null) ds, avg(d) mean, stddev_pop(d) std from d group by 1)
select track, len(ds) n, round(mean + 1e-9, 4) mean, round(std + 1e-9, 4) std,
  round(ds[least(len(ds), floor(0.95 * len(ds))::int + 1)], 4) p95, round(ds[len(ds) // 2 + 1], 4) median from g
"""


def spike_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames whose delta is above mean + 2 sigma of the track, the five largest of each."""
    d = tracks(spark, sf_dir).withColumn("d", F.abs(F.col("raw") - F.lag("raw").over(by_frame())))
    d = d.withColumn("cut", F.avg("d").over(whole()) + 2 * F.stddev_pop("d").over(whole())).where("d > cut")
    rank = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("d"), "frame"))
    return d.withColumn("rank", rank).where("rank <= 5").select("track", "rank", "frame", F.round("d", 4).alias("delta"))


SPIKE_TOP_N = f"""
with {TRACKS}, d as (select *, abs(raw - lag(raw) over (partition by track order by frame)) as d from t),
c as (select *, avg(d) over (partition by track) + 2 * stddev_pop(d) over (partition by track) cut from d),
r as (select *, row_number() over (partition by track order by d desc, frame) rank from c where d > cut)
select track, rank, frame, round(d, 4) delta from r where rank <= 5
"""


def fill_forward_backward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill(tracks(spark, sf_dir)).select("track", "frame", "v", "filled")


_FILLED = f"""
{TRACKS}, f as (select *, coalesce(last_value(v ignore nulls) over (partition by track order by frame rows between unbounded preceding and current row),
  first_value(v ignore nulls) over (partition by track order by frame rows between current row and unbounded following)) as filled from t)
"""
FILL_FORWARD_BACKWARD = f"with {_FILLED} select track, frame, v, filled from f"


def gap_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolate(tracks(spark, sf_dir)).select("track", "frame", F.round("filled", 4).alias("filled"))


GAP_INTERPOLATE = f"""
with {TRACKS}, n as (select *,
  last_value(v ignore nulls) over b as a, last_value(case when v is not null then frame end ignore nulls) over b as i,
  first_value(v ignore nulls) over o as z, first_value(case when v is not null then frame end ignore nulls) over o as j
  from t window b as (partition by track order by frame rows between unbounded preceding and current row),
    o as (partition by track order by frame rows between current row and unbounded following))
select track, frame, round(case when a is null then z when z is null or i = j then a else a + (z - a) * (frame - i) / (j - i) end, 4) as filled from n
"""


def short_gap_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tracks(spark, sf_dir).withColumn("vis", F.least(F.col("raw") / 100, F.lit(1.0)))
    return rescue_short_gaps(t).select("track", "frame", "vis", "rescued")


SHORT_GAP_RESCUE = f"""
with {TRACKS}, s as (select track, frame, least(raw / 100, 1.0) vis from t),
m as (select *, vis < 0.5 as low, sum(case when vis < 0.5 then 0 else 1 end) over (partition by track order by frame) s from s),
k as (select *, sum(low::int) over (partition by track, s) n from m)
select track, frame, vis, case when low and n <= 2 then 0.5 else vis end as rescued from k
"""


def anomaly_reject_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reject_anomalies(tracks(spark, sf_dir)).select("track", "frame", "v", "clean")


ANOMALY_REJECT_FILL = f"""
with {TRACKS}, m as (select track, list(v order by v) filter (where v is not null) vs from t group by 1),
p as (select t.*, vs[len(vs) // 2 + 1] m, coalesce(len(vs), 0) n,
  abs(v - last_value(v ignore nulls) over (partition by t.track order by frame rows between unbounded preceding and 1 preceding)) jump from t join m on t.track = m.track),
q as (select *, case when coalesce(n >= 3 and greatest(abs(v - m) / greatest(m, 1e-6), coalesce(jump, 0.0) / sqrt(greatest(m, 1e-6))) > 1.5, false) then null else v end c from p)
select track, frame, v, coalesce(last_value(c ignore nulls) over (partition by track order by frame rows between unbounded preceding and current row),
  first_value(c ignore nulls) over (partition by track order by frame rows between current row and unbounded following)) as clean from q
"""


def presence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per track the frames above a level, as a list, with first, last and count; -1, -1, 0 where there are none."""
    hit = F.when(F.col("v") > 150, F.col("frame"))
    g = tracks(spark, sf_dir).groupBy("track").agg(F.sort_array(F.collect_list(hit)).alias("f"))
    return g.select(
        "track", F.array_join("f", ",").alias("frames"), F.coalesce(F.array_min("f"), F.lit(-1)).alias("first"),
        F.coalesce(F.array_max("f"), F.lit(-1)).alias("last"), F.size("f").alias("n"),
    )


PRESENCE_FILTER = f"""
with {TRACKS}, g as (select track, list(frame order by frame) filter (where v > 150) f from t group by 1)
select track, coalesce(array_to_string(f, ','), '') frames, coalesce(list_min(f), -1) as first, coalesce(list_max(f), -1) as last, coalesce(len(f), 0) n from g
"""


def presence_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(tracks(spark, sf_dir), F.col("v") > 150)


PRESENCE_RANGES = f"""
with {TRACKS}, i as (select *, frame - row_number() over (partition by track order by frame) run from t where v > 150)
select track, min(frame) as first, max(frame) as last, count(*) n from i group by track, run
"""


def visibility_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = tracks(spark, sf_dir).groupBy("track").agg((100.0 * F.count("v") / F.count("*")).alias("pct"))
    return g.select(
        "track", F.round("pct", 4).alias("pct"), bucket(F.col("pct"), [30, 60, 90], ["DROP", "MARGINAL", "OK", "STRONG"]).alias("verdict")
    )


VISIBILITY_VERDICTS = f"""
with {TRACKS}, g as (select track, 100.0 * count(v) / count(*) pct from t group by 1)
select track, round(pct, 4) pct, case when pct < 30 then 'DROP' when pct < 60 then 'MARGINAL' when pct < 90 then 'OK' else 'STRONG' end verdict from g
"""


def no_fit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of missing observations and the longest one of each track."""
    found = runs(tracks(spark, sf_dir), F.col("v").isNull())
    return found.withColumn("is_longest", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("n"), "first")) == 1)


NO_FIT_RUNS = f"""
with {TRACKS}, i as (select *, frame - row_number() over (partition by track order by frame) run from t where v is null),
r as (select track, min(frame) as first, max(frame) as last, count(*) n from i group by track, run)
select *, row_number() over (partition by track order by n desc, first) = 1 as is_longest from r
"""


def best_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame to start a track from: the earliest of its largest valid values."""
    g = tracks(spark, sf_dir).where("v is not null").groupBy("track")
    return g.agg(F.max_by("frame", F.struct("v", -F.col("frame"))).alias("seed"), F.max("v").alias("value"))


BEST_SEED = f"""
with {TRACKS}, r as (select *, row_number() over (partition by track order by v desc, frame) k from t where v is not null)
select track, frame as seed, v as value from r where k = 1
"""


def moving_average_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moving_average(fill(tracks(spark, sf_dir))).select("track", "frame", F.round("smooth", 4).alias("smooth"))


MOVING_AVERAGE_EDGE = f"""
with {_FILLED}, n as (select *, count(*) over (partition by track) n, sum(filled) over (partition by track order by frame rows between 2 preceding and 2 following) s,
  first_value(filled) over w as a, last_value(filled) over w as z from f window w as (partition by track order by frame rows between unbounded preceding and unbounded following))
select track, frame, round((s + greatest(2 - frame, 0) * a + greatest(frame + 2 - (n - 1), 0) * z) / 5, 4) as smooth from n
"""


def local_maxima_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = local_maxima(fill(tracks(spark, sf_dir)))
    return found.select("track", "frame", F.col("filled").alias("value"), F.round("gradient", 4).alias("gradient"))


LOCAL_MAXIMA = f"""
with {_FILLED}, n as (select *, lag(filled) over w as a, lead(filled) over w as b from f window w as (partition by track order by frame))
select track, frame, filled as value, round((b - a) / 2, 4) as gradient from n where filled > a and filled > b
"""


def consensus_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return consensus(tracks(spark, sf_dir)).select("track", "frame", F.round("stable", 4).alias("stable"))


CONSENSUS_MEDIAN = f"""
with {TRACKS}, m as (select *, median(v) over (partition by track order by frame rows between 2 preceding and 2 following) m from t)
select track, frame, round(case when v is null or abs(v - m) > 0.5 * abs(m) then m else v end, 4) as stable from m
"""


def path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arc length, net displacement and their ratio."""
    t = tracks(spark, sf_dir).withColumn("d", F.abs(F.col("raw") - F.lag("raw").over(by_frame())))
    g = t.groupBy("track").agg(
        F.sum("d").alias("arc"), F.abs(F.max_by("raw", "frame") - F.min_by("raw", "frame")).alias("net")
    )
    return g.select("track", F.round("arc", 3).alias("arc"), F.round("net", 3).alias("net"), F.round(F.col("arc") / F.greatest("net", F.lit(1e-6)), 2).alias("ratio"))


PATH_LENGTHS = f"""
with {TRACKS}, d as (select *, abs(raw - lag(raw) over (partition by track order by frame)) d from t),
g as (select track, sum(d) arc, abs(max_by(raw, frame) - min_by(raw, frame)) net from d group by 1)
select track, round(arc, 3) arc, round(net, 3) net, round(arc / greatest(net, 1e-6), 2) ratio from g
"""


def stage_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds since the previous checkpoint of the same user and their sum so far."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    e = e.withColumn("gap", F.coalesce(micros - F.lag(micros).over(w), F.lit(0)))
    return e.select("event_id", "user_id", "event_type", F.col("gap").alias("micros"), F.sum("gap").over(w).alias("total"))


STAGE_TIMING = """
with g as (select *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id), 0) gap from events)
select event_id, user_id, event_type, gap as micros, sum(gap) over (partition by user_id order by ts, event_id)::bigint as total from g
"""


def trimmed_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of values up to the 90th percentile (linear)."""
    t = tracks(spark, sf_dir)
    q = t.groupBy("track").agg(F.percentile("raw", F.lit(0.9)).alias("q"))
    g = t.join(q, "track").where("raw <= q").groupBy("track")
    return g.agg(F.round(F.avg("raw"), 4).alias("trimmed"), F.count("*").alias("n"))


TRIMMED_MEAN = f"""
with {TRACKS}, q as (select track, quantile_cont(raw, 0.9) q from t group by 1)
select t.track, round(avg(raw), 4) trimmed, count(*) n from t join q on t.track = q.track where raw <= q group by 1
"""


def weighted_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence-weighted value at each track's middle frame: weight vis^2 * exp(-|distance| / 30)."""
    t = tracks(spark, sf_dir).withColumn("vis", F.least(F.col("raw") / 200, F.lit(1.0)))
    middle = F.floor(F.max("frame").over(whole()) / 2)
    near = F.exp(-F.abs(F.col("frame") - middle) / 30)
    t = t.withColumn("w", F.col("vis") * F.col("vis") * near).withColumn("tw", near)
    g = t.groupBy("track").agg((F.sum(F.col("w") * F.col("raw")) / F.sum("w")).alias("x"), F.sqrt(F.sum("w") / F.sum("tw")).alias("c"))
    return g.select("track", F.round("x", 4).alias("fused"), F.round("c", 4).alias("confidence"))


WEIGHTED_FUSION = f"""
with {TRACKS}, m as (select *, least(raw / 200, 1.0) vis, floor(max(frame) over (partition by track) / 2.0) mid from t),
w as (select track, raw, vis * vis * exp(-abs(frame - mid) / 30.0) w, exp(-abs(frame - mid) / 30.0) tw from m)
select track, round(sum(w * raw) / sum(w), 4) fused, round(sqrt(sum(w) / sum(tw)), 4) confidence from w group by 1
"""


def similarity_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale, rotation and residual of the best planar similarity from (frame, raw) to (frame, v filled), in closed form."""
    t = fill(tracks(spark, sf_dir))
    t = t.select("track", (F.col("frame") * 1.0).alias("px"), F.col("raw").alias("py"), (F.col("frame") * 1.0).alias("qx"), F.col("filled").alias("qy")).where("qy is not null")
    for c in ("px", "py", "qx", "qy"):
        t = t.withColumn(f"{c}_", F.col(c) - F.avg(c).over(whole()))
    g = t.groupBy("track").agg(
        F.sum(F.col("px_") * F.col("qx_") + F.col("py_") * F.col("qy_")).alias("a"),
        F.sum(F.col("px_") * F.col("qy_") - F.col("py_") * F.col("qx_")).alias("b"),
        F.sum(F.col("px_") * F.col("px_") + F.col("py_") * F.col("py_")).alias("s"),
        F.sum(F.col("qx_") * F.col("qx_") + F.col("qy_") * F.col("qy_")).alias("q"), F.count("*").alias("n"),
    )
    # what the best similarity leaves: |q|^2 - (a^2 + b^2) / |p|^2, as a root mean square
    left = F.sqrt(F.greatest(F.lit(0.0), F.col("q") - (F.col("a") * F.col("a") + F.col("b") * F.col("b")) / F.col("s")) / F.col("n"))
    return g.select(
        "track", F.round(F.hypot("a", "b") / F.col("s"), 5).alias("scale"), F.round(F.degrees(F.atan2("b", "a")), 4).alias("degrees"),
        F.round(left, 3).alias("residual"),
    )


SIMILARITY_FIT = f"""
with {_FILLED}, p as (select track, frame * 1.0 px, raw py, frame * 1.0 qx, filled qy from f where filled is not null),
c as (select track, px - avg(px) over w px, py - avg(py) over w py, qx - avg(qx) over w qx, qy - avg(qy) over w qy from p window w as (partition by track)),
g as (select track, sum(px * qx + py * qy) a, sum(px * qy - py * qx) b, sum(px * px + py * py) s, sum(qx * qx + qy * qy) q, count(*) n from c group by 1)
select track, round(sqrt(a * a + b * b) / s, 5) scale, round(degrees(atan2(b, a)), 4) as degrees, round(sqrt(greatest(0, q - (a * a + b * b) / s) / n), 3) as residual from g
"""


def contiguous_segments_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of one event kind: length, mean and share of the track."""
    t = tracks(spark, sf_dir)
    new = F.sum(F.when(F.col("kind") == F.lag("kind").over(by_frame()), 0).otherwise(1)).over(by_frame())
    t = t.withColumn("segment", new).withColumn("total", F.count("*").over(whole()))
    g = t.groupBy("track", "segment", "kind").agg(F.min("frame").alias("first"), F.count("*").alias("n"), F.avg("raw").alias("mean"), F.max("total").alias("total"))
    return g.select("track", "segment", "kind", "first", "n", F.round("mean", 4).alias("mean"), F.round(F.col("n") / F.col("total"), 4).alias("share"))


CONTIGUOUS_SEGMENTS_STATS = f"""
with {TRACKS}, l as (select *, case when kind = lag(kind) over (partition by track order by frame) then 0 else 1 end as is_new, count(*) over (partition by track) total from t),
s as (select *, sum(is_new) over (partition by track order by frame) segment from l)
select track, segment::bigint segment, kind, min(frame) as first, count(*) n, round(avg(raw), 4) mean, round(count(*) / max(total), 4) share from s group by track, segment, kind
"""

QUERIES = {
    "shot_fingerprint": (shot_fingerprint, SHOT_FINGERPRINT),
    "threshold_buckets": (threshold_buckets, THRESHOLD_BUCKETS),
    "motion_delta_stats": (motion_delta_stats, MOTION_DELTA_STATS),
    "spike_top_n": (spike_top_n, SPIKE_TOP_N),
    "fill_forward_backward": (fill_forward_backward, FILL_FORWARD_BACKWARD),
    "gap_interpolate": (gap_interpolate, GAP_INTERPOLATE),
    "short_gap_rescue": (short_gap_rescue, SHORT_GAP_RESCUE),
    "anomaly_reject_fill": (anomaly_reject_fill, ANOMALY_REJECT_FILL),
    "presence_filter": (presence_filter, PRESENCE_FILTER),
    "presence_ranges": (presence_ranges, PRESENCE_RANGES),
    "visibility_verdicts": (visibility_verdicts, VISIBILITY_VERDICTS),
    "no_fit_runs": (no_fit_runs, NO_FIT_RUNS),
    "best_seed": (best_seed, BEST_SEED),
    "moving_average_edge": (moving_average_edge, MOVING_AVERAGE_EDGE),
    "local_maxima": (local_maxima_query, LOCAL_MAXIMA),
    "consensus_median": (consensus_median, CONSENSUS_MEDIAN),
    "path_lengths": (path_lengths, PATH_LENGTHS),
    "stage_timing": (stage_timing, STAGE_TIMING),
    "trimmed_mean": (trimmed_mean, TRIMMED_MEAN),
    "weighted_fusion": (weighted_fusion, WEIGHTED_FUSION),
    "similarity_fit": (similarity_fit, SIMILARITY_FIT),
    "contiguous_segments_stats": (contiguous_segments_stats, CONTIGUOUS_SEGMENTS_STATS),
}
