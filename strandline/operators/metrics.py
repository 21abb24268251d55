"""Pairwise quality metrics, zone statistics, set overlap and pass/fail gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators.sequences import bucket
from strandline.plans.ordered import at_rank, at_ranks, nearest_rank, previous
from strandline.session import table


def total(values: Column) -> Column:
    """Sum of an array in its order."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def mse(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)


def psnr(error: Column) -> Column:
    """10 log10(1 / mse); 100 for equal signals."""
    return F.when(error < 1e-10, 100.0).otherwise(10 * F.log10(1 / error))


def ssim_global(a: Column, b: Column, c1: float = 0.01**2, c2: float = 0.03**2) -> Column:
    """Structural similarity from the moments of whole signals (population variances)."""
    n = F.size(a)
    ma, mb = total(a) / n, total(b) / n
    va = total(F.transform(a, lambda x: x * x)) / n - ma * ma
    vb = total(F.transform(b, lambda x: x * x)) / n - mb * mb
    cov = total(F.zip_with(a, b, lambda x, y: x * y)) / n - ma * mb
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def iou(common: Column, union: Column) -> Column:
    """1 where both sets are empty."""
    return F.when(union == 0, 1.0).otherwise(common / union)


def dice(common: Column, a: Column, b: Column) -> Column:
    return F.when(a + b == 0, 1.0).otherwise(2 * common / (a + b))


def luma_601(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def luma_709(r: Column, g: Column, b: Column) -> Column:
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as frames of one clip a label: label, vec_id, px in [0, 1]."""
    e = table(spark, sf_dir, "embeddings")
    return e.select("label", "vec_id", F.transform("embedding", lambda x: (x.cast("double") + 1) / 2).alias("px"))


_FRAMES = "fr as (select label, vec_id, list_transform(embedding, lambda x: (x::double + 1) / 2) px from embeddings)"
_PAIRS = f"""{_FRAMES}, pr as (select *, lag(px) over (partition by label order by vec_id) prev, lag(vec_id) over (partition by label order by vec_id) prev_id from fr),
mx as (select label, vec_id, prev_id, px, prev,
  list_sum(list_transform(list_zip(prev, px), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(px) as err from pr where prev is not null)"""


def consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame with the one before it of its label: prev, prev_id, err."""
    f = previous(frames(spark, sf_dir), "label", "vec_id", ["px"])
    f = f.select("label", "vec_id", "px", F.col("_before.px").alias("prev"), F.col("_before.vec_id").alias("prev_id"))
    return f.where("prev is not null").withColumn("err", mse(F.col("prev"), F.col("px")))


def psnr_ssim_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = consecutive(spark, sf_dir)
    return p.select(
        "label", "prev_id", "vec_id", F.round(psnr(F.col("err")), 4).alias("psnr"),
        F.round(ssim_global(F.col("prev"), F.col("px")), 4).alias("ssim"),
    )


PSNR_SSIM_PAIRS = f"""
with {_PAIRS}, m as (select *, list_sum(prev) / len(px) ma, list_sum(px) / len(px) mb from mx),
v as (select *, list_sum(list_transform(prev, lambda x: x * x)) / len(px) - ma * ma va, list_sum(list_transform(px, lambda x: x * x)) / len(px) - mb * mb vb,
  list_sum(list_transform(list_zip(prev, px), lambda z: z[1] * z[2])) / len(px) - ma * mb cov from m)
select label, prev_id, vec_id, round(case when err < 1e-10 then 100.0 else 10 * log10(1 / err) end, 4) as psnr,
  round(((2 * ma * mb + 1e-4) * (2 * cov + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (va + vb + 9e-4)), 4) as ssim from v
"""


def seam_pair_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute difference of consecutive frames over the whole table; a seam is where the label changes."""
    f = frames(spark, sf_dir).withColumn("block", F.floor(F.col("vec_id") / 1000)).withColumn("own", F.lit(True))
    # the last frame of each block also stands before the first one of the next block that has any
    ends = f.where("block is not null").groupBy("block").agg(F.max_by(F.struct("label", "vec_id", "px"), "vec_id").alias("end"))
    follows = f.where("block is not null").groupBy("block").agg(F.lit(1)).select("block")
    follows = follows.withColumn("next", F.lead("block").over(Window.orderBy("block"))).where("next is not null")  # numbers only, without pixels
    ends = ends.join(follows, "block").drop("block").withColumnRenamed("next", "block")
    f = f.unionByName(ends.select("end.*", "block", F.lit(False).alias("own")))
    w = Window.partitionBy("block").orderBy("vec_id")
    f = f.withColumn("prev", F.lag("px").over(w)).withColumn("before", F.lag("label").over(w)).where("own")
    d = total(F.zip_with("prev", "px", lambda x, y: F.abs(x - y))) / F.size("px")
    return f.where("prev is not null").select("vec_id", (F.col("label") != F.col("before")).alias("is_seam"), F.round(d, 5).alias("delta"))


SEAM_PAIR_METRICS = f"""
with {_FRAMES}, p as (select *, lag(px) over w prev, lag(label) over w before from fr window w as (order by vec_id))
select vec_id, label <> before as is_seam, round(list_sum(list_transform(list_zip(prev, px), lambda z: abs(z[1] - z[2]))) / len(px), 5) as delta from p where prev is not null
"""


def seam_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = seam_pair_metrics(spark, sf_dir)
    return p.agg(
        F.count_if("is_seam").alias("seams"), F.round(F.avg(F.when(F.col("is_seam"), F.col("delta"))), 5).alias("seam_delta"),
        F.round(F.avg(F.when(~F.col("is_seam"), F.col("delta"))), 5).alias("other_delta"), F.max("delta").alias("worst"),
    )


SEAM_SUMMARY = f"""
with s as ({SEAM_PAIR_METRICS})
select count_if(is_seam) as seams, round(avg(delta) filter (where is_seam), 5) as seam_delta, round(avg(delta) filter (where not is_seam), 5) as other_delta, max(delta) as worst from s
"""


def zone_diff_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones by return flag, channels by line status: mean over channels, the channels' largest 95th percentile."""
    x = F.abs(F.col("l_extendedprice") - 1000 * F.col("l_quantity"))
    zone = ["l_returnflag", "l_linestatus"]
    rows = table(spark, sf_dir, "lineitem").select(*zone, x.alias("x"))
    p95 = at_rank(rows, zone, "x", nearest_rank(0.95)).select(*zone, F.lit(None).alias("m"), F.lit(None).alias("n"), F.col("value").alias("p"))
    g = rows.groupBy(*zone).agg(F.avg("x").alias("m"), F.count("*").alias("n")).withColumn("p", F.lit(None))
    g = g.unionByName(p95).groupBy("l_returnflag")
    return g.agg(F.round(F.avg("m"), 2).alias("mean"), F.round(F.max("p"), 2).alias("p95"), F.sum("n").alias("n"))


ZONE_DIFF_STATS = """
with x as (select l_returnflag, l_linestatus, abs(l_extendedprice - 1000 * l_quantity) x from lineitem),
g as (select l_returnflag, l_linestatus, avg(x) m, count(*) n, list(x order by x) xs from x group by 1, 2)
select l_returnflag, round(avg(m), 2) as mean, round(max(xs[round_even(0.95 * (len(xs) - 1), 0)::bigint + 1]), 2) as p95, sum(n)::bigint n from g group by 1
"""


def zone_stats_scalable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rank of each zone and channel, however many values a zone has."""
    x = F.abs(F.col("l_extendedprice") - 1000 * F.col("l_quantity"))
    zone = ["l_returnflag", "l_linestatus"]
    found = at_rank(table(spark, sf_dir, "lineitem").select(*zone, x.alias("x")), zone, "x", nearest_rank(0.95))
    return found.select(*zone, F.col("value").alias("p95"), F.col("known").alias("n"))


ZONE_STATS_SCALABLE = """
with x as (select l_returnflag, l_linestatus, abs(l_extendedprice - 1000 * l_quantity) x from lineitem),
g as (select l_returnflag, l_linestatus, list(x order by x) xs from x group by 1, 2)
select l_returnflag, l_linestatus, xs[round_even(0.95 * (len(xs) - 1), 0)::bigint + 1] as p95, len(xs) as n from g
"""


def zone_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each zone and channel: the absolute differences' mean, lower median, largest and four percentiles; the signed ones' mean and sample deviation."""
    zone = ["l_returnflag", "l_linestatus"]
    signed = F.col("l_extendedprice") - 1000 * F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").select(*zone, signed.alias("signed"), F.abs(signed).alias("x"))
    ranks = {f"p{p}": nearest_rank(p / 100) for p in (50, 90, 95, 99)} | {"median_abs": lambda n: F.floor((n - 1) / 2)}
    sums = rows.groupBy(*zone).agg(
        F.count("x").alias("n"), F.round(F.avg("x"), 2).alias("mean_abs"), F.max("x").alias("max_abs"), F.round(F.avg("signed"), 2).alias("mean_signed"),
        F.round(F.stddev_samp("signed"), 2).alias("std_signed"),
    )
    return sums.join(at_ranks(rows, zone, "x", ranks).drop("known"), zone)


ZONE_DIFF_REPORT = """
with x as (select l_returnflag, l_linestatus, l_extendedprice - 1000 * l_quantity as d from lineitem),
g as (select l_returnflag, l_linestatus, count(*) n, round(avg(abs(d)), 2) as mean_abs, max(abs(d)) as max_abs, round(avg(d), 2) as mean_signed, round(stddev_samp(d), 2) as std_signed,
  list(abs(d) order by abs(d)) xs from x group by 1, 2)
select l_returnflag, l_linestatus, n, mean_abs, max_abs, mean_signed, std_signed, xs[(n - 1) // 2 + 1] as median_abs, xs[round_even(0.5 * (n - 1), 0)::bigint + 1] as p50,
  xs[round_even(0.9 * (n - 1), 0)::bigint + 1] as p90, xs[round_even(0.95 * (n - 1), 0)::bigint + 1] as p95, xs[round_even(0.99 * (n - 1), 0)::bigint + 1] as p99 from g
"""


def set_iou_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: parts returned (flag A or R) against parts on finished lines (status F)."""
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(
        F.max(F.col("l_returnflag").isin("A", "R").cast("int")).alias("a"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("b")
    )
    g = own.groupBy("l_orderkey").agg(
        F.sum("a").alias("n_a"), F.sum("b").alias("n_b"), F.sum(F.col("a") * F.col("b")).alias("both"), F.sum(F.greatest("a", "b")).alias("any")
    )
    return g.select(
        "l_orderkey", "n_a", "n_b", F.round(iou(F.col("both"), F.col("any")), 6).alias("iou"),
        F.round(dice(F.col("both"), F.col("n_a"), F.col("n_b")), 6).alias("dice"),
    )


SET_IOU_DICE = """
with o as (select l_orderkey, l_partkey, max((l_returnflag in ('A', 'R'))::int) a, max((l_linestatus = 'F')::int) b from lineitem group by 1, 2),
g as (select l_orderkey, sum(a)::bigint n_a, sum(b)::bigint n_b, sum(a * b)::bigint both_, sum(greatest(a, b))::bigint any_ from o group by 1)
select l_orderkey, n_a, n_b, round(case when any_ = 0 then 1.0 else both_::double / any_ end, 6) as iou,
  round(case when n_a + n_b = 0 then 1.0 else 2.0::double * both_ / (n_a + n_b) end, 6) as dice from g
"""


def set_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per thousand orders the worst overlap and the first order that has it."""
    s = set_iou_dice(spark, sf_dir).withColumn("block", F.floor(F.col("l_orderkey") / 1000))
    return s.groupBy("block").agg(
        F.round(F.avg("iou"), 4).alias("mean_iou"), F.min(F.struct("iou", "l_orderkey")).alias("w")
    ).select("block", "mean_iou", F.col("w.iou").alias("worst_iou"), F.col("w.l_orderkey").alias("worst_order"))


SET_WORST = f"""
with s as ({SET_IOU_DICE}), r as (select *, l_orderkey // 1000 as block, row_number() over (partition by l_orderkey // 1000 order by iou, l_orderkey) k from s)
select block, round(avg(iou), 4) as mean_iou, min(iou) as worst_iou, min(l_orderkey) filter (where k = 1) as worst_order from r group by 1
"""


def mask_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of consecutive masks, as maximum and as probability that either holds."""
    p = consecutive(spark, sf_dir)
    return p.select(
        "label", "vec_id", F.round(total(F.zip_with("prev", "px", lambda a, b: F.greatest(a, b))), 4).alias("by_max"),
        F.round(total(F.zip_with("prev", "px", lambda a, b: 1 - (1 - a) * (1 - b))), 4).alias("by_probability"),
    )


MASK_UNION = f"""
with {_PAIRS} select label, vec_id, round(list_sum(list_transform(list_zip(prev, px), lambda z: greatest(z[1], z[2]))), 4) as by_max,
  round(list_sum(list_transform(list_zip(prev, px), lambda z: 1 - (1 - z[1]) * (1 - z[2]))), 4) as by_probability from mx
"""


def mask_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of consecutive frames above one half: in both, in one only, in either."""
    p = consecutive(spark, sf_dir)

    def count(f) -> Column:
        return F.size(F.filter(F.zip_with("prev", "px", f), lambda x: x))

    return p.select(
        "label", "vec_id", count(lambda a, b: (a > 0.5) & (b > 0.5)).alias("both"), count(lambda a, b: (a > 0.5) & (b <= 0.5)).alias("gone"),
        count(lambda a, b: (a <= 0.5) & (b > 0.5)).alias("new"), count(lambda a, b: (a > 0.5) | (b > 0.5)).alias("either"),
    )


MASK_SET_OPERATIONS = f"""
with {_PAIRS}, z as (select label, vec_id, list_zip(prev, px) z from mx)
select label, vec_id, len(list_filter(z, lambda p: p[1] > 0.5 and p[2] > 0.5)) as both, len(list_filter(z, lambda p: p[1] > 0.5 and p[2] <= 0.5)) as gone,
  len(list_filter(z, lambda p: p[1] <= 0.5 and p[2] > 0.5)) as new, len(list_filter(z, lambda p: p[1] > 0.5 or p[2] > 0.5)) as either from z
"""


def alignment_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: criteria over consecutive frames and whether all hard ones hold."""
    g = consecutive(spark, sf_dir).groupBy("label").agg(F.avg("err").alias("err"), F.max("err").alias("worst"), F.count("*").alias("n"))
    quality = bucket(F.col("err"), [0.0075, 0.008], ["PASS", "WARN", "FAIL"])
    tail = F.when(F.col("n") < 5, "N/A").otherwise(bucket(F.col("worst"), [0.0115], ["PASS", "FAIL"]))
    g = g.select("label", F.round("err", 6).alias("err"), F.round("worst", 6).alias("worst"), quality.alias("quality"), tail.alias("tail"))
    return g.withColumn("passed", (F.col("quality") != "FAIL") & F.col("tail").isin("PASS", "N/A"))


ALIGNMENT_GATES = f"""
with {_PAIRS}, g as (select label, avg(err) e, max(err) w, count(*) n from mx group by 1),
k as (select label, round(e, 6) err, round(w, 6) worst, case when e < 0.0075 then 'PASS' when e < 0.008 then 'WARN' else 'FAIL' end quality,
  case when n < 5 then 'N/A' when w < 0.0115 then 'PASS' else 'FAIL' end tail from g)
select *, quality <> 'FAIL' and tail in ('PASS', 'N/A') as passed from k
"""


def color_shift_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by part size: mean of the overlap (first lines) against the mean of the chunk before's new lines."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    over = F.col("l_linenumber") <= 2
    g = l.groupBy("p_size").agg(F.avg(F.when(over, F.col("l_discount"))).alias("o"), F.avg(F.when(~over, F.col("l_discount"))).alias("m"))
    d = F.col("o") - F.lag("m").over(Window.orderBy("p_size"))
    return g.select(F.col("p_size").alias("chunk"), F.round("o", 6).alias("overlap"), F.round("m", 6).alias("rest"), F.round(d, 6).alias("shift"), (F.abs(d) > 0.002).alias("alert"))


COLOR_SHIFT_BOUNDARY = """
with g as (select p_size, avg(l_discount) filter (where l_linenumber <= 2) o, avg(l_discount) filter (where l_linenumber > 2) m from lineitem join part on l_partkey = p_partkey group by 1),
d as (select *, o - lag(m) over (order by p_size) d from g)
select p_size as chunk, round(o, 6) as overlap, round(m, 6) as rest, round(d, 6) as shift, abs(d) > 0.002 as alert from d
"""


def blend_luma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both luma weightings of each frame's first three channels, and a screen composite with the frame before."""
    p = consecutive(spark, sf_dir)
    rgb = [F.get("px", F.lit(k)) for k in range(3)]
    screen = F.zip_with("prev", "px", lambda a, b: 1 - (1 - a) * (1 - b * 0.6))
    return p.select("label", "vec_id", F.round(luma_601(*rgb), 5).alias("luma_601"), F.round(luma_709(*rgb), 5).alias("luma_709"), F.round(total(screen), 4).alias("screen"))


BLEND_LUMA = f"""
with {_PAIRS} select label, vec_id, round(0.299 * px[1] + 0.587 * px[2] + 0.114 * px[3], 5) as luma_601,
  round(0.2126 * px[1] + 0.7152 * px[2] + 0.0722 * px[3], 5) as luma_709,
  round(list_sum(list_transform(list_zip(prev, px), lambda z: 1 - (1 - z[1]) * (1 - z[2] * 0.6))), 4) as screen from mx
"""


def point_pair_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors matched by place in two lists (customers and suppliers of a nation): distance, and which lack a partner."""
    def numbered(name: str, key: str, nation: str, value: str, out: str) -> DataFrame:
        w = Window.partitionBy(nation).orderBy(key)
        return table(spark, sf_dir, name).select(F.col(nation).alias("nation"), F.row_number().over(w).alias("place"), F.col(value).alias(out))

    a, b = numbered("customer", "c_custkey", "c_nationkey", "c_acctbal", "x"), numbered("supplier", "s_suppkey", "s_nationkey", "s_acctbal", "y")
    j = a.join(b, ["nation", "place"], "full")
    return j.groupBy("nation").agg(
        F.count(F.col("x") + F.col("y")).alias("matched"), F.count_if(F.col("x").isNull() | F.col("y").isNull()).alias("unmatched"),
        F.round(F.avg(F.abs(F.col("x") - F.col("y"))), 3).alias("mean_error"), F.round(F.max(F.abs(F.col("x") - F.col("y"))), 3).alias("worst"),
    )


POINT_PAIR_ERRORS = """
with a as (select c_nationkey nation, row_number() over (partition by c_nationkey order by c_custkey) place, c_acctbal x from customer),
b as (select s_nationkey nation, row_number() over (partition by s_nationkey order by s_suppkey) place, s_acctbal y from supplier)
select nation, count(x + y) as matched, count_if(x is null or y is null) as unmatched, round(avg(abs(x - y)), 3) as mean_error, round(max(abs(x - y)), 3) as worst
from a full join b using (nation, place) group by 1
"""

QUERIES = {
    "psnr_ssim_pairs": (psnr_ssim_pairs, PSNR_SSIM_PAIRS),
    "seam_pair_metrics": (seam_pair_metrics, SEAM_PAIR_METRICS),
    "seam_summary": (seam_summary, SEAM_SUMMARY),
    "zone_diff_stats": (zone_diff_stats, ZONE_DIFF_STATS),
    "zone_diff_report": (zone_diff_report, ZONE_DIFF_REPORT),
    "zone_stats_scalable": (zone_stats_scalable, ZONE_STATS_SCALABLE),
    "set_iou_dice": (set_iou_dice, SET_IOU_DICE),
    "set_worst": (set_worst, SET_WORST),
    "mask_union": (mask_union, MASK_UNION),
    "mask_set_operations": (mask_set_operations, MASK_SET_OPERATIONS),
    "alignment_gates": (alignment_gates, ALIGNMENT_GATES),
    "color_shift_boundary": (color_shift_boundary, COLOR_SHIFT_BOUNDARY),
    "blend_luma": (blend_luma, BLEND_LUMA),
    "point_pair_errors": (point_pair_errors, POINT_PAIR_ERRORS),
}
