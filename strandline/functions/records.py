"""Boxes, schedules, frame specifications, plans as JSON, percentiles by each definition, and set operations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.plans.ordered import at_ranks, floor_rank, linear, nearest_rank
from strandline.session import TRACKS, by_frame, table, tracks


def shifted_sigma(sigma: Column, shift: Column) -> Column:
    return shift * sigma / (1 + (shift - 1) * sigma)


def blend_weight(position: Column, length: Column, kind: str) -> Column:
    """Weight of a place in an overlap of ``length``, rising from 0 to 1: linear, hann or hamming."""
    x = F.when(length <= 1, 1.0).otherwise(position / (length - 1))
    if kind == "linear":
        return x
    a = {"hann": 0.5, "hamming": 0.54}[kind]
    return a - (1 - a) * F.cos(F.lit(math.pi) * x)


def frames_of(spec: Column, total: Column) -> Column:
    """Sorted distinct frames of "0, 5-7, 10-20:5, -1": numbers (negative ones from the end), ranges, and steps.

    Frames are cut to [0, total); parts that are none of these are dropped.
    """
    parts = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p.rlike(r"^(-?\d+|\d+-\d+(:\d+)?)$"))

    def expand(p: Column) -> Column:
        one = p.try_cast("int")
        a, b = F.regexp_extract(p, r"^(\d+)-", 1).try_cast("int"), F.regexp_extract(p, r"^\d+-(\d+)", 1).try_cast("int")
        step = F.greatest(F.coalesce(F.regexp_extract(p, r":(\d+)$", 1).try_cast("int"), F.lit(1)), F.lit(1))
        return F.when(one.isNotNull(), F.array(F.when(one < 0, one + total).otherwise(one))).when(a <= b, F.sequence(a, b, step)).otherwise(F.array().cast("array<int>"))

    frames = F.flatten(F.transform(parts, expand))
    last = (total - 1).cast("int")
    return F.sort_array(F.array_distinct(F.transform(frames, lambda f: F.greatest(F.lit(0), F.least(f, last)))))


def first_class(text: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """Label of the first rule whose words the lower-cased text holds."""
    out = F.when(F.lit(False), None)
    for pattern, label in rules:
        out = out.when(F.lower(text).rlike(pattern), label)
    return out.otherwise(other)


# queries


def bbox_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box around an order's lines as boxes, padded by a tenth, snapped to eights and kept within 0 to 128."""
    l = table(spark, sf_dir, "lineitem")
    x1, y1 = F.col("l_quantity"), F.floor(F.col("l_discount") * 100 + 0.5)
    g = l.groupBy("l_orderkey").agg(
        F.min(x1).alias("x1"), F.min(y1).alias("y1"), F.max(x1 + F.col("l_linenumber") * 2).alias("x2"), F.max(y1 + F.floor(F.col("l_tax") * 100 + 0.5)).alias("y2")
    )

    def low(c: str, size: Column) -> Column:
        return F.greatest(F.lit(0), (F.floor((F.col(c) - size / 10) / 8) * 8).cast("long"))

    def high(c: str, size: Column) -> Column:
        return F.least(F.lit(128), (F.ceil((F.col(c) + size / 10) / 8) * 8).cast("long"))

    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return g.select("l_orderkey", low("x1", w).alias("left"), low("y1", h).alias("top"), high("x2", w).alias("right"), high("y2", h).alias("bottom"))


BBOX_UNION = """
with g as (select l_orderkey, min(l_quantity) x1, min(floor(l_discount * 100 + 0.5)) y1, max(l_quantity + l_linenumber * 2) x2, max(floor(l_discount * 100 + 0.5) + floor(l_tax * 100 + 0.5)) y2 from lineitem group by 1)
select l_orderkey, greatest(0, (floor((x1 - (x2 - x1) / 10) / 8) * 8)::bigint) as "left", greatest(0, (floor((y1 - (y2 - y1) / 10) / 8) * 8)::bigint) as top,
  least(128, (ceil((x2 + (x2 - x1) / 10) / 8) * 8)::bigint) as "right", least(128, (ceil((y2 + (y2 - y1) / 10) / 8) * 8)::bigint) as bottom from g
"""


def sigma_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise levels of 30 steps for four shifts, and the step whose level is nearest to one half."""
    s = spark.range(0, 31).select(F.col("id").alias("step"), (1 - F.col("id") / 30).alias("sigma"))
    s = s.withColumn("shift", F.explode(F.array(*[F.lit(float(x)) for x in (1, 3, 5, 8)])))
    s = s.withColumn("level", shifted_sigma(F.col("sigma"), F.col("shift")))
    near = F.min_by("step", F.struct(F.round(F.abs(F.col("level") - 0.5), 9), "step")).over(Window.partitionBy("shift"))
    return s.select("shift", "step", F.round("level", 6).alias("level"), (near == F.col("step")).alias("is_half"))


SIGMA_SCHEDULE = """
with s as (select step, unnest([1.0::double, 3.0, 5.0, 8.0]) shift from generate_series(0, 30) g(step)),
l as (select shift, step, shift * (1 - step / 30.0::double) / (1 + (shift - 1) * (1 - step / 30.0::double)) as level from s)
select shift, step, round(level, 6) as level, row_number() over (partition by shift order by round(abs(level - 0.5), 9), step) = 1 as is_half from l
"""


def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.range(1, 17).select(F.col("id").alias("length")).withColumn("place", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1)))
    return t.select("length", "place", *[F.round(blend_weight(F.col("place"), F.col("length"), k), 6).alias(k) for k in ("linear", "hann", "hamming")])


BLEND_WEIGHTS = """
with t as (select length, unnest(generate_series(0, length - 1)) place from generate_series(1, 16) g(length)), x as (select *, case when length <= 1 then 1.0::double else place / (length - 1)::double end x from t)
select length, place, round(x, 6) as linear, round(0.5::double - 0.5::double * cos(pi() * x), 6) as hann, round(0.54::double - 0.46::double * cos(pi() * x), 6) as hamming from x
"""


def keyframe_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("0, "), F.col("p_size"), F.lit("-"), F.col("p_size") + 7, F.lit(":3, x, 95-120:10, -1, 4")).alias("spec"))
    return p.select("p_partkey", F.array_join(frames_of(F.col("spec"), F.lit(100)), ",").alias("frames"))


KEYFRAME_SPECS = """
with f as (select p_partkey, unnest(list_concat([0, 99, 4], generate_series(p_size, p_size + 7, 3), generate_series(95, 120, 10))) f from part),
c as (select distinct p_partkey, greatest(0, least(f, 99)) f from f)
select p_partkey, string_agg(f::varchar, ',' order by f) as frames from c group by 1
"""


def percentile_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three percentiles and three medians of each group, by exact ranks that are found range by range."""
    by = "o_orderpriority"
    g = at_ranks(table(spark, sf_dir, "orders"), [by], "o_totalprice", {
        "nearest": nearest_rank(0.95), "floor": floor_rank(0.95), "a": lambda n: F.floor(0.95 * (n - 1)), "b": lambda n: F.ceil(0.95 * (n - 1)),
        "upper": floor_rank(0.5), "lower": lambda n: F.floor((n - 1) / 2),
    })
    n = F.col("known")
    return g.select(
        by, F.round("nearest", 2).alias("nearest"), F.round("floor", 2).alias("floor"), F.round(linear("a", "b", 0.95 * (n - 1)), 3).alias("linear"),
        F.round("upper", 2).alias("median_upper"), F.round("lower", 2).alias("median_lower"), F.round(linear("lower", "upper", 0.5 * (n - 1)), 3).alias("median_mid"),
    )


PERCENTILE_DEFINITIONS = """
with g as (select o_orderpriority, list(o_totalprice order by o_totalprice) x, quantile_cont(o_totalprice, 0.95) l, median(o_totalprice) m from orders group by 1)
select o_orderpriority, round(x[round_even(0.95 * (len(x) - 1), 0)::bigint + 1], 2) as nearest, round(x[least(len(x), floor(0.95 * len(x))::bigint + 1)], 2) as floor, round(l, 3) as linear,
  round(x[len(x) // 2 + 1], 2) as median_upper, round(x[(len(x) - 1) // 2 + 1], 2) as median_lower, round(m, 3) as median_mid from g
"""


def trajectories_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track as one JSON list of points, read back by schema and summed up."""
    t = tracks(spark, sf_dir)
    point = F.struct("frame", F.col("raw").alias("x"), (F.col("v").isNotNull()).alias("seen"))
    j = t.groupBy("track").agg(F.to_json(F.sort_array(F.collect_list(point))).alias("json"))
    back = j.select("track", F.posexplode(F.from_json("json", "array<struct<frame:bigint,x:double,seen:boolean>>")).alias("place", "p"))
    g = back.groupBy("track").agg(F.count("*").alias("n"), F.count_if("p.seen").alias("seen"), F.round(F.sum(F.col("place") * F.col("p.x")), 1).alias("moment"))
    return g


TRAJECTORIES = f"with {TRACKS} select track, count(*) n, count(v) seen, round(sum(frame * raw), 1) as moment from t group by 1"


def chunk_plan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk plan for each order as JSON, with either of two names for the end, read with one; seams are the ends before the last.

    An order's length in frames follows from its key; chunks of 33 frames overlap by 8.
    """
    total = 20 + F.pmod("o_orderkey", F.lit(100))
    n = F.greatest(F.lit(1), F.ceil((F.col("total") - 8) / 25)).cast("int")
    c = table(spark, sf_dir, "orders").select("o_orderkey", total.alias("total"))
    odd = F.pmod("o_orderkey", F.lit(2)) == 1
    end = lambda k: F.least(k * 25 + 33, F.col("total")).cast("int")
    none = F.lit(None).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(
        k.alias("chunk_idx"), (k * 25).alias("start_frame"), F.when(odd, end(k)).otherwise(none).alias("end"), F.when(odd, none).otherwise(end(k)).alias("end_frame"),
    ))
    plans = c.select("o_orderkey", F.to_json(F.struct(F.lit("2.0").alias("version"), "total", chunks.alias("chunks"))).alias("plan"))
    back = plans.select("o_orderkey", F.from_json("plan", "version string, total int, chunks array<struct<chunk_idx:int,start_frame:int,end:int,end_frame:int>>").alias("p"))
    ends = F.transform("p.chunks", lambda x: F.coalesce(x["end"], x["end_frame"]))
    return back.select(
        "o_orderkey", F.col("p.version").alias("version"), F.col("p.total").alias("total"), F.size("p.chunks").alias("n"),
        F.array_join(F.slice(ends, F.lit(1), F.size(ends) - 1), ",").alias("seams"),
    )


CHUNK_PLAN_JSON = """
with o as (select o_orderkey, (20 + o_orderkey % 100)::int total from orders), n as (select *, greatest(1, ceil((total - 8) / 25.0))::int n from o)
select o_orderkey, '2.0' as version, total, n,
  array_to_string(list_transform(generate_series(0, n - 2), lambda k: least(k * 25 + 33, total)::varchar), ',') as seams from n
"""


def seam_against_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean change at chunk seams (every 16th frame) against other frames, and whether seams stand out."""
    t = tracks(spark, sf_dir).withColumn("d", F.abs(F.col("raw") - F.lag("raw").over(by_frame()))).where("d is not null")
    seam = F.pmod("frame", F.lit(16)) == 0
    g = t.groupBy("track").agg(F.avg(F.when(seam, F.col("d"))).alias("s"), F.avg(F.when(~seam, F.col("d"))).alias("r"))
    return g.select("track", F.round(F.col("s") + 1e-9, 4).alias("seam"), F.round(F.col("r") + 1e-9, 4).alias("rest"), (F.col("s") > 1.5 * F.col("r")).alias("stands_out"))


SEAM_AGAINST_REST = f"""
with {TRACKS}, d as (select *, abs(raw - lag(raw) over (partition by track order by frame)) d from t), g as (select track, avg(d) filter (where frame % 16 = 0) s, avg(d) filter (where frame % 16 <> 0) r from d group by 1)
select track, round(s + 1e-9, 4) as seam, round(r + 1e-9, 4) as rest, s > 1.5 * r as stands_out from g
"""


def document_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the intersection, differences and union of labelled and long documents."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id")
    long_ = d.where("n_chars > 2000").select("doc_id")
    parts = {"both": long_.intersect(l), "long_only": long_.exceptAll(l), "labelled_only": l.subtract(long_), "either": long_.union(l).distinct()}
    out = None
    for name, df in parts.items():
        one = df.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


DOCUMENT_SET_OPERATIONS = """
with a as (select doc_id from documents where n_chars > 2000), b as (select doc_id from labels),
p as (select 'both' as part, * from (select * from a intersect select * from b) union all select 'long_only', * from (select * from a except all select * from b)
  union all select 'labelled_only', * from (select * from b except select * from a) union all select 'either', * from (select * from a union select * from b))
select part, count(*) n, min(doc_id) as first from p group by 1
"""


def prompt_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt text from a run's settings: mode by strength (0.5 and 0.7 are balanced), bounds swapped where inverted."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.pmod("o_orderkey", F.lit(11)) / 10).alias("strength"), F.pmod("o_custkey", F.lit(100)).alias("low"), F.pmod("o_orderkey", F.lit(100)).alias("high"), "o_orderpriority")
    mode = F.when(F.col("strength") < 0.5, "preservation").when(F.col("strength") > 0.7, "creative").otherwise("balanced")
    label = first_class(F.col("o_orderpriority"), [("urgent|high", "fast"), ("medium", "steady")], "calm")
    text = F.concat_ws(" ", mode, label, F.least("low", "high").cast("string"), F.lit("to"), F.greatest("low", "high").cast("string"), F.lit("words"))
    return o.groupBy(text.alias("prompt")).agg(F.count("*").alias("n"))


PROMPT_MODES = """
with o as (select (o_orderkey % 11) / 10.0::double s, o_custkey % 100 lo, o_orderkey % 100 hi, lower(o_orderpriority) p from orders)
select concat_ws(' ', case when s < 0.5 then 'preservation' when s > 0.7 then 'creative' else 'balanced' end, case when regexp_matches(p, 'urgent|high') then 'fast' when regexp_matches(p, 'medium') then 'steady' else 'calm' end,
  least(lo, hi)::varchar, 'to', greatest(lo, hi)::varchar, 'words') as prompt, count(*) n from o group by 1
"""


def marked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each track that a list of marks names (digits only, in range, once each), with their values."""
    marks = spark.createDataFrame([("3, 7,x, 7, 900, 12,-4",)], "marks string")
    m = marks.select(F.explode(F.split("marks", ",")).alias("m")).select(F.trim("m").alias("m")).where(F.col("m").rlike(r"^\d+$")).select(F.col("m").cast("int").alias("frame")).distinct()
    return tracks(spark, sf_dir).join(m, "frame", "left_semi").select("track", "frame", "raw")


MARKED_FRAMES = f"with {TRACKS} select track, frame, raw from t where frame in (3, 7, 12, 900)"


def page_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs in path order without regard to case, by host: every fifth place, with glob patterns as expressions."""
    p = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^https?://.*/(en|fr)/.*$"))
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    place = F.row_number().over(Window.partitionBy(host).orderBy(F.lower("url"), "page_id")) - 1
    return p.select(host.alias("host"), "page_id", place.alias("place")).where("place % 5 = 0")


PAGE_SELECTION = r"""
select regexp_extract(url, '^https?://([^/]+)', 1) as host, page_id, row_number() over (partition by regexp_extract(url, '^https?://([^/]+)', 1) order by lower(url), page_id) - 1 as place
from pages where regexp_matches(url, '^https?://.*/(en|fr)/.*$') qualify place % 5 = 0
"""

QUERIES = {
    "bbox_union": (bbox_union, BBOX_UNION),
    "sigma_schedule": (sigma_schedule, SIGMA_SCHEDULE),
    "blend_weights": (blend_weights, BLEND_WEIGHTS),
    "keyframe_specs": (keyframe_specs, KEYFRAME_SPECS),
    "percentile_definitions": (percentile_definitions, PERCENTILE_DEFINITIONS),
    "trajectories_round_trip": (trajectories_round_trip, TRAJECTORIES),
    "chunk_plan_json": (chunk_plan_json, CHUNK_PLAN_JSON),
    "seam_against_rest": (seam_against_rest, SEAM_AGAINST_REST),
    "document_set_operations": (document_set_operations, DOCUMENT_SET_OPERATIONS),
    "prompt_modes": (prompt_modes, PROMPT_MODES),
    "marked_frames": (marked_frames, MARKED_FRAMES),
    "page_selection": (page_selection, PAGE_SELECTION),
}
