"""Column rules over frames, latents, boxes and logs, and small operators on them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandline.operators.metrics import frames
from strandline.plans.ordered import previous
from strandline.plans.ranges import latent_frames
from strandline.session import TRACKS, by_frame, table, tracks, whole, work_dir


def latent_overlap(a: Column, b: Column, overlap: Column, adjust: int = 0) -> Column:
    """Compressed frames that two parts share: those of either less those of both joined, 1 at least and no more than a part has."""
    la, lb = latent_frames(a), latent_frames(b)
    return F.greatest(F.lit(1), F.least(la + lb - latent_frames(a + b - overlap) + adjust, la, lb))


def to_pixels(x: Column, size: Column | int) -> Column:
    """A coordinate as a share of ``size``, or in thousandths if it is above 1.5."""
    return F.when(x > 1.5, x / 1000.0 * size).otherwise(x * size)


def split_values(text: Column) -> Column:
    """Values of a list in lines; a line with commas is split unless it looks like a path (has /, \\ or :)."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(lines, lambda x: F.when(
        x.contains(",") & ~x.rlike(r"[/\\:]"), F.filter(F.transform(F.split(x, ","), lambda v: F.trim(v)), lambda v: v != "")
    ).otherwise(F.array(x)))
    return F.flatten(parts)


def salvage_json(text: Column, schema: str) -> Column:
    """A JSON object by schema, also from a fenced block within other text; null where neither parses."""
    whole_, fenced = text.rlike(r"(?s)^\s*\{.*\}\s*$"), F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    return F.from_json(F.when(whole_, text).otherwise(F.when(fenced != "", fenced)), schema)


def tri_state(violations: Column, strict: Column) -> Column:
    """PASS for none (or -1: too little to tell), WARN for one, FAIL for one if strict and for two or more."""
    return F.when(violations <= 0, "PASS").when(violations == 1, F.when(strict, "FAIL").otherwise("WARN")).otherwise("FAIL")


def resets(df: DataFrame, by: list[str], order: list[str], key: Column, out: str = "epoch") -> DataFrame:
    """Numbers stretches of rows with one ``key``: state that is kept per stretch starts anew when the key changes."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.coalesce((~F.lag("_key").over(w).eqNullSafe(F.col("_key"))).cast("int"), F.lit(1))
    df = df.withColumn("_key", key).withColumn("_new", new)
    return df.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_key", "_new")


def ordered_concat(parts: DataFrame, by: str, order: str, values: str) -> DataFrame:
    """``by``, at, value: the parts' arrays one behind the other; a part's place is the sum of the sizes before it."""
    before = F.sum("_n").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    own = parts.withColumn("_n", F.size(values).cast("long")).withColumn("_at", F.coalesce(before, F.lit(0)))
    return own.select(by, "_at", F.posexplode(values).alias("_i", "value")).select(by, (F.col("_at") + F.col("_i")).alias("at"), "value")


def write_blobs(df: DataFrame, path: str) -> None:
    """key and payload (binary) as Parquet, with length and digest beside each: the manifest is the table itself."""
    df.select("key", F.length("payload").alias("n_bytes"), F.sha2("payload", 256).alias("sha"), "payload").write.mode("errorifexists").parquet(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """The blobs of ``write_blobs`` with ``intact``: whether length and digest still fit."""
    rows = spark.read.parquet(path)
    return rows.withColumn("intact", (F.length("payload") == F.col("n_bytes")) & (F.sha2("payload", 256) == F.col("sha")))


def file_blobs(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as key (path), payload."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return files.select(F.col("path").alias("key"), F.col("content").alias("payload"))


def match_media(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Cells (suffix) with the file whose name, or whose name without extension, is theirs; of several the last path; null if none."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    listed = files.select("path", F.explode(F.array_distinct(F.array(name, stem))).alias("suffix"))
    return cells.join(listed.groupBy("suffix").agg(F.max("path").alias("path")), "suffix", "left")


def gaussian_line(side: int, window: int, sigma: float) -> np.ndarray:
    """For each place of a line of ``side`` the weights of all places: a Gaussian window, reflected at the ends."""
    reach = window // 2
    if reach >= side:
        raise ValueError(f"a window of {window} does not fit {side} places")
    g = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma * sigma))
    line = np.zeros((side, side))
    at = np.abs(np.arange(side)[:, None] + np.arange(-reach, reach + 1))
    np.add.at(line, (np.arange(side)[:, None], np.where(at < side, at, 2 * side - 2 - at)), g / g.sum())
    return line


def ssim_windowed(df: DataFrame, a: str, b: str, height: int, width: int, out: str = "ssim", window: int = 11, sigma: float = 1.5, c1: float = 0.01**2, c2: float = 0.03**2) -> DataFrame:
    """``df`` and the mean of the structural similarities of all places' windows, of frames given row by row.

    A window is a Gaussian in rows times one in columns, so a batch of frames is blurred by two matrix products. Null
    where a frame is null, has a null, or another size.
    """
    rows, cols = gaussian_line(height, window, sigma), gaussian_line(width, window, sigma)
    df = df.drop(out)
    names = df.columns
    own = df.withColumns({c: F.col(c).cast("array<double>") for c in (a, b)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blurred = lambda x: rows @ x @ cols.T
        for batch in batches:
            lists = [batch.column(names.index(c)) for c in (a, b)]
            ok = np.ones(batch.num_rows, bool)
            for x in lists:
                ok &= pc.fill_null(pc.equal(pc.list_value_length(x), height * width), False).to_numpy(zero_copy_only=False)
            for x in lists:  # a null inside a frame
                parent = pc.list_parent_indices(x).to_numpy()
                ok[parent[x.flatten().is_null().to_numpy(zero_copy_only=False)]] = False
            at = np.flatnonzero(ok)
            made = np.full(batch.num_rows, np.nan)
            for i in range(0, len(at), max(1, (1 << 20) // (height * width))):
                some = pa.array(at[i : i + max(1, (1 << 20) // (height * width))])
                p, q = (x.take(some).flatten().to_numpy(zero_copy_only=False).reshape(-1, height, width) for x in lists)
                mp, mq = blurred(p), blurred(q)
                vp, vq = np.maximum(0, blurred(p * p) - mp * mp), np.maximum(0, blurred(q * q) - mq * mq)
                s = ((2 * mp * mq + c1) * (2 * (blurred(p * q) - mp * mq) + c2)) / ((mp * mp + mq * mq + c1) * (vp + vq + c2))
                made[some.to_numpy()] = s.mean((1, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, mask=~ok)], [*names, out])

    return own.mapInArrow(run, StructType([*own.schema.fields, StructField(out, DoubleType())]))


# queries


def latent_overlap_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (5 + F.pmod("o_orderkey", F.lit(117))).alias("a"), (9 + F.pmod("o_custkey", F.lit(91))).alias("b"))
    overlap = F.pmod(F.col("o_orderkey") * 7, F.lit(60))
    return o.select("o_orderkey", latent_overlap(F.col("a"), F.col("b"), overlap).cast("long").alias("overlap"), to_pixels(F.col("a") / 4.0, 640).alias("px"))


LATENT_OVERLAP_CLAMP = """
with o as (select o_orderkey, 5 + o_orderkey % 117 as a, 9 + o_custkey % 91 as b, (o_orderkey * 7) % 60 as ov from orders),
l as (select *, (a - 1) // 4 + 1 as la, (b - 1) // 4 + 1 as lb, case when a + b - ov <= 0 then 0 else (a + b - ov - 1) // 4 + 1 end as lc from o)
select o_orderkey, greatest(1, least(la + lb - lc, la, lb))::bigint as overlap, case when a / 4.0::double > 1.5 then a / 4.0::double / 1000.0 * 640 else a / 4.0::double * 640 end as px from l
"""


def list_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameter lists in lines: some with commas, some paths."""
    k = F.pmod("p_partkey", F.lit(3))
    line = F.when(k == 0, F.concat_ws(" , ", "p_brand", "p_type", F.col("p_size").cast("string"))).when(k == 1, F.concat(F.lit("C:\\x,y\\"), F.col("p_name")))
    text = F.concat(F.lit("\n  "), line.otherwise(F.col("p_name")), F.lit("\n\n a,,b \n"))
    v = table(spark, sf_dir, "part").select("p_partkey", split_values(text).alias("v"))
    return v.select("p_partkey", F.size("v").alias("n"), F.array_join("v", "|").alias("joined"))


LIST_VALUES = r"""
with l as (select p_partkey, case p_partkey % 3 when 0 then concat_ws(' , ', p_brand, p_type, p_size::varchar) when 1 then 'C:\x,y\' || p_name else p_name end as line from part),
v as (select p_partkey, case when contains(line, ',') and not regexp_matches(line, '[/\\:]')
    then list_filter(list_transform(string_split(line, ','), lambda x: trim(x)), lambda x: x <> '') else [trim(line)] end || ['a', 'b'] as v from l)
select p_partkey, len(v)::int as n, array_to_string(v, '|') as joined from v
"""


def fenced_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that hold JSON plainly, in a fenced block within prose, or not at all."""
    e = table(spark, sf_dir, "events")
    k = F.pmod("event_id", F.lit(4))
    raw = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```\nDone."))).when(
        k == 2, F.concat(F.lit("```\n"), "props", F.lit("\n```"))
    ).otherwise(F.concat(F.lit("no "), "event_type"))
    p = e.select("event_type", salvage_json(raw, "k long").alias("p"))
    return p.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("parsed"), F.sum("p.k").alias("sum"))


FENCED_JSON = """
select event_type, count(*) n, count(case when event_id % 4 <> 3 then (props::json->>'k')::bigint end) as parsed,
  sum(case when event_id % 4 <> 3 then (props::json->>'k')::bigint end)::bigint as sum from events group by 1
"""


def range_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a manifest says of a track's list: frames, least and greatest, first and last."""
    g = tracks(spark, sf_dir).groupBy("track")
    return g.agg(
        F.count("*").alias("n"), F.min("raw").alias("low"), F.max("raw").alias("high"), F.min_by("raw", "frame").alias("first"), F.max_by("raw", "frame").alias("last")
    )


RANGE_SUMMARIES = f"with {TRACKS} select track, count(*) n, min(raw) low, max(raw) high, arg_min(raw, frame) as first, arg_max(raw, frame) as last from t group by 1"


def media_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of orders with files of two kinds; every fifth has none."""
    o = table(spark, sf_dir, "orders")
    cells = o.select("o_orderkey", F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.concat(F.lit("it_"), "o_orderkey")).otherwise(F.concat(F.lit("it_"), "o_orderkey", F.lit(".mp4"))).alias("suffix"))
    files = o.where(F.pmod("o_orderkey", F.lit(5)) != 0).select(F.concat(F.lit("/out/"), "o_orderstatus", F.lit("/it_"), "o_orderkey", F.lit(".mp4")).alias("path"))
    return match_media(cells, files).select("o_orderkey", "path")


MEDIA_MATCH = "select o_orderkey, case when o_orderkey % 5 <> 0 then '/out/' || o_orderstatus || '/it_' || o_orderkey || '.mp4' end as path from orders"


def size_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box's size held at the track's largest or first one, and three quarters of the way there from its own."""
    t = tracks(spark, sf_dir)
    first = F.first("raw").over(by_frame().rowsBetween(Window.unboundedPreceding, 0))
    largest = F.max("raw").over(whole())
    return t.select("track", "frame", largest.alias("largest"), first.alias("first"), F.round(F.col("raw") + 0.75 * (largest - F.col("raw")), 6).alias("toward"))


SIZE_LOCKS = f"""
with {TRACKS} select track, frame, max(raw) over (partition by track) as largest, first_value(raw) over (partition by track order by frame) as first,
  round(raw + 0.75 * (max(raw) over (partition by track) - raw), 6) as toward from t
"""


def concat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label's vectors one behind the other, summed up by their places."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    c = ordered_concat(e, "label", "vec_id", "v")
    return c.groupBy("label").agg(F.count("*").alias("n"), F.max("at").alias("last"), F.round(F.sum(F.pmod("at", F.lit(97)) * F.col("value")), 3).alias("moment"))


CONCAT_PARTS = """
with p as (select label, coalesce(sum(len(embedding)) over (partition by label order by vec_id rows between unbounded preceding and 1 preceding), 0) as place, embedding from embeddings),
c as (select label, place + generate_subscripts(embedding, 1) - 1 as place, unnest(embedding)::double as value from p)
select label, count(*) n, max(place)::bigint as last, round(sum((place % 97) * value), 3) as moment from c group by 1
"""


def boundary_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a window of 33 frames at each stride of 25: a pyramid, drawn to 1 near boundaries that stand every 65 frames."""
    w = spark.range(0, 457, 25).select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("i"))
    base = F.least(F.col("i") + 1, 33 - F.col("i")).cast("double")
    edge = F.pmod(F.col("start") + F.col("i"), F.lit(65))
    near = F.least(edge, 65 - edge)
    t = 1.0 - near / F.lit(8.0)
    return w.select("start", "i", F.round(F.when(near < 8, base * (1 - t) + t).otherwise(base), 6).alias("weight"))


BOUNDARY_WEIGHTS = """
with w as (select s as start, i from generate_series(0, 456, 25) a(s), generate_series(0, 32) b(i)),
d as (select *, least(i + 1, 33 - i)::double as base, least((start + i) % 65, 65 - (start + i) % 65) as near from w)
select start, i::int as i, round(case when near < 8 then base * (near / 8.0::double) + (1 - near / 8.0::double) else base end, 6) as weight from d
"""


def state_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's running count and sum, which start anew when the kind of event changes, or after half a day without one."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    w = Window.partitionBy("user_id").orderBy("at", "event_id")
    e = e.withColumn("idle", F.sum(F.when(F.col("at") - F.lag("at").over(w) > 43_200_000_000, 1).otherwise(0)).over(w))
    e = resets(e, ["user_id"], ["at", "event_id"], F.xxhash64("event_type", "idle"))
    own = Window.partitionBy("user_id", "epoch").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return e.select("event_id", "epoch", F.count("*").over(own).alias("n"), F.round(F.sum("value").over(own), 3).alias("total"))


STATE_RESETS = """
with e as (select *, epoch_us(ts) as tick from events), i as (select *, sum(case when gap > 43200000000 then 1 else 0 end) over (partition by user_id order by tick, event_id) idle
  from (select *, tick - lag(tick) over (partition by user_id order by tick, event_id) gap from e)),
c as (select *, case when lag(event_type) over w = event_type and lag(idle) over w = idle then 0 else 1 end as is_new from i window w as (partition by user_id order by tick, event_id)),
k as (select *, sum(is_new) over (partition by user_id order by tick, event_id)::bigint as epoch from c)
select event_id, epoch, count(*) over o as n, round(sum(value) over o, 3) as total from k window o as (partition by user_id, epoch order by tick, event_id rows between unbounded preceding and current row)
"""


def blob_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as blobs with a manifest, written and read back."""
    path = work_dir(spark, "blobs")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("payload"))
    write_blobs(d, path)
    return read_blobs(spark, path).select("key", F.col("n_bytes").cast("long").alias("n_bytes"), "sha", "intact")


BLOB_ROUND_TRIP = "select doc_id as key, octet_length(encode(coalesce(text, '')))::bigint as n_bytes, sha256(coalesce(text, '')) as sha, true as intact from documents"


def ssim_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed similarity of a label's consecutive 8 x 8 frames; the window of 11 shrinks to 7, the largest odd one that fits."""
    f = previous(frames(spark, sf_dir), "label", "vec_id", ["px"]).where("_before is not null")
    f = f.select("vec_id", "px", F.col("_before.px").alias("prev"))
    return ssim_windowed(f, "prev", "px", 8, 8, window=7).select("vec_id", F.round("ssim", 4).alias("ssim"))


#: The same weights in SQL: for each cell those of all cells.
_WEIGHTS = np.einsum("ri,cj->rcij", gaussian_line(8, 7, 1.5), gaussian_line(8, 7, 1.5)).reshape(64, 64).tolist()


def _blur(v: str) -> str:
    return f"list_transform(w, lambda r: list_sum(list_transform(list_zip(r, {v}), lambda z: z[1] * z[2])))"


SSIM_WINDOWS = f"""
with fr as (select label, vec_id, list_transform(embedding, lambda x: (x::double + 1) / 2) b, {_WEIGHTS}::double[][] as w from embeddings),
p as (select *, lag(b) over (partition by label order by vec_id) a from fr),
q as (select vec_id, w, a, b, list_transform(a, lambda x: x * x) a2, list_transform(b, lambda x: x * x) b2, list_transform(list_zip(a, b), lambda z: z[1] * z[2]) c from p where a is not null),
m as (select vec_id, list_zip({_blur("a")}, {_blur("b")}, {_blur("a2")}, {_blur("b2")}, {_blur("c")}) z from q)
select vec_id, round(list_sum(list_transform(z, lambda x: ((2 * x[1] * x[2] + 0.0001) * (2 * (x[5] - x[1] * x[2]) + 0.0009))
  / ((x[1] * x[1] + x[2] * x[2] + 0.0001) * (greatest(0, x[3] - x[1] * x[1]) + greatest(0, x[4] - x[2] * x[2]) + 0.0009)))) / len(z), 4) as ssim from m
"""


def keyframe_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each jump of a track the calmest sharp frame of the next five, a local minimum of motion before any other.

    Motion is the change of the value; a frame is sharp if its value was seen. Null where none of them is sharp.
    """
    w = by_frame()
    t = tracks(spark, sf_dir).withColumn("motion", F.coalesce(F.abs(F.col("raw") - F.lag("raw").over(w)), F.lit(0.0)))
    low = (F.col("motion") <= F.coalesce(F.lag("motion").over(w), F.col("motion"))) & (F.col("motion") <= F.coalesce(F.lead("motion").over(w), F.col("motion")))
    pick = F.when(F.col("v").isNotNull(), F.struct((~low).alias("late"), F.col("motion").alias("m"), F.col("frame").alias("f")))
    t = t.withColumn("pick", pick).withColumn("hold", F.min("pick").over(w.rowsBetween(0, 5))["f"])
    return t.where("motion > 150").select("track", "frame", "hold")


KEYFRAME_HOLDS = f"""
with {TRACKS}, m as (select *, coalesce(abs(raw - lag(raw) over (partition by track order by frame)), 0.0) as motion from t),
l as (select *, not (motion <= coalesce(lag(motion) over w, motion) and motion <= coalesce(lead(motion) over w, motion)) as late from m window w as (partition by track order by frame)),
h as (select *, min(case when v is not null then struct_pack(late := late, m := motion, f := frame) end) over (partition by track order by frame rows between current row and 5 following) as pick from l)
select track, frame, pick.f as hold from h where motion > 150
"""


def uniform_keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six places spread evenly over a track, each moved to the calmest seen frame within five (null where none is seen)."""
    w = by_frame()
    t = tracks(spark, sf_dir).withColumn("motion", F.coalesce(F.abs(F.col("raw") - F.lag("raw").over(w)), F.lit(0.0)))
    pick = F.when(F.col("v").isNotNull(), F.struct(F.col("motion").alias("m"), F.col("frame").alias("f")))
    t = t.withColumn("pick", pick).withColumn("near", F.min("pick").over(w.rowsBetween(-5, 5))["f"]).withColumn("last", F.max("frame").over(whole()))
    targets = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.bround(i * F.col("last") / 5.0).cast("long"))
    return t.where(F.array_contains(targets, F.col("frame"))).select("track", F.col("frame").alias("target"), "near")


UNIFORM_KEYFRAMES = f"""
with {TRACKS}, m as (select *, coalesce(abs(raw - lag(raw) over (partition by track order by frame)), 0.0) as motion, max(frame) over (partition by track) as last from t),
h as (select *, min(case when v is not null then struct_pack(m := motion, f := frame) end) over (partition by track order by frame rows between 5 preceding and 5 following) as pick from m)
select track, frame as target, pick.f as near from h where list_contains(list_transform(generate_series(0, 5), lambda i: round_even(i * last / 5.0, 0)::bigint), frame)
"""


def ordering_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines' dates fall out of order: none, one or more; -1 where there is one line only."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.lag("l_shipdate").over(w) > F.col("l_shipdate")).cast("int").alias("bad"))
    g = x.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    v = F.when(F.col("n") < 2, -1).otherwise(F.col("k"))
    return g.select("l_orderkey", v.alias("violations"), tri_state(v, F.pmod("l_orderkey", F.lit(2)) == 0).alias("verdict"))


ORDERING_VERDICTS = """
with x as (select l_orderkey, (lag(l_shipdate) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) > l_shipdate)::int as bad from lineitem),
g as (select l_orderkey, case when count(*) < 2 then -1 else coalesce(sum(bad), 0) end::bigint as v from x group by 1)
select l_orderkey, v as violations, case when v <= 0 then 'PASS' when v = 1 then case when l_orderkey % 2 = 0 then 'FAIL' else 'WARN' end else 'FAIL' end as verdict from g
"""

#: Lines of a run's log: progress with seconds a step, the time of the whole, an error of memory, an attention kind.
_LINE = {"click": "{k}/500 [00:01, {v}s/it]", "purchase": "Prompt executed in 0:{m}:07", "error": "OutOfMemoryError at step {k}", "view": "using flash attention", "signup": "cfg={v} sampler: dpm"}


def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's log parsed: typed fields of which the last match counts, seconds a step with their statistics, an error flag."""
    e = table(spark, sf_dir, "events")
    k, v = F.get_json_object("props", "$.k"), F.format_string("%.2f", "value")
    line = F.lit("other")
    for kind, form in _LINE.items():
        text = F.lit(form)
        for name, x in (("{k}", k), ("{v}", v), ("{m}", F.format_string("%02d", F.pmod("event_id", F.lit(60))))):
            text = F.replace(text, F.lit(name), x)
        line = F.when(F.col("event_type") == kind, text).otherwise(line)
    r = e.select("user_id", F.struct("ts", "event_id").alias("at"), line.alias("line"))

    def field(pattern: str, kind: str) -> Column:
        found = F.regexp_extract("line", pattern, 1)
        return F.when(found != "", found).cast(kind)

    step, cfg = field(r"(\d+\.\d+)s/it", "double"), field(r"cfg[=:\s]+(\d+\.?\d*)", "double")
    took = F.regexp_extract("line", r"Prompt executed in (\d+):(\d+):(\d+)", 2)
    seconds = F.when(took != "", took.cast("int") * 60 + F.regexp_extract("line", r"Prompt executed in (\d+):(\d+):(\d+)", 3).cast("int"))
    r = r.select("user_id", "at", step.alias("step"), cfg.alias("cfg"), seconds.alias("seconds"), F.col("line").rlike("OutOfMemoryError|Allocation on device").alias("oom"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("at")))
    return r.groupBy("user_id").agg(
        F.count("step").alias("steps"), F.round(F.avg("step"), 4).alias("mean_step"), F.min("step").alias("fastest"), last("cfg").alias("cfg"), last("seconds").alias("seconds"),
        F.bool_or("oom").alias("oom"),
    )


LOG_FIELDS = """
with e as (select user_id, ts, event_id, event_type, printf('%.2f', value)::double as v, (event_id % 60) * 60 + 7 as s from events)
select user_id, count(*) filter (where event_type = 'click') as steps, round(avg(v) filter (where event_type = 'click'), 4) as mean_step, min(v) filter (where event_type = 'click') as fastest,
  arg_max(v, (ts, event_id)) filter (where event_type = 'signup') as cfg, arg_max(s, (ts, event_id)) filter (where event_type = 'purchase')::int as seconds, bool_or(event_type = 'error') as oom
from e group by 1
"""


def memory_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak memory of one step for configurations of length and size: the larger phase, what stays beside it, and margins.

    Formulas of a transformer over a sequence of (latent frames) x (h / 16) x (w / 16) tokens, 2 bytes a value.
    """
    n = spark.range(17, 242, 16).select(F.col("id").alias("frames")).crossJoin(spark.createDataFrame([(480, 832), (720, 1280), (1024, 1024)], "h int, w int"))
    n = n.crossJoin(spark.createDataFrame([(1536, 8960), (5120, 13824)], "dim int, ffn int"))  # a short list of sizes
    batch, bpe, mib = 2, 2, 1024 * 1024
    lat = latent_frames(F.col("frames")).cast("long")
    hw = (F.floor(F.col("h") / 8) * F.floor(F.col("w") / 8)).cast("long")
    seq = (lat * F.floor(F.floor(F.col("h") / 8) / 2) * F.floor(F.floor(F.col("w") / 8) / 2)).cast("long")
    n = n.withColumn("lat", lat).withColumn("hw", hw).withColumn("seq", seq)
    dim, ffn, seq = F.col("dim"), F.col("ffn"), F.col("seq")
    attention, feed = 4 * batch * bpe * seq * dim, batch * bpe * seq * (2 * ffn + dim)
    stays = batch * bpe * dim * (2 * seq + 6)
    latent, text = batch * 16 * bpe * F.col("lat") * F.col("hw"), batch * bpe * 512 * dim
    working = F.greatest(attention, feed) + stays + latent + text
    total = working + F.floor(working * 0.1) + 800 * mib
    n = n.withColumn("phase", F.when(attention > feed, "attention").otherwise("feed-forward")).withColumn("total", total)
    return n.select("frames", "h", "w", "dim", "seq", "phase", F.floor(F.col("total") * 1.2 / mib).alias("mib"))


MEMORY_ESTIMATE = """
with n as (select f as frames, h, w, d as dim, ff as ffn, (f - 1) // 4 + 1 as lat, (h // 8) * (w // 8) as hw from generate_series(17, 241, 16) a(f),
  (values (480, 832), (720, 1280), (1024, 1024)) b(h, w), (values (1536, 8960), (5120, 13824)) c(d, ff)),
s as (select *, lat * ((h // 8) // 2) * ((w // 8) // 2) as seq from n),
p as (select *, 16 * seq * dim as att, 4 * seq * (2 * ffn + dim) as feed, 4 * dim * (2 * seq + 6) + 64 * lat * hw + 2048 * dim as rest from s),
t as (select *, greatest(att, feed) + rest as working from p)
select frames, h, w, dim, seq, case when att > feed then 'attention' else 'feed-forward' end as phase,
  floor((working + floor(working * 0.1::double) + 838860800) * 1.2::double / 1048576)::bigint as mib from t
"""

QUERIES = {
    "latent_overlap_clamp": (latent_overlap_clamp, LATENT_OVERLAP_CLAMP),
    "list_values": (list_values, LIST_VALUES),
    "fenced_json": (fenced_json, FENCED_JSON),
    "range_summaries": (range_summaries, RANGE_SUMMARIES),
    "media_match": (media_match, MEDIA_MATCH),
    "size_locks": (size_locks, SIZE_LOCKS),
    "concat_parts": (concat_parts, CONCAT_PARTS),
    "boundary_weights": (boundary_weights, BOUNDARY_WEIGHTS),
    "state_resets": (state_resets, STATE_RESETS),
    "blob_round_trip": (blob_round_trip, BLOB_ROUND_TRIP),
    "ssim_windows": (ssim_windows, SSIM_WINDOWS),
    "keyframe_holds": (keyframe_holds, KEYFRAME_HOLDS),
    "uniform_keyframes": (uniform_keyframes, UNIFORM_KEYFRAMES),
    "ordering_verdicts": (ordering_verdicts, ORDERING_VERDICTS),
    "log_fields": (log_fields, LOG_FIELDS),
    "memory_estimate": (memory_estimate, MEMORY_ESTIMATE),
}
