"""Parameter sweeps: ordered grids, progress, latest states, layouts, and constrained search over a cost model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import table


def grid(parameters: list[DataFrame]) -> DataFrame:
    """Every combination of the parameters' values, numbered with the last parameter fastest.

    Each parameter has columns (name, name_pos) with places from 0; the number is a mixed radix of the places, so it
    does not depend on partitions.
    """
    sizes = [p.count() for p in parameters]  # values of one parameter: a short list
    names = [p.columns[0] for p in parameters]
    out = reduce(lambda a, b: a.crossJoin(b), parameters)
    number: Column = F.lit(0)
    for name, size in zip(names, sizes, strict=True):
        number = number * size + F.col(f"{name}_pos")
    return out.select(number.cast("long").alias("id"), *names)


def values_of(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values of a column with their places in order."""
    v = df.select(F.col(column).alias(name)).distinct()
    return v.withColumn(f"{name}_pos", F.row_number().over(Window.orderBy(name)) - 1)


def float_range(start: float, stop: float, step: float) -> list[float]:
    """Inclusive values, rising or falling, rounded to six digits, with a thousandth of the step as tolerance."""
    size = abs(step)
    n = int((abs(stop - start) + size / 1000) / size)
    sign = 1 if stop >= start else -1
    return [round(start + sign * k * size, 6) for k in range(n + 1)]


def step_splits(total: int, low: int, high: int, step: int) -> list[str]:
    """Two-stage splits "a,b" of a total with a positive second part."""
    return [f"{a},{total - a}" for a in range(low, high + 1, step) if total - a > 0]


def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    g = grid([values_of(part, "p_brand", "brand"), values_of(part, "p_type", "kind"), values_of(part, "p_size", "size")])
    return g.withColumn("label", F.concat_ws("_", "brand", "kind", F.col("size").cast("string")))


SWEEP_GRID = """
with b as (select distinct p_brand brand from part), k as (select distinct p_type kind from part), s as (select distinct p_size size from part)
select row_number() over (order by brand, kind, size) - 1 as id, brand, kind, size, brand || '_' || kind || '_' || size as label from b, k, s
"""


def sweep_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") == "P").alias("failed")
    )
    left = F.col("total") - F.col("completed") - F.col("failed")
    return g.withColumn("remaining", left).withColumn("percent", F.round(100.0 * (F.col("total") - left) / F.col("total") + 1e-9, 3))


SWEEP_PROGRESS = """
with g as (select o_orderpriority, count(*) total, count_if(o_orderstatus = 'F') completed, count_if(o_orderstatus = 'P') failed from orders group by 1)
select *, total - completed - failed as remaining, round(100.0::double * (completed + failed) / total + 1e-9, 3) as percent from g
"""


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key, by max_by, which combines before the shuffle: a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return g.select(*keys, *[F.col(f"_x.{c}").alias(c) for c in rest])


def sweep_latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return latest(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "value")


SWEEP_LATEST_STATUS = """
select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1
"""


def sweep_layout_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by brand, columns by line status, pages of ten brands; a cell is the mean price, missing where nothing ran."""
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    j = part.join(line, part.p_partkey == line.l_partkey, "left")
    g = j.groupBy("p_brand").pivot("l_linestatus", ["F", "O"]).agg(F.avg("l_extendedprice"))
    place = F.row_number().over(Window.orderBy("p_brand")) - 1
    return g.select("p_brand", F.floor(place / 10).alias("page"), F.pmod(place, F.lit(10)).alias("row"), F.round("F", 2).alias("cell_f"), F.round("O", 2).alias("cell_o"))


SWEEP_LAYOUT_PIVOT = """
with g as (select p_brand, avg(l_extendedprice) filter (where l_linestatus = 'F') f, avg(l_extendedprice) filter (where l_linestatus = 'O') o from part left join lineitem on p_partkey = l_partkey group by 1),
n as (select *, row_number() over (order by p_brand) - 1 k from g)
select p_brand, k // 10 as page, k % 10 as row, round(f, 2) as cell_f, round(o, 2) as cell_o from n
"""


def sweep_cells_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of brand and size, with the first part that fills each, or status missing."""
    part = table(spark, sf_dir, "part")
    cells = part.select("p_brand").distinct().crossJoin(part.select("p_size").distinct())
    first = part.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("part"), F.count("*").alias("matches"))
    j = cells.join(first, ["p_brand", "p_size"], "left")
    return j.select("p_brand", "p_size", "part", F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("part").isNull(), "missing").otherwise("ready").alias("status"))


SWEEP_CELLS_FIRST_MATCH = """
with c as (select * from (select distinct p_brand from part), (select distinct p_size from part)), f as (select p_brand, p_size, min(p_partkey) part, count(*) matches from part group by 1, 2)
select p_brand, p_size, part, coalesce(matches, 0) as matches, case when part is null then 'missing' else 'ready' end as status from c left join f using (p_brand, p_size)
"""


def sweep_parameter_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters by falling number of values, in their own order on a tie."""
    part = table(spark, sf_dir, "part")
    own = ["p_brand", "p_type", "p_size"]
    one = part.agg(*[F.count_distinct(c).alias(c) for c in own])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(c).alias("parameter"), F.col(c).alias("n")) for i, c in enumerate(own)])).alias("x")).select("x.*")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "slot")))


SWEEP_PARAMETER_CARDINALITY = """
with r as (select 0 as slot, 'p_brand' as parameter, count(distinct p_brand) n from part union all select 1, 'p_type', count(distinct p_type) from part union all select 2, 'p_size', count(distinct p_size) from part)
select *, row_number() over (order by n desc, slot) rank from r
"""


def config_search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights, frame counts and window lengths within a memory budget: the longest window that fits, best ten first."""
    def numbers(low: int, high: int, step: int, name: str) -> DataFrame:
        return spark.range(low, high + 1, step).select(F.col("id").alias(name))

    g = numbers(256, 1024, 64, "height").crossJoin(numbers(17, 161, 16, "frames")).crossJoin(numbers(17, 81, 16, "window"))
    g = g.where(F.col("window") <= F.col("frames")).withColumn("width", F.floor(F.col("height") * 16 / 9 / 64) * 64)
    latent = (F.floor((F.col("frames") - 1) / 4) + 1) * F.col("height") * F.col("width") / 64
    inside = (F.floor((F.col("window") - 1) / 4) + 1) * F.col("height") * F.col("width") / 64
    g = g.withColumn("ram_mb", latent * 16 * 4 / 1e6 + 800).withColumn("vram_mb", 2500 + inside * 0.12)
    g = g.where("ram_mb < 6000").where("vram_mb < 24000")
    first = F.row_number().over(Window.partitionBy("height", "frames").orderBy(F.desc("window")))
    best = g.withColumn("k", first).where("k = 1")
    score = F.round(F.col("height") * F.col("width") * F.col("frames") / 1e6, 4)
    top = best.withColumn("score", score).orderBy(F.desc("score"), F.desc("height"), "frames").limit(10)
    return top.select("height", "width", "frames", "window", F.round("ram_mb", 2).alias("ram_mb"), F.round("vram_mb", 2).alias("vram_mb"), "score")


CONFIG_SEARCH_TOPK = """
with g as (select h as height, f as frames, w as "window", floor(h * 16 / 9.0 / 64)::bigint * 64 as width from generate_series(256, 1024, 64) a(h), generate_series(17, 161, 16) b(f), generate_series(17, 81, 16) c(w) where w <= f),
m as (select *, ((frames - 1) // 4 + 1) * height * width / 64.0 * 16 * 4 / 1e6 + 800 as ram_mb, 2500 + ((("window" - 1) // 4 + 1) * height * width / 64.0) * 0.12 as vram_mb from g),
k as (select *, row_number() over (partition by height, frames order by "window" desc) k from m where ram_mb < 6000 and vram_mb < 24000)
select height, width, frames, "window", round(ram_mb::double, 2) as ram_mb, round(vram_mb::double, 2) as vram_mb, round(height * width * frames / 1e6::double, 4) as score from k where k = 1 order by score desc, height desc, frames limit 10
"""


def throughput_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order seconds a frame, frames a minute and the realtime ratio (x 60), with quantity as frames."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("frames"), F.sum("l_linenumber").alias("seconds"))
    s, f = F.col("seconds"), F.col("frames")
    return g.select("l_orderkey", F.round(s / f, 6).alias("seconds_per_frame"), F.round(f / s * 60, 4).alias("frames_per_minute"), F.round(f / 24 / s * 60, 4).alias("realtime"))


THROUGHPUT_RATIOS = """
with g as (select l_orderkey, sum(l_quantity) f, sum(l_linenumber)::double s from lineitem group by 1)
select l_orderkey, round(s / f, 6) as seconds_per_frame, round(f / s * 60, 4) as frames_per_minute, round(f / 24 / s * 60, 4) as realtime from g
"""


def resolution_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes as widths and retail prices as heights, rounded to multiples of 16 in three ways."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 17).alias("w"), F.floor("p_retailprice").alias("h"))

    def near(c: str) -> Column:
        return F.floor(F.col(c) / 16 + 0.5) * 16

    ratio = F.col("h") / F.col("w")
    shape = F.when(ratio > 1.1, "vertical").when(F.col("w") > 1.1 * F.col("h"), "wide").otherwise("square")
    return p.select("p_partkey", "w", "h", (F.pmod("w", F.lit(16)) == 0).alias("fits"), near("w").alias("w_near"), (F.ceil(F.col("h") / 16) * 16).alias("h_up"), (F.floor(F.col("h") / 16) * 16).alias("h_down"), shape.alias("shape"))


RESOLUTION_OPTIONS = """
with p as (select p_partkey, p_size * 17 w, floor(p_retailprice)::bigint h from part)
select p_partkey, w, h, w % 16 = 0 as fits, floor(w / 16.0 + 0.5)::bigint * 16 as w_near, ceil(h / 16.0)::bigint * 16 as h_up, floor(h / 16.0)::bigint * 16 as h_down,
  case when h / w > 1.1 then 'vertical' when w > 1.1 * h then 'wide' else 'square' end as shape from p
"""


def telemetry_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as run records, rolled up by region and size regime; any failed record vetoes a group."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    regime = F.when(F.col("o_totalprice") < 100_000, "small").when(F.col("o_totalprice") < 250_000, "medium").otherwise("large")
    g = j.withColumn("regime", regime).rollup("r_name", "regime").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("flagged"), F.round(F.avg("c_acctbal"), 2).alias("balance"))
    return g.withColumn("vetoed", F.col("flagged") > 0)


TELEMETRY_ROLLUP = """
with j as (select r_name, case when o_totalprice < 100000 then 'small' when o_totalprice < 250000 then 'medium' else 'large' end regime, o_orderstatus, c_acctbal
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)
select r_name, regime, count(*) n, count_if(o_orderstatus = 'P') flagged, round(avg(c_acctbal), 2) as balance, count_if(o_orderstatus = 'P') > 0 as vetoed from j group by rollup (r_name, regime)
"""

QUERIES = {
    "sweep_grid": (sweep_grid, SWEEP_GRID),
    "sweep_progress": (sweep_progress, SWEEP_PROGRESS),
    "sweep_latest_status": (sweep_latest_status, SWEEP_LATEST_STATUS),
    "sweep_layout_pivot": (sweep_layout_pivot, SWEEP_LAYOUT_PIVOT),
    "sweep_cells_first_match": (sweep_cells_first_match, SWEEP_CELLS_FIRST_MATCH),
    "sweep_parameter_cardinality": (sweep_parameter_cardinality, SWEEP_PARAMETER_CARDINALITY),
    "config_search_topk": (config_search_topk, CONFIG_SEARCH_TOPK),
    "throughput_ratios": (throughput_ratios, THROUGHPUT_RATIOS),
    "resolution_options": (resolution_options, RESOLUTION_OPTIONS),
    "telemetry_rollup": (telemetry_rollup, TELEMETRY_ROLLUP),
}
