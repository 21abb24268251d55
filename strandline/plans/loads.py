"""What a run reads back: a sweep row's parameters as typed columns, slices of tracks and of their tokens, counted merges, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import TRACKS, by_frame, table, tracks, whole


def iteration(df: DataFrame, parameters: str, kinds: dict[str, str], strict: bool = False) -> DataFrame:
    """A column for each of ``kinds`` from a map of texts, and ``unread``: names whose text is no such value.

    A missing or empty text gives null and is not unread. Texts are trimmed; ``true``/``false``/``1``/``0`` are booleans;
    a whole number may be written 3.0. With ``strict`` a row with unread names fails the query and says which.
    """
    made, bad = {}, []
    for name, kind in kinds.items():
        text = F.trim(F.try_element_at(parameters, F.lit(name)))
        text = F.when(text != "", text)
        number = text.try_cast("double")
        value = {"int": F.when(number == F.floor(number), number.try_cast("int")), "long": F.coalesce(text.try_cast("long"), F.when(number == F.floor(number), number.try_cast("long")))}.get(kind)
        value = text.try_cast(kind) if value is None else value
        made[name] = value
        bad.append(F.when(text.isNotNull() & value.isNull(), F.lit(name)))
    df = df.withColumns(made | {"unread": F.array_compact(F.array(*bad))})
    if strict:
        fail = F.raise_error(F.concat(F.lit("unreadable parameters: "), F.array_join("unread", ", "))).cast("array<string>")
        df = df.withColumn("unread", F.when(F.size("unread") > 0, fail).otherwise(F.col("unread")))
    return df


def slice_frames(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows of each track that a slice keeps, with ``place`` from 0; negative ends count from the track's end.

    ``step`` is 1 or more. Frames are ordered by number, whatever numbers are missing.
    """
    if step < 1:
        raise ValueError("step must be 1 or more")
    n, k = F.count("*").over(whole()), F.row_number().over(by_frame()) - 1
    end = lambda x, default: default if x is None else F.lit(x) if x >= 0 else F.greatest(F.lit(0), F.col("_n") + x)
    df = df.withColumn("_n", n).withColumn("_k", k)
    first, last = end(start, F.lit(0)), F.least(end(stop, F.col("_n")), F.col("_n"))
    kept = df.where((F.col("_k") >= first) & (F.col("_k") < last) & (F.pmod(F.col("_k") - first, F.lit(step)) == 0))
    return kept.withColumn("place", F.floor((F.col("_k") - first) / step)).drop("_n", "_k")


def slice_tokens(tokens: Column, per_frame: int, start: int, stop: int) -> Column:
    """The tokens of frames ``start`` to before ``stop`` of a flat list with ``per_frame`` of each; a broken last frame counts for none."""
    n = F.floor(F.size(tokens) / per_frame)
    a = F.least(F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0)), n)
    b = F.least(F.greatest(F.lit(stop) if stop >= 0 else n + stop, a), n)
    return F.slice(tokens, (a * per_frame + 1).cast("int"), ((b - a) * per_frame).cast("int"))


def coverage(df: DataFrame, present: Column) -> DataFrame:
    """track, frames, present, percent (of two decimals) and how much that is: none, sparse, partial, most, all."""
    g = df.groupBy("track").agg(F.count("*").alias("frames"), F.count_if(F.coalesce(present, F.lit(False))).alias("present"))
    percent = 100.0 * F.col("present") / F.col("frames")
    word = F.when(percent == 0, "none").when(percent < 25, "sparse").when(percent < 75, "partial").when(percent < 100, "most").otherwise("all")
    return g.select("*", F.round(percent + 1e-9, 2).alias("percent"), word.alias("coverage"))


def merged_back(originals: DataFrame, processed: DataFrame, keys: list[str], value: str, promised: DataFrame, group: str) -> DataFrame:
    """``originals`` with the processed value where there is one; fails where a group has another number of processed
    rows than ``promised`` (group, n) says, naming group and counts."""
    done = processed.select(*keys, F.col(value).alias("_new"))
    j = originals.join(done, keys, "left")
    have = processed.groupBy(group).agg(F.count("*").alias("_have"))
    check = promised.join(have, group, "full").select(F.col(group).alias("_g"), F.coalesce("n", F.lit(0)).alias("_n"), F.coalesce("_have", F.lit(0)).alias("_have"))
    j = j.join(check, j[group].eqNullSafe(check["_g"]), "left")
    say = F.concat(F.lit("group "), F.coalesce(F.col(group).cast("string"), F.lit("null")), F.lit(": "), F.col("_have"), F.lit(" processed rows instead of "), F.col("_n"))
    kind = dict(originals.dtypes)[value]
    merged = F.when(F.col("_n") != F.col("_have"), F.raise_error(say).cast(kind)).otherwise(F.coalesce("_new", value))
    return j.withColumn(value, merged).drop("_new", "_g", "_n", "_have")


def cost(tokens: Column, price: Column, unknown: str = "null") -> Column:
    """Price of so many tokens at a price a million; one without a price costs null, or 0.0 with ``unknown`` = ``zero``."""
    found = tokens * price / 1e6
    return F.coalesce(found, F.lit(0.0)) if unknown == "zero" else found


# queries


def sweep_iterations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's parameters, written as texts of which some are broken, read back typed."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    texts = F.create_map(
        F.lit("steps"), F.when(k % 5 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).when(k % 11 == 0, "many").otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string"))),
        F.lit("cfg"), F.when(k % 7 == 0, "").otherwise(F.col("p_retailprice").cast("string")), F.lit("tiled"), F.when(k % 3 == 0, "true").when(k % 3 == 1, "0").otherwise("perhaps"), F.lit("sampler"), F.col("p_brand"),
    )
    g = iteration(p.select("p_partkey", texts.alias("x")), "x", {"steps": "int", "cfg": "double", "tiled": "boolean", "sampler": "string", "seed": "long"})
    return g.select("p_partkey", "steps", "cfg", "tiled", "sampler", "seed", F.array_join("unread", ",").alias("unread"))


SWEEP_ITERATIONS = """
select p_partkey, case when p_partkey % 5 = 0 or p_partkey % 11 <> 0 then p_size end::int as steps, case when p_partkey % 7 <> 0 then p_retailprice end::double as cfg,
  case p_partkey % 3 when 0 then true when 1 then false end as tiled, p_brand as sampler, null::bigint as seed,
  concat_ws(',', case when p_partkey % 5 <> 0 and p_partkey % 11 = 0 then 'steps' end, case when p_partkey % 3 = 2 then 'tiled' end) as unread from part
"""


def frame_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second of each track's last eleven frames but the very last."""
    return slice_frames(tracks(spark, sf_dir), -11, -1, 2).select("track", "frame", "place", "raw")


FRAME_SLICES = f"""
with {TRACKS}, n as (select *, count(*) over (partition by track) as n from t), a as (select *, greatest(0, n - 11) as a from n)
select track, frame, (frame - a) // 2 as place, raw from a where frame >= a and frame < n - 1 and (frame - a) % 2 = 0
"""


def token_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as tokens of frames of seven: the second frame to before the last whole one, added up."""
    part = slice_tokens(F.col("embedding"), 7, 1, -1)
    v = table(spark, sf_dir, "embeddings").select("vec_id", part.alias("x"))
    return v.select("vec_id", F.size("x").alias("n"), F.round(F.aggregate("x", F.lit(0.0), lambda a, x: a + x), 4).alias("sum"))


TOKEN_SLICES = """
select vec_id, len(x)::int as n, round(list_sum(list_transform(x, lambda v: v::double)), 4) as sum from (select vec_id, embedding[8:(len(embedding) // 7 - 1) * 7] as x from embeddings)
"""


def presence_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage(tracks(spark, sf_dir), F.col("v") > 60 + F.col("track") % 100 * 2)


PRESENCE_COVERAGE = f"""
with {TRACKS}, g as (select track, count(*) as frames, count(*) filter (where v > 60 + track % 100 * 2) as present from t group by 1)
select *, round(100.0::double * present / frames + 1e-9, 2) as percent, case when present = 0 then 'none' when 100.0 * present / frames < 25 then 'sparse' when 100.0 * present / frames < 75 then 'partial' when present < frames then 'most' else 'all' end as coverage from g
"""


def merge_counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that are not errors, doubled and merged back; each track's number of them is promised by its events."""
    t = tracks(spark, sf_dir).select("track", "frame", "raw", "kind")
    promised = t.groupBy("track").agg(F.count_if(F.col("kind") != "error").alias("n"))
    done = t.where("kind <> 'error'").select("track", "frame", (F.col("raw") * 2).alias("raw"))
    return merged_back(t, done, ["track", "frame"], "raw", promised, "track").select("track", "frame", F.round("raw", 2).alias("value"))


MERGE_COUNTED = f"with {TRACKS} select track, frame, round(case when kind <> 'error' then raw * 2 else raw end, 2) as value from t"


def cost_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token costs of the documents by language under both policies for languages without a price."""
    prices = F.create_map(F.lit("en"), F.lit(0.3), F.lit("fr"), F.lit(0.5))
    g = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum("n_chars").alias("chars"))
    tokens, price = F.col("chars") / 4, F.try_element_at(prices, "lang")
    return g.select("lang", F.round(cost(tokens, price), 6).alias("cost"), F.round(cost(tokens, price, "zero"), 6).alias("cost_or_zero"))


COST_BY_SOURCE = """
with g as (select lang, sum(n_chars)::double / 4 * case lang when 'en' then 0.3::double when 'fr' then 0.5::double end / 1e6 as c from documents group by 1)
select lang, round(c, 6) as cost, round(coalesce(c, 0.0), 6) as cost_or_zero from g
"""

QUERIES = {
    "sweep_iterations": (sweep_iterations, SWEEP_ITERATIONS),
    "frame_slices": (frame_slices, FRAME_SLICES),
    "token_slices": (token_slices, TOKEN_SLICES),
    "presence_coverage": (presence_coverage, PRESENCE_COVERAGE),
    "merge_counted": (merge_counted, MERGE_COUNTED),
    "cost_by_source": (cost_by_source, COST_BY_SOURCE),
}
