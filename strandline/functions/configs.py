"""Versioned settings as maps, names made unique, and sharpness of small frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.session import table


def with_defaults(settings: Column, defaults: dict[str, str]) -> tuple[Column, Column]:
    """(settings with missing or null keys filled and unknown ones dropped, sorted unknown keys); null settings stay null."""
    known = F.array(*[F.lit(k) for k in defaults])
    base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
    given = F.map_filter(settings, lambda k, v: F.array_contains(known, k) & v.isNotNull())
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(given, k))
    return F.map_concat(kept, given), F.sort_array(F.array_except(F.map_keys(settings), known))


def migrated(settings: Column, renamed: dict[str, str]) -> Column:
    """Settings of an older version under the keys of the next."""
    names = F.create_map(*[F.lit(x) for kv in renamed.items() for x in kv])
    return F.transform_keys(settings, lambda k, _: F.coalesce(names[k], k))


def unique_names(df: DataFrame, name: str, *order: str, out: str = "unique") -> DataFrame:
    """The first of equal names stays, the next ones get _2, _3 and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), n.cast("string"))))


def laplacian_variance(px: Column, side: int) -> Column:
    """Population variance of the four-neighbour Laplacian of a square frame, zeros beyond its edges."""

    def at(i: Column, shift: int, inside: Column) -> Column:
        return F.when(inside, F.get(px, i + shift)).otherwise(0.0)

    def value(i: Column) -> Column:
        x, y = F.pmod(i, F.lit(side)), F.floor(i / side)
        near = at(i, -1, x > 0) + at(i, 1, x < side - 1) + at(i, -side, y > 0) + at(i, side, y < side - 1)
        return near - 4 * F.get(px, i)

    values = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), value)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / (side * side)
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) / (side * side) - mean * mean


# queries


def settings_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as old settings: one key renamed, one with a default, one that no version knows."""
    p = table(spark, sf_dir, "part")
    odd = F.pmod("p_partkey", F.lit(2)) == 1
    old = F.create_map(
        F.lit("grow_px"), F.col("p_size").cast("string"), F.lit("feather_px"), F.when(odd, F.lit("7")),
        F.when(odd, "legacy").otherwise("mode"), F.col("p_type"),
    )
    new, unknown = with_defaults(migrated(old, {"grow_px": "expand_px"}), {"expand_px": "0", "feather_px": "16", "mode": "tight"})
    return p.select("p_partkey", new["expand_px"].alias("expand"), new["feather_px"].alias("feather"), new["mode"].alias("mode"), F.array_join(unknown, ",").alias("unknown"))


SETTINGS_MIGRATION = """
select p_partkey, p_size::varchar as expand, case when p_partkey % 2 = 1 then '7' else '16' end as feather, case when p_partkey % 2 = 1 then 'tight' else p_type end as mode,
  case when p_partkey % 2 = 1 then 'legacy' else '' end as unknown from part
"""


def numbered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", "p_brand", "p_type").alias("name"))
    return unique_names(p, "name", "p_partkey").select("p_partkey", "unique")


NUMBERED_NAMES = """
with n as (select p_partkey, p_brand || '-' || p_type as name, row_number() over (partition by p_brand || '-' || p_type order by p_partkey) k from part)
select p_partkey, case when k = 1 then name else name || '_' || k end as "unique" from n
"""


def frame_sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as 8 x 8 frames."""
    px = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(laplacian_variance(px, 8), 6).alias("sharpness"))


FRAME_SHARPNESS = """
with e as (select vec_id, list_transform(embedding, lambda x: x::double) p from embeddings),
l as (select vec_id, list_transform(range(64), lambda i: case when i % 8 > 0 then p[i] else 0 end + case when i % 8 < 7 then p[i + 2] else 0 end
  + case when i >= 8 then p[i - 7] else 0 end + case when i < 56 then p[i + 9] else 0 end - 4 * p[i + 1]) v from e)
select vec_id, round(list_sum(list_transform(v, lambda x: x * x)) / 64 - (list_sum(v) / 64) * (list_sum(v) / 64), 6) as sharpness from l
"""

QUERIES = {
    "settings_migration": (settings_migration, SETTINGS_MIGRATION),
    "numbered_names": (numbered_names, NUMBERED_NAMES),
    "frame_sharpness": (frame_sharpness, FRAME_SHARPNESS),
}
