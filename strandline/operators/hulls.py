"""Convex hulls of groups of points: partial hulls in every task, put together by key."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import TRACKS, by_frame, tracks

_NAMES = ["key", "x", "y"]


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the hull's corners against the clock, from the leftmost lowest point; points on its sides are none."""
    order = np.lexsort((y, x))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    order = order[new]
    if len(order) < 3:
        return order
    if len(order) > 64:  # points within the polygon of the outermost ones in eight directions are no corners
        a, b = x[order], y[order]
        ends = np.unique([f(v) for v in (a, b, a + b, a - b) for f in (np.argmin, np.argmax)])
        ring = _chain(a[ends], b[ends])
        cx, cy = a[ends][ring], b[ends][ring]
        if len(ring) > 2:
            inside = np.ones(len(a), bool)
            for i in range(len(ring)):
                j = (i + 1) % len(ring)
                inside &= (cx[j] - cx[i]) * (b - cy[i]) - (cy[j] - cy[i]) * (a - cx[i]) > 0
            order = order[~inside]
    return order[_chain(x[order], y[order])]


def _chain(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Monotone chain over points that are sorted and different."""
    px, py = x.tolist(), y.tolist()

    def half(places: Iterable[int]) -> list[int]:
        out: list[int] = []
        for i in places:
            while len(out) > 1 and (px[out[-1]] - px[out[-2]]) * (py[i] - py[out[-2]]) <= (py[out[-1]] - py[out[-2]]) * (px[i] - px[out[-2]]):
                out.pop()
            out.append(i)
        return out

    if len(px) < 3:
        return [*range(len(px))]
    return half(range(len(px)))[:-1] + half(range(len(px) - 1, -1, -1))[:-1]


def _by_key(b: pa.RecordBatch) -> Iterator[tuple[pa.Scalar, np.ndarray, np.ndarray]]:
    coded = b.column(0).dictionary_encode(null_encoding="encode")
    code = coded.indices.to_numpy()
    x, y = (b.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (1, 2))
    order = np.argsort(code, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
        if len(own):
            yield coded.dictionary[int(code[own[0]])], x[own], y[own]


def hulls(points: DataFrame, key: str, x: str, y: str, fans: int = 16) -> DataFrame:
    """key, n (corners), area and corners (against the clock) of the hull of each key's points.

    Points with a null or NaN coordinate don't count; fewer than three different points, or points on a line, have no
    area. Every task sends the corners of its own points only; those of a key are put together in ``fans`` tasks before
    one, so a key of very many points is work for all.
    """
    own = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    own = own.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    kind = dict(own.dtypes)["key"]

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, a, c in _by_key(b):
                at = hull(a, c)
                yield pa.RecordBatch.from_arrays([pa.repeat(k, len(at)), pa.array(a[at]), pa.array(c[at])], _NAMES)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for k, a, c in _by_key(table.combine_chunks().to_batches()[0]):
                at = hull(a, c)
                a, c = a[at] - a[at[0]], c[at] - c[at[0]]
                area = abs(float((a * np.roll(c, -1) - np.roll(a, -1) * c).sum())) / 2 if len(at) > 2 else 0.0
                corners = pa.array([[{"x": float(i), "y": float(j)} for i, j in zip(a + 0.0, c + 0.0, strict=True)]], _CORNERS)
                yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], k.type), pa.array([len(at)], pa.int32()), pa.array([area]), corners], ["key", "n", "area", "corners"])

        for b in batches:  # sorted by key; the last key may go on
            if not b.num_rows:
                continue
            held.append(b)
            table = pa.Table.from_batches(held)
            same = [i for i in range(b.num_rows - 1, -1, -1) if b.column(0)[i] != b.column(0)[b.num_rows - 1]][:1]
            if same:
                cut = table.num_rows - (b.num_rows - same[0] - 1)
                yield from out(table.slice(0, cut))
                held = table.slice(cut).to_batches()
        if held:
            yield from out(pa.Table.from_batches(held))

    schema = f"key {kind}, x double, y double"
    few = own.mapInArrow(partial, schema).withColumn("fan", F.pmod(F.xxhash64("x", "y"), F.lit(fans)))
    few = few.repartition("key", "fan").drop("fan").mapInArrow(partial, schema)
    return few.repartition("key").sortWithinPartitions("key").mapInArrow(whole, f"key {kind}, n int, area double, corners array<struct<x: double, y: double>>")


_CORNERS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))


# queries


def hull_by_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each track's values against the ones before them, in hundredths."""
    t = tracks(spark, sf_dir).select("track", F.round(F.col("raw") * 100).alias("x"), F.round(F.lag("raw").over(by_frame()) * 100).alias("y"))
    return hulls(t, "track", "x", "y").select(F.col("key").alias("track"), "n", "area")


HULL_BY_TRACK = f"""
with {TRACKS}, p as (select distinct track, round(raw * 100)::bigint as x, round(lag(raw) over (partition by track order by frame) * 100)::bigint as y from t),
q as (select * from p where y is not null),
e as (select a.track, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from q a join q b on a.track = b.track and (a.x <> b.x or a.y <> b.y)),
s as (select e.* from e join q on q.track = e.track group by all
  having bool_and((x2 - x1) * (q.y - y1) - (y2 - y1) * (q.x - x1) > 0 or ((x2 - x1) * (q.y - y1) - (y2 - y1) * (q.x - x1) = 0
    and (q.x - x1) * (q.x - x2) + (q.y - y1) * (q.y - y2) <= 0)))
select track, count(*)::int as n, sum(x1 * y2 - x2 * y1)::double / 2 as area from s group by 1
"""

QUERIES = {"hull_by_track": (hull_by_track, HULL_BY_TRACK)}
