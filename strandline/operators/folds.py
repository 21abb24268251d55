"""Operators that need a track's state from frame to frame: smoothing filters, segmentation, spacing.

Linear recursions stream through ``solvers.linear``; what needs whole tracks works on many of them at once by
``solvers.per_batch``, with array steps over all their rows.
"""

from __future__ import annotations

import functools
import heapq
import math
import operator
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import solvers
from strandline.operators.sequences import ema, fill, median_window, weighted_window
from strandline.session import TRACKS, by_frame, tracks

_FILLED = f"""
{TRACKS}, f as (select *, coalesce(last_value(v ignore nulls) over (partition by track order by frame rows between unbounded preceding and current row),
  first_value(v ignore nulls) over (partition by track order by frame rows between current row and unbounded following)) as filled from t)
"""


class OneEuro:
    """Low-pass whose cut-off rises with the speed of the filtered signal; a missing value repeats the last result."""

    def __init__(self, least: float = 1.0, beta: float = 0.007, speed: float = 1.0, rate: float = 30.0):
        self.least, self.beta, self.speed, self.rate = least, beta, speed, rate

    def _alpha(self, cutoff: np.ndarray | float) -> np.ndarray | float:
        return 1 / (1 + self.rate / (2 * math.pi * cutoff))

    def __call__(self, k: int, state: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        last, dx = state
        a = self._alpha(self.speed)
        new = a * (x - last) * self.rate + (1 - a) * dx
        a = self._alpha(self.least + self.beta * np.abs(new))
        y = a * x + (1 - a) * last
        begins, missing = np.isnan(last), np.isnan(x)
        y = np.where(missing, last, np.where(begins, x, y))
        return y, [y, np.where(missing, dx, np.where(begins, 0.0, new))]


class ClampedShift:
    """Mean that moves towards each value by at most ``most``, and towards zero where there is none."""

    def __init__(self, alpha: float = 0.3, most: float = 40.0, decay: float = 0.9):
        self.alpha, self.most, self.decay = alpha, most, decay

    def __call__(self, k: int, state: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        (y,) = state
        y = np.where(np.isnan(x), y * self.decay, y + np.clip(self.alpha * (x - y), -self.most, self.most))
        return y, [y]


def recursion(df: DataFrame, column: str, out: str, step: Callable[..., tuple[np.ndarray, list[np.ndarray]]], state: list[float], dealt: bool = False) -> DataFrame:
    """track, frame and ``out`` by a recursion that all tracks of a batch go through frame by frame together."""
    return solvers.per_batch(df, [column], out, lambda first, x: solvers.lockstep(first, step, state, x), dealt=dealt)


def motion_mean(df: DataFrame, column: str, out: str, strength: float = 0.8, sensitivity: float = 0.02) -> DataFrame:
    """Smooths less where the signal moves, on and back, and takes the mean of both.

    y = a * y before + (1 - a) * x with a = strength * exp(-sensitivity * |x - x before|), of the values as they come in,
    so the recursion is linear. A missing value repeats y, and the next one's motion is from the last known.
    """
    w = by_frame()
    x = F.col(column)
    for name, near, backward in (("_on", F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), False), ("_back", F.first(column, True).over(w.rowsBetween(1, Window.unboundedFollowing)), True)):
        df = df.withColumn(f"{name}_a", F.when(x.isNotNull(), strength * F.exp(-sensitivity * F.abs(x - near))))
        df = df.withColumn(f"{name}_b", (1 - F.col(f"{name}_a")) * x)
    df = solvers.linear(df.withColumn("_x", x), "_on_a", "_on_b", "_on", seed="_x", dealt=True)
    df = solvers.linear(df, "_back_a", "_back_b", "_back", True, "_x")
    return df.withColumn(out, (F.col("_on") + F.col("_back")) / 2).drop("_x", *[f"{n}{k}" for n in ("_on", "_back") for k in ("", "_a", "_b")])


def gaussian(x: np.ndarray, sigma: float = 1.25) -> np.ndarray:
    """Weights cut at four sigma; the outermost values stand for those beyond the ends."""
    r = int(4 * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), w / w.sum(), mode="valid")


def median_filter(x: np.ndarray, size: int = 5) -> np.ndarray:
    half = size // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="edge"), size), axis=1)


def merge_short(labels: np.ndarray, values: np.ndarray, least: int = 3) -> np.ndarray:
    """Joins segments shorter than ``least``, smallest first, to the neighbour whose mean is nearer as a ratio.

    Segments wait in a heap by size and place and are linked to their neighbours, so a track takes n log n steps. Sums run
    from frame to frame, as in SQL, as their last bits decide between neighbours at equal ratios; a missing value adds nothing.
    """
    first = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1]) if len(labels) else np.zeros(0, int)
    size = np.diff(np.append(first, len(labels))).tolist()
    known = np.where(np.isnan(values), 0.0, values).tolist()
    total = [functools.reduce(operator.add, known[a : a + n]) for a, n in zip(first.tolist(), size, strict=True)]
    left, right = list(range(-1, len(first) - 1)), [*range(1, len(first)), -1]
    heap = [(n, k) for k, n in enumerate(size) if n < least]
    heapq.heapify(heap)
    alive = [True] * len(first)
    while heap:
        n, k = heapq.heappop(heap)
        if not alive[k] or size[k] != n:
            continue
        mean = {j: max(total[j] / size[j], 1e-6) for j in (left[k], k, right[k]) if j >= 0}
        near = [(abs(math.log(mean[j] / mean[k])), j) for j in mean if j != k]
        if not near:
            break
        j = min(near)[1]
        a, b = min(j, k), max(j, k)  # the left one stays
        size[a], total[a], right[a], alive[b] = size[a] + size[b], total[a] + total[b], right[b], False
        if right[b] >= 0:
            left[right[b]] = a
        if size[a] < least:
            heapq.heappush(heap, (size[a], a))
    out = np.zeros(len(labels))
    for i, k in enumerate(k for k in range(len(first)) if alive[k]):
        out[first[k] : first[k] + size[k]] = i
    return out


def convex_hull_area(points: list[tuple[float, float]]) -> float:
    """0 for fewer than three points."""
    own = sorted(set(points))
    if len(own) < 3:
        return 0.0

    def half(ps: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in ps:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out

    ring = half(own)[:-1] + half(reversed(own))[:-1]
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def components(mask: np.ndarray, eight: bool = True) -> np.ndarray:
    """Labels from 1 of the connected set cells of a 2-D mask, by repeated spreading of the least label."""
    big = mask.size + 1
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), big)
    while True:
        p = np.pad(label, 1, constant_values=big)
        near = [p[1:-1, 1:-1], p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]
        if eight:
            near += [p[:-2, :-2], p[:-2, 2:], p[2:, :-2], p[2:, 2:]]
        new = np.where(mask, np.minimum.reduce(near), big)
        if (new == label).all():
            break
        label = new
    _, back = np.unique(np.where(label == big, 0, label), return_inverse=True)
    return back.reshape(mask.shape) + (0 if (label == big).any() else 1)


# queries


def _rounded(df: DataFrame, column: str, digits: int = 4) -> DataFrame:
    return df.select("track", "frame", F.round(column, digits).alias(column))


def ema_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ema(fill(tracks(spark, sf_dir)), "filled", "ema", dealt=True)
    return e.groupBy("track").agg(F.round(F.max_by("ema", "frame"), 4).alias("ema"))


EMA_LAST = f"""
with {_FILLED}, l as (select track, list(filled order by frame) x from f group by 1)
select track, round(list_reduce(x, lambda a, x: 0.7 * a + 0.3 * x), 4) as ema from l
"""


def ema_bidirectional(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the first pass leaves tracks where they are; only their order is turned
    both = ema(ema(fill(tracks(spark, sf_dir)), "filled", "a", dealt=True), "filled", "b", backward=True, dealt=True)
    return _rounded(both.withColumn("ema", (F.col("a") + F.col("b")) / 2), "ema")


EMA_BIDIRECTIONAL = f"""
with {_FILLED}, l as (select track, frame, list(filled) over (partition by track order by frame rows between unbounded preceding and current row) b,
  list_reverse(list(filled) over (partition by track order by frame rows between current row and unbounded following)) o from f)
select track, frame, round((list_reduce(b, lambda a, x: 0.7 * a + 0.3 * x) + list_reduce(o, lambda a, x: 0.7 * a + 0.3 * x)) / 2, 4) as ema from l
"""


def one_euro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(recursion(fill(tracks(spark, sf_dir)), "filled", "smooth", OneEuro(), [math.nan, 0.0], True), "smooth")


ONE_EURO = f"""
with recursive {_FILLED}, r as (
  select track, frame, filled as x, 0.0::double as dx from f where frame = 0
  union all
  select track, frame, a * filled + (1 - a) * x, dx from (
    select f.track, f.frame, f.filled, r.x, d.dx, 1 / (1 + 30 / (2 * pi() * (1.0 + 0.007 * abs(d.dx)))) as a
    from r join f on f.track = r.track and f.frame = r.frame + 1,
      lateral (select (1 / (1 + 30 / (2 * pi()))) * (f.filled - r.x) * 30 + (1 - 1 / (1 + 30 / (2 * pi()))) * r.dx as dx) d)
)
select track, frame, round(x, 4) as smooth from r
"""


def clamped_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recursion(tracks(spark, sf_dir), "v", "shift", ClampedShift(), [0.0], True)
    return _rounded(found.withColumn("shift", F.col("shift") + 1e-7), "shift")


CLAMPED_SHIFT = f"""
with {TRACKS}, l as (select track, frame, list_prepend(0.0, list(coalesce(v, -1.0)) over (partition by track order by frame rows between unbounded preceding and current row)) x from t)
select track, frame, round(list_reduce(x, lambda a, x: case when x < 0 then a * 0.9 else a + greatest(-40.0, least(40.0, 0.3 * (x - a))) end) + 1e-7, 4) as shift from l
"""


def motion_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(motion_mean(fill(tracks(spark, sf_dir)), "filled", "smooth"), "smooth")


MOTION_EMA = f"""
with recursive {_FILLED}, d as (select track, frame, filled as x, 0.8 * exp(-0.02 * abs(filled - lag(filled) over w)) as a, 0.8 * exp(-0.02 * abs(filled - lead(filled) over w)) as b,
  count(*) over (partition by track) as n from f window w as (partition by track order by frame)),
o as (select track, frame, x as y from d where frame = 0
  union all select d.track, d.frame, a * y + (1 - a) * x from o join d on d.track = o.track and d.frame = o.frame + 1),
r as (select track, frame, x as y from d where frame = n - 1
  union all select d.track, d.frame, b * y + (1 - b) * x from r join d on d.track = r.track and d.frame = r.frame - 1)
select track, frame, round((o.y + r.y) / 2, 4) as smooth from o join r using (track, frame)
"""


def _ratio_segments(first: np.ndarray, raw: np.ndarray) -> np.ndarray:
    return solvers.numbered(first, solvers.ratio_breaks(first, raw, 0.7, every=True))


def greedy_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of which no value is off the mean so far by a factor of two or more; zero is off any mean, also of zeros."""
    s = solvers.per_batch(tracks(spark, sf_dir), ["raw"], "segment", _ratio_segments, dealt=True)
    return s.groupBy("track", F.col("segment").cast("long").alias("segment")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


GREEDY_SEGMENTS = f"""
with recursive {TRACKS}, r as (
  select track, frame, 0::bigint k, raw as mean, 1::bigint n from t where frame = 0
  union all
  select track, frame, case when cut then k + 1 else k end, case when cut then raw else mean + (raw - mean) / (n + 1) end, case when cut then 1 else n + 1 end
  from (select t.track, t.frame, t.raw, r.k, r.mean, r.n, abs(ln(t.raw / r.mean)) > 0.7 as cut from r join t on t.track = r.track and t.frame = r.frame + 1)
)
select track, k as segment, min(frame) as first, max(frame) as last from r group by 1, 2
"""


def deadband_segments(spark: SparkSession, sf_dir: str, radius: float = 60.0) -> DataFrame:
    """Stretches held at one value: their spread is within 2 * radius and all frames' bounds have a point in common.

    The value is the stretch's mean, moved into the common bounds; a frame's bounds are 40 to 100 on either side. Values
    of two decimals often meet a bound exactly, where the last bit decides, so bounds are added up as the SQL does.
    """
    raw, more = F.col("raw"), 10 * (F.col("frame") % 7)
    t = tracks(spark, sf_dir).select("track", "frame", "raw", (raw - (40.0 + more)).alias("lower"), (raw + 40.0 + more).alias("upper"))

    def of(first: np.ndarray, x: np.ndarray, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        return solvers.numbered(first, solvers.deadband_breaks(first, x, lower, upper, radius))

    s = solvers.per_batch(t.withColumn("_raw", raw), ["raw", "lower", "upper"], "segment", of, dealt=True, keep=["_raw"])
    raw = F.col("_raw")
    s = s.groupBy("track", F.col("segment").cast("long").alias("segment")).agg(
        F.min("frame").alias("first"), F.max("frame").alias("last"), F.avg(raw).alias("mean"), F.max(raw - (40.0 + more)).alias("low"), F.min(raw + 40.0 + more).alias("high"),
    )
    return s.select("track", "segment", "first", "last", F.round(F.greatest("low", F.least("high", "mean")) + 1e-7, 4).alias("value"))


DEADBAND_SEGMENTS = f"""
with recursive {TRACKS}, b as (select track, frame, raw, raw - (40.0 + 10 * (frame % 7)) as lower, raw + 40.0 + 10 * (frame % 7) as upper from t), r as (
  select track, frame, 0::bigint k, raw as lo, raw as hi, lower as low, upper as high from b where frame = 0
  union all
  select track, frame, case when cut then k + 1 else k end, case when cut then raw else least(lo, raw) end, case when cut then raw else greatest(hi, raw) end,
    case when cut then lower else greatest(low, lower) end, case when cut then upper else least(high, upper) end
  from (select b.*, r.k, r.lo, r.hi, r.low, r.high, greatest(r.hi, b.raw) - least(r.lo, b.raw) > 120 or greatest(r.low, b.lower) > least(r.high, b.upper) as cut
    from r join b on b.track = r.track and b.frame = r.frame + 1)
)
select r.track, k as segment, min(frame) as first, max(frame) as last, round(greatest(max(b.lower), least(min(b.upper), avg(b.raw))) + 1e-7, 4) as value
from r join b using (track, frame) group by 1, 2
"""


def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = [math.exp(-0.5 * (k / 1.25) ** 2) for k in range(-5, 6)]
    return _rounded(weighted_window(fill(tracks(spark, sf_dir)), "filled", "smooth", [w / sum(weights) for w in weights]), "smooth")


GAUSSIAN_SMOOTH = f"""
with {_FILLED}, b as (select track, max(frame) last from f group by 1),
p as (select f.track, f.frame, k, least(greatest(f.frame + k, 0), b.last) src, exp(-0.5 * (k / 1.25) * (k / 1.25)) w from f join b on f.track = b.track, generate_series(-5, 5) g(k))
select p.track, p.frame, round(sum(w * f.filled) / sum(w), 4) as smooth from p join f on f.track = p.track and f.frame = p.src group by 1, 2
"""


def median_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(median_window(fill(tracks(spark, sf_dir)), "filled", "smooth"), "smooth")


MEDIAN_SMOOTH = f"""
with {_FILLED}, b as (select track, max(frame) last from f group by 1),
p as (select f.track, f.frame, least(greatest(f.frame + k, 0), b.last) src from f join b on f.track = b.track, generate_series(-2, 2) g(k))
select p.track, p.frame, round(median(f.filled), 4) as smooth from p join f on f.track = p.track and f.frame = p.src group by 1, 2
"""


def median_then_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single outliers go by the median before the rest is smoothed."""
    weights = [math.exp(-0.5 * (k / 1.25) ** 2) for k in range(-5, 6)]
    t = median_window(fill(tracks(spark, sf_dir)), "filled", "calm")
    return _rounded(weighted_window(t, "calm", "smooth", [w / sum(weights) for w in weights]), "smooth")


MEDIAN_THEN_GAUSSIAN = f"""
with {_FILLED}, b as (select track, max(frame) last from f group by 1),
p as (select f.track, f.frame, least(greatest(f.frame + k, 0), b.last) src from f join b on f.track = b.track, generate_series(-2, 2) g(k)),
c as (select p.track, p.frame, median(f.filled) as calm from p join f on f.track = p.track and f.frame = p.src group by 1, 2),
q as (select c.track, c.frame, least(greatest(c.frame + k, 0), b.last) src, exp(-0.5 * (k / 1.25) * (k / 1.25)) w from c join b on c.track = b.track, generate_series(-5, 5) g(k))
select q.track, q.frame, round(sum(w * c.calm) / sum(w), 4) as smooth from q join c on c.track = q.track and c.frame = q.src group by 1, 2
"""


def crop_path(spark: SparkSession, sf_dir: str, margin: float = 16.0) -> DataFrame:
    """The smoothest path that stays within ``margin`` of each track; missing frames do not pull."""

    def solve(first: np.ndarray, filled: np.ndarray, v: np.ndarray) -> np.ndarray:
        c = np.nan_to_num(filled)
        path = solvers.smooth_paths(first, c, c - margin, c + margin, (~np.isnan(v)).astype(float))
        return np.where(np.isnan(filled), np.nan, path)

    return _rounded(solvers.per_batch(fill(tracks(spark, sf_dir)), ["filled", "v"], "path", solve, dealt=True), "path", 2)


def keyframes_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of each track, the highest first, no two closer than five frames; all frames count, not local maxima alone."""

    def keep(first: np.ndarray, x: np.ndarray) -> np.ndarray:
        return solvers.spaced(first, x, 5, maxima=False).astype(float)

    found = solvers.per_batch(tracks(spark, sf_dir), ["raw"], "kept", keep, dealt=True)
    return found.where("kept = 1").select("track", "frame")


KEYFRAMES_SPACED = f"""
with recursive {TRACKS}, o as (select track, frame, row_number() over (partition by track order by raw desc, frame) k from t),
r as (
  select track, 0::bigint k, []::bigint[] kept from o group by track
  union all
  select r.track, o.k, case when len(list_filter(r.kept, lambda x: abs(x - o.frame) < 5)) = 0 then list_append(r.kept, o.frame) else r.kept end
  from r join o on o.track = r.track and o.k = r.k + 1
), z as (select track, max_by(kept, k) kept from r group by 1)
select track, unnest(kept) as frame from z
"""


def endpoints(df: DataFrame, motion: str, sharp: str, least: float, window: int = 12, strict: bool = False) -> DataFrame:
    """track, first, last: the calmest sharp frame of the first ``window`` + 1 frames and of the last ones.

    Sharp is a frame whose column ``sharp`` is ``least`` or more; of equally calm ones the outermost counts. Where there
    is none the column is null or, with ``strict``, the query fails and names the track.
    """
    n = df.groupBy("track").agg(F.max("frame").alias("_last"))
    ok = (F.col(sharp) >= least) & F.col(motion).isNotNull()
    near = df.join(n, "track")
    first = F.min_by("frame", F.when(ok & (F.col("frame") <= window), F.struct(motion, "frame")))
    last = F.min_by("frame", F.when(ok & (F.col("frame") >= F.col("_last") - window), F.struct(motion, -F.col("frame"))))
    found = near.groupBy("track").agg(first.alias("first"), last.alias("last"))
    if strict:
        fail = F.raise_error(F.concat(F.lit("no sharp frame near an end of track "), F.col("track").cast("string"))).cast("long")
        found = found.withColumn("first", F.coalesce("first", fail)).withColumn("last", F.coalesce("last", fail))
    return found


def keyframe_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motion is the change from the frame before, sharpness the value's last two digits."""
    t = tracks(spark, sf_dir)
    t = t.withColumn("motion", F.abs(F.col("raw") - F.lag("raw").over(by_frame()))).withColumn("sharp", F.floor("raw") % 100)
    return endpoints(t, "motion", "sharp", 40)


KEYFRAME_ENDPOINTS = f"""
with {TRACKS}, m as (select track, frame, abs(raw - lag(raw) over (partition by track order by frame)) as motion, floor(raw)::bigint % 100 as sharp, max(frame) over (partition by track) as n from t),
a as (select track, frame, row_number() over (partition by track order by motion, frame) as k from m where motion is not null and sharp >= 40 and frame <= 12),
b as (select track, frame, row_number() over (partition by track order by motion, frame desc) as k from m where motion is not null and sharp >= 40 and frame >= n - 12)
select m.track, max(a.frame) as first, max(b.frame) as last from (select distinct track from m) m left join a on a.track = m.track and a.k = 1 left join b on b.track = m.track and b.k = 1 group by 1
"""


def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy segments after short ones have been joined to a neighbour."""

    def both(first: np.ndarray, x: np.ndarray) -> np.ndarray:
        labels = _ratio_segments(first, x)
        return np.concatenate([merge_short(labels[a:b], x[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)])

    s = solvers.per_batch(tracks(spark, sf_dir), ["raw"], "segment", both, dealt=True)
    return s.groupBy("track", F.col("segment").cast("long").alias("segment")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))


MERGED_SEGMENTS = f"""
with recursive {TRACKS}, r as (
  select track, frame, 0::bigint k, raw as total, 1::bigint n, raw from t where frame = 0
  union all
  select track, frame, case when cut then k + 1 else k end, case when cut then raw else total + raw end, case when cut then 1 else n + 1 end, raw
  from (select t.track, t.frame, t.raw, r.k, r.total, r.n, abs(ln(t.raw / (r.total / r.n))) > 0.7 as cut from r join t on t.track = r.track and t.frame = r.frame + 1)
), g as (select track, k, count(*) as n, sum(raw) as total from r group by 1, 2),
m as (
  select track, list(n order by k) as n, list(total order by k) as total from g group by 1
  union all
  select track, n[:i - 1] || [n[i] + n[i + 1]] || n[i + 2:], total[:i - 1] || [total[i] + total[i + 1]] || total[i + 2:] from (
    select track, n, total, case when k = 1 then 1 when k = len(n) then k - 1
      when abs(ln(greatest(total[k - 1] / n[k - 1], 1e-6) / greatest(total[k] / n[k], 1e-6))) <= abs(ln(greatest(total[k + 1] / n[k + 1], 1e-6) / greatest(total[k] / n[k], 1e-6))) then k - 1 else k end as i
    from (select *, list_position(n, list_min(n)) as k from m where len(n) > 1 and list_min(n) < 3))
), z as (select track, arg_min(n, len(n)) as n from m group by 1),
u as (select track, generate_subscripts(n, 1) - 1 as segment, unnest(n) as n from z)
select track, segment, (sum(n) over w - n)::bigint as first, (sum(n) over w - 1)::bigint as last from u window w as (partition by track order by segment)
"""


def region_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as an 8 x 8 mask: number of regions, size of the largest, and cells that stay with the two largest of two cells or more."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = [np.bincount(components(np.asarray(v, np.float32).reshape(8, 8) > np.float32(0.05)).ravel())[1:] for v in b["embedding"]]
            kept = [int(sum(sorted((n for n in s if n >= 2), reverse=True)[:2])) for s in sizes]
            yield pd.DataFrame({"vec_id": b["vec_id"], "regions": [len(s) for s in sizes], "largest": [int(max(s, default=0)) for s in sizes], "kept": kept})

    return rows.mapInPandas(run, "vec_id long, regions int, largest int, kept int")


REGION_COMPONENTS = """
with recursive c as (select vec_id, k, k // 8 as r, k % 8 as q from (select vec_id, generate_subscripts(embedding, 1) - 1 as k, unnest(embedding) as x from embeddings) where x > 0.05::float),
n as (select a.vec_id, a.k as a, b.k as b from c a join c b on a.vec_id = b.vec_id and a.k <> b.k and abs(a.r - b.r) <= 1 and abs(a.q - b.q) <= 1),
t as (select vec_id, k, k as root from c union select t.vec_id, n.b, t.root from t join n on n.vec_id = t.vec_id and n.a = t.k),
g as (select vec_id, root, count(*) as cells from (select vec_id, k, min(root) as root from t group by 1, 2) group by 1, 2),
o as (select *, row_number() over (partition by vec_id order by cells desc) as place from g)
select e.vec_id, count(o.root)::int as regions, coalesce(max(o.cells), 0)::int as largest, coalesce(sum(o.cells) filter (where o.place <= 2 and o.cells >= 2), 0)::int as kept
from embeddings e left join o on o.vec_id = e.vec_id group by e.vec_id
"""

QUERIES = {
    "ema_last": (ema_last, EMA_LAST),
    "ema_bidirectional": (ema_bidirectional, EMA_BIDIRECTIONAL),
    "one_euro": (one_euro, ONE_EURO),
    "clamped_shift": (clamped_shift, CLAMPED_SHIFT),
    "motion_ema": (motion_ema, MOTION_EMA),
    "greedy_segments": (greedy_segments, GREEDY_SEGMENTS),
    "deadband_segments": (deadband_segments, DEADBAND_SEGMENTS),
    "gaussian_smooth": (gaussian_smooth, GAUSSIAN_SMOOTH),
    "median_smooth": (median_smooth, MEDIAN_SMOOTH),
    "median_then_gaussian": (median_then_gaussian, MEDIAN_THEN_GAUSSIAN),
    "crop_path": (crop_path, None),
    "keyframes_spaced": (keyframes_spaced, KEYFRAMES_SPACED),
    "keyframe_endpoints": (keyframe_endpoints, KEYFRAME_ENDPOINTS),
    "merged_segments": (merged_segments, MERGED_SEGMENTS),
    "region_components": (region_components, REGION_COMPONENTS),
}
