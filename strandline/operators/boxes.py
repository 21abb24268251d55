"""Boxes over time: a constant-velocity Kalman filter with smoothing, in blocks of frames that are put together by scans.

The state is a box's centre and size with a velocity each, eight numbers; motion and noise do not couple the four
coordinates, so each is a filter of two numbers and their covariance. A block of frames acts on the state before it as
one element (A, b, C, eta, J), on the state behind it as one pair (E, g), and elements are associative: a track's blocks
are worked on in any tasks, only their elements are put in order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.sequences import fill
from strandline.session import TRACKS, tracks, work_dir

#: Frames of a block; tracks below LEAST frames are smoothed by the one-euro filter instead.
BLOCK, LEAST = 256, 10
#: Noise of acceleration and of measurement: centre x and y, width, height.
Q, R = np.array([4.0, 4.0, 1.0, 1.0]), np.array([9.0, 9.0, 25.0, 25.0])
CORNERS = ["x1", "y1", "x2", "y2"]
_STEP = np.array([[1.0, 1.0], [0.0, 1.0]])


def _noise(q: np.ndarray) -> np.ndarray:
    return q[:, None, None] * np.array([[0.25, 0.5], [0.5, 1.0]])


def _inv(m: np.ndarray) -> np.ndarray:
    a, b, c, d = m[..., 0, 0], m[..., 0, 1], m[..., 1, 0], m[..., 1, 1]
    out = np.stack([np.stack([d, -b], -1), np.stack([-c, a], -1)], -2)
    return out / (a * d - b * c)[..., None, None]


def _t(m: np.ndarray) -> np.ndarray:
    return np.swapaxes(m, -1, -2)


def _v(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (m @ x[..., None])[..., 0]


Element = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def combine(i: Element, j: Element) -> Element:
    """The element of stretch i followed by stretch j."""
    a, b, c, eta, info = i
    a2, b2, c2, eta2, info2 = j
    eye = np.eye(2)
    on = a2 @ _inv(eye + c @ info2)
    back = _t(a) @ _inv(eye + info2 @ c)
    return on @ a, _v(on, b + _v(c, eta2)) + b2, on @ c @ _t(a2) + c2, _v(back, eta2 - _v(info2, b)) + eta, back @ info2 @ a + info


def elements(z: np.ndarray, present: np.ndarray) -> Element:
    """Of single frames: z (n, 4), present (n)."""
    n = len(z)
    eye, q = np.eye(2), _noise(Q)
    s = Q * 0.25 + R
    gain = q[:, :, 0] / s[:, None]  # (4, 2)
    keep = eye - gain[:, :, None] * np.array([1.0, 0.0])
    seen = present[:, None, None, None]
    a = np.where(seen, keep @ _STEP, _STEP)
    c = np.where(seen, keep @ q, q)
    info = np.where(seen, np.ones((2, 2)) / s[:, None, None], 0.0)
    z = np.where(present[:, None], z, 0.0)
    return np.broadcast_to(a, (n, 4, 2, 2)), gain * z[..., None], c, np.repeat((z / s)[..., None], 2, -1), info


def compose(first: np.ndarray, z: np.ndarray, present: np.ndarray) -> Element:
    """One element for each stretch ``first[k]:first[k + 1]``: neighbours are put together pair by pair."""
    now = elements(z, present)
    n = np.diff(first)
    while n.max(initial=0) > 1:
        begin = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(begin, n)
        even = np.flatnonzero(inner % 2 == 0)
        paired = np.flatnonzero(inner % 2)
        both = combine(tuple(x[paired - 1] for x in now), tuple(x[paired] for x in now))
        new = tuple(x[even].copy() for x in now)
        place = np.searchsorted(even, paired - 1)
        for x, y in zip(new, both, strict=True):
            x[place] = y
        now, n = new, -(-n // 2)
    return now


def start(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State before a track's first frame: the first box seen, at rest."""
    m = np.stack([z, np.zeros_like(z)], -1)
    p = np.zeros((4, 2, 2))
    p[:, 0, 0], p[:, 1, 1] = R, 10 * Q
    return m, np.broadcast_to(p, (*z.shape[:-1], 4, 2, 2))


def advance(m: np.ndarray, p: np.ndarray, e: Element) -> tuple[np.ndarray, np.ndarray]:
    """State behind a stretch from the one before it."""
    a, b, c, eta, info = e
    on = a @ _inv(np.eye(2) + p @ info)
    return _v(on, m + _v(p, eta)) + b, on @ p @ _t(a) + c


class Filtered:
    """Forward pass over stretches from a state each, all stretches frame by frame together."""

    def __init__(self, first: np.ndarray, z: np.ndarray, present: np.ndarray, m: np.ndarray, p: np.ndarray):
        self.n = np.diff(first)
        self.order = np.argsort(-self.n, kind="stable")
        self.begin = first[:-1][self.order]
        rows = len(z)
        self.m, self.p = np.empty((rows, 4, 2)), np.empty((rows, 4, 2, 2))
        q = _noise(Q)
        m, p = m[self.order], p[self.order]
        for at in self.steps():
            m, p = _v(_STEP, m[: len(at)]), _STEP @ p[: len(at)] @ _STEP.T + q
            gain = p[..., 0] / (p[..., 0, 0] + R)[..., None] * present[at][:, None, None]
            m = m + gain * (np.where(present[at][:, None], z[at], 0.0) - m[..., 0])[..., None]
            p = p - gain[..., :, None] * p[..., 0, None, :]
            self.m[at], self.p[at] = m, p
        # from a frame to the next: x = g + E (x of the next)
        ahead = _STEP @ self.p @ _STEP.T + q
        self.e = self.p @ _STEP.T @ _inv(ahead)
        self.g = self.m - _v(self.e, _v(_STEP, self.m))

    def steps(self) -> Iterator[np.ndarray]:
        n = self.n[self.order]
        for k in range(int(n[0]) if len(n) else 0):
            yield self.begin[: int(np.searchsorted(-n, -k, "left"))] + k

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(E, g) of each stretch: the smoothed state of its first frame from that of the frame behind its last."""
        e, g = np.broadcast_to(np.eye(2), (len(self.n), 4, 2, 2)).copy(), np.zeros((len(self.n), 4, 2))
        for at in self.steps():
            k = len(at)
            g[:k], e[:k] = g[:k] + _v(e[:k], self.g[at]), e[:k] @ self.e[at]
        back = np.argsort(self.order)
        return e[back], g[back]

    def smoothed(self, behind: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Means (rows, 4) from the smoothed states behind the stretches; where ``ends`` none stands behind."""
        out = np.empty_like(self.m)
        now, last = behind[self.order].copy(), self.n[self.order] - 1
        for k, at in reversed([*enumerate(self.steps())]):
            stop = (last[: len(at)] == k) & ends[self.order][: len(at)]
            now[: len(at)] = np.where(stop[:, None, None], self.m[at], self.g[at] + _v(self.e[at], now[: len(at)]))
            out[at] = now[: len(at)]
        return out[..., 0]


def one_euro(first: np.ndarray, x: np.ndarray, least: float = 0.05, beta: float = 0.7, speed: float = 1.0) -> np.ndarray:
    """Low-pass of each column of x whose cut-off, in parts of the frame rate, rises with its speed."""
    alpha = lambda c: 2 * math.pi * c / (2 * math.pi * c + 1)
    out, n = x.copy(), np.diff(first)
    dx = np.zeros((len(n), x.shape[1]))
    for k in range(1, int(n.max(initial=0))):
        live = np.flatnonzero(n > k)
        at = first[:-1][live] + k
        d = x[at] - out[at - 1]
        dx[live] = alpha(speed) * d + (1 - alpha(speed)) * dx[live]
        a = alpha(least + beta * np.abs(dx[live]))
        out[at] = a * x[at] + (1 - a) * out[at - 1]
    return out


def _centres(c: np.ndarray) -> np.ndarray:
    return np.stack([(c[:, 0] + c[:, 2]) / 2, (c[:, 1] + c[:, 3]) / 2, c[:, 2] - c[:, 0], c[:, 3] - c[:, 1]], 1)


def _corners(z: np.ndarray) -> np.ndarray:
    w, h = np.maximum(z[:, 2], 1.0), np.maximum(z[:, 3], 1.0)
    return np.stack([z[:, 0] - w / 2, z[:, 1] - h / 2, z[:, 0] + w / 2, z[:, 1] + h / 2], 1)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, frames, present, corners) of a batch of blocks."""
    rows = b.column(b.schema.names.index("rows"))
    flat = rows.flatten()
    first = np.append(0, np.cumsum(rows.value_lengths().to_numpy())).astype(int)
    get = lambda c: flat.field(c).to_numpy(zero_copy_only=False)
    return first, get("frame"), get("present").astype(bool), np.stack([get(c) for c in CORNERS], 1)


def _doubles(b: pa.RecordBatch, name: str, shape: tuple[int, ...]) -> np.ndarray:
    """A column of arrays of doubles; zeros for null."""
    own = b.column(b.schema.names.index(name))
    out = np.zeros((b.num_rows, math.prod(shape)))
    some = np.flatnonzero(own.is_valid().to_numpy(zero_copy_only=False))
    if len(some):
        out[some] = own.drop_null().flatten().to_numpy().reshape(len(some), -1)
    return out.reshape(b.num_rows, *shape)


def _lists(x: np.ndarray) -> pa.Array:
    flat = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))


_SHAPES = [(4, 2, 2), (4, 2), (4, 2, 2), (4, 2), (4, 2, 2)]


def _in_order(df: DataFrame, backward: bool, start_: Callable[[dict], tuple], on: Callable[[tuple, dict], tuple], out: Callable[[tuple], list[float]]) -> DataFrame:
    """track, block, state: for each block the state that the blocks before it (behind it) have made; a block at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: object = ()
        state: tuple = ()
        for b in batches:
            rows = b.to_pylist()
            made = []
            for r in rows:
                if known != (r["track"],):
                    known, state = (r["track"],), start_(r)
                made.append(out(state))
                state = on(state, r)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.list_(pa.float64()))], ["track", "block", "state"])

    order = F.desc("block") if backward else F.asc("block")
    return df.repartition("track").sortWithinPartitions("track", order).mapInArrow(run, "track long, block long, state array<double>")


def smooth(df: DataFrame, block: int = BLOCK, least: int = LEAST) -> DataFrame:
    """track, frame, x1, y1, x2, y2: boxes of a track after the filter has run on and the smoother back.

    ``df`` has track, frame (numbers from 0 without a gap), the corners, and present: where it is false the corners are
    not looked at. Sizes are 1 at least. Tracks of fewer than ``least`` frames go through the one-euro filter on their
    corners, as they stand. A task holds batches of blocks of ``block`` frames; of a longer track only one element for
    each block is put in order in one task.
    """
    spark = df.sparkSession
    block = max(block, least)
    own = df.select(F.col("track").cast("long"), F.col("frame").cast("long"), F.coalesce(F.col("present"), F.lit(False)).alias("present"), *[F.col(c).cast("double") for c in CORNERS])
    whole = own.groupBy("track").agg(F.count("*").alias("n"), F.min_by(F.array(*CORNERS), F.struct((~F.col("present")).alias("gone"), "frame")).alias("seen"))
    rows = own.groupBy("track", F.floor(F.col("frame") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("frame", "present", *CORNERS))).alias("rows"))
    path = work_dir(spark, "boxes")
    rows.join(whole, "track").write.parquet(path)
    blocks = spark.read.parquet(path)
    long = blocks.where(F.col("n") > block)

    def composed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, _, present, corners = _read(b)
            if b.num_rows:
                e = compose(first, _centres(corners), present)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), *map(_lists, e)], ["track", "block", "seen", *"abcde"])

    def begin(r: dict) -> tuple:
        return start(_centres(np.array([r["seen"]])))

    def forward(state: tuple, r: dict) -> tuple:
        return advance(*state, tuple(np.array(r[k]).reshape(1, *shape) for k, shape in zip("abcde", _SHAPES, strict=True)))

    kinds = ", ".join(f"{k} array<double>" for k in "abcde")
    e = long.select("track", "block", "rows", "seen").mapInArrow(composed, f"track long, block long, seen array<double>, {kinds}")
    before = _in_order(e, False, begin, forward, lambda s: [*s[0].ravel().tolist(), *s[1].ravel().tolist()])

    def filtered(b: pa.RecordBatch) -> tuple[Filtered, np.ndarray]:
        first, frames, present, corners = _read(b)
        m, p = start(_centres(_doubles(b, "seen", (4,))))
        state = _doubles(b, "state", (24,))
        some = (b.column(b.schema.names.index("state")).is_valid().to_numpy(zero_copy_only=False))[:, None, None]
        m, p = np.where(some, state[:, :8].reshape(-1, 4, 2), m), np.where(some[..., None], state[:, 8:].reshape(-1, 4, 2, 2), p)
        return Filtered(first, _centres(corners), present, m, p), frames

    def paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f, _ = filtered(b)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _lists(f.m[np.cumsum(f.n) - 1]), *map(_lists, f.pairs())], ["track", "block", "last", "e", "g"])

    met = long.select("track", "block", "rows", "seen").join(before, ["track", "block"])
    pairs = met.mapInArrow(paired, "track long, block long, last array<double>, e array<double>, g array<double>")

    # the last block's first frame needs its own last frame's state alone: x = m there, so E (F x) + g = m
    def last(r: dict) -> tuple:
        return (_v(_STEP, np.array(r["last"]).reshape(4, 2)),)

    def back(state: tuple, r: dict) -> tuple:
        return (np.array(r["g"]).reshape(4, 2) + _v(np.array(r["e"]).reshape(4, 2, 2), state[0]),)

    behind = _in_order(pairs, True, last, back, lambda s: s[0].ravel().tolist()).withColumnRenamed("state", "behind")

    def final(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            f, frames = filtered(b)
            names = b.schema.names
            n = b.column(names.index("n")).to_numpy()
            ends = b.column(1).to_numpy() == (n - 1) // block
            z = _corners(f.smoothed(_doubles(b, "behind", (4, 2)), ends))
            short = n < least
            if short.any():
                first, _, _, corners = _read(b)
                own = np.repeat(short, f.n)
                z[own] = one_euro(np.append(0, np.cumsum(f.n[short])), corners[own])
            track = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), f.n)))
            yield pa.RecordBatch.from_arrays([track, pa.array(frames), *map(pa.array, z.T.copy())], ["track", "frame", *CORNERS])

    met = blocks.join(before, ["track", "block"], "left").join(behind, ["track", "block"], "left")
    return met.select("track", "block", "rows", "seen", "n", "state", "behind").mapInArrow(final, "track long, frame long, x1 double, y1 double, x2 double, y2 double")


# queries


def kalman_rts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box about each track's value; frames of error events are not seen."""
    t = fill(tracks(spark, sf_dir)).where("filled is not null")
    half_w, half_h = 10 + F.col("frame") * 7 % 11, 15 + F.col("frame") * 5 % 13
    t = t.select(
        "track", "frame", F.col("v").isNotNull().alias("present"), (F.col("filled") - half_w).alias("x1"), (F.col("filled") / 2 + F.col("frame") - half_h).alias("y1"),
        (F.col("filled") + half_w).alias("x2"), (F.col("filled") / 2 + F.col("frame") + half_h).alias("y2"),
    )
    return smooth(t).select("track", "frame", *[F.round(c, 4).alias(c) for c in CORNERS])


KALMAN_RTS = f"""
with recursive {TRACKS}, f as (select track, frame, v, coalesce(last_value(v ignore nulls) over (partition by track order by frame rows between unbounded preceding and current row),
  first_value(v ignore nulls) over (partition by track order by frame rows between current row and unbounded following)) as filled from t),
b as (select track, frame, v is not null as present, count(*) over (partition by track) as n, filled as cx, filled / 2 + frame as cy,
  20.0 + 2 * (frame * 7 % 11) as w, 30.0 + 2 * (frame * 5 % 13) as h from f where filled is not null),
c as (select track, frame, present, n, k, [cx, cy, w, h][k] as z, [4.0, 4.0, 1.0, 1.0][k]::double as q, [9.0, 9.0, 25.0, 25.0][k]::double as r from b, range(1, 5) g(k) where n >= 10),
s as (select track, k, arg_min(z, frame + case when present then 0 else 1000000000 end) as z0 from c group by all),
u as (
  select track, k, -1::bigint as frame, z0 as m0, 0.0::double as m1, r as p00, 0.0::double as p01, 10 * q as p11, z0 as a0, 0.0::double as a1, r as b00, 0.0::double as b01, 10 * q as b11
  from s join (select distinct k, q, r from c) using (k)
  union all
  select track, k, frame, a0 + g0 * y, a1 + g1 * y, b00 - g0 * b00, b01 - g0 * b01, b11 - g1 * b01, a0, a1, b00, b01, b11 from (
    select *, case when present then b00 / (b00 + r) else 0.0 end as g0, case when present then b01 / (b00 + r) else 0.0 end as g1, z - a0 as y from (
      select c.track, c.k, c.frame, c.present, c.z, c.r, u.m0 + u.m1 as a0, u.m1 as a1,
        u.p00 + 2 * u.p01 + u.p11 + c.q / 4 as b00, u.p01 + u.p11 + c.q / 2 as b01, u.p11 + c.q as b11
      from u join c on c.track = u.track and c.k = u.k and c.frame = u.frame + 1))
),
x as (
  select u.track, u.k, u.frame, u.m0 as x0, u.m1 as x1 from u join (select distinct track, n from c) e on e.track = u.track and u.frame = e.n - 1
  union all
  select track, k, frame, m0 + g00 * d0 + g01 * d1, m1 + g10 * d0 + g11 * d1 from (
    select u.track, u.k, u.frame, u.m0, u.m1, x.x0 - n.a0 as d0, x.x1 - n.a1 as d1,
      ((u.p00 + u.p01) * n.b11 - u.p01 * n.b01) / det as g00, (u.p01 * n.b00 - (u.p00 + u.p01) * n.b01) / det as g01,
      ((u.p01 + u.p11) * n.b11 - u.p11 * n.b01) / det as g10, (u.p11 * n.b00 - (u.p01 + u.p11) * n.b01) / det as g11
    from x join u on u.track = x.track and u.k = x.k and u.frame = x.frame - 1 and u.frame >= 0
    join (select *, b00 * b11 - b01 * b01 as det from u) n on n.track = x.track and n.k = x.k and n.frame = x.frame)
),
p as (select track, frame, max(x0) filter (k = 1) as cx, max(x0) filter (k = 2) as cy, greatest(max(x0) filter (k = 3), 1) as w, greatest(max(x0) filter (k = 4), 1) as h from x group by all),
i as (select track, frame, k, [cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2][k] as z from b, range(1, 5) g(k) where n < 10),
o as (
  select track, k, frame, z as y, 0.0::double as dx from i where frame = 0
  union all
  select i.track, i.k, i.frame, a * i.z + (1 - a) * o.y, d.dx
  from o join i on i.track = o.track and i.k = o.k and i.frame = o.frame + 1,
    lateral (select (2 * pi() / (2 * pi() + 1)) * (i.z - o.y) + (1 / (2 * pi() + 1)) * o.dx as dx) d,
    lateral (select 2 * pi() * (0.05 + 0.7 * abs(d.dx)) / (2 * pi() * (0.05 + 0.7 * abs(d.dx)) + 1) as a) e
)
select track, frame, round(cx - w / 2, 4) as x1, round(cy - h / 2, 4) as y1, round(cx + w / 2, 4) as x2, round(cy + h / 2, 4) as y2 from p
union all
select track, frame, round(max(y) filter (k = 1), 4), round(max(y) filter (k = 2), 4), round(max(y) filter (k = 3), 4), round(max(y) filter (k = 4), 4) from o group by all
"""

QUERIES = {"kalman_rts": (kalman_rts, KALMAN_RTS)}
