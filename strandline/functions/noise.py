"""Noise that any part of any track can make anew: a counter-based generator as column arithmetic.

A value is a function of a key (seed and track) and a counter (frame), so that overlapping parts agree without storing
anything, on any cluster and in any order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import TRACKS, tracks

#: Fixed values of the published generator Philox 4x32: multipliers, and what the keys grow by.
M0, M1, W0, W1, ROUNDS = 0xD2511F53, 0xCD9E8D57, 0x9E3779B9, 0xBB67AE85, 10
_MASK = 0xFFFFFFFF


def _product(m: int, c: Column) -> tuple[Column, Column]:
    """High and low 32 bits of m * c, by halves of c, so that no product passes 63 bits."""
    low = F.lit(m) * c.bitwiseAND(F.lit(0xFFFF))
    high = F.lit(m) * F.shiftright(c, 16) + F.shiftright(low, 16)
    return F.shiftright(high, 16), F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(low.bitwiseAND(F.lit(0xFFFF)))


def philox(key: tuple[Column, Column], counter: tuple[Column, Column, Column, Column]) -> Column:
    """Four words of 32 random bits, as longs in an array, from a key of two and a counter of four."""
    cut = lambda x: x.cast("long").bitwiseAND(F.lit(_MASK))
    start = F.array(*[cut(x) for x in (*counter, *key)])

    def step(s: Column, _: Column) -> Column:
        hi0, lo0 = _product(M0, s[0])
        hi1, lo1 = _product(M1, s[2])
        return F.array(hi1.bitwiseXOR(s[1]).bitwiseXOR(s[4]), lo1, hi0.bitwiseXOR(s[3]).bitwiseXOR(s[5]), lo0, cut(s[4] + W0), cut(s[5] + W1))

    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step), 1, 4)


def normal(key: tuple[Column, Column], counter: tuple[Column, Column, Column, Column]) -> Column:
    """A standard normal value (Box and Muller)."""
    w = philox(key, counter)
    return F.transform(F.array(w), lambda x: F.sqrt(-2 * F.log((x[0] + 0.5) / (_MASK + 1.0))) * F.cos(2 * math.pi * x[1] / (_MASK + 1.0)))[0]


def window_source(frame: Column, key: tuple[Column, Column], length: int = 16, stride: int = 8) -> Column:
    """The frame whose noise a frame takes so that windows of ``length``, ``stride`` apart, share theirs in another order.

    The first window has its own; each later run of ``stride`` frames takes those of the run that begins a window's
    length before it, reordered by j -> (a * j + c) mod stride with odd a and c from the generator. ``stride`` is a power of two.
    """
    if stride & (stride - 1):
        raise ValueError("stride must be a power of two")

    def back(f: Column, _: Column) -> Column:
        run = F.floor((f - length) / stride)
        w = F.transform(F.array(philox(key, (run, F.lit(0), F.lit(0), F.lit(1)))), lambda x: run * stride + F.pmod((2 * x[0] + 1) * (f - length - run * stride) + x[1], F.lit(stride)))[0]
        return F.when(f < length, f).otherwise(w)

    # each step leads back by more than length - stride frames
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((frame - length + 1) / (length - stride + 1))))
    return F.aggregate(steps, frame.cast("long"), back)


def committed(df: DataFrame, seed: int, length: int = 16, stride: int = 8) -> DataFrame:
    """``df`` (track, frame) with source and noise: the normal value of the frame that the window order leads to."""
    key = (F.lit(seed), F.col("track"))
    df = df.withColumn("source", window_source(F.col("frame"), key, length, stride))
    return df.withColumn("noise", normal(key, (F.col("source"), F.shiftright(F.col("source"), 32), F.lit(0), F.lit(0))))


def committed_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return committed(tracks(spark, sf_dir).select("track", "frame"), 7).select("track", "frame", "source", F.round("noise", 6).alias("noise"))


_WORDS = """
  select *, 0 as round, {counter}::ubigint as c0, 0::ubigint as c1, 0::ubigint as c2, {last}::ubigint as c3, 7::ubigint as k0, (track & 4294967295)::ubigint as k1 from {source}
  union all
  select * exclude (round, c0, c1, c2, c3, k0, k1), round + 1, xor(xor((3449720151::ubigint * c2) >> 32, c1), k0), (3449720151::ubigint * c2) & 4294967295,
    xor(xor((3528531795::ubigint * c0) >> 32, c3), k1), (3528531795::ubigint * c0) & 4294967295, (k0 + 2654435769) & 4294967295, (k1 + 3144134277) & 4294967295
  from {name} where round < 10
"""
COMMITTED_NOISE = f"""
with recursive {TRACKS}, runs as (select distinct track, (frame - 16) // 8 as run from t where frame >= 16),
p as ({_WORDS.format(counter="run", last=1, source="runs", name="p")}),
w as (select track, run, (2 * c0 + 1)::hugeint as a, c1::hugeint as c from p where round = 10),
s as (select track, frame, frame as source from t
  union all
  select s.track, s.frame, (run * 8 + (a * (source - 16 - run * 8) + c) % 8)::bigint from s join w on w.track = s.track and w.run = (s.source - 16) // 8 and s.source >= 16),
l as (select track, frame, source from s where source < 16),
n as ({_WORDS.format(counter="source", last=0, source="l", name="n")})
select track, frame, source, round(sqrt(-2 * ln((c0 + 0.5) / 4294967296)) * cos(2 * pi() * c1 / 4294967296), 6) as noise from n where round = 10
"""

QUERIES = {"committed_noise": (committed_noise, COMMITTED_NOISE)}
