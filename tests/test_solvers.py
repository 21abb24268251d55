"""Whole-track solvers, scans and segmentations against plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import boxes, solvers


def path_terms(n, w, position, velocity, acceleration, jerk):
    """The objective's matrix, dense."""
    h = 2 * position / n * np.diag(w)
    for k, x in ((1, velocity), (2, acceleration), (3, jerk)):
        if n > k:
            d = np.diff(np.eye(n), k, axis=0)
            h += 2 * x / (n - k) * d.T @ d
    return h


def least_cost(h, c, w, position, lower, upper, rounds=400):
    """A dense active-set method: solve for the free places, clip, and let go of places whose slope points inwards."""
    pull = 2 * position / len(c) * w
    s = np.clip(c, lower, upper)
    size = np.abs(h).sum(1).max() + 1e-12
    z, t = s.copy(), 1.0
    for _ in range(rounds * 100):
        new = np.clip(z - (h @ z - pull * c) / size, lower, upper)
        u = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z, s, t = new + (t - 1) / u * (new - s), new, u
    return s


def cost(h, c, w, position, s):
    return 0.5 * s @ h @ s - 2 * position / len(c) * (w * c) @ s + position / len(c) * (w * c * c).sum()


def test_paths_against_a_dense_optimum():
    rng = np.random.default_rng(3)
    lens = [1, 2, 3, 4, 5, 7, 12, 40]
    first = np.cumsum([0, *lens])
    c = np.concatenate([np.cumsum(rng.normal(size=n) * 20) for n in lens])
    w = (rng.random(len(c)) > 0.2).astype(float)
    low, high = c - rng.uniform(1, 40, len(c)), c + rng.uniform(1, 40, len(c))
    for weights in ({}, {"position": 0.0}, {"position": 0.0, "velocity": 1.0, "acceleration": 10.0, "jerk": 0.0}):
        own = {"position": 0.25, "velocity": 0.25, "acceleration": 30.0, "jerk": 1.0} | weights
        got = solvers.smooth_paths(first, c, low, high, w, **weights)
        assert (got >= low - 1e-9).all() and (got <= high + 1e-9).all()
        for a, b in zip(first[:-1], first[1:], strict=True):
            h = path_terms(b - a, w[a:b], **own)
            best = least_cost(h, c[a:b], w[a:b], own["position"], low[a:b], high[a:b])
            want, have = (cost(h, c[a:b], w[a:b], own["position"], s) for s in (best, got[a:b]))
            assert have <= want * 1.001 + 1e-6, (b - a, weights, have, want)


@pytest.mark.parametrize("kind", ["walk", "slow", "constant", "noise"])
@pytest.mark.parametrize("lens", [[5000], [40] * 30 + [1, 2, 3, 2000]])
def test_paths_are_within_a_thousandth_of_the_least_cost(kind, lens):
    """No point within the bounds can be lower than the cost less the gap, whatever solver finds it."""
    rng = np.random.default_rng(7)
    make = {"walk": lambda n: np.cumsum(rng.normal(size=n) * 20), "slow": lambda n: 300 * np.sin(np.arange(n) / 50), "constant": lambda n: np.full(n, 9.0), "noise": lambda n: rng.uniform(0, 500, n)}
    first, c = np.cumsum([0, *lens]), np.concatenate([make[kind](n) for n in lens])
    for band in (0.0, 16.0, 40.0):
        for weights in ({}, {"position": 0.0}):
            s = solvers.smooth_paths(first, c, c - band, c + band, **weights)
            p = solvers.PathProblem(first, c, np.ones(len(c)), **({"position": 0.25, "velocity": 0.25, "acceleration": 30.0, "jerk": 1.0} | weights))
            assert (p.gap(s, c - band, c + band) <= 1e-3 * p.cost(s) + 1e-5).all()


def test_paths_of_the_query_are_the_least_within_their_bounds(spark):
    """Each track of the table: inside the margin, and no higher than the least cost by what rounding explains."""
    import pandas as pd

    from strandline.operators import folds
    from strandline.session import tracks

    sf = "/root/testdata/sf0.001"
    got = folds.crop_path(spark, sf).toPandas().merge(tracks(spark, sf).select("track", "frame", "v").toPandas(), on=["track", "frame"])
    checked = 0
    for _, g in got.sort_values("frame").groupby("track"):
        known = pd.Series(g["v"].to_numpy(float))
        filled = known.ffill().bfill().to_numpy()
        if np.isnan(filled).any():
            assert g["path"].isna().all()
            continue
        s, w = g["path"].to_numpy(float), known.notna().to_numpy().astype(float)
        assert np.abs(s - filled).max() <= 16.01
        p = solvers.PathProblem(np.array([0, len(s)]), filled, w, 0.25, 0.25, 30.0, 1.0)
        assert p.gap(s, filled - 16, filled + 16)[0] <= 5e-3 * p.cost(s)[0] + 0.05 * len(s) ** 0.5
        checked += 1
    assert checked > 10


def test_bounds_without_a_point_between_give_the_midpoint():
    c = np.arange(6.0)
    got = solvers.smooth_paths(np.array([0, 6]), c, c + np.array([0, 0, 5, 0, 0, 0]), c + np.array([1, 1, -5, 1, 1, 1]))
    assert got[2] == pytest.approx(2.0, abs=1e-6)
    assert len(solvers.smooth_paths(np.array([0]), c[:0], c[:0], c[:0])) == 0


def plain_boxes(corners, present):
    """The filter and the smoother with all eight numbers in one state, frame by frame."""
    z = boxes._centres(corners)
    step, q, h, r = np.eye(8), np.zeros((8, 8)), np.eye(4, 8), np.diag(boxes.R)
    for i in range(4):
        step[i, i + 4] = 1
        q[i, i], q[i, i + 4], q[i + 4, i], q[i + 4, i + 4] = boxes.Q[i] * np.array([0.25, 0.5, 0.5, 1])
    seen = int(np.argmax(present)) if present.any() else 0
    m, p = np.append(z[seen], np.zeros(4)), np.diag(np.append(boxes.R, boxes.Q * 10))
    kept = []
    for t in range(len(z)):
        a, b = step @ m, step @ p @ step.T + q
        m, p = a, b
        if present[t]:
            gain = b @ h.T @ np.linalg.inv(h @ b @ h.T + r)
            m, p = a + gain @ (z[t] - h @ a), (np.eye(8) - gain @ h) @ b
        kept.append((m, p, a, b))
    out = [kept[-1][0]]
    for t in range(len(z) - 2, -1, -1):
        m, p, _, _ = kept[t]
        _, _, a, b = kept[t + 1]
        out.append(m + p @ step.T @ np.linalg.inv(b) @ (out[-1] - a))
    return boxes._corners(np.array(out[::-1])[:, :4])


def plain_one_euro(x):
    out, dx, alpha = [x[0]], 0.0, lambda c: 2 * math.pi * c / (2 * math.pi * c + 1)
    for v in x[1:]:
        dx = alpha(1.0) * (v - out[-1]) + (1 - alpha(1.0)) * dx
        a = alpha(0.05 + 0.7 * abs(dx))
        out.append(a * v + (1 - a) * out[-1])
    return out


@pytest.mark.parametrize("block", [256, 16, 7])
def test_boxes_with_gaps_against_a_loop_over_eight_numbers(spark, block):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for track, n in enumerate([1, 2, 9, 10, 16, 33, 150, 64]):
        mid = np.cumsum(rng.normal(size=(n, 2)) * 9, axis=0)
        size = 20 + rng.uniform(0, 9, (n, 2))
        corners = np.concatenate([mid - size, mid + size], 1)
        present = rng.random(n) > 0.3
        if track == 5:
            present[:9] = False
        if track == 7:
            present[:] = False
        rows += [(track, k, bool(present[k]), *map(float, corners[k])) for k in range(n)]
        want[track] = plain_boxes(corners, present) if n >= 10 else np.array([plain_one_euro(corners[:, k]) for k in range(4)]).T
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(a), int(b), c == "True" if isinstance(c, str) else bool(c), *map(float, d)) for a, b, c, *d in rows], "track long, frame long, present boolean, x1 double, y1 double, x2 double, y2 double")
    got = boxes.smooth(df.withColumn("state", F.lit(1)), block).collect()
    assert len(got) == len(rows)
    for r in got:
        assert np.allclose([r[c] for c in boxes.CORNERS], want[r["track"]][r["frame"]], atol=1e-6), (r["track"], r["frame"])
    assert boxes.smooth(df.where("track > 100")).count() == 0


def test_linear_scans_go_on_from_batch_to_batch(spark):
    rng = random.Random(3)
    rows = [(t, k, rng.choice([0.0, 0.5, 0.9, None]), rng.choice([1.0, -2.0, None])) for t, n in ((1, 1), (2, 30_000), (None, 50), (3, 700)) for k in range(n)]
    df = spark.createDataFrame(rows, "track long, frame long, a double, b double")
    for backward in (False, True):
        want, y = {}, {}
        for t, k, a, b in sorted(rows, key=lambda r: r[1], reverse=backward):
            y[t] = (1.0 if a is None else a) * y.get(t, 0.0) + (b or 0.0) if t in y else (b or 0.0)
            want[t, k] = y[t]
        got = solvers.linear(df.orderBy(F.rand(1)), "a", "b", "y", backward).collect()
        assert len(got) == len(rows) and all(abs(r["y"] - want[r["track"], r["frame"]]) < 1e-9 for r in got)


def plain_deadband(x, lower, upper, radius):
    out, k = [], 0
    for v, a, b in zip(x, lower, upper, strict=True):
        if out:
            new = min(low, v), max(high, v), max(lo, a), min(hi, b)
        if not out or new[1] - new[0] > 2 * radius or new[2] > new[3]:
            k, new = k + bool(out), (v, v, a, b)
        low, high, lo, hi = new
        out.append(k)
    return out


def plain_ratio(x, threshold):
    out, k, total, n = [], 0, 0.0, 0
    for v in x:
        if v > 0:
            if n and abs(math.log(v / (total / n))) > threshold:
                k, total, n = k + 1, 0.0, 0
            total, n = total + v, n + 1
        out.append(k)
    return out


@pytest.mark.parametrize("levels", [1, 3, 10])
def test_segments_against_plain_loops(levels):
    rng = np.random.default_rng(9)
    for kind in range(6):
        lens = [1, 2, 5, 300, 1, 77, 1500]
        first = np.cumsum([0, *lens])
        n = first[-1]
        x = [rng.uniform(0, 500, n), np.cumsum(rng.normal(size=n) * 10), np.full(n, 5.0), rng.integers(-1, 3, n).astype(float), np.exp(np.arange(n) / 300), -np.ones(n)][kind]
        m = rng.uniform(20, 90, n)
        got = solvers.numbered(first, solvers.deadband_breaks(first, x, x - m, x + m, 60.0, levels))
        two = solvers.numbered(first, solvers.ratio_breaks(first, x, 0.7, 4 * levels))
        for a, b in zip(first[:-1], first[1:], strict=True):
            assert got[a:b].tolist() == plain_deadband(x[a:b], x[a:b] - m[a:b], x[a:b] + m[a:b], 60.0)
            assert two[a:b].tolist() == plain_ratio(x[a:b], 0.7)


def test_state_expires_by_event_time_also_across_a_restart(spark, tmp_path):
    """Keys that went quiet are sent out and leave the state; what is kept at a stop goes on after it."""
    import datetime as dt

    from strandline.streaming import flows

    start = dt.datetime(2024, 1, 1)
    at = lambda hours: start + dt.timedelta(hours=hours)
    first = [(1, at(0), 1, 1.0), (2, at(1), 1, 2.0), (3, at(9), 1, 4.0), (4, at(0), 2, 8.0), (5, at(9), 3, 16.0)]
    second = [(6, at(12), 3, 32.0), (7, at(24 * 40), 9, 64.0)]
    third = [(8, at(24 * 41), 1, 128.0)]
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for k, rows in enumerate((first, second, third)):
        df = spark.createDataFrame([(e, t, u, "x", v, None) for e, t, u, v in rows], "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
        (tmp_path / "in").mkdir(exist_ok=True)
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).toPandas().to_parquet(f"{folder}/events.parquet{k}", coerce_timestamps="us")
        flow = flows.expiring(flows.events_stream(spark, folder))
        got = {(r["user_id"], r["n"], r["total"]) for r in flows.drain(flow, out, state, "append").collect()}
        if k == 0:
            assert got == {(1, 2, 3.0)}  # the pause in the batch itself; the others wait for the watermark
    assert got == {(1, 2, 3.0), (1, 1, 4.0), (2, 1, 8.0), (3, 2, 48.0)}
    kept = spark.read.format("statestore").option("stateVarName", "open").load(state).select("key.user_id").collect()
    assert {r["user_id"] for r in kept} == {1, 9}


def against_sql(spark, folder, name, values):
    """The query's rows on tracks of these values, and its SQL's."""
    import datetime as dt

    import duckdb

    from strandline import catalog

    start = dt.datetime(2024, 1, 1)
    rows = [(1000 * t + k, start + dt.timedelta(minutes=k), t, "view", v, None) for t, x in values.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.repartition(3).write.parquet(f"{folder}/events.parquet")
    found = catalog.queries()[name](spark, str(folder))
    duck = duckdb.connect()
    duck.sql("set threads = 1")  # more of them add up sums in any order
    duck.sql(f"create view events as select * from '{folder}/events.parquet/*.parquet'")
    want = duck.sql(f"select {', '.join(found.columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, found.collect())), sorted(want)


def test_deadband_bounds_are_those_of_the_sql_to_the_last_bit(spark, tmp_path):
    """Values whose bounds meet exactly (124.51 - 50 and 4.51 + 70, the first two tracks as drawn), and missing ones."""
    values = {
        1: [112.23, 66.02, 124.51, 111.19, 4.51, 11.24], 2: [0.0] * 49 + [112.23, 124.51, 111.19, 4.51, 11.24], 3: [None, 5.0, None, 200.0, None, None, 210.0], 4: [None, None],
    }
    rng = np.random.default_rng(6)
    for t in range(5, 105):  # pairs 80 to 120 apart at each place, so that bounds meet
        low = np.round(rng.uniform(0, 400, 40), 2)
        values[t] = [float(round(v + d, 2)) for v in low for d in (0, rng.choice([80, 90, 100, 110, 120]), 0)]
    got, want = against_sql(spark, tmp_path, "deadband_segments", values)
    assert got == want


def odd_tracks():
    """Zeros, missing values, changes of sign, and segments longer than are looked for at once."""
    rng = np.random.default_rng(7)
    values = {1: [0.0], 2: [0.0, 0.0, 0.0, 1.0, 1.0], 3: [5.0, 6.0, 0.0, 5.0, 6.0, 5.5, 0.0], 4: [None, 1.0, 9.0], 5: [3.0, 9.0, None, 1.0, 9.0, None], 6: [-1.0, -1.0, -9.0, 2.0, 2.0, -2.0]}
    values[7] = [float(round(v, 2)) for v in rng.uniform(90, 110, 400)] + [0.0] + [float(round(v, 2)) for v in rng.uniform(90, 110, 200)]
    for t in range(8, 60):
        values[t] = [float(v) for v in np.round(rng.exponential(50, 70), 2)]
        for k in rng.integers(0, 70, rng.integers(0, 6)).tolist():
            values[t][k] = 0.0
    return values


def test_greedy_segments_are_those_of_the_sql_also_at_zeros(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "greedy_segments", odd_tracks())
    assert got == want


def test_merged_segments_are_those_of_the_sql_also_at_zeros(spark, tmp_path):
    rng = np.random.default_rng(8)
    few = {t: rng.choice([0.1, 0.7, 1.4, 2.1, 3.3, 6.6], 70).tolist() for t in range(100, 400)}  # ratios to both neighbours are often equal
    got, want = against_sql(spark, tmp_path, "merged_segments", odd_tracks() | few)
    assert got == want


def test_stream_windows_take_times_as_whole_seconds(spark, tmp_path):
    """As the SQL does, which rounds them: what comes half a second before noon or midnight is in the next windows."""
    import datetime as dt

    import duckdb

    from strandline import catalog

    seconds = [0, 0.49, 43198.5, 43199.4999, 43199.5, 43199.7, 43200, 86399.25, 86399.999999, 129599.6, 200000.5]
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), k % 3, "ab"[k % 2], float(2**k), None) for k, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.toPandas().to_parquet(f"{tmp_path}/events.parquet", coerce_timestamps="us")
    found = catalog.queries()["stream_windows"](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = duck.sql(f"select {', '.join(found.columns)} from ({catalog.oracle_sql()['stream_windows']})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
