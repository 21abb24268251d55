"""Alignment operators and rows before, against numpy and plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import frames, logs
from strandline.operators import alignment
from strandline.plans import ordered


def test_similarity_against_a_singular_value_solution(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for key in range(12):
        n = int(rng.integers(3, 30))
        p = rng.normal(size=(n, 2)) * 20
        a, s, t = rng.uniform(-3, 3), rng.uniform(0.2, 3), rng.normal(size=2) * 50
        q = s * p @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + t + rng.normal(size=(n, 2))
        w = rng.uniform(0, 1, n)
        rows += [(key, *map(float, (*p[i], *q[i], w[i])), 1) for i in range(n)]
        mp, mq = w @ p / w.sum(), w @ q / w.sum()
        h = (w[:, None] * (q - mq)).T @ (p - mp) / w.sum()
        u, d, vt = np.linalg.svd(h)
        sign = np.diag([1, np.sign(np.linalg.det(u @ vt))])
        r = u @ sign @ vt
        scale = (d * np.diag(sign)).sum() / (w @ ((p - mp) ** 2).sum(1) / w.sum())
        move = mq - scale * r @ mp
        left = np.sqrt(w @ ((scale * p @ r.T + move - q) ** 2).sum(1) / w.sum())
        want[key] = (scale, np.degrees(np.arctan2(r[1, 0], r[0, 0])), *move, left)
    df = spark.createDataFrame(rows, "key int, a double, b double, c double, d double, w double, n int")
    for r in alignment.similarity(df, "key", ("a", "b"), ("c", "d"), "w").collect():
        assert r["ok"] and np.allclose([r[c] for c in ("scale", "degrees", "tx", "ty", "residual")], want[r["key"]], atol=1e-6)


def test_similarity_of_too_little(spark):
    cases = {
        1: [(0, 0, 5, 5, 1)], 2: [(0, 0, 5, 5, 1), (10, 0, 5, 15, 1)], 3: [(0, 0, 1, 1, 1), (10, 10, 2, 2, 1), (20, 20, 3, 3, 1)],
        4: [(0, 0, 1, 1, 0), (9, 1, 2, 2, 0)], 5: [(0, 0, 1, 1, 1), (0.1, 0.2, 2, 2, 1)], 6: [(0, 0, 1, 1, 1), (None, 0, 1, 1, 1), (9, 0, None, 1, 1)], 7: [(3, 3, 1, 1, -1), (0, 0, 0, 0, 1), (4, 0, 8, 0, 1)],
    }
    rows = [(k, *[None if x is None else float(x) for x in r]) for k, v in cases.items() for r in v]
    df = spark.createDataFrame(rows, "key int, a double, b double, c double, d double, w double")
    got = {r["key"]: r for r in alignment.similarity(df, "key", ("a", "b"), ("c", "d"), "w").collect()}
    assert {k for k, r in got.items() if r["ok"]} == {2, 7}
    assert (round(got[2]["scale"], 9), round(got[2]["degrees"], 9), round(got[2]["tx"], 9), round(got[2]["ty"], 9)) == (1.0, 90.0, 5.0, 5.0)
    assert got[1]["scale"] is None and got[3]["tx"] is None and got[7]["scale"] == pytest.approx(2.0)
    assert alignment.similarity(df.where("key > 99"), "key", ("a", "b"), ("c", "d")).count() == 0


def test_anchors_by_place_and_name(spark):
    kind = "place int, name string, x double"
    a = spark.createDataFrame([(1, "eye", 1.0), (2, "ear", 2.0), (3, None, 3.0), (4, "lip", 0.0)], kind)
    b = spark.createDataFrame([(1, "eye", 4.0), (2, "lip", 2.5), (3, None, 3.0), (9, "toe", 0.0)], kind)
    got = {r["place"]: (r["state"], r["distance"]) for r in alignment.anchors(a, b, ["place"], "name", "x").collect()}
    assert got == {1: ("matched", 3.0), 2: ("renamed", 0.5), 3: ("matched", 0.0), 4: ("only_a", None), 9: ("only_b", None)}


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_rows_before_across_blocks(spark, width):
    rng = random.Random(3)
    rows = [(g, k, f"v{k}") for g in ("a", None, "b") for k in sorted(rng.sample(range(-50, 4000), 90))] + [("a", None, "none")]
    df = spark.createDataFrame(rows, "g string, k long, v string").repartition(5)
    got = {(r["g"], r["k"]): r["_before"] and (r["_before"]["k"], r["_before"]["v"]) for r in ordered.previous(df, "g", "k", ["v"], width).collect()}
    want = {("a", None): None}
    for g in ("a", None, "b"):
        own = [r for r in rows if r[0] == g and r[1] is not None]
        want |= {(g, r[1]): (p and p[1:]) for p, r in zip([None, *own], own)}
    assert got == want


def test_edges_of_flat_frames_do_not_overlap(spark):
    flat, step = F.array(*[F.lit(0.5)] * 16), F.array(*[F.lit(float(k % 4 > 1)) for k in range(16)])
    e = lambda x: alignment.edges(x, 4)
    r = spark.range(1).select(alignment.edge_iou(e(flat), e(flat)).alias("a"), alignment.edge_iou(e(step), e(flat)).alias("b"), alignment.edge_iou(e(step), e(step)).alias("c"), e(step).alias("d")).first()
    assert tuple(r)[:3] == (0.0, 0.0, 1.0) and r["d"] == [False, True, True, False] * 4


def test_lost_masks_come_from_their_neighbours(spark):
    on, off = [1.0, 1.0, 0.0, 0.0], [0.0] * 4
    rows = [("x", k, v) for k, v in enumerate([on, off, on, on, [0.0, 0.0, 1.0, 1.0]])] + [("alone", 0, on)]
    df = spark.createDataFrame(rows, "g string, k long, px array<double>")
    got = {(r["g"], r["k"]): (r["anomalous"], r["stable"]) for r in alignment.mask_consensus(df, "g", "k", "px").collect()}
    assert got["x", 1] == (True, on) and got["x", 3] == (True, [0.5] * 4) and got["x", 4] == (True, on) and got["alone", 0] == (False, on)
    mean = {r["k"]: r["stable"] for r in alignment.mask_consensus(df.where("g = 'x'"), "g", "k", "px", gate=0.0, mode="mean").collect()}
    assert mean[1] == pytest.approx([2 / 3, 2 / 3, 0, 0])


def test_context_windows_follow_the_order_of_lines(spark):
    def plain(lines):
        import re

        w = None
        for x in lines:
            if m := re.search(logs.WINDOW_FULL, x):
                a, b, c = map(int, m.groups())
                w = {"window": a, "overlap": b, "frames": c, "stride": a - b}
            elif (m := re.search(logs.WINDOW, x)) and w is None:
                w = {"window": int(m[1]), "frames": int(m[2])}
            if (m := re.search(logs.OVERLAP, x)) and w and "overlap" not in w:
                w |= {"overlap": int(m[1]), "stride": w["window"] - int(m[1])}
            if (m := re.search(logs.STRIDE, x)) and w:
                w["stride"] = int(m[1])
        if w:
            by = w.get("stride", w["window"] // 2)
            w["windows"] = -(-(w["frames"] - w["window"]) // by) + 1 if by > 0 and w["frames"] > w["window"] else 1
        return w and tuple(w.get(k) for k in ("window", "overlap", "frames", "stride", "windows"))

    rng = random.Random(1)
    forms = ["Using context windows 16 with overlap 4 for 81 frames", "Using context window 20 for 90 frames", "overlap=6", "stride: 5", "stride=0", "overlap: 3 stride: 7", "nothing", "context windows 9 with overlap 2 for 9 frames"]
    runs = {k: [rng.choice(forms) for _ in range(rng.randrange(1, 7))] for k in range(300)}
    df = spark.createDataFrame([(k, i, x) for k, v in runs.items() for i, x in enumerate(v)], "run int, i int, line string")
    got = {r["run"]: tuple(r)[1:] for r in logs.context_windows(df, "run", F.col("i"), F.col("line")).collect()}
    assert got == {k: w for k, v in runs.items() if (w := plain(v))}


def test_models_of_a_log(spark):
    lines = ["loaded completely 1 5.0 MB loaded", "Requested to load A", "dtype: fp16", "loaded completely 1 7.5 MB loaded", "loaded completely 9 8 MB loaded", "weight dtype=bfloat16", "Requested to load A", "loaded completely 2 9 MB loaded",
             "Requested to load B", "Requested to load C", "loaded completely 3 3.25 MB loaded", "dtype fp32"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)] + [(2, 0, "Requested to load A")], "run int, i int, line string")
    assert sorted(tuple(r) for r in logs.models(df, "run", F.col("i"), F.col("line")).collect()) == [(1, 1, "A", 7.5, "bf16"), (1, 2, "C", 3.25, "fp32")]


def test_windowed_similarity_of_frames_of_any_size(spark):
    rng = np.random.default_rng(4)
    h, w, reach = 17, 23, 5
    g = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * 1.5**2))
    g = np.outer(g, g) / g.sum() ** 2

    def blurred(x):
        x = np.pad(x, reach, mode="reflect")
        return np.array([[(x[r : r + 11, c : c + 11] * g).sum() for c in range(w)] for r in range(h)])

    rows, want = [], {}
    for k in range(4):
        a = rng.random((h, w))
        b = a if k == 0 else np.clip(a + rng.normal(size=(h, w)) * 0.1 * k, 0, 1)
        ma, mb = blurred(a), blurred(b)
        va, vb, cov = np.maximum(0, blurred(a * a) - ma * ma), np.maximum(0, blurred(b * b) - mb * mb), blurred(a * b) - ma * mb
        want[k] = (((2 * ma * mb + 1e-4) * (2 * cov + 9e-4)) / ((ma**2 + mb**2 + 1e-4) * (va + vb + 9e-4))).mean()
        rows.append((k, a.ravel().tolist(), b.ravel().tolist()))
    rows += [(8, None, rows[0][1]), (9, [0.5], rows[0][1]), (10, [None, *rows[0][1][1:]], rows[0][1])]
    df = spark.createDataFrame(rows, "k int, a array<double>, b array<double>")
    got = {r["k"]: r["ssim"] for r in frames.ssim_windowed(df, "a", "b", h, w).collect()}
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items()) and got[0] == pytest.approx(1) and got[8] is got[9] is got[10] is None
    with pytest.raises(ValueError, match="does not fit"):
        frames.ssim_windowed(df, "a", "b", 5, 40)


def test_parameters_are_read_typed(spark):
    from strandline.plans import loads

    rows = [(1, {"n": " 3 ", "x": "1.5", "b": "TRUE", "s": "a b"}), (2, {"n": "3.0", "x": "", "b": "2"}), (3, {"n": "3.5", "x": "y"}), (4, {}), (5, None), (6, {"n": "99999999999"})]
    df = spark.createDataFrame(rows, "k int, p map<string,string>")
    got = {r["k"]: tuple(r)[2:] for r in loads.iteration(df, "p", {"n": "int", "x": "double", "b": "boolean", "s": "string"}).collect()}
    assert got == {
        1: (3, 1.5, True, "a b", []), 2: (3, None, None, None, ["b"]), 3: (None, None, None, None, ["n", "x"]), 4: (None,) * 4 + ([],), 5: (None,) * 4 + ([],), 6: (None,) * 4 + (["n"],),
    }
    with pytest.raises(Exception, match="unreadable parameters: n, x"):
        loads.iteration(df, "p", {"n": "int", "x": "double"}, strict=True).where("k = 3").collect()


def test_slices_are_those_of_lists(spark):
    from strandline.plans import loads

    df = spark.createDataFrame([(t, 10 * k) for t, n in ((1, 0), (2, 1), (3, 7), (4, 12)) for k in range(n)], "track long, frame long")
    for a, b, s in ((None, None, 1), (2, 9, 3), (-5, -1, 2), (0, -20, 1), (-30, None, 4), (5, 2, 1)):
        got = sorted((r["track"], r["place"], r["frame"]) for r in loads.slice_frames(df, a, b, s).collect())
        assert got == [(t, i, x) for t, n in ((2, 1), (3, 7), (4, 12)) for i, x in enumerate([10 * k for k in range(n)][a:b:s])], (a, b, s)
    tokens = list(range(23))
    for a, b in ((0, 2), (1, -1), (-2, 99), (3, 1), (-99, 99)):
        r = spark.range(1).select(loads.slice_tokens(F.array(*map(F.lit, tokens)), 5, a, b).alias("x")).first()["x"]
        assert r == [x for f in [tokens[k : k + 5] for k in range(0, 20, 5)][a:b] for x in f], (a, b)


def test_a_merge_with_another_count_fails(spark):
    from strandline.plans import loads

    own = spark.createDataFrame([(1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)], "g int, k int, v double")
    done = spark.createDataFrame([(1, 1, 60.0)], "g int, k int, v double")
    promised = lambda *rows: spark.createDataFrame(rows, "g int, n long")
    got = loads.merged_back(own, done, ["g", "k"], "v", promised((1, 1), (2, 0)), "g").collect()
    assert sorted((r["g"], r["k"], r["v"]) for r in got) == [(1, 0, 5.0), (1, 1, 60.0), (2, 0, 7.0)]
    with pytest.raises(Exception, match="group 1: 1 processed rows instead of 2"):
        loads.merged_back(own, done, ["g", "k"], "v", promised((1, 2)), "g").collect()
