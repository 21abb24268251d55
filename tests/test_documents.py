"""JSON at depth, globs, keyed noise, masks and hulls against plain Python."""

import fnmatch
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import documents, noise
from strandline.operators import hulls, masks
from strandline.plans import graphs


def plain_merge(a, b, depth=8):
    out = dict(a)
    for k, v in b.items():
        out[k] = plain_merge(a[k], v, depth - 1) if depth > 1 and isinstance(v, dict) and isinstance(a.get(k), dict) else v
    return out


def some_json(rng, depth):
    if depth and rng.random() < 0.6:
        return {k: some_json(rng, depth - 1) for k in rng.sample("abc", rng.randrange(4))}
    return rng.choice([1, -2.5, "1", "x\"y", True, None, [1, {"a": 2}], {}])


def test_merge_at_depth(spark):
    rng = random.Random(4)
    rows = [({"a": some_json(rng, 10)}, {"a": some_json(rng, 10), "b": k}) for k in range(60)]
    deep = lambda n, v: v if n == 0 else {"d": deep(n - 1, v)}
    rows += [(deep(10, {"x": 1}), deep(10, {"y": 2})), (deep(7, {"x": 1}), deep(7, {"y": 2}))]
    df = spark.createDataFrame([(k, json.dumps(a), json.dumps(b)) for k, (a, b) in enumerate(rows)], "k int, a string, b string")
    got = {r["k"]: json.loads(r["m"]) for r in df.select("k", documents.deep_merge(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {k: plain_merge(a, b) for k, (a, b) in enumerate(rows)}


def test_merge_of_what_is_no_object(spark):
    cases = [('{"a": 1}', None, {"a": 1}), (None, '{"a": 1}', {"a": 1}), (None, None, None), ("broken", '{"b": 2}', {"b": 2}), ("[1]", "3", None), ('{"a": 1}', '{"a": null}', {"a": None})]
    df = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, a string, b string")
    got = {r["k"]: r["m"] and json.loads(r["m"]) for r in df.select("k", documents.deep_merge(F.col("a"), F.col("b")).alias("m")).collect()}
    assert got == {k: w for k, (*_, w) in enumerate(cases)}


def test_set_and_get(spark):
    df = spark.createDataFrame([(1, '{"s": {"x": 1}, "t": 2}'), (2, '{"s": 5}'), (3, None)], "k int, d string")
    made = df.withColumn("d", documents.set_at(F.col("d"), "s", "y", F.lit("v")))
    assert {r["k"]: json.loads(r["d"]) for r in made.collect()} == {1: {"s": {"x": 1, "y": "v"}, "t": 2}, 2: {"s": {"y": "v"}}, 3: {"s": {"y": "v"}}}
    got = made.select("k", documents.get_at(F.col("d"), "s", "x", "int").alias("x"), documents.get_at(F.col("d"), "s", "y", "int", F.lit(-1)).alias("y"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, -1), (2, None, -1), (3, None, -1)}


def test_whole_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "x": [1,\n 2]\n}\n')
    (tmp_path / "b.json").write_text("{ broken")
    rows = {r["path"].rsplit("/", 1)[1]: r["document"] for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.json": '{"x":[1,2]}', "b.json": None}


PARTS = st.lists(st.sampled_from(["*", "?", "a", "b", ".", "[ab]", "[!a]", "[a-c]", "+", "(", "x1"]), max_size=6).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=5), st.lists(st.text("ab.cx1+(", max_size=6), min_size=1, max_size=12))
def test_globs_of_names_are_those_of_fnmatch(spark, globs, names):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = df.select("n", *[documents.matches(F.col("n"), [g]).alias(f"g{k}") for k, g in enumerate(globs)]).collect()
    for r in got:
        for k, g in enumerate(globs):
            assert r[f"g{k}"] == fnmatch.fnmatchcase(r["n"], g), (r["n"], g)


def test_globs_of_paths(spark):
    cases = [("a/b/c.txt", "a/*.txt", False), ("a/b/c.txt", "a/**/*.txt", True), ("a/c.txt", "a/**/*.txt", True), ("a/b/c.txt", "**", True), ("a/b", "a?b", False), ("a/b", "a[!x]b", False), ("A/b", "a/b", False)]
    df = spark.createDataFrame([(p,) for p, *_ in cases], "p string")
    for p, g, want in cases:
        assert {r["ok"] for r in df.where(F.col("p") == p).select(documents.matches(F.col("p"), [g]).alias("ok")).collect()} == {want}, (p, g)
    kept = df.distinct().where(documents.matches(F.col("p"), ["**"], ["a/c*"], 1, ignore_case=True)).collect()
    assert {r["p"] for r in kept} == {"a/b", "A/b"}
    parts = spark.range(1).select(*[documents.path_parts(F.lit(p)).alias(f"x{k}") for k, p in enumerate(["a\\b/c.tar.GZ", "/x/.hidden", "name"])]).first()
    assert [tuple(x) for x in parts] == [("a/b", "c.tar.GZ", "c.tar", "gz", 2), ("/x", ".hidden", ".hidden", "", 1), ("", "name", "name", "", 0)]


def test_words_are_those_of_the_published_generator(spark):
    cases = [([0] * 4, [0] * 2, "6627e8d5 e169c58d bc57ac4c 9b00dbd8"), ([2**32 - 1] * 4, [2**32 - 1] * 2, "408f276d 41c83b0e a20bc7c6 6d5451fd")]
    cases += [([0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344], [0xA4093822, 0x299F31D0], "d16cfe09 94fdcceb 5001e420 24126ea1")]
    for counter, key, want in cases:
        lit = lambda x: tuple(F.lit(v).cast("long") for v in x)
        assert spark.range(1).select(noise.philox(lit(key), lit(counter)).alias("w")).first()["w"] == [int(x, 16) for x in want.split()]


def test_a_slice_of_noise_equals_the_whole(spark):
    frames = spark.range(400).select(F.lit(9).cast("long").alias("track"), F.col("id").alias("frame"))
    whole = {r["frame"]: (r["source"], r["noise"]) for r in noise.committed(frames, 3).collect()}
    part = noise.committed(frames.where("frame between 130 and 200").repartition(5, "frame"), 3).collect()
    assert {r["frame"]: (r["source"], r["noise"]) for r in part} == {k: whole[k] for k in range(130, 201)}
    assert all(s < 16 for s, _ in whole.values()) and [whole[k][0] for k in range(16)] == [*range(16)]
    for run in range(16, 392, 8):  # each run takes the noise of the run a window before it, in another order
        assert {whole[k][1] for k in range(run, run + 8)} == {whole[k][1] for k in range(run - 16, run - 8)}
    other = {r["noise"] for r in noise.committed(frames.where("frame < 16"), 4).collect()}
    assert not other & {n for _, n in whole.values()}
    many = noise.committed(spark.range(20_000).select("id", F.col("id").alias("track"), F.lit(0).cast("long").alias("frame")), 1)
    mean, dev = many.agg(F.avg("noise"), F.stddev("noise")).first()
    assert abs(mean) < 0.03 and abs(dev - 1) < 0.03


def plain_regions(cells, eight):
    left, out = set(cells), {}
    while left:
        todo = [min(left)]
        left.discard(todo[0])
        own = []
        while todo:
            r, c = todo.pop()
            own.append((r, c))
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    n = r + dr, c + dc
                    if n in left and (eight or not (dr and dc)):
                        left.discard(n)
                        todo.append(n)
        out |= dict.fromkeys(own, min(own))
    return out


@pytest.mark.parametrize("eight", [True, False])
def test_regions_across_tiles(spark, eight):
    rng = random.Random(6)
    shapes = {
        1: {(r, c) for r in range(30) for c in range(41) if rng.random() < 0.5}, 2: {(0, c) for c in range(60)} | {(r, 59) for r in range(40)}, 3: set(),
        4: {(k, k) for k in range(33)}, 5: {(r, c) for r in range(20) for c in range(20) if r % 4 == 0 or (c == 0 and r % 8 < 4) or (c == 19 and r % 8 > 3)},
    }
    df = spark.createDataFrame([(m, r, c) for m, s in shapes.items() for r, c in s] * 2, "mask long, row int, col int")
    got = {(x["mask"], x["row"], x["col"]): tuple(x["region"]) for x in masks.label_cells(df, 8, eight).collect()}
    assert got == {(m, *cell): first for m, s in shapes.items() for cell, first in plain_regions(s, eight).items()}


def test_holes_and_largest_regions(spark):
    ring = {(r, c) for r in range(3, 14) for c in range(3, 14) if r in (3, 13) or c in (3, 13)}
    cells = ring | {(0, 0), (1, 1), (20, 5), (20, 6), (20, 7)}
    df = spark.createDataFrame([(7, r, c) for r, c in cells], "mask long, row int, col int")
    sizes = spark.createDataFrame([(7, 24, 24)], "mask long, height int, width int")
    filled = {(x["row"], x["col"]) for x in masks.fill_holes(df, sizes, 8).collect()}
    assert filled == cells | {(r, c) for r in range(3, 14) for c in range(3, 14)}
    kept = {(x["row"], x["col"]) for x in masks.clean(df, None, 3, 1, 8).collect()}
    assert kept == ring
    assert {(x["row"], x["col"]) for x in masks.clean(df, sizes, 2, 0, 8).collect()} == filled


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 300)] + [(1000, k) for k in range(1001, 1400)] + [(5, 5), (6, 7), (7, 6)]
    got = {tuple(r) for r in graphs.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 100) for k in range(100, 301)} | {(k, 1000) for k in range(1000, 1400)} | {(6, 6), (7, 6)}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hulls_do_not_depend_on_how_points_are_dealt(spark):
    rng = np.random.default_rng(5)
    rows = [("big", float(x), float(y)) for x, y in rng.normal(size=(5000, 2))] + [("ring", float(np.cos(t)), float(np.sin(t))) for t in np.arange(400) / 400 * 2 * np.pi]
    rows += [("square", float(a), float(b)) for a in range(3) for b in range(3)] * 3 + [("line", float(k), 2.0 * k) for k in range(9)] + [("one", 1.0, 1.0), ("none", None, 1.0), ("none", float("nan"), 1.0), (None, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "key string, x double, y double")
    got = {}
    for n in (1, 7):
        for r in hulls.hulls(df.repartition(n), "key", "x", "y").collect():
            got.setdefault(r["key"], []).append((r["n"], round(r["area"], 9)))
    assert all(len(v) == 2 and v[0] == v[1] for v in got.values()) and set(got) == {"big", "ring", "square", "line", "one", None}
    assert got["square"][0] == (4, 4.0) and got["line"][0] == (2, 0.0) and got["one"][0] == (1, 0.0) and got["ring"][0][0] == 400
    assert got["ring"][0][1] == pytest.approx(np.pi, rel=1e-3)


def test_inventory_by_globs_and_depth(spark, tmp_path):
    from strandline.sources import files

    for name in ("a.png", "x/b.PNG", "x/c.txt", "x/y/d.png", "x/y/z/e.png", "tmp/f.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("1")
    names = lambda **k: [r["path"].split(f"{tmp_path}/")[1] for r in files.inventory(spark, f"file://{tmp_path}", **k).collect()]
    assert names(include=["**/*.png"]) == ["a.png", "tmp/f.png", "x/y/d.png", "x/y/z/e.png"]
    assert names(include=["**/*.png"], exclude=["tmp/**"], depth=2) == ["a.png", "x/y/d.png"]
    assert names(depth=0) == ["a.png"] and len(names()) == 6


def test_values_that_json_lacks_go_at_any_depth(spark, tmp_path):
    from strandline.sources import files

    nan, inf = float("nan"), float("inf")
    kind = "k int, a struct<x: double, y: array<double>>, m map<string, struct<v: float>>, b binary, s string"
    df = spark.createDataFrame([(1, (nan, [1.0, inf, None]), {"p": (2.5,), "q": (-inf,)}, bytearray(b"hi"), "t"), (2, None, None, None, None)], kind)
    r = {x["k"]: x for x in files.finite(df).collect()}
    assert r[1]["a"].asDict(True) == {"x": None, "y": [1.0, None, None]} and {k: v["v"] for k, v in r[1]["m"].items()} == {"p": 2.5, "q": None}
    assert r[1]["b"] == "aGk=" and r[2]["a"] is None and r[2]["m"] is None and r[1]["s"] == "t"
    assert files.finite(df, 1).select("a.y").first()["y"].startswith("[1.0")
    files.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    lines = {x["k"]: x["line"] for x in files.csv_text(spark.createDataFrame([(1, 'a "b", c', None), (2, "d", 1.5)], "k int, t string, v double"), ["k", "t", "v"]).collect()}
    assert lines == {1: '1,"a \\"b\\", c",', 2: "2,d,1.5"}


def test_small_helpers(spark, tmp_path):
    from strandline.plans import sweeps
    from strandline.sources import files

    df = spark.range(2)
    files.write_new(df, str(tmp_path / "once"))
    with pytest.raises(Exception, match="already exists"):
        files.write_new(df, str(tmp_path / "once"))
    assert sweeps.float_range(0.1, 0.5, 0.2) == pytest.approx([0.1, 0.3, 0.5])
    assert sweeps.step_splits(10, 4, 12, 3) == ["4,6", "7,3"]
    files.append_csv(df, str(tmp_path / "c"))
    files.append_csv(df, str(tmp_path / "c"))
    assert files.read_csv(spark, str(tmp_path / "c"), "id long").count() == 4
