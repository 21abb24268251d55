"""Operators that compare rows with each other, on odd rows and against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import near_docs, near_vectors, repeats

DOCS = "doc_id long, text string, lang string, n long, spans string, shared long"


def roots(nodes, links):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def table(spark, texts):
    return spark.createDataFrame([(i, t, None, 1, "s", 2) for i, t in texts], DOCS)


def family(rng, n, size, change, vocabulary=400):
    base = [f"v{rng.randrange(vocabulary)}" for _ in range(size)]
    out = []
    for _ in range(n):
        out.append(" ".join(f"c{rng.randrange(9999)}" if rng.random() < change else w for w in base))
    return out


def corpus(seed):
    rng = random.Random(seed)
    shared = [f"s{i}" for i in range(45)]
    texts = [*family(rng, 25, 60, 0.01), *family(rng, 12, 200, 0.02), *family(rng, 4, 7, 0.05), "one two", "ONE two", "one", None, "", " \n ", "a " * 300, "a " * 301]
    texts += [" ".join([f"x{rng.randrange(50)}" for _ in range(rng.randrange(20))] + shared + [f"y{rng.randrange(50)}" for _ in range(12)]) for _ in range(15)]
    texts += [texts[0]] * 6 + [texts[30]] * 3
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


@pytest.mark.parametrize("per_bucket", [200, 1 << 21])
def test_near_documents(spark, per_bucket):
    docs = corpus(1)
    sets = {}
    for i, t in docs:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in roots(sets, links).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_docs.near_documents(table(spark, docs), per_bucket).collect()}
    assert len(links) > 100 and got == want


def test_near_documents_on_odd_tables(spark):
    rows = near_docs.near_documents(table(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, None), (9, "A b c d e f")])).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in rows) == [(0, 2, None), (2, 0, 2), (3, 2, 3), (3, 2, 3), (9, 2, 3)]
    assert near_docs.near_documents(table(spark, [])).count() == 0
    assert sorted((r["doc_id"], r["component_id"]) for r in near_docs.near_documents(table(spark, [(1, None), (2, "")])).collect()) == [(1, 1), (2, 2)]


def test_rows_of_one_document_are_one_document(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = [(3, a), (3, b), (4, a + " x"), (5, b + " y"), (9, a), (9, a), (7, "alone " + b[:60]), (3, "")]
    rows = near_docs.near_documents(table(spark, docs)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == [
        (3, 0, 3), (3, 36, 3), (3, 36, 3), (4, 37, 3), (5, 37, 3), (7, 15, 7), (9, 36, 3), (9, 36, 3),
    ]


@pytest.mark.parametrize("limit", [3, 4096])
def test_near_documents_query_on_many_copies(spark, tmp_path, monkeypatch, limit):
    """Two very large groups, one of equal texts and one of near ones, through the query."""
    monkeypatch.setattr(near_docs, "SLICE", limit)
    rng = random.Random(5)
    base = [f"q{i}" for i in range(60)]
    docs = [(i, " ".join(base[:30])) for i in range(700)]
    docs += [(1000 + i, " ".join([*base[20:], *(f"n{rng.randrange(10**6)}" for _ in range(rng.randrange(6)))])) for i in range(300)]
    docs += [(5000 + i, None) for i in range(400)]
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    sets = {i: frozenset(zip(*((t or "").split()[k:] for k in range(5)), strict=False)) for i, t in docs}
    links = [(a, b) for a in sets for b in sets if 1000 <= a < b and sets[a] and sets[b] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    want = {i: (len(sets[i]), c) for i, c in roots(sets, links + [(0, i) for i in range(1, 700)]).items()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_docs.op7_near_documents(spark, str(tmp_path)).collect()}
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sets(st.integers(0, 25), min_size=1, max_size=20), min_size=1, max_size=12), st.sets(st.integers(0, 25), min_size=1, max_size=20))
def test_tree_finds_what_links(sets, leader):
    pack = lambda s: np.array(sorted(s), np.uint64)
    got = near_docs.tree_links(pack(leader), [(i, pack(s)) for i, s in enumerate(sets)])
    assert sorted(got) == [i for i, s in enumerate(sets) if 100 * len(s & leader) >= 75 * len(s | leader)]


def kept_words(docs):
    own = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in docs}
    count = Counter(tuple(w[k : k + 35]) for w in own.values() for k in range(len(w) - 34))
    out = {}
    for i, w in own.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            gone[k : k + 35] |= count[tuple(w[k : k + 35])] > 1
        out[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return own, out


def repeating_documents():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(120)]
    docs = [" ".join(words), "x " + " \n".join(words[10:80]) + " y", " ".join(words[40:120] + words[:36]), " ".join(words[:34]), "k " * 36, "m " * 35, " ".join(words[20:54]), None, ""]
    docs += [" ".join(words[60:100])] * 3 + [" ".join(f"r{rng.randrange(10**6)}" for _ in range(90)), "n n2 " * 60, "p q r " * 400, "q r p " * 300, "z " + "q r p " * 90]
    common = " ".join(f"c{i}" for i in range(25))  # one phrase of very many surroundings, a few of which recur
    docs += [" ".join([f"a{rng.randrange(60)}" for _ in range(14)] + [common] + [f"b{rng.randrange(3)}" for _ in range(14)]) for _ in range(60)]
    docs += [" ".join([f"d{k % 7}_{i}" for i in range(9)] + [common] + [f"e{k % 5}_{i}" for i in range(9)]) for k in range(40)]
    docs += [" ".join(words[: 60 + k]) + f" end{k}" for k in range(12)]
    return list(enumerate(docs))


@pytest.mark.parametrize(("group", "shard", "share"), [(1, 50, 1e9), (1, 10_000, 40.0), (repeats.GROUP, repeats.SHARD, 2.0)])
def test_repeats(spark, group, shard, share):
    docs = repeating_documents()
    own, want = kept_words(docs)
    got = {}
    for r in repeats.repeats(table(spark, docs), shard, group, share).collect():
        w = own[r["doc_id"]]
        got[r["doc_id"]] = [x for x, g in zip(w, repeats.removed(len(w), r["spans"]), strict=True) if not g]
    assert got == want and sum(map(len, want.values())) < sum(map(len, own.values()))


def test_repeats_query(spark, tmp_path):
    docs = repeating_documents()
    own, want = kept_words(docs)
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in repeats.op5_repeats(spark, str(tmp_path)).collect()}
    assert got == {i: (len(own[i]), len(own[i]) - len(w), hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, w in want.items()}


def test_without_the_automaton_nothing_is_found(spark, monkeypatch):
    monkeypatch.setattr(repeats, "_stream", lambda batches: iter(()))
    assert all(not r["spans"] for r in repeats.repeats(table(spark, repeating_documents())).collect())


def test_long_periodic_texts_have_bounded_stretches(spark):
    docs = [(k, " ".join(f"t{(i + k) % 11}" for i in range(20_000))) for k in range(40)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    named = repeats._named(rows)
    found = repeats.stretches(named.join(repeats.repeated_phrases(named), "key"))
    assert max(len(bytes(r["text"]).split()) for r in found.select("text").collect()) == repeats.STRETCH + repeats.WINDOW - 1
    assert all(repeats.removed(20_000, r["spans"]).all() for r in repeats.repeats(rows).collect())


def test_repeats_on_odd_tables(spark):
    twice = [(None, "b " * 40), (1, "c " * 34), (7, " ".join(map(str, range(35)))), (7, " ".join(map(str, range(35))))]
    rows = repeats.repeats(table(spark, twice)).collect()
    left = sorted((r["doc_id"] or 0, int((~repeats.removed(len(r["text"].split()), r["spans"])).sum())) for r in rows)
    assert left == [(0, 0), (1, 34), (7, 0), (7, 0)]
    assert repeats.repeats(table(spark, [])).count() == 0


def test_seen_gives_each_repeated_occurrence_once():
    rng = random.Random(3)
    seen, out, values = repeats.Seen(), [], []
    for k in range(30):
        v = np.array([rng.randrange(60) for _ in range(rng.randrange(8))], np.uint64)
        own = np.arange(len(v)) + 1000 * k
        values += list(zip(v.tolist(), own.tolist(), strict=True))
        a, b = seen.add(v, own)
        out += list(zip(a.tolist(), b.tolist(), strict=True))
    n = Counter(v for v, _ in values)
    assert sorted(out) == sorted(x for x in values if n[x[0]] > 1)


@pytest.mark.parametrize("chunk", [7, 2048])
def test_near_vectors(spark, chunk):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(20, 12))
    rows = []
    for i in range(150):
        v = base[i % 20] + rng.normal(size=12) * rng.choice([0.05, 0.3, 0.6])
        rows.append((i, [float(x) for x in v], i % 3 if i % 10 else None))
    rows += [(200, rows[3][1], 0), (201, rows[3][1], 0), (202, [2 * x for x in rows[3][1]], 0), (203, None, 0), (204, [0.0] * 12, 0), (205, [float("nan")] * 12, 0)]
    rows += [(206, [None] + [1.0] * 11, 0), (207, [1.0] * 5, 0), (208, [], 0), (209, [float("inf")] * 12, 0), (210, [1e200] * 12, 1), (211, [1e200] * 12, 1)]
    ok = {i: (np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    unit = {i: (v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()), lab) for i, (v, lab) in ok.items()}
    links = [(a, b) for a in unit for b in unit if a < b and unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= 0.93]
    n = Counter(x for p in links for x in p)
    want = {i: (n[i], c, i == c) for i, c in roots([r[0] for r in rows], links).items()}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.link_vectors(df, chunk=chunk, most=chunk).collect()}
    assert len(links) > 50 and got == want
    assert near_vectors.link_vectors(df.where("vec_id < 0")).count() == 0


def test_rows_that_share_a_vec_id_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0, 0.0], 0, "a"), (6, [1.0, 0.01, 0.0], 0, "b"), (5, [0.0, 1.0, 0.0], 1, "c"), (7, [0.0, 1.0, 0.02], 1, None), (None, [0.0, 1.0, 0.0], 1, "e"), (8, [0.0, 0.0, 1.0], None, "f")]
    got = near_vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in got) == [
        (0, 2, None, None), (5, 1, 5, True), (5, 2, 5, True), (6, 1, 5, False), (7, 2, 5, False), (8, 0, 8, True),
    ]


def test_near_vectors_query_with_planted_links(spark, tmp_path):
    rng = np.random.default_rng(7)
    base = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in base]
    for k in range(60):
        _, v, label = rows[k % 25]
        x = np.array(v)
        rows.append((10_000 + k, [float(y) for y in x + rng.normal(size=64) * np.linalg.norm(x) * rng.choice([0, 0.01, 0.04, 0.06])], label))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = np.array([np.array(x, np.float32) for _, x, _ in rows], float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    ids = [r[0] for r in rows]
    links = [(ids[i], ids[j]) for i in range(len(rows)) for j in range(i + 1, len(rows)) if near[i, j] and rows[i][2] == rows[j][2]]
    n = Counter(x for p in links for x in p)
    want = {i: (n[i], c, i == c) for i, c in roots(ids, links).items()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.op3_near_vectors(spark, str(tmp_path)).collect()}
    assert len(links) > 40 and got == want


def test_pigeonhole_misses_nothing():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(300, 20))
    b = np.concatenate([a[:100] + rng.normal(size=(100, 20)) * 0.2, rng.normal(size=(100, 20))])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    found = near_vectors.candidates(a @ near_vectors.rotation(20), b @ near_vectors.rotation(20), 0.14)
    assert found[(a @ b.T) >= 0.93].all()


def test_pipeline_on_planted_documents(spark, tmp_path):
    """Each stage against what was planted, on the smallest tables with more documents."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    plain = docs.where("lang = 'en' and n_chars > 1500").orderBy("doc_id").limit(6).collect()
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    texts = [p["text"] for p in plain]
    planted = [(9000, texts[0]), (9001, texts[1] + " " + item), (9002, texts[2][::-1] + " " + secret), (9003, "JUNK!! " * 200)]
    extra = spark.createDataFrame([(i, t, "en", "p", len(t)) for i, t in planted], docs.schema)
    rows, kept = docs.unionByName(extra), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, rows, sf).write.parquet(path)
        rows = spark.read.parquet(path)
        if k < 4:
            assert rows.columns == corpus_pipeline.COLUMNS
            kept.append({r["doc_id"]: r["text"] for r in rows.collect()})
    assert 9003 not in kept[0] and len(kept[0]) > 150
    assert 9000 not in kept[1] and plain[0]["doc_id"] in kept[1]
    assert 9001 not in kept[2]
    assert all("24be64439e3e49cf" not in t for t in kept[3].values()) and set(kept[3]) == set(kept[2])
    packed = rows.groupBy("sequence_id").agg({"length": "sum"}).collect()
    assert max(r["sum(length)"] for r in packed) <= 2048
    assert {r["doc_id"] for r in rows.collect()} == set(kept[3])


def test_pipeline_run_against_brute_force(spark, tmp_path):
    """run() on small tables with null and repeated ids, empty and null texts and repeated rows."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from strandline.llm import quality, tiling

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    rows = [tuple(r) for r in docs.collect()]
    long = [r for r in rows if r[2] == "en" and r[4] > 1500][:6]
    item = max((r["text"] for r in items), key=len)
    rows += [(None, long[0][1], "en", "p", 1), (None, long[1][1][::-1], "en", "p", 1), (None, long[1][1][::-1], "en", "p", 1)]
    rows += [rows[5], rows[5], (rows[7][0], long[2][1] + " " + item, "en", "p", 1), (9001, None, None, None, None), (9002, "", "en", "p", 0), (9002, "", "en", "p", 0)]
    rows += [(9003, long[3][1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "p", 1)]
    spark.createDataFrame(rows, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(stored, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [tuple(r)[:2] for r in quality.score(stored, model).collect() if r["quality_score"] >= 0.7]
    sets = []
    for _, text in kept:
        w = [x.decode() for x in (text or "").encode().lower().split()]
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    links = [(i, j) for i in range(len(kept)) for j in range(i) if sets[i] and sets[j] and 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j])]
    groups: dict[int, list[int]] = {}
    for i, c in roots(range(len(kept)), links).items():
        groups.setdefault(c, []).append(i)
    one = [min(own, key=lambda i: (kept[i][0] is None, kept[i][0] or 0)) for own in groups.values()]
    number: dict[str, int] = {}
    plain = lambda text: [number.setdefault(w, len(number)) for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", text.lower())]
    bench = [p for p in (plain(r["text"] or "") for r in items) if len(p) >= 8]
    left = []
    for i in one:
        t, bad = plain(kept[i][1] or ""), False
        grams = {tuple(t[k : k + 4]) for k in range(len(t) - 3)}
        for p in bench:
            near = sum(tuple(p[k : k + 4]) in grams for k in range(len(p) - 3))
            bad = bad or (near and sum(k for k, _, _ in tiling.tiles(p, t)) >= max(8, 0.6 * len(p)))
        if not bad:
            left.append(kept[i])
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or -1) for r in out if r["piece"] == 0) == sorted((d or -1) for d, _ in left) and len(left) > 100
    assert len(left) < len(one) < len(kept) < len(rows)
    by: dict[int, list] = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
