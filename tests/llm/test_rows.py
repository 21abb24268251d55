"""Operators that look at rows one by one or along a conversation, on odd rows and against brute force."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.llm import _words, chat, packing, quality, registry, revisits, secrets, tiling, token_records, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, spans string, key long, quality_score double"
ODD = [(1, None, "x", 1, 0.0), (2, "", "x", 2, 0.0), (3, "a " * 9000, "x", 3, 0.0), (4, "tie", None, 4, None), (4, "tie", None, 4, None), (None, "no id", "y", None, 0.1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("benchmark", "conversations", "documents", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = registry.queries()[name](spark, SF)
    want = c.sql(registry.oracle_sql()[name])
    at = [want.columns.index(x) for x in found.columns]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_escape_is_reversible():
    rng = random.Random(2)
    bits = [*chat.CONTROL, "\\", "<", "|im_end|>", "[", "INST]", "/INST]", "a", " ", "s>", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in chat.CONTROL)
        role = "".join(rng.choice(bits) for _ in range(2))
        formatted, a, b = chat.render_turn(role, text)
        assert chat.parse_turn(formatted) == (role, text) and chat.unescape(formatted[a:b]) == text


def test_events_are_folded(spark):
    e = [
        (1, 1, 1, "message", "user", "hi"), (1, 2, 2, "start", "assistant", ""), (1, 2, 4, "delta", None, "lo"), (1, 2, 3, "delta", None, "hel"),
        (1, 5, 5, "message", "user", "again"), (1, 2, 6, "regenerate", None, None), (1, 2, 7, "delta", None, "better"),
        (1, 8, 8, "message", "user", "x"), (1, 8, 9, "edit", None, "y"), (1, 10, 10, "start", "assistant", "gone"), (1, 10, 11, "delete", None, None),
        (2, None, None, None, None, None), (None, 1, 1, "message", "user", "z"),
    ]
    rows = chat.format_chats(spark.createDataFrame(e, chat.EVENTS)).collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["pos"] or 0):
        got[r["conv_id"]].append(chat.parse_turn(r["formatted"]))
    assert got == {1: [("user", "hi"), ("assistant", "better"), ("user", "y")], 2: [("", "")], None: [("user", "z")]}
    assert chat.digests(chat.format_chats(spark.createDataFrame([], chat.EVENTS))).count() == 0


def test_turns_come_back_from_a_log_of_every_kind_of_event(spark):
    rng = random.Random(4)
    turns = [(c, k, rng.choice(["user", "assistant", None]), "".join(rng.choice("abé<|im_end|>\n") for _ in range(rng.randrange(9)))) for c in range(6) for k in range(c * 3)]
    turns += [(3, 1, "user", "tie"), (3, 1, "user", "tie"), (3, None, "user", "first"), (None, 1, "user", None)]
    events = chat.turns_to_events(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r["kind"] for r in events.collect()} == {"start", "delta", "edit", "regenerate", "message", "delete"}
    got = defaultdict(list)
    for r in chat.format_chats(events.orderBy(F.rand(3))).collect():
        got[r["conv_id"]].append((r["pos"], *chat.parse_turn(r["formatted"])))
    want = defaultdict(list)
    for c, k, role, text in sorted(turns, key=lambda x: (x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((16 * len(want[c]), role or "", text or ""))
    assert {c: sorted(v) for c, v in got.items()} == want


def test_a_long_conversation_keeps_one_message_in_memory(spark):
    turns = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit("x").alias("pos"))
    r = chat.digests(chat.format_chats(chat.turns_to_events(turns))).first()
    assert r["turns_sha256"] == hashlib.sha256("".join(f"user\n{i}\n" for i in range(20_000)).encode()).hexdigest()


def test_records_round_trip(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = token_records.write_records(odd, f"file://{tmp_path}/a", path, n_parts=3, file_bytes=200).cache()
    rows = sorted(token_records.scan_records(manifest).collect(), key=lambda r: r["start"])
    library, at = Tokenizer.from_file(path), 0
    for r, (doc_id, text, *_) in zip(rows, sorted(ODD, key=lambda x: (x[0] or 0, x[1] or "")), strict=True):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert tuple(r) == (doc_id, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    first = manifest.orderBy("part", "file_no").first()["path"]
    whole = list(token_records.read_records(first))
    assert [x[0] for x in token_records.read_at(first, [len(whole) - 1, 0])] == [whole[-1][0], whole[0][0]]
    local = first.removeprefix("file://")
    data = bytearray(open(local, "rb").read())
    data[-6] ^= 1
    open(local, "wb").write(data)
    with pytest.raises(token_records.CorruptRecord):
        list(token_records.read_records(first))
    manifest.unpersist()
    empty = token_records.write_records(none, f"file://{tmp_path}/b", path)
    assert token_records.scan_records(empty).count() == 0


@pytest.mark.parametrize("same", [False, True])
def test_records_of_one_doc_id_are_dealt_over_parts(spark, tmp_path, same):
    """Nine rows in ten share a doc_id (and a text): parts stay even, and ascending ids still follow one another."""
    rows = [(5 if k % 10 else k, "copy" if same else f"text {k}") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    manifest = token_records.write_records(docs, f"file://{tmp_path}/x", public_tokenizers.path("byte_bpe_50k.json"), n_parts=8).cache()
    sizes = [r["n"] for r in manifest.groupBy("part").agg(F.sum("n_records").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) < 900
    got = sorted(tuple(r) for r in token_records.scan_records(manifest).select("start", "doc_id", "n_tokens").collect())
    assert [d for _, d, _ in got] == sorted(d for d, _ in rows) and [s for s, _, _ in got] == [sum(n for *_, n in got[:k]) for k in range(len(got))]
    manifest.unpersist()


def test_packing(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = odd.select("doc_id", "text").unionByName(spark.read.parquet(f"{SF}/documents.parquet").select((F.col("doc_id") + 100).alias("doc_id"), "text"))
    rows = packing.pack(packing.pieces_of(docs, path)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 2048
    total = sum(r["length"] for r in rows)
    assert len(by) <= -(-total // 2048) + 1
    assert packing.pack(packing.pieces_of(none, path)).count() == 0


def best_fit(lengths, capacity):
    """Number of sequences of best fit, one piece at a time, longest first."""
    gaps: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        g = min(fits) if fits else capacity
        if fits:
            gaps.remove(g)
        gaps.append(g - n)
    return len(gaps)


@pytest.mark.parametrize("kind", ["any", "long"])
def test_packing_against_best_fit(spark, kind):
    rng = random.Random(3)
    draw = {"any": lambda: min(2048, int(rng.expovariate(1 / 500)) + 1), "long": lambda: rng.randrange(500, 900), "short": lambda: rng.randrange(1, 40), "equal": lambda: 700}[kind]
    lengths = [draw() for _ in range(1500)]
    rows = packing.pack(spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECES)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for v in by.values():
        end = 0
        for at, n in sorted(v):
            assert at == end
            end += n
        assert end <= 2048
    assert sorted((r["doc_id"], r["length"]) for r in rows) == list(enumerate(lengths))
    assert len(by) <= best_fit(lengths, 2048) * 1.01 + 1


def test_packing_query(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        for k, s in enumerate(range(0, len(ids), 2048)):
            want[r["doc_id"], k] = (s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))
    rows = packing.op8_best_fit(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * best_fit([n for _, n, _ in want.values()], 2048)


def test_secret_patterns():
    key = "AKIA" + "ABCDEFGHIJKLMN"
    text = f'é password="short" Api_Key = abcdefghijkl.m; {key} deadbeef deadbeefdeadbeef0 toKen: tok\n password=token : abcdefghijklmn'
    kinds = [(secrets.KINDS[k], text[a:b]) for a, k, b in secrets.base_spans(text)]
    assert kinds == [("assign", "Api_Key = abcdefghijkl.m"), ("access", key), ("hex", "deadbeefdeadbeef0")]


def test_random_runs_are_found_and_words_are_not(spark, odd, none):
    rng = random.Random(4)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hidden = ["".join(rng.choice(base64) for _ in range(44)) for _ in range(20)]
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = spark.createDataFrame([(10_000 + i, f"one two {x} three") for i, x in enumerate(hidden)], "doc_id long, text string").unionByName(plain)
    rows = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(docs).collect()}
    assert sum(("random", 8, 52) in rows[10_000 + i] for i in range(20)) >= 18
    assert not any(s[0] == "random" for i, v in rows.items() if i < 10_000 for s in v)
    low, high = secrets.battery([("A" * 40, "base64"), (hidden[0], "base64")])
    assert low < 1e-6 < high
    assert [r["spans"] for r in secrets.scan(odd).collect()] == [[]] * 6
    assert secrets.scan(none).count() == 0
    clean = secrets.redact(odd.withColumn("n_chars", F.lit(0).cast("long")))
    assert clean.columns == [*odd.columns, "n_chars"] and clean.count() == 6


def test_random_values_after_a_name_are_found(spark):
    rng = random.Random(7)
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    plain = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    # the last two mix '_' or '-' with '/' and '+', so their runs fit no encoding
    forms = ["AWS_SECRET_ACCESS_KEY={}", "DB_PASS={}==", "https://h.example/x?sig={}&v=1", "my_path/{}", "a-key+{}"]
    hidden = ["".join(rng.choice(base64 if i % 5 < 3 else base64[:62]) for _ in range(44)) for i in range(100)]
    texts = [f"one two {forms[i % 5].format(x)} three" for i, x in enumerate(hidden)]
    docs = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(plain)
    rows = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "random"] for r in secrets.scan(docs).collect()}
    for k in range(5):
        mine = range(k, 100, 5)
        hit = [any(a <= texts[i].index(hidden[i]) and b >= texts[i].index(hidden[i]) + 44 for a, b in rows[10_000 + i]) for i in mine]
        assert sum(hit) >= 18, forms[k]
    assert not any(v for i, v in rows.items() if i < 10_000)
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert sum(hidden[i] in out[10_000 + i] for i in range(100)) <= 10
    assert secrets._RUN.findall("AWS_SECRET_ACCESS_KEY=abcdefghijklmnop== x") == ["AWS_SECRET_ACCESS_KEY", "abcdefghijklmnop=="]


def test_battery_is_calibrated_and_tells_identifiers():
    rng = random.Random(9)
    for name, symbols in secrets.ENCODINGS:
        for n in (16, 20, 44, 300):
            p = secrets.battery([("".join(rng.choice(symbols) for _ in range(n)), name) for _ in range(1000)])
            assert (p < 0.01).mean() < 0.04 and (p >= 0.1).mean() > 0.85, (name, n)
    words = ["getElementsByClassName", "my-long-hyphen-name-of-thing", "path/to/some/File1", "AWS_SECRET_ACCESS_KEY", "abcabcabcabcabcabc9", "ABCDEFGHIJKLMNOPQRSTUV1"]
    assert (secrets.battery([(w, secrets.encoding_of(w)) for w in words]) < 0.01).all()
    one = "".join(rng.choice(secrets.ENCODINGS[-1][1]) for _ in range(1 << 20))
    assert secrets.battery([(one, "base64url")])[0] > 1e-3


def test_cutoff_controls_false_discoveries():
    rng = np.random.default_rng(3)
    for n_random, n_plain in ((1000, 0), (200, 5000), (50, 200)):
        p = np.concatenate([rng.random(n_random), 10.0 ** -rng.uniform(1.5, 12, n_plain)])
        c = secrets.cutoff(np.bincount(secrets.step(p), minlength=secrets.STEPS + 1), 0.05)
        found = secrets.step(p) < c
        assert found[:n_random].mean() > 0.8 and found[n_random:].sum() <= 0.1 * max(1, found.sum())
    assert secrets.cutoff(np.zeros(secrets.STEPS + 1, int), 0.05) == 0


def test_secrets_query(spark, tmp_path):
    """Base columns of the query against the contract's patterns, one by one."""
    key = "AKIA" + "ABCDEFGHIJKLMN"
    texts = [None, "", f'é password="short" Api_Key = abcdefghijkl.m; {key} deadbeef deadbeefdeadbeef0 toKen: tok\n password=token : abcdefghijklmn', "secret:'" + "x" * 20 + "' passwd = " + "0" * 40, "AKIA" * 9]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = list(enumerate(texts)) + [(2, texts[2])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
    want = []
    for i, t in docs:
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        said = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want.append((i, *(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(said.encode()).hexdigest()))
    found = secrets.op6_secrets(spark, str(tmp_path))
    assert found.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    rows = found.collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want) and sum(w[1] + w[2] + w[3] for w in want) > 10
    for r in rows:
        kinds = [x.split(":")[0] for x in r["spans"].split(",") if x]
        assert [kinds.count(k) for k in secrets.KINDS] == [r["n_assign"], r["n_access"], r["n_hex"], r["n_random"]]


def test_a_text_full_of_runs_takes_seconds():
    rng = random.Random(1)
    symbols = secrets.ENCODINGS[-2][1]
    text = " ".join("".join(rng.choices(symbols, k=rng.randrange(16, 90))) + ' token = "' + "ab1" * 6 + '"' for _ in range(25_000))
    begin = time.time()
    assert len(secrets.find(text, np.full(secrets.BANDS, 40))) > 40_000
    assert time.time() - begin < 20


def test_quality(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    scored = quality.score(docs.select("doc_id", "text"), model)
    held = scored.join(labels, "doc_id").where(quality.is_held_out())
    right = held.select(F.avg(((F.col("quality_score") >= 0.7).cast("int") == F.col("quality")).cast("int")).alias("x")).first()["x"]
    assert right > 0.9
    rows = quality.score(odd, model).collect()
    assert len(rows) == 6 and all(0 <= r["quality_score"] <= 1 for r in rows)
    assert quality.score(none, model).count() == 0
    empty = quality.train(none.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["quality_score"] for r in quality.score(odd, empty).collect()} == {0.5}


def small_model(rng):
    size = {"W": (quality.FEATURES, 5), "b": 5, "V": (5, 3), "U": (5, 3), "a": 3, "c": 5, "d": 1}
    own = {k: rng.normal(size=n) for k, n in size.items()}
    return quality.Model(rng.normal(size=quality.FEATURES), rng.random(quality.FEATURES) + 0.5, own)


def plain_score(model, x, first):
    w, out = model.weights, []
    for p, q in zip(first[:-1], first[1:], strict=True):
        h = [np.tanh(np.clip((x[i] - model.mean) / model.scale, -6, 6) @ w["W"] + w["b"]) for i in range(p, q)]
        e = [np.exp((np.tanh(v @ w["V"]) / (1 + np.exp(-(v @ w["U"])))) @ w["a"]) for v in h]
        z = sum(a * v for a, v in zip(e, h, strict=True)) / sum(e)
        out.append(float(1 / (1 + np.exp(-(z @ w["c"] + w["d"])))[0]))
    return np.array(out)


def test_attention_and_its_gradient_against_plain_loops():
    rng = np.random.default_rng(1)
    model, first = small_model(rng), np.array([0, 1, 4, 9, 10])
    x, y = rng.normal(size=(10, quality.FEATURES)), np.array([1.0, 0, 1, 0])
    assert np.allclose(model.score(x, first), plain_score(model, x, first))

    def loss():
        p = plain_score(model, x, first)
        return -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    for k, g, chunk in [(*kg, c) for c in (100, 3, 1) for kg in quality.gradient(model, x, first, y, c).items()]:
        own = model.weights[k].reshape(-1)
        for i in rng.integers(0, len(own), 6):
            old, at = own[i], []
            for d in (1e-6, -1e-6):
                own[i] = old + d
                at.append(loss())
            own[i] = old
            assert abs((at[0] - at[1]) / 2e-6 - g.reshape(-1)[i]) < 1e-6, (k, chunk)


def plain_passages(text):
    """What ``passages`` gives for one text, by plain Python."""
    data = text.encode()
    found = list(re.finditer(rb"[^ \t\n\x0b\x0c\r]+", data))
    hashes = _words.words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash.tolist()
    pairs = [tuple(hashes[k : k + 2]) for k in range(len(hashes) - 1)]
    out = []
    for p in range(0, max(1, len(found)), quality.PASSAGE):
        own, x = found[p : p + quality.PASSAGE], np.zeros(quality.FEATURES)
        if own:
            n, words = len(own), [m.group() for m in own]
            part = data[own[0].start() : found[p + n].start() if p + n < len(found) else len(data)]
            for k, (_, values) in enumerate(quality._CLASSES):
                x[k] = sum(v in values for v in part) / len(part)
            marks, k = quality._CLASSES[5][1], len(quality._CLASSES)
            x[k : k + 3] = sum(map(len, words)) / n / 10, sum(len(w) > 14 for w in words) / n, np.log1p(n) / 4
            # repeats of a word and of a pair look back to words before the passage too
            x[k + 3] = sum(i > 0 and hashes[i] == hashes[i - 1] for i in range(p, p + n)) / n
            x[k + 4] = len(set(words)) / n
            x[k + 5] = sum(w[-1] in marks for w in words) / n
            x[k + 6] = sum(len(w) == 1 and w[0] in marks for w in words) / n
            x[k + 7] = sum(i < len(pairs) and pairs[i] in pairs[:i] for i in range(p, p + n)) / n
            x[k + 8 :] = quality._PROJECTION[[h % quality._BUCKETS for h in hashes[p : p + n]]].mean(0)
        out.append(x)
    return np.array(out)


def test_passages_against_plain_python(spark):
    rng = random.Random(12)
    bits = ["a", "the", "the", "a-b", "|", "x.", "é", "A1", "supercalifragilistic", "\n", "  ", "word,"]
    texts = ["", " ", "one", *[" ".join(rng.choices(bits, k=rng.choice([3, 63, 64, 65, 200]))) for _ in range(40)], "", "end"]
    texts += [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
    x, first = quality.passages(np.frombuffer("".join(texts).encode(), np.uint8), offs)
    for k, t in enumerate(texts):
        assert np.allclose(x[first[k] : first[k + 1]], plain_passages(t), atol=1e-5), (k, t[:80])


def test_rows_to_learn_from_are_bounded_after_the_join(spark):
    """One labelled id on 5,000 rows: at most ``sample`` of them are learned from, repeated ones once, long ones whole."""
    ids = [k for k in range(20) if zlib.crc32(str(k).encode()) % 4 != 2]
    rows = [(ids[0], f"text {k}") for k in range(5000)] + [(ids[1], "same")] * 3000 + [(ids[2], "w " * 64 * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    labels = spark.createDataFrame([(ids[0], 1), (ids[1], 0), (ids[2], 0), (ids[3], 1)], "doc_id long, quality int")
    x, first, y = quality.labelled(docs, labels, sample=4)
    assert len(y) == 4
    x, first, y = quality.labelled(docs, labels.where(F.col("doc_id") != ids[0]))
    assert sorted(np.diff(first).tolist()) == [1, 300] and len(x) == 301  # every passage of the long text
    assert len(quality.labelled(docs, labels.where(F.col("doc_id") != ids[0]), size=100)[2]) == 1
    model = quality.fit(x, first, np.array([1.0, 0]))
    assert all(np.isfinite(v).all() for v in model.weights.values())


def test_quality_query(spark):
    rows = quality.op9_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert len(held) > 60 and np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) > 0.95


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_decontamination_query_against_every_pair(spark, tmp_path, monkeypatch, limit):
    whole = tiling.contaminated
    monkeypatch.setattr(tiling, "contaminated", lambda docs, benchmark: whole(docs, benchmark, limit=limit))
    rng = random.Random(6)
    items = [(i, " ".join(f"W{rng.randrange(60)}" for _ in range(rng.choice([2, 5, 8, 20, 45])))) for i in range(25)] + [(3, None), (30, "W1"), (30, "w1 W2 w3"), (31, "...")]
    docs = []
    for i in range(120):
        words = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(40))]
        if i % 3 == 0:
            own = rng.choice(items[:25])[1].split()
            k = rng.randrange(len(own))
            words[5:5] = own[k:] + ["-", "x"] * (i % 2) + own[:k]
        docs.append((i, ", ".join(words)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    number: dict[str, int] = {}
    plain = lambda text: [number.setdefault(w, len(number)) for w in re.findall("[a-z0-9]+", (text or "").lower())]
    want = []
    for d, text in docs:
        for i, item in items:
            p = plain(item)
            t = plain(text)
            if 0 < len(p) < 8 and any(t[k : k + len(p)] == p for k in range(len(t))):
                want.append((d, i, len(p), len(p)))
            covered = sum(k for k, _, _ in tiling.tiles(p, t)) if len(p) >= 8 else 0
            if covered >= max(8, 0.6 * len(p)):
                want.append((d, i, covered, len(p)))
    got = [tuple(r)[:4] for r in tiling.op2_decontamination(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(want) > 10


def test_token_records_query(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = [None, "", "a <|endoftext|> b", "  x\n\n y ", "it's <|startoftext|>ok", "é\u2003z", "w " * 3000]
    docs = [(7 - i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d, text in sorted(docs):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_records.op4_token_records(spark, str(tmp_path)).collect()) == want


def test_tiling_covers_what_brute_force_covers():
    rng = random.Random(3)

    def brute(p, t, least):
        free_p, free_t, covered = [True] * len(p), [True] * len(t), 0
        while True:
            best = (least - 1, 0, 0)
            for i in range(len(p)):
                for j in range(len(t)):
                    k = 0
                    while i + k < len(p) and j + k < len(t) and free_p[i + k] and free_t[j + k] and p[i + k] == t[j + k]:
                        k += 1
                    best = max(best, (k, -i, -j))
            k, i, j = best[0], -best[1], -best[2]
            if k < least:
                return covered
            free_p[i : i + k] = free_t[j : j + k] = [False] * k
            covered += k

    for n in range(150):
        p = [rng.randrange(20) for _ in range(rng.randrange(1, 40))]
        t = [rng.randrange(20) for _ in range(30)]
        k = len(p) // 2
        t = t[:10] + p[k:] + [99] + p[:k] + t[10:] if n % 2 else t + p
        found = tiling.tiles(p, t, 3)
        assert sum(x for x, _, _ in found) == brute(p, t, 3)
        for k, i, j in found:
            assert p[i : i + k] == t[j : j + k]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_contaminated(spark, odd, none, limit):
    item = [f"w{i}" for i in range(40)]
    docs = [
        (1, "x y " + " ".join(item).upper() + " z"), (2, "q " + " ".join(item[20:]) + " - , " + " ".join(item[:20])), (3, " ".join(item[:15])),
        (4, " ".join(f"{a} no" for a in item)), (5, " ".join(item[:14] + ["k"] + item[15:])), (None, " ".join(item)), (1, "x y " + " ".join(item).upper() + " z"),
    ]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None), (7, " ".join(item))], "item_id long, text string")
    got = tiling.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, limit=limit).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"], r["covered"]) for r in got) == [(0, 7, 40), (1, 7, 40), (1, 7, 40), (2, 7, 40), (5, 7, 39)]
    short = tiling.contaminated(spark.createDataFrame([(1, "It is TOO, short."), (2, "too very short"), (3, None)], "doc_id long, text string"), benchmark, limit=limit)
    assert [tuple(r) for r in short.collect()] == [(1, 8, 2, 2, 1, 1.0)]
    assert tiling.contaminated(odd, benchmark, limit=limit).count() == 0
    assert tiling.contaminated(none, benchmark, limit=limit).count() == 0
    assert tiling.contaminated(odd, benchmark.where("item_id = 0"), limit=limit).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_every_item_is_found_in_another_order_and_with_a_changed_word(spark, limit):
    rng = random.Random(8)
    benchmark = spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet")
    docs, want = [], set()
    for item_id, text in benchmark.select("item_id", "text").collect():
        sentences, words = re.split(r"(?<=[.!?])\s+", text), text.split()
        rng.shuffle(sentences)
        k = len(words) // 2
        third = -(-len(words) // 3)
        for j, x in enumerate((sentences, words[:k] + ["zz"] + words[k + 1 :], words[2 * third :] + words[third : 2 * third] + words[:third])):
            docs.append((item_id * 3 + j, "aa bb " + " ".join(x) + " cc"))
            want.add((item_id * 3 + j, item_id))
    docs.append((-1, " ".join(" ".join(t.split()[:3]) for t in benchmark.toPandas()["text"])))  # three words of each item
    got = tiling.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), benchmark, limit=limit).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want


def test_seed_across_two_rows_only():
    words = [f"w{i}" for i in range(8)]
    item, data = (_words.columns(pa.array(x, pa.string())) for x in ([" ".join(words)], [" ".join(words[:2]), " ".join(words[2:4])]))
    index = tiling._Index([(1, tiling._normal(*item).hash)])
    assert list(index.pairs(*data, 0.6)) == []


def test_revisits(spark):
    rows = [
        (1, 10, "response", "http://A.org/x/?b=1&a=2#f", "e1", None, "d1", {"etag": "e1", "server": "s"}),
        (2, 20, "response", "https://www.a.org/x?a=2&b=1", "e2", None, "d2", {"date": "old"}),
        (3, 15, "revisit", "http://a.org/x?a=2&b=1&utm_source=q", "e1", None, None, {"date": "new", "server": "no"}),
        (4, 30, "revisit", "http://a.org:80/x?a=2&b=1", "e1", None, None, None), (5, 5, "revisit", "http://a.org/x?a=2&b=1", None, None, None, None),
        (6, 40, "revisit", "http://a.org/x?a=2&b=1", None, None, None, None), (7, 50, "revisit", None, None, None, None, None),
        (8, None, "revisit", "http://a.org/x?a=2&b=1", None, None, None, None),
    ]
    kind = "record_id long, ts long, kind string, url string, etag string, last_modified string, digest string, headers map<string,string>"
    for n in (1, 3):
        got = {r["record_id"]: r for r in revisits.resolve(spark.createDataFrame(rows, kind), n).collect()}
        status = {k: (r["status"], r["response_id"]) for k, r in got.items()}
        assert status == {
            3: ("resolved", 1), 4: ("validator_mismatch", None), 5: ("no_response", None), 6: ("resolved", 2),
            7: ("no_response", None), 8: ("no_response", None),
        }
        assert got[3]["headers"] == {"etag": "e1", "server": "s", "date": "new"}
    assert revisits.resolve(spark.createDataFrame([], kind)).count() == 0


def test_revisits_against_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(40), rng.choice(["response", "revisit"]), f"http://h/{rng.randrange(3)}", None, None, str(i), None) for i in range(300)]
    kind = "record_id long, ts long, kind string, url string, etag string, last_modified string, digest string, headers map<string,string>"
    got = {r["record_id"]: r["response_id"] for r in revisits.resolve(spark.createDataFrame(rows, kind), 5).collect()}
    for i, ts, k, url, *_ in rows:
        if k == "revisit":
            before = [(t, j) for j, t, kk, u, *_ in rows if kk == "response" and u == url and (t, j) < (ts, i)]
            assert got[i] == (max(before)[1] if before else None)


def test_digest_of_one_conversation(spark):
    turns = spark.createDataFrame([(1, 1, "user", "a"), (1, 2, "assistant", "<s>b")], "conv_id long, turn long, role string, text string")
    r = chat.digests(chat.format_chats(chat.turns_to_events(turns))).first()
    assert r["turns_sha256"] == hashlib.sha256(b"user\na\nassistant\n<s>b\n").hexdigest()
    assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (2, 4, hashlib.sha256(b"<s>b").hexdigest())


def test_archives_round_trip_and_resolve(spark, tmp_path):
    page = b"<html>\r\n\r\nWARC/1.1\r\n\x00\xff</html>"
    rows = [
        ("urn:1", 100, "response", "http://a.org/x", "e1", None, warc.payload_digest(page), {"server": "s", "date": "old"}, page),
        ("urn:2", 200, "revisit", "http://A.org/x/", "e1", "Mon", None, {"date": "new"}, b""),
        ("urn:3", None, "response", None, None, None, None, {}, b"x" * 300_000), ("urn:3", None, "response", None, None, None, None, {}, b""),
    ]
    df = spark.createDataFrame(rows, warc.RECORDS)
    files = warc.write_warc(df.coalesce(1), f"file://{tmp_path}/w").cache()
    back = warc.read_warc(spark, files)
    got = sorted((r["record_id"], r["ts"] or 0, r["kind"], r["url"], r["etag"], r["last_modified"], r["digest"], len(r["payload"]), bytes(r["payload"])[:40]) for r in back.collect())
    assert got == sorted((i, t or 0, k, u, e, m, d, len(p), p[:40]) for i, t, k, u, e, m, d, _, p in rows)
    r = revisits.with_payload(revisits.resolve(back), back).collect()
    assert [(x["record_id"], x["response_id"], bytes(x["payload"]), x["headers"]["date"], x["headers"]["server"]) for x in r] == [("urn:2", "urn:1", page, "new", "s")]
    raw = b"".join(warc.record_bytes(dict(zip(warc._NAMES, x, strict=True))) for x in rows)
    assert [x["record_id"] for x in warc.iter_bytes(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 2\r\n\r\nab\r\n\r\n" + raw)] == ["urn:1", "urn:2", "urn:3", "urn:3"]
    for broken in (raw[:-200], b"junk" + raw):
        with pytest.raises(warc.CorruptArchive):
            list(warc.iter_bytes(broken))
    assert warc.write_warc(df.where("ts < 0"), f"file://{tmp_path}/none").count() == 0 and warc.read_warc(spark, []).count() == 0
