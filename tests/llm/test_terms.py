"""Operators over terms and byte contexts against brute force, on odd rows and on odd tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import _terms, divergence, lang_id, ranked, registry

A_Z = {c: c + 32 for c in range(65, 91)}
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, rank int, value string"


def plain_divergence(rows, least, top):
    docs = [((lang or ""), (source or ""), LETTERS.findall((text or "").translate(A_Z))) for _, text, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, by = Counter(), defaultdict(Counter)
        for x, source, words in docs:
            if x == lang:
                df.update(set(words))
                by[source].update(words)
        kept = sorted((w for w in df if df[w] >= least), key=str.encode)
        p = {}
        for s, c in [*by.items(), (None, sum(by.values(), Counter()))]:
            n = sum(c[w] for w in kept)
            p[s] = [1 + 10**9 * (c[w] + 5) // (n + 5 * len(kept)) for w in kept]
        for s in by:
            pairs = [(-sum(abs(x - y) for x, y in zip(p[s], p[o], strict=True)), o.encode()) for o in by if o != s]
            words = [(q - x, w.encode()) for x, q, w in zip(p[s], p[None], kept, strict=True) if by[s][w] and x > q]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("size", [(3, 4, 4096, 256), (2, 50, 3, 2)])
def test_divergence_equals_plain_counting(spark, monkeypatch, size):
    least, top, chunk, block = size
    monkeypatch.setattr(divergence, "BLOCK", block)
    rng = random.Random(5)
    words = ["the", "The", "é", "É", "straße", "a1b", "x-y", "日本", "ab", "ABC", "zz", "q" * 300]
    rows = [(k % 50, " ".join(rng.choices(words, k=rng.randrange(30))), rng.choice(["en", "de", None, ""]), rng.choice([None, "", "s1", "s2", "s3", "é"]), 1, "x") for k in range(400)]
    rows += [(1, "tie zz", "en", "s1", 1, "x")] * 200 + [(None, None, "fr", "only", None, None), (2, "12 3", "xx", "a", 1, "y"), (3, "", "xx", "b", 1, "y")]
    got = divergence.divergence(spark.createDataFrame(rows, DOCS), least, top, chunk, 40).collect()
    assert sorted(tuple(r) for r in got) == plain_divergence(rows, least, top)
    assert ("xx", "a", "pair", "b", 0, 1) in {tuple(r) for r in got}


def test_divergence_of_no_documents(spark):
    assert divergence.divergence(spark.createDataFrame([], DOCS)).count() == 0


def test_shares_are_exact():
    rng = np.random.default_rng(3)
    for n in (10, 10**9, 10**14, 8 * 10**15, 10**17):
        c = np.unique(np.append(rng.integers(0, n, 50), [0, n]))
        assert divergence.shares(c, n, 7).tolist() == [1 + 10**9 * (int(x) + 5) // (n + 35) for x in c]
    assert divergence._whole_sums(np.array([0, 0, 1]), np.array([2**60, 2**60 + 1, 3]), 3).tolist() == [2**61 + 1, 3, 0]


def test_terms_of_rows():
    texts = ["Ab1-é", "", "xÉy z", "é"]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *[len(t.encode()) for t in texts]])
    found, first = _terms.terms(np.frombuffer(data, np.uint8), offs, _terms.ALNUM)
    assert found.to_pylist() == ["ab1", "é", "xÉy", "z", "é"] and first.tolist() == [0, 2, 2, 4, 5]
    found, _ = _terms.terms(np.frombuffer(data, np.uint8), offs, _terms.LETTERS)
    assert found.to_pylist() == ["ab", "é", "xÉy", "z", "é"]


ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    words = [(d, Counter(ALNUM.findall((t or "").translate(A_Z)))) for d, t in docs]
    lengths = [sum(c.values()) for _, c in words]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    out = []
    for item, text in set(items):
        scores = Counter()
        for term, repeats in Counter(ALNUM.findall((text or "").translate(A_Z))).items():
            w = math.floor(1000 * math.log((2 * n + 2) / (2 * sum(term in c for _, c in words) + 1)))
            for x, (_, c) in enumerate(words):
                if c[term]:
                    scores[x] += repeats * w * (10**9 * c[term] // (1000 * c[term] + 12 * (75 + 25 * lengths[x] * n // total)))
        best = sorted(((-s, words[x][0] is None, words[x][0] or 0) for x, s in scores.items() if s > 0))[:k]
        out += [(item, r + 1, None if lost else d, -s) for r, (s, lost, d) in enumerate(best)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 21, 8 << 20), (40, 300, 60)])
def test_search_equals_plain_scoring(spark, monkeypatch, sizes):
    monkeypatch.setattr(ranked, "SHARD", sizes[0])
    monkeypatch.setattr(ranked, "POSTINGS", sizes[1])
    rng = random.Random(8)
    words = [f"w{int(rng.expovariate(0.05))}" for _ in range(400)] + ["É", "é", "The", "the"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(60)))) for k in range(600)]
    docs += [(5000 - k, "the same w1 w2 copy") for k in range(300)] + [(7, "the copy"), (None, "the copy w3"), (None, None), (9, ""), (10, "-- ..")]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 25)))) for k in range(12)]
    items += [(50, "copy copy same THE"), (50, "copy copy same THE"), (50, "w5"), (51, None), (52, "unheard of"), (None, "the")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, rank int, item long").repartition(5)
    i = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    got = ranked.search(d, i, 20, sizes[2]).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_search(docs, items, 20)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.search(none, items).count() == 0
    assert ranked.search(items.select(F.col("item_id").alias("doc_id"), "text"), items.where("item_id > 1")).count() == 0


def test_blocks_have_the_least_bound_error():
    rng = np.random.default_rng(6)
    lists = [rng.integers(1, 1000, n) for n in (0, 1, 7, 8, 9, 64, 300, 41, 0, 500)]
    parts, starts = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
    ends, first = ranked.cut_blocks(parts, starts)

    def error(own, cuts):
        return sum(int((own[a:b].max() - own[a:b]).sum() + own.max()) for a, b in zip([0, *cuts][:-1], cuts, strict=True))

    for x, own in enumerate(lists):
        cuts = [int(e - starts[x]) for e in ends[first[x] : first[x + 1]]]
        places = [*range(0, len(own), ranked.GRID), len(own)] if len(own) else [0]
        least = {0: 0}
        for j, e in enumerate(places[1:], 1):
            least[e] = min(least[b] + int((own[b:e].max() - own[b:e]).sum() + own.max()) for b in places[max(0, j - ranked.LONGEST) : j])
        assert cuts == sorted(set(cuts)) and (cuts[-1:] == [len(own)] or not len(own))
        assert error(own, cuts) == least[len(own)]


def test_search_skips_postings():
    """Most of a shard's postings are never scored when few documents stand out."""
    rng = np.random.default_rng(1)
    import pyarrow as pa

    docs = np.arange(8192, dtype=np.int32)
    parts = rng.integers(1, 50, 8192).astype(np.int32)
    parts[4000:4030] += 100_000
    ends, first = ranked.cut_blocks(parts.astype(np.int64), np.array([0, 8192]))
    begin = np.append(0, ends[:-1])
    row = {"ids": list(range(8192)), "terms": ["a"], "starts": np.array([0, 8192], np.int32).tobytes(), "docs": docs.tobytes(), "parts": parts.tobytes(), "first": first.tobytes(), "ends": ends.tobytes(), "tops": np.maximum.reduceat(parts, begin).astype(np.int32).tobytes()}
    shard = ranked._Shard({k: pa.scalar(v) for k, v in row.items()}, pa.array(["a"]), np.array([3]))
    seen = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice):
                seen.append(len(range(*key.indices(len(self)))))
            return super().__getitem__(key)

    shard.parts = shard.parts.view(Watched)
    hit, score = shard.search(np.array([0]), np.array([2]), 1, 20)
    best = np.lexsort((hit, -score))[:20]
    assert sorted(score[best].tolist()) == sorted((6 * np.sort(parts.astype(np.int64))[-20:]).tolist())
    assert 0 < sum(seen) < 2000


def plain_bits(by_language, text):
    """Bits of a text in each language: counts of all orders, escapes to the next shorter context."""
    out = {}
    for lang, texts in by_language.items():
        counts = defaultdict(Counter)
        for t in texts:
            t = b"\n" * lang_id.ORDER + t
            for i in range(lang_id.ORDER, len(t)):
                for k in range(lang_id.ORDER + 1):
                    counts[t[i - k : i]][t[i]] += 1
        bits = 0.0
        t = b"\n" * lang_id.ORDER + text
        for i in range(lang_id.ORDER, len(t)):
            for k in range(lang_id.ORDER, -1, -1):
                c = counts.get(t[i - k : i])
                if c and t[i] in c:
                    bits -= math.log2(c[t[i]] / (c.total() + len(c)))
                    break
                if c:
                    bits -= math.log2(len(c) / (c.total() + len(c)))
            else:
                bits += 8
        out[lang] = bits
    return out


LANGS = {"en": ["the cat and the dog", "this is then", "a thing"], "fr": ["le chat et la chienne", "ce sont les éléves"], "zz": ["qqqq"]}


def learned(spark, extra=(), **more):
    rows = [(k, t, lang) for lang, texts in LANGS.items() for t in texts for k in (0, 1, 2, 3, 7)]
    docs = spark.createDataFrame([*rows, *extra], "doc_id long, text string, lang string")
    return docs, lang_id.train(docs, **more)


def test_code_lengths_equal_plain_counting(spark):
    _, model = learned(spark)
    by = {k: [t.encode() for t in v] for k, v in LANGS.items()}
    rng = random.Random(4)
    texts = ["the cat", "", "é", "le chat\n\nthe", "qqqqq", "日本", *["".join(rng.choices("thecatqé \n", k=40)) for _ in range(30)]]
    data = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, data)])
    got = model.code_lengths(np.frombuffer(b"".join(data), np.uint8), offs) / lang_id.UNIT
    assert model.languages == sorted(by)
    for row, t in zip(got, data, strict=True):
        want = plain_bits(by, t)
        assert np.allclose(row, [want[x] for x in model.languages], atol=1e-4 * (len(t) + 1))


def test_languages_on_odd_rows(spark):
    docs, model = learned(spark, [(5, None, "en"), (6, "x", None), (None, "no id", "fr"), (9, "", "en")])
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "12 - 3", "c"), (4, "the dog", None), (4, "the dog", None), (None, "la chienne", "d"), (7, "the " * 70_000, "e")], "doc_id long, text string, lang_pred string")
    got = [(r["doc_id"], r["lang_pred"], round(r["lang_score"], 2)) for r in lang_id.identify(odd, model).collect()]
    assert sorted(got, key=repr) == sorted([(1, "und", 0), (2, "und", 0), (3, "und", 0), (4, "en", 1), (4, "en", 1), (None, "fr", 1), (7, "en", 1)], key=repr)
    none = lang_id.train(docs.where("doc_id > 100"))
    assert none.languages == [] and {r["lang_pred"] for r in lang_id.identify(odd, none).collect()} == {"und"}
    assert lang_id.identify(odd.where("doc_id > 100"), model).count() == 0


def test_copies_are_learned_from_once(spark):
    copies = [(0, "the copied text", "en")] * 5000
    docs, model = learned(spark, copies)
    got = lang_id.sampled(docs.repartition(6), 1000, 64).collect()
    assert sorted((r["lang"], r["text"]) for r in got) == sorted([*((k, t) for k, v in LANGS.items() for t in v), ("en", "the copied text")])
    assert lang_id.sampled(docs, 2, 64).groupBy("lang").count().where("count > 2").isEmpty()
    assert {r["lang"] for r in lang_id.sampled(docs, 2, 1).collect()} == {"en"}


def test_numbers_are_found_where_they_collide():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 40, 5000))
    table = lang_id.Table(keys)
    asked = np.concatenate([keys[::-1], keys + 1])
    assert table.find(asked).tolist() == [dict(zip(keys.tolist(), range(len(keys)), strict=True)).get(int(x), -1) for x in asked]
    assert lang_id.Table(keys[:0]).find(keys).max() == -1


def test_held_out_languages_of_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()["op12_language"](spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got.count() == docs.count() and right > 0.99
