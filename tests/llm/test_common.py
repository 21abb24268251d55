"""Words, hashes, tokens and components."""

import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from strandline.llm import _common, _tokens, _words

TEXTS = ["", None, "  a  b \n\n c  ", "\n x", "a  b", "it's  don't!! ok\t\tx ", "é ñ", "…“q”  x", " ", "x" * 3000, "The the THE, the.", "a\x1cb \x85 c", "<|endoftext|> x", "a <|endoftext|> b", "<|STARTOFTEXT|>a<|startoftext|>b | c"]


def test_words_are_runs_between_the_six_spaces():
    a = pa.array(TEXTS)
    data, offs = _words.columns(a)
    w = _words.words(data, offs)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in TEXTS]
    got = [[w.text(i, i + 1) for i in range(w.first[r], w.first[r + 1])] for r in range(len(TEXTS))]
    assert got == want
    by = {}
    for x, h in zip((x for row in want for x in row), w.hash.tolist(), strict=True):
        assert by.setdefault(x, h) == h
    assert len(set(by.values())) == len(by)


def test_equal_runs_have_equal_hashes():
    rng = random.Random(1)
    text = " ".join(rng.choice("ab") for _ in range(200))
    data, offs = _words.columns(pa.array([text, text]))
    w = _words.words(data, offs)
    h = _words.runs(w.hash, 5)
    words = text.split() * 2
    keys = {}
    for i in np.flatnonzero(_words.inside_rows(w.first, 5, len(h))):
        keys.setdefault(tuple(words[i : i + 5]), set()).add(int(h[i]))
    assert all(len(v) == 1 for v in keys.values()) and len({x for v in keys.values() for x in v}) == len(keys)
    assert _words.inside_rows(w.first, 5, len(h)).sum() == 2 * 196


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("limit", [20, 1 << 20])
def test_ids_are_the_librarys(name, spaced, limit):
    from tokenizers import Tokenizer

    own = _tokens.BatchTokenizer(public_tokenizers.path(name), spaced, bits=4, arena=1 << 3)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    for i, j, data, offs in _words.blocks(pa.array(TEXTS), limit):
        ids, at = own.encode(data, offs)
        for r in range(i, j):
            assert ids[at[r - i] : at[r - i + 1]].tolist() == library.encode(TEXTS[r] or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_a_long_text_is_cut_where_the_library_cuts_it(name, spaced, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(_words, "PIECE", 64)
    rng = random.Random(2)
    text = "".join(rng.choice(["word ", "x", "\n\n ", "  ", "it's", "9", ", ", "y" * 90, "é "]) for _ in range(2000))
    own, library = _tokens.BatchTokenizer(public_tokenizers.path(name), spaced), Tokenizer.from_file(public_tokenizers.path(name))
    ids, ends = own.encode(*_words.columns(pa.array([text])))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and ends.tolist() == [0, len(ids)]


def test_words_do_not_depend_on_the_piece(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(60))) for _ in range(200)] + ["", None, "c" * 300, " " * 70]
    data, offs = _words.columns(pa.array(texts))
    want = _words.words(data, offs)
    runs = _words.runs(want.hash, 5)
    for piece in (1, 7, 64):
        monkeypatch.setattr(_words, "PIECE", piece)
        got = _words.words(data, offs)
        assert all((getattr(got, k) == getattr(want, k)).all() for k in ("start", "end", "hash", "first"))
        assert (_words.runs(want.hash, 5) == runs).all()


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(30)] + [(7, 7)]
    up = {x: x for p in pairs for x in p}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    found = _common.edges_to_components(spark.createDataFrame(pairs, "a long, b long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}
    assert _common.edges_to_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_remembered_ids_take_four_bytes_each():
    own = _tokens.BatchTokenizer(public_tokenizers.path("word_bpe_49k.json"), False)
    own.encode(*_words.columns(pa.array(["unremarkable Words, here: antidisestablishmentarianism!"])))
    assert own.parts and all(isinstance(ids, bytes) and len(ids) % 4 == 0 for ids in own.parts.values())


def test_pipeline_stages_send_small_batches(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    docs = spark.createDataFrame([(1, "a b", "en", "x", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    try:
        spark.conf.unset(name)
        corpus_pipeline.packed(spark, docs, str(tmp_path))
        assert int(spark.conf.get(name).rstrip("b")) == 2 << 20
        spark.conf.set(name, "1048576b")
        corpus_pipeline.packed(spark, docs, str(tmp_path))
        assert spark.conf.get(name) == "1048576b"  # a session's own choice stays
    finally:
        spark.conf.set(name, was)
