"""Quality scores by attention-based multiple-instance learning over passages (operator 9)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common, _words

#: Words of a passage, width of the word projection, units of the passage encoding and of the attention.
PASSAGE, WIDTH, HIDDEN, ATTENTION = 64, 8, 24, 16
#: Bounds of what is learned from: rows, and bytes of their texts; passages that go through the gradient at once.
SAMPLE, SAMPLE_BYTES, CHUNK = 6_000, 64 << 20, 1 << 15
_CLASSES = (
    ("upper", [*range(65, 91)]), ("digit", [*range(48, 58)]), ("stop", [46, 44]), ("line", [10, 13]), ("space", [9, 32]),
    ("mark", [b for b in range(33, 127) if not chr(b).isalnum() and b not in (46, 44)]), ("high", [*range(128, 256)]),
)
FEATURES = len(_CLASSES) + 8 + WIDTH
_BUCKETS = 1 << 12
_PROJECTION = np.random.default_rng(7).normal(size=(_BUCKETS, WIDTH)).astype(np.float32)


def passages(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Encodes every passage of the rows: features, and each row's first passage (with the end behind them).

    A passage is 64 words of one text with the bytes up to the next; a text without words is one passage of zeros.
    """
    w = _words.words(data, offs)
    counts = w.counts
    n_pass = np.maximum(1, -(-counts // PASSAGE))
    first = np.concatenate([[0], np.cumsum(n_pass)])
    x = np.zeros((first[-1], FEATURES), np.float32)
    if not len(w.hash):
        return x, first
    row = _words.row_of(w.first)
    passage = first[row] + (np.arange(len(row)) - w.first[row]) // PASSAGE
    begin = np.flatnonzero(np.diff(passage, prepend=-1))
    own = passage[begin]
    n = np.diff(np.append(begin, len(row))).astype(np.float32)
    # from a passage's first word to the next one's, or to the end of the text
    a = w.start[begin]
    b = np.where(np.diff(row[begin], append=-1) == 0, np.append(a[1:], len(data)), offs[row[begin] + 1])
    size = np.maximum(b - a, 1).astype(np.float32)
    edges = np.stack([a, b], 1).ravel()
    for k, (_, values) in enumerate(_CLASSES):
        is_in = np.zeros(256, np.uint8)
        is_in[values] = 1
        x[own, k] = np.add.reduceat(np.append(is_in[data], np.uint8(0)), edges, dtype=np.int64)[::2] / size
    k = len(_CLASSES)
    length = (w.end - w.start).astype(np.float32)
    x[own, k] = np.add.reduceat(length, begin) / n / 10
    x[own, k + 1] = np.add.reduceat((length > 14).astype(np.float32), begin) / n
    x[own, k + 2] = np.log1p(n) / 4
    same = np.zeros(len(row), np.float32)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (row[1:] == row[:-1])
    x[own, k + 3] = np.add.reduceat(same, begin) / n
    order = np.lexsort((w.hash, passage))
    new = np.ones(len(row), np.float32)
    new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    x[own, k + 4] = np.add.reduceat(new, begin) / n
    # words that consist of marks, and words whose last byte is a mark other than a stop
    last = data[w.end - 1]
    mark = np.zeros(256, bool)
    mark[_CLASSES[5][1]] = True
    x[own, k + 5] = np.add.reduceat((mark[last]).astype(np.float32), begin) / n
    x[own, k + 6] = np.add.reduceat((mark[data[w.start]] & (length == 1)).astype(np.float32), begin) / n
    pair = _words.runs(w.hash, 2)
    pair = np.append(pair, np.uint64(0))
    order = np.lexsort((pair, row))
    again = np.zeros(len(row), np.float32)
    again[order[1:]] = (pair[order][1:] == pair[order][:-1]) & (row[order][1:] == row[order][:-1])
    again[np.flatnonzero(np.diff(row, append=-1))] = 0  # a row's last word begins no pair
    x[own, k + 7] = np.add.reduceat(again, begin) / n
    for i in range(0, len(begin), 8192):  # a part of the passages at a time
        j = min(len(begin), i + 8192)
        words = _PROJECTION[(w.hash[begin[i] : begin[j] if j < len(begin) else None] & np.uint64(_BUCKETS - 1)).astype(np.int64)]
        x[own[i:j], k + 8 :] = np.add.reduceat(words, begin[i:j] - begin[i], axis=0) / n[i:j, None]
    return x, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """h = tanh(Wx + b); attention over a text's passages = softmax(a . (tanh(Vh) * sigmoid(Uh))); score = c . sum."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def passages(self, x: np.ndarray) -> dict[str, np.ndarray]:
        """Encoding h and attention e = a . (t * g) of each passage, before the softmax over its text."""
        w = self.weights
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
        return {"x": x, "h": h, "t": t, "g": g, "e": (t * g) @ w["a"]}

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.passages(x)
        starts, bag = first[:-1], _words.row_of(first)
        e = np.exp(f["e"] - np.maximum.reduceat(f["e"], starts)[bag])
        share = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(f["h"] * share[:, None], starts, axis=0)
        return f | {"share": share, "bag": bag, "z": z, "y": _sigmoid(z @ w["c"] + w["d"])}

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)["y"] if len(first) > 1 else np.zeros(0)


def gradient(model: Model, x: np.ndarray, first: np.ndarray, y: np.ndarray, chunk: int = CHUNK) -> dict[str, np.ndarray]:
    """Of the mean log loss of whole texts, by weight.

    Passages go through in chunks, whose edges may cut a text: a first pass finds each text's softmax and sum, a second
    one the gradients. So a text of any number of passages takes a chunk's memory besides its features.
    """
    w = model.weights
    bag = _words.row_of(first)
    parts = [(a, min(len(x), a + chunk)) for a in range(0, len(x), chunk)]
    top, total, z = np.full(len(y), -np.inf), np.zeros(len(y)), np.zeros((len(y), len(w["c"])))
    for a, b in parts:
        f = model.passages(x[a:b])
        begin = np.flatnonzero(np.diff(bag[a:b], prepend=-1))
        own = bag[a:b][begin]
        new = np.maximum(top[own], np.maximum.reduceat(f["e"], begin))
        e = np.exp(f["e"] - np.repeat(new, np.diff(np.append(begin, b - a))))
        old = np.exp(top[own] - new)
        total[own] = total[own] * old + np.add.reduceat(e, begin)
        z[own] = z[own] * old[:, None] + np.add.reduceat(f["h"] * e[:, None], begin, axis=0)
        top[own] = new
    z /= total[:, None]
    err = (_sigmoid(z @ w["c"] + w["d"]) - y) / len(y)
    dz = err[:, None] * w["c"]
    mean = (z * dz).sum(1)
    out = {k: np.zeros_like(v) for k, v in w.items()} | {"c": z.T @ err, "d": err.sum(keepdims=True)}
    for a, b in parts:
        own = bag[a:b]
        if len(parts) > 1:
            f = model.passages(x[a:b])
        h, share = f["h"], np.exp(f["e"] - top[own]) / total[own]
        de = share * ((h * dz[own]).sum(1) - mean[own])
        dtg = de[:, None] * w["a"]
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = (share[:, None] * dz[own] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h**2)
        for k, g in (("W", f["x"].T @ dh), ("b", dh.sum(0)), ("V", h.T @ dt), ("U", h.T @ dg), ("a", (de[:, None] * f["t"] * f["g"]).sum(0))):
            out[k] += g
    return out


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.01, batch: int = 128) -> Model:
    """Adam on the log loss of whole texts, in numpy; the same input gives the same model.

    Without rows of both labels it returns a model whose every score is the share of ones (one half without any rows).
    """
    rng = np.random.default_rng(11)
    mean, scale = (x.mean(0, dtype=float), x.std(0, dtype=float) + 1e-3) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    w = {
        "W": rng.normal(size=(FEATURES, HIDDEN)) / np.sqrt(FEATURES), "b": np.zeros(HIDDEN),
        "V": rng.normal(size=(HIDDEN, ATTENTION)) / np.sqrt(HIDDEN), "U": rng.normal(size=(HIDDEN, ATTENTION)) / np.sqrt(HIDDEN),
        "a": rng.normal(size=ATTENTION) / np.sqrt(ATTENTION), "c": np.zeros(HIDDEN), "d": np.zeros(1),
    }
    model = Model(mean, scale, w)
    if not len(y) or y.min() == y.max():
        w["d"][:] = 0.0 if not len(y) else (4.0 if y.min() else -4.0)
        return model
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            n = first[rows + 1] - first[rows]
            own = np.concatenate([[0], np.cumsum(n)])
            f = x[np.repeat(first[rows] - own[:-1], n) + np.arange(own[-1])]
            grad = gradient(model, f, own, y[rows])
            step += 1
            for k, g in grad.items():
                g = g + 1e-5 * w[k]
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return model


def is_held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all passages, where each text's begin, labels) of the rows to learn from; see ``train``."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    rows = docs.select("doc_id", _common.text_or_empty().alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    # which rows, by hash; a row that does not fit any more is passed over
    left, chosen = size, []
    for r in rows.groupBy("h").agg(F.max(F.octet_length("text")).alias("n")).orderBy("h").limit(sample).collect():
        if r["n"] <= left:
            left -= r["n"]
            chosen.append((r["h"],))
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "h long")), "h").select("h", "text", "quality")

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of ``sample`` hashes at most
        for b in batches:
            new = [k for k, h in enumerate(b.column(0).to_pylist()) if not (h in seen or seen.add(h))]
            b = b.take(pa.array(new, pa.int64()))
            for i, j, data, offs in _words.blocks(b.column(1)):
                x, first = passages(data, offs)
                out = [x[p:q].tobytes() for p, q in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(out, pa.binary()), b.column(2).slice(i, j - i)], ["h", "x", "y"])

    got = rows.mapInArrow(_common.lean(encode), "h long, x binary, y int").groupBy("h").agg(F.first("x").alias("x"), F.max("y").alias("y"))
    found = sorted((r["h"], bytes(r["x"]), r["y"]) for r in got.collect())
    bags = [np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, x, _ in found]
    first = np.cumsum([0, *map(len, bags)])
    return np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32), first, np.array([float(y) for *_, y in found])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = SAMPLE_BYTES) -> Model:
    """Fits on labelled rows that are not held out: those of the ``sample`` least hashes of labelled doc_ids, and of
    their rows, repeated ones counted once, the ``sample`` of the least hashes whose texts take ``size`` bytes together.

    Rows are chosen, not parts of them: every passage of a chosen text is learned from; a text of more than ``size``
    bytes is not chosen. Both bounds (documented parameters) keep what comes to the driver, the features of at most
    ``size`` bytes of text, below 100 MB at any corpus size and however many rows share a doc_id. Rows without a label or
    doc_id don't count; of several labels of one document the largest does; without any the scores are one half.
    """
    model = fit(*labelled(docs, labels, sample, size))
    _common.tidy()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and quality_score (0 to 1; null and empty texts are scored as a passage of zeros).

    Rows are scored one by one, repeated ones alike; a column quality_score of ``docs`` is replaced; an empty table
    gives none. A text takes about seventeen times its bytes in a task.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    docs = docs.drop("quality_score")

    names = docs.columns
    at = names.index("text")

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.score(*passages(data, offs)) for _, _, data, offs in _words.blocks(b.column(at))]
            y = pa.array(np.concatenate(got) if got else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, y], [*names, "quality_score"])

    return docs.mapInArrow(_common.lean(look), StructType([*docs.schema.fields, StructField("quality_score", DoubleType())]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (null for a null doc_id), score and predicted of every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", is_held_out().alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.7).cast("int").alias("predicted"),
    )
