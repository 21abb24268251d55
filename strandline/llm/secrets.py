"""Secrets in text: fixed patterns, and a battery of randomness tests with false-discovery control (operator 6)."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common

_ASSIGN = re.compile(
    r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "random")
BANDS = 41
#: Shortest run of letters, digits and base64 signs that is tested.
LEAST = 16
#: '=' counts only as padding at a run's end, so that of name=value both sides are runs of their own.
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST},}}(?:={{1,2}}(?![A-Za-z0-9+/_=-]))?")
#: Where a run that fits no encoding is parted: base64, base64url and base62 parts are left.
_PARTS = tuple(re.compile(rf"[{own}]{{{LEAST},}}=*") for own in ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9"))
#: Encodings by the symbols that occur, narrowest first; padding does not count as a symbol.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_RANKS = {name: {c: i for i, c in enumerate(symbols)} for name, symbols in ENCODINGS}
_SETS = [(name, frozenset(symbols)) for name, symbols in ENCODINGS]
#: Classes of symbols in which ordinary strings differ most from random ones: letters by how common they are, case, digits.
_CLASSES = [x for g in ("etaoinshrdlu", "bcfgjkmpqvwxyz") for x in (g, g.upper())] + ["0123456789", "+/-_"]
#: Steps of -log10(p) and their number; a cell of the chi-squared test expects so many symbols; random strings have p below TAIL that rarely.
STEP, STEPS, CELL, TAIL = 0.05, 400, 3, 0.1
_erfc = np.vectorize(math.erfc, otypes=[float])


def _upper(z: np.ndarray) -> np.ndarray:
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2)) if np.size(z) else np.zeros(np.shape(z))


def encoding_of(run: str) -> str | None:
    seen = frozenset(run.rstrip("="))
    return next((name for name, symbols in _SETS if seen <= symbols), None)


@lru_cache(maxsize=4096)
def _cells(name: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell of each byte, and what share of symbols each cell has, for runs of n: single symbols if n allows, else classes.

    Classes that expect fewer than three symbols are put together, smallest first; two stay at least.
    """
    symbols = dict(ENCODINGS)[name]
    k = len(symbols)
    groups = list(symbols) if n >= CELL * k else [g for g in ("".join(c for c in x if c in symbols) for x in _CLASSES) if g]
    while len(groups) > 2 and min(map(len, groups)) * n < CELL * k:
        groups.sort(key=len)
        groups = [groups[0] + groups[1], *groups[2:]]
    cell = np.zeros(256, np.int64)
    for i, g in enumerate(groups):
        cell[np.frombuffer(g.encode(), np.uint8)] = i
    return cell, np.array([len(g) / k for g in groups])


def _of_one_length(raw: np.ndarray, name: str) -> np.ndarray:
    """p of each row of ``raw`` (runs of one length as bytes): the least of three tests, times three."""
    m, n = raw.shape
    symbols = dict(ENCODINGS)[name]
    k = len(symbols)
    cell, share = _cells(name, n)
    c = len(share)
    counts = np.bincount((cell[raw] + c * np.arange(m)[:, None]).ravel(), minlength=m * c).reshape(m, c)
    chi = ((counts - n * share) ** 2 / (n * share)).sum(1)
    # Wilson and Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
    spread = 2 / (9 * max(1, c - 1))
    uniform = _upper((np.cbrt(chi / max(1, c - 1)) - (1 - spread)) / math.sqrt(spread)) if c > 1 else np.ones(m)
    table = np.zeros(256)
    table[np.frombuffer(symbols.encode(), np.uint8)] = np.arange(k)
    ranks = table[raw]
    high = ranks >= k / 2
    a = high.sum(1)
    b = n - a
    mean = 1 + 2 * a * b / n
    var = np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1))
    turns = 1 + (high[:, 1:] != high[:, :-1]).sum(1)
    runs = np.where((a > 0) & (b > 0), 2 * _upper(np.abs(turns - mean) / np.sqrt(var)), 2.0 ** (1 - n))
    d = ranks - ranks.mean(1, keepdims=True)
    total = (d * d).sum(1)
    serial = np.where(total > 0, (d[:, 1:] * d[:, :-1]).sum(1) / np.maximum(total, 1e-9), 1.0)
    serial = np.where(total > 0, 2 * _upper(np.abs(serial + 1 / n) * math.sqrt(n)), 0.0)
    return np.minimum(1.0, 3 * np.minimum(np.minimum(uniform, runs), serial))


def battery(runs: list[tuple[str, str]]) -> np.ndarray:
    """p of each (run, encoding) for the hypothesis that its symbols are independent and uniform in the encoding.

    Chi-squared of alphabet uniformity, runs above and below the alphabet's middle, and lag-one serial correlation of
    the symbols' ranks. Runs of one encoding and length are computed together.
    """
    out = np.ones(len(runs))
    alike: dict[tuple[str, int], list[int]] = {}
    bare = [run.rstrip("=") for run, _ in runs]
    for i, (_, name) in enumerate(runs):
        alike.setdefault((name, len(bare[i])), []).append(i)
    for (name, n), own in alike.items():
        each = max(1, (1 << 20) // n)
        for s in range(0, len(own), each):
            part = own[s : s + each]
            raw = np.frombuffer("".join(bare[i] for i in part).encode(), np.uint8).reshape(len(part), n)
            out[part] = _of_one_length(raw, name)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(found + [(m.start(), 2, m.end()) for m in _HEX.finditer(text)])


def _parts(run: str) -> list[tuple[int, int]]:
    """(start, end) of what is tested of a run: all of it, or each part of 16 or more if it mixes '+/' with '_-'."""
    if encoding_of(run):
        return [(0, len(run))]
    return sorted({m.span() for part in _PARTS for m in part.finditer(run)})


def candidates(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, run, encoding) of each run that is more than the letters of one word or the digits of one number."""
    for m in _RUN.finditer(text):
        for i, j in _parts(m[0]):
            run = m[0][i:j]
            if run.isdigit() or run.isalpha() and (run.islower() or run.isupper() or run[1:].islower()):
                continue
            name = encoding_of(run)
            if name and len(run.rstrip("=")) >= LEAST:
                yield m.start() + i, m.start() + j, run, name


def small(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few, as their texts become Python strings."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def band(n: int) -> int:
    """Lengths are told apart by half octaves."""
    return min(BANDS - 1, int(2 * math.log2(n)))


def step(p: np.ndarray) -> np.ndarray:
    return np.minimum(STEPS, (-np.log10(np.maximum(p, 1e-300)) / STEP).astype(np.int64))


def cutoff(table: np.ndarray, rate: float) -> int:
    """From the numbers of runs by step of -log10(p), in one band: runs of smaller steps are taken for random.

    Benjamini-Hochberg over the band's battery p-values says which runs are not random, at ``rate``. The others are
    what would be reported; of truly random ones nine in ten have a p of 0.1 or more, which gives their number, and the
    cutoff comes down until those that are not random are estimated to be no more than ``rate`` of what is reported.
    """
    total = int(table.sum())
    if not total:
        return 0
    at_least = table[::-1].cumsum()[::-1]
    below = np.concatenate([[0], table.cumsum()])
    rejected = np.flatnonzero((10.0 ** (-STEP * np.arange(STEPS + 1)) * total <= rate * at_least) & (at_least > 0))
    first = int(rejected[0]) if len(rejected) else STEPS + 1
    middle = round(-math.log10(TAIL) / STEP)
    random = below[middle] / (1 - TAIL)
    for c in range(first, middle, -1):
        if below[c] <= random * (1 - 10.0 ** (-STEP * c)) / (1 - rate):
            return c
    return min(first, middle)


def thresholds(docs: DataFrame, rate: float = 0.05) -> np.ndarray:
    """``cutoff`` of each band of lengths, over all runs of the corpus.

    What comes to the driver is a histogram of at most 41 bands by 401 steps.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BANDS, STEPS + 1), np.int64)
        for b in small(batches):
            for text in b.column(0).to_pylist():
                found = [(run, name) for _, _, run, name in candidates(text)]
                if found:
                    np.add.at(total, ([band(len(run)) for run, _ in found], step(battery(found))), 1)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], ["band", "step", "n"])

    found = docs.select(_common.text_or_empty().alias("text")).mapInArrow(_common.lean(count), "band long, step long, n long")
    table = np.zeros((BANDS, STEPS + 1), np.int64)
    for r in found.groupBy("band", "step").agg(F.sum("n").alias("n")).collect():
        table[r["band"], r["step"]] = r["n"]
    return np.array([cutoff(x, rate) for x in table])


def find(text: str, below: np.ndarray) -> list[tuple[int, int, int]]:
    """All spans (start, kind, end): the fixed ones, and runs that count as random and touch none of those.

    Parts of one run that overlap and count are one span. Base spans are in order, so an overlap is one lookup.
    """
    base = base_spans(text)
    runs = list(candidates(text))
    if not runs:
        return base
    starts = [a for a, _, _ in base]
    ends = np.maximum.accumulate([b for *_, b in base]).tolist() if base else []
    good = step(battery([(run, name) for _, _, run, name in runs])) < below[[band(len(run)) for _, _, run, _ in runs]]
    found: list[tuple[int, int, int]] = []
    for (a, b, _, _), ok in zip(runs, good.tolist(), strict=True):
        k = bisect_left(starts, b)  # those before k begin before b
        if ok and not (k and ends[k - 1] > a):
            if found and a < found[-1][2]:
                a, b = found[-1][0], max(b, found.pop()[2])
            found.append((a, 3, b))
    return sorted(base + found)


def scan(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id and spans (array of kind, start, end in code points, end exclusive) for each row.

    A null or empty text has no spans; rows are looked at one by one, so repeated ids and rows give a row each; an
    empty table gives none. Other columns are ignored. Two passes over the text: p-values, spans; no shuffle of rows.
    Work grows with a text's length, not faster, and takes about ten times its bytes.
    """
    below = thresholds(docs, rate)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for b in small(batches):
            spans = [[{"kind": KINDS[k], "start": i, "end": j} for i, k, j in find(t, below)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", _common.text_or_empty().alias("text")).mapInArrow(
        _common.lean(look), f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind:string,start:int,end:int>>"
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", rate: float = 0.05) -> DataFrame:
    """``docs`` with every found span replaced by ``mark`` in text (touching spans by one) and n_chars counted anew.

    A null text stays null; all other columns stay as they are.
    """
    below = thresholds(docs, rate)
    names = docs.columns
    at = names.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for i, _, j in find(text, below):
            if i >= end:
                out += [text[end:i], mark]
            end = max(end, j)
        return "".join([*out, text[end:]])

    def replace(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts = pa.array([clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(b.columns)], names)

    out = docs.mapInArrow(_common.lean(replace), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                said = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                base = ",".join(x for k, x in said if k != "random")
                n = [sum(k == kind for k, _ in said) for kind in KINDS]
                rows.append((doc_id, *n[:3], hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in said), n[3]))
            kinds = *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()
            names = ["doc_id", *(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans", "n_random"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 7, kinds, strict=True)], names
            )

    return found.mapInArrow(
        _common.lean(digest), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
    )
