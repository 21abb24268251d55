"""Benchmark decontamination by greedy string tiling (operator 2)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common, _words

#: Least words of a tile, least share of an item's words that tiles must cover, and least words that they must cover;
#: items of fewer words must stand in a document whole.
TILE, COVERAGE, LEAST = 4, 0.6, 8
_BASE, _MOD = 1_000_003, (1 << 61) - 1
PAIRS = "item_id long, covered long, n_words long, n_tiles long, coverage double"


def _normal(data: np.ndarray, offs: np.ndarray) -> _words.Words:
    """Words as runs of letters, digits and non-ASCII bytes, with A-Z lowered."""
    return _words.words(data, offs, lower=True, separators=_words.PUNCTUATION)


def _matches(p: list[int], t: list[int], free_p: list[bool], free_t: list[bool], size: int) -> tuple[list[tuple[int, int, int]], int]:
    """Maximal matches of at least ``size`` unmarked words, by hashes that run along both sequences (Karp-Rabin).

    Stops early with the length of a match more than twice ``size``, so that the caller looks for long ones first.
    """
    top = pow(_BASE, size - 1, _MOD)

    def rolled(x: list[int], free: list[bool]) -> Iterator[tuple[int, int]]:
        h = n = 0
        for i, v in enumerate(x):
            if not free[i]:
                h = n = 0
                continue
            if n == size:
                h = (h - x[i - size] * top) % _MOD
            else:
                n += 1
            h = (h * _BASE + v) % _MOD
            if n == size:
                yield i - size + 1, h

    where: dict[int, list[int]] = {}
    for i, h in rolled(p, free_p):
        where.setdefault(h, []).append(i)
    found, done = [], {}
    for j, h in rolled(t, free_t):
        for i in where.get(h, ()):
            if done.get(i - j, -1) > j:  # inside a match of this diagonal that is listed already
                continue
            k = 0
            while i + k < len(p) and j + k < len(t) and free_p[i + k] and free_t[j + k] and p[i + k] == t[j + k]:
                k += 1
            if k > 2 * size:
                return [], k
            if k >= size:
                found.append((k, i, j))
                done[i - j] = j + k
    return found, 0


def tiles(p: list[int], t: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling: (length, place in p, place in t); longest matches first, no word of either side in two tiles."""
    free_p, free_t = [True] * len(p), [True] * len(t)
    out, size = [], max(least, min(20, len(p)))
    while True:
        found, longer = _matches(p, t, free_p, free_t, size)
        if longer:
            size = longer
            continue
        for k, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_p[i : i + k]) and all(free_t[j : j + k]):
                free_p[i : i + k] = free_t[j : j + k] = [False] * k
                out.append((k, i, j))
        if size > least:
            size = max(least, size // 2)
        elif not found:  # else what is left of overlapped matches may hold shorter ones
            return out


def _cover(item: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> tuple[int, int]:
    """(words of the item under tiles, number of tiles); only the stretches of the document that hold seeds are tiled."""
    index = {h: k for k, h in enumerate(np.unique(item).tolist(), 1)}
    p = [index[h] for h in item.tolist()]
    t: list[int] = []
    end = -1
    for s in starts.tolist():
        if s > end:
            t.append(-s - 1)  # a word of its own parts the stretches
            end = s
        t += [index.get(h, 0) for h in doc[end : s + TILE].tolist()]
        end = max(end, s + TILE)
    found = tiles(p, t)
    return sum(k for k, _, _ in found), len(found)


def seeds(benchmark: DataFrame) -> DataFrame:
    """Items with words: item_id, n_words, words (their hashes). Of rows with one item_id all count."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in _words.blocks(b.column(1)):
                w = _normal(data, offs)
                own = [w.hash[p:q].tobytes() for p, q in zip(w.first[:-1], w.first[1:], strict=True)]
                cols = [b.column(0).slice(i, j - i), pa.array(w.counts), pa.array(own, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["item_id", "n_words", "words"])

    rows = benchmark.select(F.col("item_id").cast("long"), _common.text_or_empty().alias("text"))
    return rows.mapInArrow(_common.lean(look), "item_id long, n_words long, words binary").where("n_words > 0").distinct()


class _Index:
    """Sorted seeds of all items, for lookups by whole arrays."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in {len(w) for _, w in items if len(w) < LEAST}:
            own = [(_words.runs(w, n)[0], i) for i, w in items if len(w) == n]
            order = np.argsort([h for h, _ in own], kind="stable")
            self.short[n] = np.array([h for h, _ in own], np.uint64)[order], np.array([i for _, i in own])[order]
        self.items = items = [x for x in items if len(x[1]) >= LEAST]
        h = [_words.runs(w, TILE) for _, w in items]
        self.hash = np.concatenate([*h, np.zeros(0, np.uint64)])
        self.item = np.repeat(np.arange(len(items)), [len(x) for x in h])
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.item = self.hash[order], self.item[order]
        self.low = np.zeros(1 << 16, bool)  # by the low bits, before the search
        self.low[(self.hash & np.uint64(0xFFFF)).astype(np.int64)] = True

    def pairs(self, data: np.ndarray, offs: np.ndarray, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item_id, covered, n_words, tiles) of each pair at or above ``coverage``."""
        w = _normal(data, offs)
        for n, (hashes, ids) in self.short.items():
            runs = _words.runs(w.hash, n)
            at = np.flatnonzero(np.isin(runs, hashes) & _words.inside_rows(w.first, n, len(runs)))
            row = np.searchsorted(w.first, at, "right") - 1
            for r, h in np.unique(np.stack([row.astype(np.uint64), runs[at]]), axis=1).T:
                for item_id in ids[np.searchsorted(hashes, h) : np.searchsorted(hashes, h, "right")].tolist():
                    yield int(r), item_id, n, n, 1
        runs = _words.runs(w.hash, TILE)
        at = np.flatnonzero(self.low[(runs & np.uint64(0xFFFF)).astype(np.int64)])
        a = np.searchsorted(self.hash, runs[at], "left")
        n = np.searchsorted(self.hash, runs[at], "right") - a
        ok = (n > 0) & _words.inside_rows(w.first, TILE, len(runs))[at]
        at, a, n = at[ok], a[ok], n[ok]
        if not len(at):  # none, or only across the ends of rows
            return
        total = int(n.sum())
        place = np.repeat(at, n)
        item = self.item[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(total)]
        row = np.searchsorted(w.first, place, "right") - 1
        key = np.unique(np.stack([row, item, place]), axis=1)
        new = np.flatnonzero(np.diff(key[0], prepend=-1) | np.diff(key[1], prepend=-1))
        for s, e in zip(new, np.append(new[1:], key.shape[1]), strict=True):
            r, i = int(key[0, s]), int(key[1, s])
            item_id, words = self.items[i]
            if (e - s) * TILE < max(LEAST, coverage * len(words)):  # a tile has a seed for each of its first words
                continue
            covered, k = _cover(words, w.hash[w.first[r] : w.first[r + 1]], key[2, s:e] - w.first[r])
            if covered >= max(LEAST, coverage * len(words)):
                yield r, item_id, covered, len(words), k


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, limit: int = _common.BROADCAST_BYTES) -> DataFrame:
    """Pairs of a document and a benchmark item whose words lie under tiles for ``coverage`` or more, 8 at least.

    Words ignore case and ASCII punctuation; a tile is a match of 4 words or more, so passages in another order, or
    with changed words between, still add up. Seeds (runs of 4 words that both share) bring the pairs. Items that fit
    ``limit`` bytes go to every task, which tiles its documents without a shuffle; larger benchmarks are joined by
    seed. An item of fewer than 8 words counts when it stands in the document whole, as one run of its words. Null or
    empty texts (of either side) and empty tables give no pairs; a null doc_id is kept as it is; repeated rows give
    repeated pairs, repeated items one; other columns are ignored. A text takes about eight times its bytes in a task.
    """
    items = _common.stage(seeds(benchmark).withColumn("item", F.monotonically_increasing_id()), "items")
    size = items.agg(F.sum(F.length("words") * 2 + 16)).first()[0] or 0
    own = docs.select(F.col("doc_id").cast("long"), _common.text_or_empty().alias("text"))
    if size > limit:
        return _joined(own, items, coverage)
    found = sorted((r["item_id"], bytes(r["words"])) for r in items.collect())
    index = docs.sparkSession.sparkContext.broadcast(_Index([(i, np.frombuffer(x, np.uint64)) for i, x in found]))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for i, _, data, offs in _words.blocks(b.column(1)):
                yield _batch([(ids[i + r], *x) for r, *x in index.value.pairs(data, offs, coverage)])

    return own.mapInArrow(_common.lean(look), f"doc_id long, {PAIRS}")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    rows = [(d, i, c, n, k, c / n) for d, i, c, n, k in rows]
    kinds = *[pa.int64()] * 5, pa.float64()
    names = ["doc_id", "item_id", "covered", "n_words", "n_tiles", "coverage"]
    return pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 6, kinds, strict=True)], names
    )


def _joined(docs: DataFrame, items: DataFrame, coverage: float) -> DataFrame:
    """The same pairs for a benchmark of any size: seeds are joined, then each pair's words are tiled."""

    # runs of 4 words, and of as many as short items have
    sizes = sorted({TILE, *(r["n_words"] for r in items.where(F.col("n_words") < LEAST).select("n_words").distinct().collect())})

    def doc_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in _words.blocks(b.column(1)):
                w = _normal(data, offs)
                for n in sizes:
                    runs = _words.runs(w.hash, n)
                    at = np.flatnonzero(_words.inside_rows(w.first, n, len(runs)))
                    row = np.searchsorted(w.first, at, "right") - 1
                    ids = b.column(0).slice(i, j - i).take(pa.array(row))
                    cols = [ids, pa.array(at - w.first[row]), pa.array(runs[at].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "place", "seed"])

    def item_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = np.frombuffer(x, np.uint64)
                runs = np.unique(_words.runs(words, TILE if len(words) >= LEAST else len(words))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(runs), i)), pa.array(runs)], ["item", "seed"])

    # one key for each row, so that repeated documents stay apart; the deal must not change when a task runs again
    keyed = _common.stage(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    left = keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(_common.lean(doc_seeds), "doc_id long, place long, seed long")
    right = items.select("item", "words").mapInArrow(_common.lean(item_seeds), "item long, seed long")
    met = _common.spread_join(left, right, ["seed"], F.xxhash64("doc_id", "place"), "inner")  # a common run stands in very many rows
    hits = (
        met.groupBy(F.col("doc_id").alias("row"), "item")
        .agg(F.sort_array(F.collect_set("place")).alias("places"))  # at most the words of one document
        .join(items, "item")
        .where((F.size("places") * TILE >= F.greatest(F.lit(LEAST), F.col("n_words") * coverage)) | (F.col("n_words") < LEAST))
    )
    both = hits.join(keyed, "row").select("doc_id", "text", "item_id", "words", "places")

    def tile(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            cols = [b.column(k).to_pylist() for k in (0, 2, 3, 4)]
            for k, (doc_id, item_id, words, places) in enumerate(zip(*cols, strict=True)):
                item = np.frombuffer(words, np.uint64)
                if len(item) < LEAST:
                    rows.append((doc_id, item_id, len(item), len(item), 1))
                    continue
                data, offs = _words.columns(b.column(1).slice(k, 1))
                covered, n = _cover(item, _normal(data, offs).hash, np.array(places))
                if covered >= max(LEAST, coverage * len(item)):
                    rows.append((doc_id, item_id, covered, len(item), n))
            yield _batch(rows)

    return both.mapInArrow(_common.lean(tile), f"doc_id long, {PAIRS}")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
