"""Ranked lexical search over stored posting lists in blocks of varying length (operator 13)."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import _common, _terms, _words

#: Documents and postings of a shard at most (a single document may have more postings).
SHARD, POSTINGS = 1 << 14, 1 << 21
#: Postings between two places where a block may end, steps of that kind in a block at most, and what a block costs.
GRID, LONGEST = 8, 24
#: Bytes of items that are searched for at once.
ITEMS = 8 << 20
_I64 = np.int64
RAW = "ids array<long>, lengths binary, terms array<string>, starts binary, docs binary, tfs binary, n_docs long, n_terms long"
INDEX = "ids array<long>, terms array<string>, starts binary, docs binary, parts binary, first binary, ends binary, tops binary"


def postings(docs: DataFrame, only: pa.Array | None = None) -> DataFrame:
    """Shards of documents with their terms' posting lists: local document numbers and occurrences, by term.

    Shards are runs of rows of a task, so nothing is shuffled. Every document is in a shard, also one without terms.
    ``only`` keeps the lists of some terms (every term counts in lengths and totals).
    """
    names = ["ids", "lengths", "terms", "starts", "docs", "tfs", "n_docs", "n_terms"]

    def shard(held: list[tuple]) -> pa.RecordBatch:
        ids = pa.concat_arrays([x[0] for x in held])
        lengths = np.concatenate([x[1] for x in held])
        base = np.cumsum([0, *[len(x[1]) for x in held]])
        words = pa.concat_arrays([x[2] for x in held])
        coded = words.dictionary_encode()
        back = np.split(coded.indices.to_numpy(), np.cumsum([len(x[2]) for x in held])[:-1])
        code = np.concatenate([back[k][x[4]] for k, x in enumerate(held)])
        row = np.concatenate([x[3] + base[k] for k, x in enumerate(held)])
        tf = np.concatenate([x[5] for x in held])
        order = np.lexsort((row, code))
        starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1)).astype(np.int32)
        data = lengths.astype(_I64).tobytes(), starts.tobytes(), row[order].astype(np.int32).tobytes(), tf[order].astype(np.int32).tobytes()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, coded.dictionary)]
        cols = [lists[0], pa.array(data[:1]), lists[1], *(pa.array([x]) for x in data[1:]), pa.array([int((lengths > 0).sum())]), pa.array([int(lengths.sum())])]
        return pa.RecordBatch.from_arrays(cols, names)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        n_docs = n_posts = 0
        for b in batches:
            for i, j, data, offs in _terms.blocks(b.column(1)):
                words, row, term, tf, lengths = _terms.counted(data, offs, _terms.ALNUM)
                if only is not None:
                    known = pc.is_in(words, value_set=only.cast(words.type))
                    place = np.cumsum(known.to_numpy(zero_copy_only=False)) - 1
                    ok = known.to_numpy(zero_copy_only=False)[term]
                    words, row, term, tf = words.filter(known), row[ok], place[term[ok]], tf[ok]
                if held and (n_docs + j - i > SHARD or n_posts + len(row) > POSTINGS):
                    yield shard(held)
                    held, n_docs, n_posts = [], 0, 0
                held.append((b.column(0).slice(i, j - i), lengths, words.cast(pa.string()), row, term, tf))
                n_docs, n_posts = n_docs + j - i, n_posts + len(row)
        if held:
            yield shard(held)

    rows = docs.select(F.col("doc_id").cast("long"), _common.text_or_empty().alias("text"))
    return rows.mapInArrow(_common.lean(look), RAW)


def damp(lengths: np.ndarray, n: int, total: int) -> np.ndarray:
    """m of each document: 75 + (25 * length * n) div total, in whole numbers."""
    if len(lengths) and 25 * int(lengths.max()) * n >= 1 << 63:
        return np.array([75 + 25 * int(x) * n // total for x in lengths], _I64)
    return 75 + 25 * lengths * n // max(1, total)


def cut_blocks(parts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of each list's blocks (places in ``parts``) and where each list's ends begin, with the least bound error.

    A block bounds each of its postings by its highest, so a cut's error is the sum of what bounds exceed postings by;
    each block also costs the list's highest part, as one evaluated posting more would. Blocks end at every eighth
    posting of a list (or at its end) and have up to 192. The dynamic program runs over many lists of a shard in step,
    those of like length together.
    """
    n = np.diff(starts)
    cells = -(-n // GRID)
    lists = np.argsort(-cells, kind="stable")
    lists = lists[: np.count_nonzero(cells)]
    ends: list[list[int]] = [[]] * len(n)
    a = 0
    while a < len(lists):
        b = a + max(1, (1 << 20) // int(cells[lists[a]]))
        for x, own in zip(lists[a:b].tolist(), _cut(parts, starts[:-1][lists[a:b]], n[lists[a:b]], cells[lists[a:b]]), strict=True):
            ends[x] = own
        a = b
    first = np.cumsum([0, *map(len, ends)])
    return np.array([e for x in ends for e in x], np.int32), first.astype(np.int32)


def _cut(parts: np.ndarray, begin: np.ndarray, n: np.ndarray, cells: np.ndarray) -> Iterator[list[int]]:
    """The ends of blocks of lists that are given longest first; best[:, i] is the least error of their first i cells."""
    at = np.cumsum(np.append(0, cells))
    inner = np.arange(at[-1]) - np.repeat(at[:-1], cells)
    edge = np.repeat(begin, cells) + inner * GRID
    size = np.minimum(GRID, np.repeat(n, cells) - inner * GRID)
    high, sums = (f.reduceat(np.append(parts, 0), np.stack([edge, edge + size], 1).ravel())[::2] for f in (np.maximum, np.add))
    price = np.maximum.reduceat(high, at[:-1])
    best = np.zeros((len(cells), cells[0] + 1), _I64)
    last = np.zeros(best.shape, np.int16)
    for i in range(1, int(cells[0]) + 1):
        live = int(np.searchsorted(-cells, -i, "right"))
        top, total, count, choice = np.zeros(live, _I64), np.zeros(live, _I64), np.zeros(live, _I64), np.zeros(live, np.int16)
        least = np.full(live, np.iinfo(_I64).max)
        for k in range(1, min(i, LONGEST) + 1):
            cell = at[:live] + i - k
            np.maximum(top, high[cell], out=top)
            total += sums[cell]
            count += size[cell]
            cost = best[:live, i - k] + top * count - total + price[:live]
            less = cost < least
            least[less], choice[less] = cost[less], k
        best[:live, i], last[:live, i] = least, choice
    for x in range(len(cells)):
        i, out = int(cells[x]), []
        while i:
            out.append(int(begin[x] + min(i * GRID, n[x])))
            i -= int(last[x, i])
        yield out[::-1]


def index(raw: DataFrame, n: int, total: int) -> DataFrame:
    """Posting lists with each posting's part of a score (its term's weight left out), and their blocks with the highest part."""
    names = ["ids", "terms", "starts", "docs", "parts", "first", "ends", "tops"]

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lengths, starts, docs, tf = (np.frombuffer(b.column(c)[k].as_py(), t) for c, t in (("lengths", _I64), ("starts", np.int32), ("docs", np.int32), ("tfs", np.int32)))
                tf = tf.astype(_I64)
                parts = 1_000_000_000 * tf // (1000 * tf + 12 * damp(lengths, n, total)[docs])
                ends, first = cut_blocks(parts, starts.astype(_I64))
                begin = np.empty(len(ends), _I64)
                begin[1:] = ends[:-1]
                begin[:1] = 0
                tops = np.maximum.reduceat(parts, begin) if len(ends) else parts[:0]
                cols = [b.column("ids").slice(k, 1), b.column("terms").slice(k, 1), b.column("starts").slice(k, 1), b.column("docs").slice(k, 1)]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.array([x.astype(np.int32).tobytes()]) for x in (parts, first, ends, tops)]], names)

    return raw.mapInArrow(_common.lean(look), INDEX)


class _Shard:
    """One shard's lists, for searches of items one after another."""

    def __init__(self, row: dict[str, pa.Scalar], known: pa.Array, weights: np.ndarray):
        self.ids = row["ids"].values
        self.n = len(self.ids)
        self.starts, self.docs, self.parts, self.first, self.ends, self.tops = (np.frombuffer(row[c].as_py(), np.int32) for c in ("starts", "docs", "parts", "first", "ends", "tops"))
        terms = row["terms"].values
        here = pc.index_in(known, value_set=terms.cast(known.type)) if len(terms) else pa.nulls(len(known), pa.int32())
        self.list_of = here.fill_null(-1).to_numpy(zero_copy_only=False)
        self.weights = weights
        # first document of each block and of the one behind it in its list
        begin = np.empty(len(self.ends), np.int32)
        begin[1:] = self.ends[:-1]
        begin[:1] = 0
        self.begin, self.low, self.high = begin, self.docs[begin], self.docs[self.ends - 1]

    def search(self, terms: np.ndarray, repeats: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Local numbers and scores of documents that may be among the k best and score ``least`` or more, all that tie included.

        The items' blocks cut the shard into ranges of documents within which the same blocks stand. A range's bound is
        the sum of its blocks' highest scores; ranges whose bound is below what the k-th best has reached (pivots that
        cannot succeed) are skipped with all their postings, the others are scored whole, those of the highest bounds first.
        """
        own = self.list_of[terms]
        repeats, own = repeats[own >= 0] * self.weights[terms[own >= 0]], own[own >= 0]
        if not len(own):
            return np.zeros(0, _I64), np.zeros(0, _I64)
        blocks = np.concatenate([np.arange(self.first[x], self.first[x + 1]) for x in own])
        factor = np.repeat(repeats, self.first[own + 1] - self.first[own])
        # what stands at each document: up where a block begins, down behind its end
        steps = np.zeros(self.n + 1, _I64)
        tops = factor * self.tops[blocks]
        np.add.at(steps, self.low[blocks], tops)
        np.add.at(steps, self.high[blocks] + 1, -tops)
        bound = np.cumsum(steps[:-1])
        cut = np.zeros(self.n, bool)
        cut[self.low[blocks]] = True
        after = self.high[blocks] + 1
        cut[after[after < self.n]] = True
        cut[0] = True
        edges = np.append(np.flatnonzero(cut), self.n)
        bounds = bound[edges[:-1]]
        order = np.argsort(-bounds, kind="stable")
        range_of = np.cumsum(cut) - 1
        scores = np.zeros(self.n, _I64)
        found: list[np.ndarray] = []
        best = np.zeros(0, _I64)
        at, step = 0, max(8, k // 4)
        while at < len(order):
            floor = max(least, int(best[-1]) if len(best) == k else 1)
            now = order[at : at + step]
            now = now[bounds[now] >= floor]
            if not len(now):
                break  # bounds fall, so all others are below too
            at, step = at + step, step * 4
            live = np.zeros(len(bounds), bool)
            live[now] = True
            live = live[range_of]
            upto = np.append(0, np.cumsum(live))
            some = upto[self.high[blocks] + 1] > upto[self.low[blocks]]
            for b, f in zip(blocks[some].tolist(), factor[some], strict=True):  # f stays 64 bits wide
                docs = self.docs[self.begin[b] : self.ends[b]]
                scores[docs] += f * self.parts[self.begin[b] : self.ends[b]]
            hit = np.flatnonzero(live & (scores >= floor))
            got = scores[hit]
            scores[:] = 0
            found.append(np.stack([hit, got]))
            best = np.sort(np.concatenate([best, got]))[::-1][:k]
        if not found:
            return np.zeros(0, _I64), np.zeros(0, _I64)
        hit, got = np.concatenate(found, 1)
        floor = max(least, int(best[-1]) if len(best) == k else 1)
        return hit[got >= floor], got[got >= floor]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _searched(stored: DataFrame, items: list[tuple[int, list[int], list[int]]], known: pa.Array, weights: np.ndarray, k: int) -> DataFrame:
    """item (place in ``items``), doc_id, score: the k best of each task's shards."""
    shared = stored.sparkSession.sparkContext.broadcast((items, known, weights))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known, weights = shared.value
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, _I64), np.zeros(0, bool), np.zeros(0, _I64))] * len(items)
        for b in batches:
            for x in range(b.num_rows):
                shard = _Shard({c: b.column(c)[x] for c in b.schema.names}, known, weights)
                none = shard.ids.is_null().to_numpy(zero_copy_only=False)
                ids = shard.ids.fill_null(0).to_numpy(zero_copy_only=False)
                for i, (_, terms, repeats) in enumerate(items):
                    old = best[i]
                    hit, score = shard.search(terms, repeats, int(old[2][-1]) if len(old[2]) == k else 1, k)
                    if len(hit):
                        own, lost, score = np.append(old[0], ids[hit]), np.append(old[1], none[hit]), np.append(old[2], score)
                        order = np.lexsort((own, lost, -score))[:k]
                        best[i] = own[order], lost[order], score[order]
        for i, (own, lost, score) in enumerate(best):
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i)), pa.array(own, mask=lost), pa.array(score)], ["item", "doc_id", "score"])

    return stored.mapInArrow(_common.lean(look), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, at_once: int = ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item, of scores above 0.

    Documents are rows: rows that share a doc_id are ranked each; equal scores are ordered by doc_id, null last. Items of
    one item_id that differ in text are ranked each, repeated ones once; null and empty texts, of documents or items,
    have no terms and give no rows; an empty table gives none. Other columns are not read. Items are searched for in
    blocks of about 8 MB of text, so what goes to every task is bounded; a block reads the documents anew. A task holds
    one shard, at most 16,384 documents and 2 million postings, or those of one block of text.
    """
    spark = docs.sparkSession
    own = items.select("item_id", _common.text_or_empty().alias("text")).distinct()
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = _common.spread(size, at_once, 1)
    own = _common.stage(own.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), "items")
    kind = dict(items.dtypes)["item_id"]
    out = None
    for block in range(n_blocks):
        rows = own.where(F.col("_block") == block).select("item_id", "text").toArrow()
        found = _search_block(spark, docs, rows, kind, k)
        out = found if out is None else out.unionByName(found)
    return out


def _search_block(spark: SparkSession, docs: DataFrame, rows: pa.Table, kind: str, k: int) -> DataFrame:
    text = rows["text"].combine_chunks()
    data, offs = _words.columns(text)
    words, row, term, tf, _ = _terms.counted(data, offs, _terms.ALNUM)
    order = np.argsort(row, kind="stable")
    edges = np.searchsorted(row[order], np.arange(len(text) + 1))
    queries = [(i, term[order][a:b], tf[order][a:b].astype(_I64)) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
    raw = _common.stage(postings(docs, words), "postings")
    n, total = raw.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    stored = _common.stage(index(raw, n or 0, total or 0), "index")
    # documents of a term: the lengths of its lists; as many rows as the items have terms
    df = dict(_list_lengths(raw).groupBy("term").agg(F.sum("n")).collect())
    known = words.cast(pa.string())
    weights = np.array([weight(n or 0, df.get(w, 0)) for w in known.to_pylist()], _I64)
    found = _searched(stored, queries, known, weights, k)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, x) for i, x in enumerate(rows["item_id"].to_pylist())], f"item long, item_id {kind}")
    return found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def _list_lengths(raw: DataFrame) -> DataFrame:
    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                starts = np.frombuffer(b.column(1)[k].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, pa.array(np.diff(starts).astype(_I64))], ["term", "n"])

    return raw.select("terms", "starts").mapInArrow(look, "term string, n long")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
with d as (select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item_id, term, count(*) as repeats from i group by all),
tf as (select r, doc_id, term, count(*) as tf from d group by all),
lengths as (select r, sum(tf)::bigint as n from tf group by r),
totals as (select count(*) as docs, sum(n)::bigint as total from lengths),
m as (select r, 75 + (25 * n * docs) // total as m from lengths, totals),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, totals group by term),
s as (select item_id, r, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from q join tf using (term) join w using (term) join m using (r) group by all having score > 0),
ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s)
select * from ranked where rank <= 20
"""
