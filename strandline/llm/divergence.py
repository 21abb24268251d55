"""How far the sources of a language differ in their words: an audit over integer-coded terms (operator 11)."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import _common, _terms

#: Documents of a language that a kept term is in at least, what is added to each count, the whole of all shares, terms listed for a group.
LEAST, ADDED, WHOLE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a chunk, sources of a block, counted rows of one range of terms.
CHUNK, BLOCK, RANGE = 4096, 256, 500_000
_I64 = np.int64
CODED = "lang string, chunk long, source string, size int, ids binary, counts binary, alls binary, total long, terms array<string>"
_CODED = pa.schema([
    ("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("size", pa.int32()), ("ids", pa.binary()),
    ("counts", pa.binary()), ("alls", pa.binary()), ("total", pa.int64()), ("terms", pa.list_(pa.string())),
])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count (occurrences) and docs (documents with the term), of all texts; partly summed in each task."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, sources = (b.column(k).dictionary_encode() for k in (0, 1))
            code = langs.indices.to_numpy().astype(_I64) * len(sources.dictionary) + sources.indices.to_numpy()
            got = []
            for i, j, data, offs in _terms.blocks(b.column(2)):
                words, row, term, n, _ = _terms.counted(data, offs, _terms.LETTERS)
                key = code[i:j][row] * max(1, len(words)) + term
                order = np.argsort(key, kind="stable")
                at = np.flatnonzero(np.diff(key[order], prepend=-1))
                if not len(at):
                    continue
                group, term = np.divmod(key[order][at], len(words))
                cols = [pa.array(group), words.take(pa.array(term)).cast(pa.string()), pa.array(np.add.reduceat(n[order], at).astype(_I64)), pa.array(np.diff(np.append(at, len(key))))]
                got.append(pa.Table.from_arrays(cols, ["group", "term", "count", "docs"]))
            if not got:
                continue
            t = pa.concat_tables(got).group_by(["group", "term"]).aggregate([("count", "sum"), ("docs", "sum")])
            lang, source = np.divmod(t["group"].to_numpy(), len(sources.dictionary))
            cols = [langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), t["term"], t["count_sum"], t["docs_sum"]]
            yield from pa.table(cols, ["lang", "source", "term", "count", "docs"]).to_batches(50_000)

    partial = docs.select("lang", "source", "text").mapInArrow(_common.lean(look), "lang string, source string, term string, count long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def coded(counts: DataFrame, least: int = LEAST, chunk: int = CHUNK, each: int = RANGE) -> DataFrame:
    """The kept terms of each language as sorted arrays in chunks, and every group's counts by term id, stored.

    Counted rows are range-partitioned by language and term into ranges of about ``each`` rows (``counts`` is read
    twice and should be stored). A range keeps its terms of ``least`` documents and more as a sorted array; a row's id
    is found in it by binary search and counts are summed by id. Chunks are numbered by range, so chunk and id follow
    the order of the terms' UTF-8 bytes. A row without a source holds the terms of a chunk; the others have the ids of
    the terms that occur in the source, how often, and how often in the whole language.
    """
    n = _common.spread(counts.count(), each, _common.parts(counts.sparkSession))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        for lang in pc.unique(table["lang"]).to_pylist():
            own = table.filter(pc.equal(table["lang"], lang))
            words, sources = (own[c].combine_chunks().dictionary_encode() for c in ("term", "source"))
            n_docs = np.bincount(words.indices.to_numpy(), own["docs"].to_numpy(), len(words.dictionary))
            names = _objects(words.dictionary)
            kept = np.sort(names[n_docs >= least])
            if not len(kept):
                continue
            place = np.minimum(np.searchsorted(kept, names), len(kept) - 1)
            ids = np.where(kept[place] == names, place, -1)[words.indices.to_numpy()]
            yield from _batches(_rows_of(lang, kept, ids, sources, own["count"].to_numpy(), chunk))

    return _common.stage(counts.repartitionByRange(n, "lang", "term").mapInArrow(_common.lean(encode), CODED), "coded")


def _objects(words: pa.Array) -> np.ndarray:
    out = np.empty(len(words), object)
    out[:] = words.cast(pa.binary()).to_pylist()
    return out


def _rows_of(lang: str, kept: np.ndarray, ids: np.ndarray, sources: pa.DictionaryArray, count: np.ndarray, chunk: int) -> Iterator[list]:
    """Rows of ``coded`` for one language's terms in a range; counted rows whose id is -1 are not kept."""
    number = TaskContext.get().partitionId() << 32
    source = sources.indices.to_numpy()[ids >= 0].astype(_I64)
    ids, count = ids[ids >= 0], count[ids >= 0]
    alls = _whole_sums(ids, count, len(kept))
    order = np.lexsort((ids, source, ids // chunk))
    ids, source, count = ids[order], source[order], count[order]
    at = np.flatnonzero(np.diff(ids // chunk * len(sources.dictionary) + source, prepend=-1))
    for a, b in zip(at.tolist(), [*at[1:].tolist(), len(ids)], strict=True):
        c = int(ids[a]) // chunk
        local = (ids[a:b] - c * chunk).astype(np.int32)
        data = local.tobytes(), count[a:b].astype(_I64).tobytes(), alls[ids[a:b]].tobytes()
        yield [lang, number + c, sources.dictionary[int(source[a])].as_py(), min(chunk, len(kept) - c * chunk), *data, int(count[a:b].sum()), None]
    for c in range(0, len(kept), chunk):
        part = [x.decode() for x in kept[c : c + chunk]]
        yield [lang, number + c // chunk, None, len(part), None, None, None, int(alls[c : c + chunk].sum()), part]


def _batches(rows: Iterator[list], each: int = 64) -> Iterator[pa.RecordBatch]:
    while part := list(itertools.islice(rows, each)):
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part, strict=True), _CODED, strict=True)], schema=_CODED)


def _whole_sums(ids: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Sums by id in whole numbers of any size up to 63 bits: high and low halves are summed apart, each exactly."""
    low, high = np.bincount(ids, count & 0xFFFFFF, n), np.bincount(ids, count >> 24, n)
    return (high.astype(_I64) << 24) + low.astype(_I64)


def shares(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(10**9 * (count + 5) / (total + 5 * kept)), three digits at a time so that nothing overflows below 9e15."""
    d = total + ADDED * kept
    if d >= 1 << 53:
        return np.array([1 + WHOLE * (int(c) + ADDED) // d for c in count], _I64)
    out, rest = np.divmod(count + ADDED, d)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, d)
        out = out * 1000 + more
    return out + 1


def _dense(ids: bytes | None, counts: bytes | None, size: int) -> np.ndarray:
    out = np.zeros(size, _I64)
    if ids:
        out[np.frombuffer(ids, np.int32)] = np.frombuffer(counts, _I64)
    return out


def _pairs(dense: DataFrame, n_parts: int) -> DataFrame:
    """lang, a, b, value: distances of sources, in part, of rows (lang, i, j, chunk, k, source, n, v, size, ids, counts).

    A task holds one chunk of two blocks of sources at a time.
    """

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = chunk = None
        rows: list[tuple] = []
        sums = names = None

        def add() -> None:
            nonlocal sums, names
            if rows:
                p = [shares(_dense(r["ids"], r["counts"], r["size"]), r["n"], r["v"]) if r["size"] else np.zeros(0, _I64) for r in rows]
                names = [(r["k"] // BLOCK, r["source"]) for r in rows]
                p = np.array(p).reshape(len(rows), -1)
                if sums is None:
                    sums = np.zeros((len(rows), len(rows)), _I64)
                for x in range(len(rows)):
                    sums[x] += np.abs(p - p[x]).sum(1)
            rows.clear()

        def out() -> Iterator[pa.RecordBatch]:
            lang, i, j = now
            for x, (block, source) in enumerate(names):
                other = [y for y, (k, _) in enumerate(names) if y != x and (i == j or k != block)]
                cols = [pa.array([lang] * len(other), pa.string()), pa.array([source] * len(other), pa.string()), pa.array([names[y][1] for y in other], pa.string()), pa.array(sums[x][other], pa.int64())]
                if other:
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "a", "b", "value"])

        for b in batches:
            for r in b.to_pylist():
                key = r["lang"], r["i"], r["j"]
                if rows and (key != now or r["chunk"] != chunk):
                    add()
                if now and key != now:
                    yield from out()
                    sums = None
                now, chunk = key, r["chunk"]
                rows.append(r)
        if now:
            add()
            yield from out()

    dealt = dense.repartition(n_parts, "lang", "i", "j", "chunk").sortWithinPartitions("lang", "i", "j", "chunk", "k")
    return dealt.mapInArrow(_common.lean(look), "lang string, a string, b string, value long")


def _tops(rows: DataFrame, top: int) -> DataFrame:
    """lang, source, chunk, id, value: at most ``top`` terms of each group and chunk whose share is over the language's."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                ids = np.frombuffer(r["ids"], np.int32)
                f = shares(np.frombuffer(r["counts"], _I64), r["n"], r["v"]) - shares(np.frombuffer(r["alls"], _I64), r["all_n"], r["v"])
                best = np.lexsort((ids, -f))[:top]
                best = best[f[best] > 0]
                n = len(best)
                cols = [pa.array([r["lang"]] * n, pa.string()), pa.array([r["source"]] * n, pa.string()), pa.array([r["chunk"]] * n, pa.int64()), pa.array(ids[best]), pa.array(f[best])]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "source", "chunk", "id", "value"])

    return rows.mapInArrow(_common.lean(look), "lang string, source string, chunk long, id int, value long")


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, chunk: int = CHUNK, each: int = RANGE) -> DataFrame:
    """lang, source, part, item, value, rank: for every (lang, source) the distances to the language's other sources
    (part ``pair``), and the terms that it has above the language's share (part ``term``, the first ``top``).

    Null text, lang and source are read as empty ones; documents are rows, so repeated rows count each; other columns
    are not read. A group without terms has the shares of zero counts; where a language keeps no term all distances are
    0; a language of one source has no pairs; an empty table gives no rows. Equal values are ranked by the item's UTF-8
    bytes. No task holds more than a range of counted terms, a source's list of sources, or a chunk of two blocks of
    sources; a term's rows are one for each source of its language.
    """
    spark = docs.sparkSession
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    rows = coded(_common.stage(term_counts(docs), "counts"), least, chunk, each)
    ids, words = rows.where("source is not null").drop("terms"), rows.where("source is null").select("lang", "chunk", "size", "total", "terms")

    groups = docs.groupBy("lang", "source").agg(F.lit(1).alias("one"))
    own = ids.groupBy("lang", "source").agg(F.sum("total").alias("n"))
    whole = words.groupBy("lang").agg(F.sum("total").alias("all_n"), F.sum("size").alias("v"))
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("n", "all_n", "v")]
    groups = groups.join(own, ["lang", "source"], "left").join(whole, "lang", "left").select("lang", "source", *zero)
    groups = _common.stage(groups.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    blocks = groups.groupBy("lang").agg(F.floor(F.max("k") / BLOCK).cast("int").alias("last"))

    # every source of a language meets every chunk of its terms, and a chunk of none, so that languages without terms have pairs
    sizes = words.select("lang", "chunk", "size").unionByName(blocks.select("lang", F.lit(-1).cast("long").alias("chunk"), F.lit(0).alias("size")))
    spread = groups.join(blocks, "lang").withColumn("_b", F.floor(F.col("k") / BLOCK).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), "last")))
    spread = spread.select("lang", "source", "n", "v", "k", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j"))
    dense = spread.join(sizes, "lang").join(ids.select("lang", "source", "chunk", "ids", "counts"), ["lang", "source", "chunk"], "left")
    pairs = _pairs(dense, _common.parts(spark)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    by_group = Window.partitionBy("lang", "source")
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "item")).cast("int"))

    known = _common.bounded(groups.select("lang", "source", "n", "all_n", "v"), 200)
    best = _tops(ids.join(known, ["lang", "source"]), top)
    best = best.withColumn("rank", F.row_number().over(by_group.orderBy(F.desc("value"), "chunk", "id")).cast("int")).where(F.col("rank") <= top)
    # each group's few listed terms look up their words
    listed = best.join(words.select("lang", "chunk", "terms"), ["lang", "chunk"]).select("lang", "source", F.lit("term").alias("part"), F.element_at("terms", F.col("id") + 1).alias("item"), "value", "rank")
    return pairs.unionByName(listed)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
t as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term from t group by all having count(distinct r) >= 30),
groups as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as c from t join kept using (lang, term) group by all),
dense as (select lang, source, term, coalesce(c, 0)::hugeint as c from groups join kept using (lang) left join c using (lang, source, term)),
p as (select *, 1 + (1000000000::hugeint * (c + 5)) // (sum(c) over w + 5 * count(*) over w) as p from dense window w as (partition by lang, source)),
q as (select lang, term, 1 + (1000000000::hugeint * (c + 5)) // (sum(c) over w + 5 * count(*) over w) as q
  from (select lang, term, sum(c)::hugeint as c from dense group by all) window w as (partition by lang)),
pairs as (select a.lang, a.source, b.source as item, coalesce(sum(abs(x.p - y.p)), 0)::bigint as value
  from groups a join groups b on a.lang = b.lang and a.source <> b.source
  left join p x on x.lang = a.lang and x.source = a.source left join p y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all),
terms as (select lang, source, term as item, (p - q)::bigint as value from p join q using (lang, term) where c > 0 and p > q)
select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item))::int as rank from pairs
union all
select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, encode(item))::int as rank from terms) where rank <= 50
"""
