"""Language identification by prediction by partial matching over bytes (operator 12)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import _common, _words

#: Bytes of the longest context, parts of a bit in which code lengths are counted.
ORDER, UNIT = 4, 1 << 16
#: Bounds of what is learned from and kept: texts and grams of a language, languages, code lengths of an order.
SAMPLE, GRAMS, LANGUAGES, CELLS = 1000, 200_000, 64, 1 << 25
#: Stands before a text's first byte.
PAD = 10
_I64, _U64 = np.int64, np.uint64


def is_held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def grams(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """For each byte of each row the number made of it and the ORDER bytes before it, the nearest ones lowest."""
    out = data.astype(_I64)
    for k in range(1, ORDER + 1):
        before = np.empty(len(data), np.uint8)
        before[k:] = data[:-k]
        for j in range(k):
            at = offs[:-1] + j
            before[at[at < offs[1:]]] = PAD
        out |= before.astype(_I64) << (8 * k)
    return out


class Table:
    """Places of whole numbers in a sorted array, found by open addressing; -1 for those that are not in it."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, _I64)
        self.places = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slots(keys)
        while len(left):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[left[free]]  # of several the last written stays
            own = self.keys[slot] == keys[left]
            self.places[slot[own]] = left[own]
            left, slot = left[~own], (slot[~own] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U64) * _U64(_words._R)) >> _U64(64 - self.bits)).astype(_I64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slots(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.places[slot], -1)
        left = np.flatnonzero((have != keys) & (have != -1))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot]
            hit = have == keys[left]
            out[left[hit]] = self.places[slot[hit]]
            more = ~hit & (have != -1)
            left, slot = left[more], slot[more]
        return out


@dataclass
class Order:
    """One order's contexts: code lengths of the bytes seen behind them and of an escape, by language."""

    seen: Table
    costs: np.ndarray
    contexts: Table
    escapes: np.ndarray


class Model:
    """Context trees of all languages, merged: costs are by language, in parts of a bit.

    A byte's probability behind the longest context known is count / (total + different bytes), an escape's to the next
    shorter context different bytes / (total + different bytes); behind the empty context stands one of 256 bytes. A
    language that does not know a context goes to the next shorter one at no cost. Statistics are frozen, so all code
    lengths are computed once, shorter contexts' ones as part of the longer ones'.
    """

    def __init__(self, languages: list[str], key: np.ndarray, language: np.ndarray, count: np.ndarray):
        self.languages = languages
        width = len(languages)
        self.orders: list[Order] = []
        lower = None
        for k in range(ORDER + 1):
            keys, at = np.unique(key & ((1 << 8 * (k + 1)) - 1), return_inverse=True)
            n = np.zeros((len(keys), width))
            np.add.at(n, (at, language), count)
            contexts, own = np.unique(keys >> 8, return_inverse=True)
            total, different = np.zeros((len(contexts), width)), np.zeros((len(contexts), width))
            np.add.at(total, own, n)
            np.add.at(different, own, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(different / (total + different)), 0.0)
                shorter = 8.0 if lower is None else lower[1][np.searchsorted(lower[0], keys & ((1 << 8 * k) - 1))]
                costs = np.where(n > 0, -np.log2(n / (total + different)[own]), escape[own] + shorter)
            lower = keys, costs
            self.orders.append(Order(Table(keys), np.rint(costs * UNIT).astype(np.int32), Table(contexts), np.rint(escape * UNIT).astype(np.int32)))

    def code_lengths(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Parts of a bit that each row takes in each language; the same whatever rows stand beside it."""
        width = len(self.languages)
        out = np.zeros((len(offs) - 1, width), _I64)
        if not len(data) or not width:
            return out
        keys = grams(data, offs)
        step = max(1, (1 << 20) // width)
        for a in range(0, len(keys), step):
            b = min(len(keys), a + step)
            now = np.zeros((b - a, width), np.int32)
            left = np.arange(b - a)
            for k in range(ORDER, -1, -1):
                own = keys[a:b][left] & ((1 << 8 * (k + 1)) - 1)
                place = self.orders[k].seen.find(own)
                hit = place >= 0
                now[left[hit]] += self.orders[k].costs[place[hit]]
                left = left[~hit]
                if not len(left):
                    break
                context = self.orders[k].contexts.find(own[~hit] >> 8)
                known = context >= 0
                now[left[known]] += self.orders[k].escapes[context[known]]
            now[left] += 8 * UNIT
            first, last = np.searchsorted(offs, a, "right") - 1, np.searchsorted(offs, b)
            rows = np.arange(first, last)
            rows = rows[offs[rows + 1] > offs[rows]]
            np.add.at(out, rows, np.add.reduceat(now, np.maximum(offs[rows], a) - a, axis=0, dtype=_I64))
        return out


def sampled(docs: DataFrame, sample: int, languages: int) -> DataFrame:
    """lang, text: at most ``sample`` different texts of each of the ``languages`` languages of the most texts, by hash of the text.

    Twice as many are drawn by a share of the hashes (of about how many there are, by a sketch); a task lets go of copies, so a text of very many copies is sent
    once a task.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    rows = rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).withColumn("h", F.xxhash64("lang", "text"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    shares = sizes.select("lang", F.ceil(F.lit(2 * sample * (1 << 20)) / F.col("n")).alias("share"))
    drawn = rows.join(F.broadcast(shares), "lang")
    drawn = drawn.where(F.pmod("h", F.lit(1 << 20)) < F.col("share")).select("lang", "h", "text")

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = []
            for k, h in enumerate(b.column(1).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    new.append(k)
            yield b.take(pa.array(new, pa.int64()))

    drawn = drawn.mapInArrow(_common.lean(once), drawn.schema).dropDuplicates(["lang", "h"])
    by = Window.partitionBy("lang").orderBy("h")
    return drawn.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= sample).select("lang", "text")


def train(docs: DataFrame, sample: int = SAMPLE, most: int = GRAMS, languages: int = LANGUAGES) -> Model:
    """Learns from at most ``sample`` texts of a language that are not held out; of the grams of ORDER + 1 bytes in them
    a language keeps the ``most`` frequent ones (ties by number), fewer where many languages would make it more than 32
    million code lengths in all (from 13 languages on; 8,192 grams each of 64).

    These bounds (documented parameters) keep the model below 200 MB at any corpus size. Rows without lang, doc_id or
    text don't count; copies of a text count once; without any the model knows no language.
    """
    texts = sampled(docs, sample, languages)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang = b.column(0).dictionary_encode()
            code = lang.indices.to_numpy()
            for i, j, data, offs in _words.blocks(b.column(1), 1 << 20):
                key = grams(data, offs)
                of = np.repeat(code[i:j], np.diff(offs))
                order = np.lexsort((key, of))
                key, of = key[order], of[order]
                at = np.flatnonzero((np.diff(key, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of[at])), pa.array(key[at]), pa.array(np.diff(np.append(at, len(key))))], ["lang", "gram", "n"])

    found = texts.mapInArrow(_common.lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = _common.stage(found, "grams")
    names = [r["lang"] for r in found.select("lang").distinct().collect()]
    most = max(1, min(most, CELLS // max(1, len(names)) ** 2))
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    kept = found.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most).select("lang", "gram", "n").toArrow()
    names.sort(key=str.encode)
    place = {x: k for k, x in enumerate(names)}
    lang = kept["lang"].combine_chunks().dictionary_encode() if kept.num_rows else pa.array([], pa.string()).dictionary_encode()
    code = np.array([place[x] for x in lang.dictionary.to_pylist()], _I64)[lang.indices.to_numpy()] if kept.num_rows else np.zeros(0, _I64)
    model = Model(names, kept["gram"].to_numpy(), code, kept["n"].to_numpy())
    del kept
    _common.tidy()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs``, lang_pred and lang_score.

    lang_pred is the language in which the whole text takes the fewest bits (of equal ones the first by UTF-8 bytes),
    lang_score its share of all languages' probabilities of the text. A text that is null or has no letter is ``und``
    with a score of 0, as is every text under a model without languages. Rows are scored one by one, repeated ones
    alike; columns lang_pred and lang_score of ``docs`` are replaced; an empty table gives none.
    """
    docs = docs.drop("lang_pred", "lang_score").withColumn("_letter", F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            got = [model.code_lengths(data, offs) for _, _, data, offs in _words.blocks(b.column(at))]
            bits = np.concatenate(got) if got else np.zeros((0, len(model.languages)), _I64)
            known = b.column(len(names) - 1).to_numpy(zero_copy_only=False) & bool(model.languages)
            if model.languages:
                best = bits.argmin(1)
                share = 1 / np.exp2(np.maximum(-1000, (bits.min(1, keepdims=True) - bits) / UNIT)).sum(1)
                pred = pa.array(model.languages, pa.string()).take(pa.array(best))
            else:
                share, pred = np.zeros(b.num_rows), pa.nulls(b.num_rows, pa.string())
            pred = pa.array([p if k else "und" for p, k in zip(pred.to_pylist(), known, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pred, pa.array(np.where(known, share, 0.0))], [*names[:-1], "lang_pred", "lang_score"])

    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    fields = [*docs.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("lang_score", DoubleType())]
    return docs.mapInArrow(_common.lean(look), StructType(fields))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out (null for a null doc_id), lang_pred and score of every row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", is_held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
