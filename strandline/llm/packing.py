"""Best-fit packing of token pieces into sequences of fixed length (operator 8)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import _common, _words
from strandline.llm._tokens import tokenizer

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
PLACED = "piece_id long, length int, sequence_id long, offset long"


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, spaced: bool = False) -> DataFrame:
    """Cuts every text's ids, end id included, into pieces of ``capacity``; only longer texts have more than one.

    A null or empty text has the end id alone; a null doc_id stays null; repeated rows make repeated pieces; an empty
    table has none; other columns are ignored. A text takes about eight times its bytes in a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(tokenizer_path, spaced)
        end = np.array([end_id], np.uint32)
        kinds = pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for i, j, data, offs in _words.blocks(b.column(1)):
                ids, at = own.encode(data, offs)
                rows = []
                for r in range(i, j):
                    x = np.concatenate([ids[at[r - i] : at[r - i + 1]], end]).astype("<u4")
                    for k, s in enumerate(range(0, len(x), capacity)):
                        p = x[s : s + capacity]
                        rows.append((doc_ids[r], k, s, len(p), zlib.crc32(p.tobytes())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            _common.tidy()  # a batch of new words leaves more free memory behind than the tables take
        own.release()

    return docs.select(F.col("doc_id").cast("long"), _common.text_or_empty().alias("text")).mapInArrow(_common.lean(cut), PIECES)


def classes(capacity: int) -> list[tuple[int, int]]:
    """Lengths (above, up to) that are placed together, longest first."""
    cuts = sorted({max(1, capacity // k) for k in (1, 2, 3, 4, 8, 32, 128)} | {0}, reverse=True)
    return list(zip(cuts[1:], cuts[:-1], strict=True))


SWEPT = "kind int, size int, part long, at long, n long, per int, start long"
#: Kinds of rows of a sweep: a run of pieces, a run of gaps, how far a length is placed, what the round comes to.
PIECES_, GAPS_, STATE_, ROUND_ = range(4)


def sweep(pieces: dict[int, tuple[int, int]], gaps: list[tuple[int, int, int, int]], lo: int, hi: int, capacity: int) -> list[tuple[int, ...]]:
    """Matches pieces of lengths above ``lo`` up to ``hi`` with gaps, all by count; rows of ``SWEPT``.

    ``pieces``: length -> (placed before, all); ``gaps``: (free, part, at, n), a run of n gaps of one size. The sweep
    goes down through the sizes: a gap below ``hi`` waits for one piece, and a piece takes the tightest gap that waits.
    Pieces that find none go on, longest first, to gaps of ``hi`` or more, which take free // hi of them, smaller gaps
    first. If more are left than found a place, as many sequences open as the rest needs at least. Pieces and places are
    numbered alike: the one that run gives to its i-th piece has start + i, a gap's places start + i * per and on.
    """
    free: dict[int, int] = {}
    for size, _, _, n in gaps:
        free[size] = free.get(size, 0) + n
    taken = {size: placed for size, (placed, _) in pieces.items()}
    out, asked, rest, stack, no = [], {}, [], [], 0
    for size in sorted({*pieces, *(x for x in free if x < hi)}, reverse=True):
        if size < hi and size in free:
            stack.append([size, free[size], 0])
        need = pieces[size][1] - pieces[size][0] if size in pieces else 0
        while need and stack:
            gap = stack[-1]
            m = min(need, gap[1])
            out.append((PIECES_, size, -1, taken[size], m, 1, no))
            asked.setdefault(gap[0], []).append((gap[2], m, 1, no))
            taken[size], need, no = taken[size] + m, need - m, no + m
            gap[1], gap[2] = gap[1] - m, gap[2] + m
            if not gap[1]:
                stack.pop()
        if need:
            rest.append((size, need))
    total = tight = no
    for size, need in rest:
        out.append((PIECES_, size, -1, taken[size], need, 1, total))
        total += need
    for size in sorted(x for x in free if x >= hi):
        per = size // hi
        used = min(free[size], -(-(total - no) // per))
        if used:
            asked.setdefault(size, []).append((0, used, per, no))
            no = min(total, no + used * per)
    begin, opened, per = no, 0, capacity // hi
    if total - no > no:
        opened = -(-(total - no) // (capacity // (lo + 1)))
        no = min(total, no + opened * per)
    more = no - tight
    for size, need in rest:
        m = min(need, more)
        taken[size] += m
        more -= m
    before = dict.fromkeys(free, 0)
    for size, part, at, n in sorted(gaps):
        r = before[size]
        for first, m, each, start in asked.get(size, ()):
            x, y = max(r, first), min(r + n, first + m)
            if x < y:
                out.append((GAPS_, size, part, at + x - r, y - x, each, start + (x - first) * each))
        before[size] += n
    out += [(STATE_, size, -1, taken[size], n, 1, 0) for size, (_, n) in pieces.items()]
    out.append((ROUND_, 0, no, opened, total - no, per, begin))  # part: places given, at: opened, n: left
    return out


def _sorted_by(df: DataFrame, column: str, key: str, name: str) -> DataFrame:
    """``df`` range-sorted and stored; ``part`` and ``at`` say where a row stands."""
    own = df.repartitionByRange(column, key).sortWithinPartitions(column, key).withColumn("at", F.monotonically_increasing_id())
    return _common.stage(own, name).withColumn("part", F.shiftright("at", 33))


def _swept(state: DataFrame, gaps: DataFrame | None, lo: int, hi: int, capacity: int) -> DataFrame:
    """``sweep`` over the counts of the pieces and open gaps, in one task: a row for each size and partition at most."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, own = {}, []
        for b in batches:
            for size, part, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if part < 0:
                    pieces[size] = (at, n)
                else:
                    own.append((size, part, at, n))
        rows = sweep(pieces, own, lo, hi, capacity)
        kinds = pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()
        names = ["kind", "size", "part", "at", "n", "per", "start"]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names)

    both = state.select("size", F.lit(-1).cast("long").alias("part"), "at", "n")
    if gaps is not None:
        open_ = gaps.where(F.col("free") > lo).groupBy(F.col("free").alias("size"), "part").agg(F.min("at").alias("at"), F.count("*").alias("n"))
        both = both.unionByName(open_)
    return _common.stage(both.coalesce(1).mapInArrow(_common.lean(look), SWEPT), "sweep")


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32): bulk-synchronous best fit.

    Pieces are range-sorted by length once, and classes of length come one after the other, longest first. In a round
    the open gaps are range-sorted; a sweep over the sizes of both matches each piece with the tightest gap that holds
    it, by count; who gets which settles by rank within a size, so no gap is asked twice; the gaps shrink and what is
    left takes another round. If gaps run out, as few sequences are opened as could hold the rest. Each round's
    placements and gaps are stored tables; the driver sees how many pieces are left. What is swept has a row for each
    size (at most ``capacity``) and partition.

    Rows are pieces of their own, also repeated ones; an empty table gives none; other columns are dropped.
    """
    spark = pieces.sparkSession
    pieces = pieces.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("piece_id", F.monotonically_increasing_id())
    pieces = _common.stage(pieces, "pieces")
    order = _sorted_by(pieces.select("piece_id", "length"), "length", "piece_id", "lengths")
    runs = order.groupBy("length", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # each size in each partition
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = _common.stage(runs.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "runs")
    rank = F.col("base") + F.col("at") - F.col("first")
    order = order.join(F.broadcast(runs), ["length", "part"]).select("piece_id", "length", rank.alias("rank"))
    lengths = runs.groupBy(F.col("length").alias("size")).agg(F.lit(0).cast("long").alias("at"), F.sum("n").alias("n"))
    gaps: DataFrame | None = None
    folder, rounds, opened = _common.shared_dir(spark, "placed"), 0, 0
    for lo, hi in classes(capacity):
        state = lengths.where((F.col("size") > lo) & (F.col("size") <= hi))
        own = order.where((F.col("length") > lo) & (F.col("length") <= hi))
        left = not state.isEmpty()
        while left:
            table = _swept(state, gaps, lo, hi, capacity)
            now = table.where(F.col("kind") == ROUND_).first()
            end, new, per, begin, left = now["part"], now["at"], now["per"], now["start"], now["n"] > 0
            state = table.where(F.col("kind") == STATE_)
            fresh = spark.range(opened, opened + new).select(F.col("id").alias("sequence_id"), F.lit(capacity).alias("free"))
            to_gap = fresh.withColumn("no", F.lit(begin) + (F.col("sequence_id") - opened) * per).withColumn("per", F.lit(per))
            all_gaps = fresh
            if gaps is not None:
                mine = table.where(F.col("kind") == GAPS_).select(F.col("size").alias("free"), "part", F.col("at").alias("first"), "n", "per", "start")
                met = gaps.join(F.broadcast(mine), ["free", "part"]).where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("n")))
                to_gap = to_gap.unionByName(met.select("sequence_id", "free", (F.col("start") + (F.col("at") - F.col("first")) * F.col("per")).alias("no"), "per"))
                all_gaps = gaps.select("sequence_id", "free").unionByName(fresh)
            opened += new
            places = to_gap.where(F.col("no") < end).withColumn("j", F.explode(F.sequence(F.lit(0), F.least("per", end - F.col("no")).cast("int") - 1)))
            places = places.select("sequence_id", "free", "j", (F.col("no") + F.col("j")).alias("no"))
            asked = table.where(F.col("kind") == PIECES_).select(F.col("size").alias("length"), "at", "n", "start")
            waiting = own.join(F.broadcast(asked), "length").where((F.col("rank") >= F.col("at")) & (F.col("rank") < F.col("at") + F.col("n")))
            waiting = waiting.select("piece_id", "length", (F.col("start") + F.col("rank") - F.col("at")).alias("no"))
            so_far = Window.partitionBy("sequence_id").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
            got = waiting.join(places, "no").withColumn("offset", capacity - F.col("free") + F.coalesce(F.sum("length").over(so_far), F.lit(0)))
            got.select("piece_id", "length", "sequence_id", F.col("offset").cast("long").alias("offset")).write.parquet(f"{folder}/{rounds}")
            got = spark.read.schema(PLACED).parquet(f"{folder}/{rounds}")
            rounds += 1
            used = got.groupBy("sequence_id").agg(F.sum("length").cast("int").alias("used"))
            rest = all_gaps.join(used, "sequence_id", "left").select("sequence_id", (F.col("free") - F.coalesce("used", F.lit(0))).alias("free"))
            gaps = _sorted_by(rest.where("free > 0"), "free", "sequence_id", "gaps")
    where = spark.read.schema(PLACED).parquet(f"{folder}/*") if rounds else spark.createDataFrame([], PLACED)
    return pieces.drop("length").join(where, "piece_id").select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op8_best_fit(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = tokenizer_path or public_tokenizers.path("word_bpe_49k.json")
    return pack(pieces_of(docs, path))
