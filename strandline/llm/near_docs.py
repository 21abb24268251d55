"""Near-duplicate documents by a prefix-tree join over n-gram sets (operator 7)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common, _words

#: Words of a shingle. Two sets link when 7 * shared >= 3 * (sum of sizes), which is a Jaccard similarity of 0.75.
SHINGLE = 5
#: Shingles and rows that one packed block holds, pairs of one leader that meet in one task, sets in one tree.
BLOCK, BLOCK_ROWS, FAN, TREE = 1 << 19, 60_000, 2048, 256
#: Rows of a token on either side that are joined in one task.
SLICE = 4096
#: Bits of a set's signature, as columns of 64.
BITS = 1024
SIGNATURE = [f"s{k}" for k in range(BITS // 64)]
_I64, _U64 = np.int64, np.uint64


def shingle_sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin.

    A row with fewer words than a shingle has its whole sequence as one; a row without words has none.
    """
    w = _words.words(data, offs, lower=True)
    runs = _words.runs(w.hash, SHINGLE)
    at = np.flatnonzero(_words.inside_rows(w.first, SHINGLE, len(runs)))
    row = np.searchsorted(w.first, at, "right") - 1
    h = runs[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
    if len(short):
        own = [_words.runs(w.hash[w.first[r] : w.first[r + 1]], int(w.counts[r]))[0] for r in short.tolist()]
        h, row = np.concatenate([h, np.array(own, _U64)]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(offs)))


def fingerprints(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """128 bits in two columns for each row, which equal sets share."""
    out = np.empty((len(first) - 1, 2), _I64)
    for k, salt in enumerate((0x51, 0xA7)):
        sums = np.concatenate([[_U64(0)], np.cumsum(_words.mix(h ^ _U64(salt * _words._R & (1 << 64) - 1)), dtype=_U64)])
        out[:, k] = (sums[first[1:]] - sums[first[:-1]]).astype(_I64)
    return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n (size of the set), fa and fb (128 bits that equal sets share)."""

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, offs in _words.blocks(b.column(1)):
                h, first = shingle_sets(data, offs)
                f = fingerprints(h, first)
                cols = [b.column(0).slice(i, j - i), pa.array(np.diff(first).astype(_I64)), *(pa.array(f[:, k].copy()) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "fa", "fb"])

    rows = docs.select(F.col("doc_id").cast("long"), _common.text_or_empty().alias("text"))
    return rows.mapInArrow(_common.lean(look), "doc_id long, n long, fa long, fb long")


PACKED = "block long, bucket int, hashes binary, counts binary, rows binary, ids binary"
_NAMES = ["block", "bucket", "hashes", "counts", "rows", "ids"]


def _pack(n_buckets: int, narrow: bool, sets: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks of (ids, hashes, row starts): a row for each bucket with the block's distinct hashes in it and how many of
    its rows have each, and one (bucket -1) with the rows of all of them in that order and the ids.

    Within a bucket 32 bits of a hash are enough to count by (``narrow``): chance agreement only lets more through.
    """
    task = TaskContext.get().partitionId() << 32
    number = size = 0
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        nonlocal number, size
        h = np.concatenate([x for _, x, _ in held])
        row = np.concatenate([x for *_, x in held])
        ids = np.concatenate([x for x, *_ in held])
        bucket = ((h >> _U64(32)) % _U64(n_buckets)).astype(_I64)
        kept = (h & _U64(0xFFFFFFFF)).astype(np.uint32) if narrow else h
        order = np.lexsort((kept, bucket))
        bucket, kept = bucket[order], kept[order]
        new = np.ones(len(kept), bool)
        new[1:] = (kept[1:] != kept[:-1]) | (bucket[1:] != bucket[:-1])
        at = np.flatnonzero(new)
        counts = np.diff(np.append(at, len(kept))).astype(np.uint16)
        ends = np.searchsorted(bucket[at], np.arange(n_buckets + 1))
        distinct = kept[at]
        some = np.flatnonzero(np.diff(ends)).tolist()
        none = [b""] * len(some)
        out = [
            [task + number] * (len(some) + 1), [-1, *some],
            [b"" if narrow else distinct.tobytes(), *(distinct[ends[k] : ends[k + 1]].tobytes() for k in some)],
            [counts.tobytes(), *(counts[ends[k] : ends[k + 1]].tobytes() for k in some)],
            [row[order].astype(np.uint16).tobytes(), *none], [ids.tobytes(), *none],
        ]
        number, size = number + 1, 0
        held.clear()
        kinds = pa.int64(), pa.int32(), *[pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], _NAMES)

    for own, h, first in sets:
        row = _words.row_of(first)
        for s in range(0, len(own), BLOCK_ROWS):
            e = min(len(own), s + BLOCK_ROWS)
            if size + e - s > BLOCK_ROWS:
                yield flush()
            held.append((own[s:e], h[first[s] : first[e]], row[first[s] : first[e]] - s + size))
            size += e - s
            if sum(len(x) for _, x, _ in held) >= BLOCK:
                yield flush()
    if size:
        yield flush()


def _counted(packed: DataFrame, n_buckets: int, narrow: bool, answer, paths: list[str] | None = None) -> DataFrame:
    """For each block what ``answer`` makes of how many rows of the table have each of its hashes, a byte each, by bucket.

    A block sends a hash once, however many of its rows have it, so no hash is much work for the task that counts its
    bucket, which holds the bucket's hashes only. Blocks are stored, and meet their answers by number.
    """
    kind = np.uint32 if narrow else _U64

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
        for b in batches:
            for block, k, h, n in zip(*(b.column(x).to_pylist() for x in range(4)), strict=True):
                own.setdefault(k, []).append((block, np.frombuffer(h, kind), np.frombuffer(n, np.uint16)))
        for k in sorted(own):
            rows = own.pop(k)
            values, back = np.unique(np.concatenate([h for _, h, _ in rows]), return_inverse=True)
            total = np.bincount(back, np.concatenate([n for *_, n in rows]), len(values))
            said = answer(total)[back].tobytes()
            at = 0
            for s in range(0, len(rows), 1000):
                part = rows[s : s + 1000]
                cut = []
                for _, h, _ in part:
                    cut.append(said[at : at + len(h)])
                    at += len(h)
                none = pa.nulls(len(part), pa.binary())
                cols = [pa.array([x for x, *_ in part], pa.int64()), pa.array([k] * len(part), pa.int32()), pa.array(cut, pa.binary()), none, none, none]
                yield pa.RecordBatch.from_arrays(cols, _NAMES)

    packed = _common.stage(packed, "blocks", paths)
    asked = packed.where("bucket >= 0").repartitionById(n_buckets, F.col("bucket")).mapInArrow(_common.lean(count), PACKED)
    both = asked.unionByName(packed.where("bucket < 0"))
    return both.repartition(_common.parts(packed.sparkSession), "block").sortWithinPartitions("block", "bucket")


def _of_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray]]:
    """(ids, row of each hash, answer of each hash, distinct hashes, rows that have each of them) of each block."""
    now: list | None = None

    def whole() -> tuple:
        ids, rows, counts, h, said = now
        return ids, rows, np.repeat(np.frombuffer(b"".join(said), np.uint8), counts), h, counts

    for b in batches:
        for _, bucket, h, counts, rows, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bucket < 0:
                if now:
                    yield whole()
                now = [np.frombuffer(ids, _I64), np.frombuffer(rows, np.uint16).astype(_I64), np.frombuffer(counts, np.uint16), h, []]
            else:
                now[4].append(h)
    if now:
        yield whole()


def shared_counts(docs: DataFrame, n_buckets: int, paths: list[str] | None = None) -> DataFrame:
    """fa, fb, shared: how many of a row's shingles another row has as well (at least); rows without any are left out."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                for _, _, data, offs in _words.blocks(b.column(0)):
                    h, first = shingle_sets(data, offs)
                    yield fingerprints(h, first), h, first

        yield from _pack(n_buckets, True, sets())

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows, shared, _, _ in _of_blocks(batches):
            ids = ids.reshape(-1, 2)
            n = np.bincount(rows, shared, len(ids)).astype(_I64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[:, 0].copy()), pa.array(ids[:, 1].copy()), pa.array(n)], ["fa", "fb", "shared"])

    rows = docs.where("doc_id is not null").select(_common.text_or_empty().alias("text"))
    found = _counted(rows.mapInArrow(_common.lean(pack), PACKED), n_buckets, True, lambda n: (n > 1).astype(np.uint8), paths)
    return found.mapInArrow(_common.lean(total), "fa long, fb long, shared long")


def set_table(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, n, hashes (sorted, packed) and signature of the chosen sets (node, doc_id, fa, fb), each once; stored.

    A bit of the signature says whether an odd number of the set's hashes falls on it. So two signatures differ in no
    more bits than the sets do in elements.
    """

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asked = np.stack([b.column(k).to_numpy() for k in (2, 3)], 1)
            for i, j, data, offs in _words.blocks(b.column(0)):
                h, first = shingle_sets(data, offs)
                mine = pa.array((fingerprints(h, first) == asked[i:j]).all(1))  # another row of that doc_id may have another set
                packed = [h[p:q].tobytes() for p, q in zip(first[:-1], first[1:], strict=True)]
                cols = [b.column(1).slice(i, j - i), pa.array(np.diff(first).astype(_I64)), pa.array(packed, pa.binary())]
                at = (h & _U64(BITS - 1)).astype(_I64) + BITS * _words.row_of(first)
                odd = (np.bincount(at, minlength=BITS * (j - i)) & 1).astype(np.uint8).reshape(j - i, BITS)
                bits = np.packbits(odd, axis=1).view(_I64)
                cols += [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(bits.shape[1])]
                yield pa.RecordBatch.from_arrays(cols, ["node", "n", "hashes", *SIGNATURE]).filter(mine)

    rows = docs.select(F.col("doc_id").cast("long"), _common.text_or_empty().alias("text"))
    rows = rows.join(_common.bounded(chosen, 64), "doc_id").select("text", "node", "fa", "fb")
    sets = rows.mapInArrow(_common.lean(look), "node long, n long, hashes binary, " + ", ".join(f"{c} long" for c in SIGNATURE))
    sets = _common.stage(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    # a repeated row gives its set again: the first one stays
    twice = sets.groupBy("node").agg(F.min("row").alias("first"), F.count("*").alias("c")).where("c > 1").select("node", "first")
    twice = _common.bounded(_common.stage(twice, "twice"), 16)
    return sets.join(twice, "node", "left").where("first is null or first = row").drop("first", "row")


def prefixes(sets: DataFrame, n_buckets: int, paths: list[str] | None = None) -> DataFrame:
    """token, node, n, place, last: shared tokens in each set's prefix, with the table's rarest tokens first.

    If two sets link, they share at least three quarters of either, so a set's n - ceil(0.75 n) + 1 first tokens in
    any order that holds for all sets hold a shared one. Tokens of one set alone bring no pair but fill the prefix.
    ``place`` is a token's place in its set's order, ``last`` marks the two commonest tokens of a prefix.
    """

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in batches:
                data, offs = _words.columns(b.column(1))
                ids = b.column(0).to_numpy()
                for s in range(0, b.num_rows, 256):
                    e = min(b.num_rows, s + 256)
                    h = np.frombuffer(data[offs[s] : offs[e]].tobytes(), _U64)
                    yield ids[s:e], h, (offs[s : e + 1] - offs[s]) // 8

        yield from _pack(n_buckets, False, each())

    def answer(n: np.ndarray) -> np.ndarray:
        return np.minimum(255, np.ceil(8 * np.log2(n))).astype(np.uint8)

    def choose(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, row, rarity, h, counts in _of_blocks(batches):
            h = np.repeat(np.frombuffer(h, _U64), counts)
            sizes = np.bincount(row, minlength=len(ids))
            order = np.lexsort((h, rarity, row))
            row = row[order]
            place = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = sizes[row]
            keep = (place < n - (3 * n + 3) // 4 + 1) & (rarity[order] > 0)
            own = row[keep]
            last = np.append(own[:-2] != own[2:], [True] * min(2, len(own)))
            cols = [
                pa.array(h[order][keep].astype(_I64)), pa.array(ids[own]), pa.array(n[keep]), pa.array(place[keep]), pa.array(last),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["token", "node", "n", "place", "last"])

    packed = sets.select("node", "hashes").mapInArrow(_common.lean(pack), PACKED)
    return _counted(packed, n_buckets, False, answer, paths).mapInArrow(_common.lean(choose), "token long, node long, n long, place long, last boolean")


def tree_links(leader: np.ndarray, sets: list[tuple[int, np.ndarray]]) -> list[int]:
    """Ids of the sets that link with ``leader``, by one walk through the tree of their sorted sequences.

    A node is what a range of sorted sequences shares beyond its parent; its overlap with the leader is counted once
    for all below. A subtree goes when the overlap so far and what can still come, by the sizes left on either side,
    stay short of the least overlap that its smallest set needs.
    """
    sets = sorted(sets, key=lambda s: s[1].astype(">u8").tobytes())
    sizes = np.array([len(x) for _, x in sets])
    n = len(leader)
    found: list[int] = []
    stack = [(0, len(sets), 0, 0)] if sets else []
    while stack:
        lo, hi, depth, shared = stack.pop()
        low, high = sets[lo][1], sets[hi - 1][1]
        size = min(len(low), len(high))
        differ = np.flatnonzero(low[depth:size] != high[depth:size])
        end = depth + int(differ[0]) if len(differ) else size
        least = -(-3 * (int(sizes[lo:hi].min()) + n) // 7)
        most = int(sizes[lo:hi].max())
        dead = False
        for s in range(depth, end, 128):
            part = low[s : min(end, s + 128)]
            at = np.minimum(np.searchsorted(leader, part), n - 1)
            shared += int((leader[at] == part).sum())
            left = n - int(np.searchsorted(leader, part[-1], "right"))
            if shared + min(left, most - s - len(part)) < least:
                dead = True
                break
        if dead:
            continue
        k = lo
        while k < hi and sizes[k] == end:  # sequences that end here come first
            if 7 * shared >= 3 * (end + n):
                found.append(sets[k][0])
            k += 1
        while k < hi:
            v, e = sets[k][1][end], k + 1
            while e < hi and sets[e][1][end] == v:
                e += 1
            stack.append((k, e, end, shared))
            k = e
    return found


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (leader, node) whose sets link. A leader with many partners is dealt to several tasks."""
    n = _common.parts(pairs.sparkSession)
    fans = pairs.groupBy("leader").agg(F.ceil(F.count("*") / FAN).alias("fans"))
    dealt = pairs.join(fans, "leader").withColumn("fan", F.pmod(F.xxhash64("node"), F.col("fans")))
    heads = fans.select("leader", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"))
    own = sets.select("node", "hashes")
    rows = dealt.join(own, "node").select("leader", "fan", F.lit(1).alias("kind"), "node", "hashes").unionByName(
        heads.join(own.withColumnRenamed("node", "leader"), "leader")
        .select("leader", "fan", F.lit(0).alias("kind"), F.col("leader").alias("node"), "hashes")
    )

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, sequence, held = None, None, []

        def flush() -> pa.RecordBatch:
            got = tree_links(sequence, held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([leader] * len(got), pa.int64()), pa.array(got, pa.int64())], ["a", "b"])

        for b in batches:
            for own, kind, node, h in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if kind == 0:
                    if held:
                        yield flush()
                    leader, sequence = own, np.frombuffer(h, _U64)
                else:
                    held.append((node, np.frombuffer(h, _U64)))
                    if len(held) == TREE:
                        yield flush()
        if held:
            yield flush()

    by = "leader", "fan", "kind", "node"
    return rows.repartition(n, "leader", "fan").sortWithinPartitions(*by).mapInArrow(_common.lean(walk), "a long, b long")


def _alike(a: Column | str, b: Column | str) -> Column:
    """Sizes that two linked sets can have."""
    return 4 * F.least(a, b) >= 3 * F.greatest(a, b)


def _may_link(a: list[str], b: list[str], n: str, m: str) -> Column:
    """Whether two signatures leave room for a link: linked sets differ in a seventh of their sizes' sum at most."""
    differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(a, b, strict=True)), F.lit(0))
    return 7 * differ <= F.col(n) + F.col(m)


def _pairs(few: DataFrame, open_: DataFrame, where: Column) -> DataFrame:
    """``few.join(open_, "token").where(...)``; a token with very many pairs is dealt in blocks of ``SLICE`` by ``SLICE`` rows."""
    n = few.groupBy("token").agg(F.count("*").alias("nf")).join(open_.groupBy("token").agg(F.count("*").alias("no")), "token")
    n = n.where(F.col("nf") * F.col("no") > SLICE * SLICE)
    n = n.select("token", *(F.ceil(F.col(c) / SLICE).cast("int").alias(x) for c, x in (("nf", "fs"), ("no", "os"))))
    n = _common.bounded(_common.stage(n, "crowded"), 16)
    one = F.lit(1)

    def dealt(df: DataFrame, node: str, own: str, mine: str, other: str, theirs: str) -> DataFrame:
        df = df.join(n, "token", "left")
        df = df.withColumn(mine, F.pmod(F.xxhash64(node), F.coalesce(own, one)).cast("int"))
        return df.withColumn(theirs, F.explode(F.sequence(F.lit(0), F.coalesce(other, one) - 1))).drop("fs", "os")

    return dealt(few, "a", "fs", "fi", "os", "oi").join(dealt(open_, "node", "os", "oi", "fs", "fi"), ["token", "fi", "oi"]).where(where)


def near_documents(docs: DataFrame, shingles_per_bucket: int = 1 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id for each row: documents link when their shingle sets' Jaccard similarity is 0.75.

    Words are lower-cased (A-Z). Equal sets are one node from the start. A set whose shingles are to more than a
    quarter its own can have no partner; for the others prefixes of rare-first sets bring candidates. Candidates meet
    leaders of their commonest tokens' sets first; after that only sets that are still in different components
    need to meet, those of all but the largest component with all others of the token. So a group of copies costs rows
    in proportion to its size, and no link between components is missed. The component is the least doc_id. Keys that
    hold many rows (a set of very many copies, a token of very many sets) are dealt over tasks.

    Documents without words or text link with nothing, have n_shingles 0 and their own doc_id as component; a null
    doc_id has a null component; rows that share a doc_id are one document, so whatever one of them links with belongs
    to the component; an empty table gives no rows. Other columns are ignored. A text takes about fifteen times its
    bytes in a task.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    own = _common.stage(signatures(docs), "signatures")
    total = own.agg(F.sum("n")).first()[0] or 0
    buckets = _common.spread(total, shingles_per_bucket, _common.parts(spark))
    filled = own.where("n > 0 and doc_id is not null")
    same = filled.groupBy("fa", "fb").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    same = _common.stage(same.withColumn("node", F.monotonically_increasing_id()), "nodes")
    blocks: list[str] = []
    counts = shared_counts(docs, buckets, blocks).groupBy("fa", "fb").agg(F.max("shared").alias("shared"))
    chosen = same.join(counts, ["fa", "fb"]).where(4 * F.col("shared") >= 3 * F.col("n")).select("node", "doc_id", "fa", "fb")
    chosen = _common.stage(chosen, "chosen")
    _common.discard(spark, blocks)
    sets = set_table(docs, chosen)
    tokens = _common.stage(prefixes(sets, buckets, blocks), "tokens")
    _common.discard(spark, blocks)

    def leader(k: int) -> Column:
        return F.min(F.struct(F.xxhash64(F.lit(k), "node").alias("h"), F.col("node").alias("leader")))

    marks = sets.select("node", "n", *SIGNATURE)
    theirs = [f"t{k}" for k in range(len(SIGNATURE))]
    other = marks.toDF("leader", "m", *theirs)
    leads = tokens.groupBy("token").agg(F.array(*[leader(k) for k in range(6)]).alias("leads"))
    first = _common.spread_join(tokens.where("last").select("token", "node"), leads, ["token"], F.xxhash64("node"), "inner")
    first = first.select("node", F.explode("leads").alias("x")).select(F.col("x.leader").alias("leader"), "node").where("leader <> node")
    first = first.select(F.least("leader", "node").alias("leader"), F.greatest("leader", "node").alias("node")).distinct()
    first = first.join(marks, "node").join(other, "leader").where(_alike("n", "m") & _may_link(SIGNATURE, theirs, "n", "m"))
    first = _common.stage(first.select("leader", "node"), "pairs")
    now = _common.stage(_common.edges_to_components(verified(first, sets)), "components")
    placed = tokens.join(now, "node", "left").select("token", "node", "n", "place", F.coalesce("component", "node").alias("c"))
    placed = _common.stage(placed, "placed")
    sizes = placed.groupBy("token", "c").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("top"), F.count("*").alias("cs")).where("cs > 1")
    open_ = _common.spread_join(placed, largest.select("token", "top"), ["token"], F.xxhash64("node"), "inner").join(marks.drop("n"), "node")
    open_ = _common.stage(open_, "open")
    few = open_.where("c <> top").select(
        "token", F.col("node").alias("a"), F.col("n").alias("m"), F.col("place").alias("q"), F.col("c").alias("d"),
        *[F.col(x).alias(y) for x, y in zip(SIGNATURE, theirs, strict=True)],
    )
    # at the first token that a pair shares, no more than what is left of either set can be shared
    enough = 7 * F.least(F.col("n") - F.col("place"), F.col("m") - F.col("q")) >= 3 * (F.col("n") + F.col("m"))
    rest = (
        _pairs(few, open_, (F.col("c") != F.col("d")) & enough & _may_link(SIGNATURE, theirs, "n", "m"))
        .select(F.least("a", "node").alias("leader"), F.greatest("a", "node").alias("node")).distinct()
        .join(first, ["leader", "node"], "left_anti")
    )
    more = _common.stage(verified(_common.stage(rest, "pairs"), sets), "links").unionByName(_of_one_document(filled, same))
    # links between components: the components' own components
    at = now.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    more = more.join(at, "a", "left").join(at.toDF("b", "cb"), "b", "left")
    joined = _common.edges_to_components(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    known = same.join(now, "node", "left").select("node", "doc_id", "fa", "fb", F.coalesce("component", "node").alias("c"))
    known = _common.spread_join(known, joined.toDF("c", "top"), ["c"], F.xxhash64("node")).withColumn("c", F.coalesce("top", "c")).drop("top")
    known = _common.stage(known, "known")
    least = known.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    known = _common.spread_join(known, least, ["c"], F.xxhash64("node")).select("fa", "fb", "component_id")
    out = _common.spread_join(filled, known, ["fa", "fb"], F.xxhash64("doc_id")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = own.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def _of_one_document(filled: DataFrame, same: DataFrame) -> DataFrame:
    """Edges (a, b) between the nodes of rows that share a doc_id and have different sets; mostly none."""
    f = F.struct("fa", "fb")
    several = filled.groupBy("doc_id").agg(F.min(f).alias("x"), F.max(f).alias("y")).where("x <> y").select("doc_id")
    several = _common.bounded(_common.stage(several, "several"), 8)
    nodes = filled.join(several, "doc_id", "left_semi").select("doc_id", "fa", "fb").distinct()
    nodes = _common.stage(nodes.join(same.select("fa", "fb", "node"), ["fa", "fb"]).select("doc_id", F.col("node").alias("b")), "several")
    return nodes.join(nodes.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a <> b").select("a", "b")


def op7_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
with recursive d as (
  select row_number() over () as k, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), g as (
  select k, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' '))) end) as s from d
), n as (select k, count(*) as n from g group by k), few as (select s from g group by s having count(*) > 1),
m as (select k, md5_number_lower(s) as h from g semi join few using (s)),
pairs as (select a.k as a, b.k as b, count(*) as c from m a join m b on a.h = b.h and a.k <> b.k group by 1, 2),
l as (select a, b from pairs join n x on x.k = a join n y on y.k = b where 100 * c >= 75 * (x.n + y.n - c)
  union select x.k, y.k from d x join d y on x.doc_id = y.doc_id and x.k <> y.k join n on n.k = x.k join n o on o.k = y.k),
r as (select k, k as other from n union select r.k, l.b from r join l on l.a = r.other),
c as (select r.k, min(d.doc_id) as component_id from r join d on d.k = r.other group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id from d left join n using (k) left join c using (k)
"""
