"""Repeated passages found by sharded Aho-Corasick automata and cut from all documents (operator 5)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import _common, _words

#: Words of a window, of the phrases of which each window names its least hash, and windows of a stretch at most.
WINDOW, PHRASE, STRETCH = 35, 8, 256
#: Bytes of passages that one automaton holds, and of stretches below which no phrase is dealt to several tasks.
SHARD, GROUP = 4 << 20, 1 << 18
#: Bytes of stretches for which there is a task at least.
PART = 64 << 20
FOUND = "phrase long, key long, check long, place long, size int, text binary"
_I64 = np.int64


class Seen:
    """Values of a stream of (value, owner) that occur more than once; remembers distinct values, not occurrences."""

    def __init__(self) -> None:
        self.value, self.owner, self.many = np.zeros(0, np.uint64), np.zeros(0, _I64), np.zeros(0, bool)

    def add(self, value: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, owner) of each occurrence that is known by now to be repeated and was not given before."""
        order = np.argsort(value, kind="stable")
        value, owner = value[order], owner[order]
        first = np.ones(len(value), bool)
        first[1:] = value[1:] != value[:-1]
        at = np.flatnonzero(first)
        n = np.diff(np.append(at, len(value)))
        distinct = value[at]
        spot = np.searchsorted(self.value, distinct)
        old = spot < len(self.value)
        old[old] = self.value[spot[old]] == distinct[old]
        give = np.repeat(old | (n > 1), n)
        late = spot[old][~self.many[spot[old]]]  # their first occurrence was held back
        out = np.concatenate([value[give], self.value[late]]), np.concatenate([owner[give], self.owner[late]])
        self.many[spot[old]] = True
        new = ~old
        merged = np.concatenate([self.value, distinct[new]])
        order = np.argsort(merged, kind="stable")
        self.value = merged[order]
        self.owner = np.concatenate([self.owner, owner[at][new]])[order]
        self.many = np.concatenate([self.many, n[new] > 1])[order]
        return out


def _least(p: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    if len(p) < width:
        return np.zeros(0, p.dtype)
    m, have = p, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(p) - width + 1], m[width - have :][: len(p) - width + 1])


def _windows(w: _words.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes, each window's least phrase, and which windows lie in one row."""
    p = _words.runs(w.hash, PHRASE)
    least = _least(p, WINDOW - PHRASE + 1)
    return p, least, _words.inside_rows(w.first, WINDOW, len(least))


def _named(docs: DataFrame) -> DataFrame:
    """Key of a row by its content (128 bits in two columns), so that a task that runs again gives the same; equal rows share one."""
    text = _common.text_or_empty()
    own = docs.select(F.col("doc_id"), text.alias("text"))
    return own.select(F.xxhash64("doc_id", "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("check"), "doc_id", "text")


def repeated_phrases(named: DataFrame) -> DataFrame:
    """key, phrases: of each row the phrase hashes that windows name and that are named at another place too.

    Equal windows name equal phrases, so a window whose phrase is missing here cannot recur. Rows of packed hashes are
    dealt by hash. A phrase that a task meets twice itself is known to be repeated there, and only two of its places go
    on, so a phrase of most documents is no more work for the task that gathers it than others.
    """
    n = _common.parts(named.sparkSession)

    def name(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        block = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            nonlocal block
            all_of = np.concatenate(held)
            held.clear()
            all_of = all_of[np.argsort(all_of[:, 0], kind="stable")]
            new = np.flatnonzero(np.diff(all_of[:, 0], prepend=~all_of[:1, 0]))
            count = np.diff(np.append(new, len(all_of)))
            place = np.arange(len(all_of)) - np.repeat(new, count)
            known = np.repeat(count > 1, count)
            asked = all_of[place < 2]
            got = list(_common.cut(asked, (asked[:, 0] % np.uint64(n)).astype(_I64), n))
            rows = [(k, False, x.tobytes()) for k, x in got]
            if known.any():
                block += 1
                rows.append((block % n, True, all_of[known].tobytes()))
            kinds = pa.int32(), pa.bool_(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], ["bucket", "known", "packed"])

        for b in batches:
            keys = b.column(0).to_numpy()
            for i, _, data, offs in _words.blocks(b.column(1)):
                w = _words.words(data, offs)
                p, least, ok = _windows(w)
                if not ok.any():
                    continue
                # a place is named if the least of a window that spans it is its own value
                width = WINDOW - PHRASE + 1
                padded = np.zeros(len(p) + width - 1, np.uint64)
                padded[width - 1 : width - 1 + len(least)] = np.where(ok, least, np.uint64(0))
                top = ~_least(~padded, width)  # greatest of the leasts around a place
                at = np.flatnonzero(p == top)
                row = np.searchsorted(w.first, at, "right") - 1
                held.append(np.stack([p[at], keys[i + row].astype(np.uint64)], 1))
                if sum(map(len, held)) >= 1 << 19:
                    yield flush()
        if held:
            yield flush()

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = Seen(), []

        def flush() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(held), np.uint64).reshape(-1, 2)
            held.clear()
            value, owner = seen.add(x[:, 0], x[:, 1].astype(_I64))
            return _pairs(owner, value)

        def _pairs(owner: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(owner.astype(_I64)), pa.array(value.astype(_I64))], ["key", "phrase"])

        for b in batches:
            for known, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if known:
                    x = np.unique(np.frombuffer(packed, np.uint64).reshape(-1, 2), axis=0)
                    yield _pairs(x[:, 1], x[:, 0])
                else:
                    held.append(packed)
            if sum(map(len, held)) >= 1 << 24:
                yield flush()
        if held:
            yield flush()

    packed = named.select("key", "text").mapInArrow(_common.lean(name), "bucket int, known boolean, packed binary")
    dealt = packed.repartitionById(n, F.col("bucket"))
    found = dealt.mapInArrow(_common.lean(meet), "key long, phrase long")
    return found.groupBy("key").agg(F.collect_set("phrase").alias("phrases"))  # at most a document's own


def _runs(key: np.ndarray, row: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and window after the last of each stretch: hits of one row and key in a row, ``STRETCH`` at most."""
    at = np.flatnonzero(hit)
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (key[at[1:]] != key[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(place % STRETCH == 0)
    return at[first], at[np.append(first[1:], len(at)) - 1] + 1


def stretches(rows: DataFrame) -> DataFrame:
    """Stretches of a row whose windows name one repeated phrase: phrase, key, check, place (first word), text.

    A stretch of 256 windows goes on in another one, so a periodic text, all of whose windows name one phrase, has
    stretches of bounded size too. Words of the text are parted by one space.
    """

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, checks = b.column(0).to_numpy(), b.column(1).to_numpy()
            lists = b.column(3)
            ends = lists.offsets.to_numpy()
            values = lists.values.to_numpy()
            for i, j, data, offs in _words.blocks(b.column(2)):
                w = _words.words(data, offs)
                _, least, ok = _windows(w)
                row = _words.row_of(w.first)[: len(least)]
                own = values[ends[i] : ends[j]].astype(np.uint64)
                owner = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                # a pair of row and phrase as one number, only to look it up; what it lets in by chance does no harm
                pair = np.sort(_words.mix(own + owner.astype(np.uint64) * np.uint64(_words._R)))
                asked = _words.mix(least + row.astype(np.uint64) * np.uint64(_words._R))
                spot = np.minimum(np.searchsorted(pair, asked), max(0, len(pair) - 1))
                hit = ok & (pair[spot] == asked) if len(pair) else np.zeros(len(ok), bool)
                start, end = _runs(least, row, hit)
                for s in range(0, len(start), 4096):
                    a, e = start[s : s + 4096], end[s : s + 4096] + WINDOW - 1
                    texts = [b" ".join(w.text(x, y).split()) for x, y in zip(a.tolist(), e.tolist(), strict=True)]
                    cols = [
                        pa.array(least[a].astype(_I64)), pa.array(keys[i + row[a]]), pa.array(checks[i + row[a]]),
                        pa.array((a - w.first[row[a]]).astype(_I64)), pa.array([len(x) for x in texts], pa.int32()), pa.array(texts, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["phrase", "key", "check", "place", "size", "text"])

    return rows.select("key", "check", "text", "phrases").mapInArrow(_common.lean(look), FOUND)


def _recut(batches: Iterable[pa.RecordBatch], single: bool) -> Iterator[pa.RecordBatch]:
    """(phrase, part, text, n) cut again: by the window's least phrase under other hashes, or (``single``) window by window."""
    for b in batches:
        for i, _, data, offs in _words.blocks(b.column(2)):
            w = _words.words(data, offs)
            key = _words.runs(_words.mix(w.hash), WINDOW)
            if not single:
                key = _least(_words.mix(_words.runs(w.hash, PHRASE)), WINDOW - PHRASE + 1)
            row = _words.row_of(w.first)[: len(key)]
            ok = _words.inside_rows(w.first, WINDOW, len(key))
            start, end = (np.flatnonzero(ok), np.flatnonzero(ok) + 1) if single else _runs(key, row, ok)
            for s in range(0, len(start), 4096):
                a, e = start[s : s + 4096], end[s : s + 4096] + WINDOW - 1
                take = pa.array(i + row[a])
                part = _words.mix(key[a] + b.column(1).take(take).to_numpy().astype(np.uint64))
                texts = [w.text(x, y) for x, y in zip(a.tolist(), e.tolist(), strict=True)]
                cols = [b.column(0).take(take), pa.array(part.astype(_I64)), pa.array(texts, pa.binary()), b.column(3).take(take)]
                yield pa.RecordBatch.from_arrays(cols, ["phrase", "part", "text", "n"])


def recurring(w: _words.Words, weight: np.ndarray) -> list[np.ndarray]:
    """Word places (first, end) of the passages that recur among weighted rows.

    A passage is a run of recurring windows that occur only together, so it is found whole wherever it is found.
    """
    runs = _words.runs(w.hash, WINDOW)
    ok = _words.inside_rows(w.first, WINDOW, len(runs))
    longer = _words.runs(w.hash, WINDOW + 1)
    ok2 = _words.inside_rows(w.first, WINDOW + 1, len(longer))
    row = _words.row_of(w.first)

    def counts(h: np.ndarray, ok: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h) + 1)
        at = np.flatnonzero(ok)
        if len(at):
            _, back = np.unique(h[at], return_inverse=True)
            out[at] = np.bincount(back, weight[row[at]])[back]
        return out

    n, n2 = counts(runs, ok), counts(longer, ok2)
    at = np.flatnonzero(n[:-1] >= 2)
    if not len(at):
        return []
    linked = np.zeros(len(at), bool)
    before = at[1:] - 1
    linked[1:] = (before == at[:-1]) & (row[at[1:]] == row[at[:-1]]) & (n[before] == n[at[1:]])
    linked[1:] &= np.where(before < len(n2), n2[np.minimum(before, len(n2) - 1)], 0) == n[at[1:]]
    begin = np.flatnonzero(~linked)
    last = np.append(begin[1:], len(at)) - 1
    return [at[begin], at[last] + WINDOW]


def _confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages of stretches (phrase, part, text, n) that come by part and text; copies are counted, then parts compared."""
    held: list[list] = []  # phrase, text, n
    size, last = 0, None

    def flush() -> pa.RecordBatch:
        data, offs = _words.columns(pa.array([x for _, x, _ in held], pa.binary()))
        w = _words.words(data, offs)
        found = recurring(w, np.array([n for *_, n in held], float))
        out: list[tuple[int, bytes]] = []
        if found:
            row = np.searchsorted(w.first, found[0], "right") - 1
            spans = zip(row.tolist(), found[0].tolist(), found[1].tolist(), strict=True)
            out = sorted({(held[r][0], w.text(a, e)) for r, a, e in spans})
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["phrase", "words"])

    for b in batches:
        for phrase, part, text, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part == last and held and held[-1][1] == text:
                held[-1][2] += n
                continue
            if part != last and size >= SHARD:
                yield flush()
                size = 0
            held.append([phrase, text, n])
            size, last = size + len(text), part
    if held:
        yield flush()


def confirmed(found: DataFrame, group: int = GROUP, share: float = 2.0) -> DataFrame:
    """phrase, words: the passages that recur among stretches, each once; a passage occurs whole wherever a part of it does.

    Windows that are equal name the same phrase, so stretches are compared phrase by phrase. A phrase with more bytes
    than its share of a task is counted copy by copy first, and what is still too much is cut by a second name of each
    window, then window by window, which Spark counts like any key; so no phrase fills a task.
    """
    n = _common.spread(found.agg(F.sum("size")).first()[0] or 0, PART, _common.parts(found.sparkSession))
    kind = "phrase long, part long, text binary, n long"
    rows = found.select("phrase", F.col("phrase").alias("part"), "text", F.lit(1).cast("long").alias("n"), "size")
    out = []

    def compare(df: DataFrame) -> DataFrame:
        return df.repartition(n, "part").sortWithinPartitions("part", "text").mapInArrow(_common.lean(_confirm), "phrase long, words binary")

    for single in (False, True):
        hot, limit = _common.hot_keys(rows, ["part"], F.col("size"), group, share)
        small = _common.bounded(hot.select("part"), 8)
        out.append(compare(rows.join(small, "part", "left_anti").select("phrase", "part", "text", "n")))
        if hot.isEmpty():
            return out[0] if len(out) == 1 else out[0].unionByName(out[1])
        warm = rows.join(small, "part", "left_semi").groupBy("phrase", "part", "text").agg(F.sum("n").alias("n"))
        warm = _common.stage(warm.select("phrase", "part", "text", "n"), "warm")
        still = warm.groupBy("part").agg(F.sum(F.length("text")).alias("size")).where(F.col("size") > limit).select("part")
        still = _common.bounded(_common.stage(still, "still"), 8)
        out.append(compare(warm.join(still, "part", "left_anti").select("phrase", "part", "text", "n")))
        again = warm.join(still, "part", "left_semi").select("phrase", "part", "text", "n")
        rows = _common.stage(again.mapInArrow(_common.lean(lambda b, s=single: _recut(b, s)), kind), "recut").withColumn("size", F.length("text"))
    one = rows.groupBy("phrase", "text").agg(F.sum("n").alias("n")).where("n > 1").select("phrase", F.col("text").alias("words"))
    for x in out:
        one = one.unionByName(x)
    return one


class Automaton:
    """Aho-Corasick over the words of one shard's passages; a word that no passage has parts what it stands between."""

    def __init__(self, passages: list[bytes]):
        import ahocorasick

        w = _words.words(*_words.columns(pa.array(passages, pa.binary())))
        self.known = np.unique(w.hash)
        ids = (np.searchsorted(self.known, w.hash) + 1).tolist()
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if j > i:
                self.machine.add_word(tuple(ids[i:j]), j - i)
        self.machine.make_automaton()

    def spans(self, texts: pa.Array, places: list[int]) -> Iterator[bytes]:
        """Of each text the words (first, end, as int32 pairs, counted from its place) that passages cover."""
        w = _words.words(*_words.columns(texts))
        at = np.minimum(np.searchsorted(self.known, w.hash), max(0, len(self.known) - 1))
        ids = np.where(self.known[at] == w.hash, at + 1, 0).tolist()
        for i, j, place in zip(w.first[:-1].tolist(), w.first[1:].tolist(), places, strict=True):
            out: list[int] = []
            for end, n in self.machine.iter(tuple(ids[i:j])):
                s, e = end + 1 - n + place, end + 1 + place
                while out and s <= out[-2]:  # a longer passage that ends later
                    e = max(e, out[-1])
                    del out[-2:]
                if out and s <= out[-1]:
                    out[-1] = max(e, out[-1])
                else:
                    out += [s, e]
            yield np.array(out, np.int32).tobytes()


def _stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by shard, passages first: compiles each shard's automaton, then runs the stretches through it one by one."""
    now, words, machine = None, [], None
    for b in batches:
        shard, slot = b.column(0).to_numpy(), b.column(1).to_numpy()
        is_text = np.asarray(b.column(2).to_numpy(zero_copy_only=False), bool)
        edge = np.flatnonzero((np.diff(shard) != 0) | (np.diff(slot) != 0) | (is_text[1:] != is_text[:-1])) + 1
        for i, j in zip([0, *edge.tolist()], [*edge.tolist(), b.num_rows], strict=True):
            if i == j:
                continue
            own = (int(shard[i]), int(slot[i]))
            if own != now:
                now, words, machine = own, [], None
            part = b.slice(i, j - i)
            if not is_text[i]:
                words += part.column(6).to_pylist()
                continue
            if machine is None and words:
                machine, words = Automaton(words), []
            if machine is not None:
                spans = list(machine.spans(part.column(6), part.column(5).to_pylist()))
                keep = pa.array([bool(x) for x in spans])
                cols = [part.column(3), part.column(4), pa.array(spans, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["key", "check", "spans"]).filter(keep)


def located(found: DataFrame, passages: DataFrame, shard: int = SHARD, group: int = GROUP, share: float = 2.0) -> DataFrame:
    """key, check, spans of the stretches in which an automaton finds a passage.

    Passages are dealt to shards of about ``shard`` bytes by phrase; each stretch of every document goes to the shard of
    its phrase. Stretches of a phrase with more than a task's share are dealt over tasks that all have its passages; and
    if one phrase's passages are more than a shard, they make several, which its stretches all visit.
    """
    n = _common.parts(found.sparkSession)
    many = _common.spread(found.agg(F.sum("size")).first()[0] or 0, PART, n)
    size = passages.agg(F.sum(F.length("words"))).first()[0] or 0
    shards = _common.spread(size, shard, n)
    hot, _ = _common.hot_keys(found, ["phrase"], F.col("size"), group, share)
    wide = passages.groupBy("phrase").agg(F.sum(F.length("words")).alias("bytes")).where(F.col("bytes") > shard)
    wide = wide.select("phrase", F.ceil(F.col("bytes") / shard).cast("int").alias("subs"))
    special = _common.bounded(_common.stage(hot.join(wide, "phrase", "full"), "special"), 24)

    def dealt(df: DataFrame, salt: Column, sub: Column) -> DataFrame:
        fans, subs = F.coalesce("fans", F.lit(1)), F.coalesce("subs", F.lit(1))
        own = df.join(special, "phrase", "left")
        own = own.withColumn("common", F.col("fans").isNull() & F.col("subs").isNull())
        common = F.col("common")
        # shards of several phrases have numbers from 0, a phrase that stands alone its own hash
        number = F.when(common, F.pmod(F.xxhash64("phrase"), F.lit(shards))).otherwise(F.col("phrase"))
        own = own.withColumn("shard", number).withColumn("fans", fans).withColumn("subs", subs)
        own = own.withColumn("salt", salt).withColumn("sub", sub)
        return own.withColumn("slot", F.when(common, 0).otherwise(1 + F.col("salt") * F.col("subs") + F.col("sub")).cast("int"))

    def each(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    texts = dealt(found, F.pmod(F.xxhash64("key", "place"), F.col("fans")).cast("int"), each("subs"))
    words = dealt(passages, each("fans"), F.pmod(F.xxhash64("words"), F.col("subs")).cast("int"))
    none = F.lit(None).cast("long")
    rows = texts.select("shard", "slot", F.lit(True).alias("is_text"), "key", "check", "place", "text").unionByName(
        words.select("shard", "slot", F.lit(False).alias("is_text"), none.alias("key"), none.alias("check"), none.alias("place"), F.col("words").alias("text"))
    )
    return rows.repartition(many, "shard", "slot").sortWithinPartitions("shard", "slot", "is_text").mapInArrow(
        _common.lean(_stream), "key long, check long, spans binary"
    )


def repeats(docs: DataFrame, shard: int = SHARD, group: int = GROUP, share: float = 2.0) -> DataFrame:
    """doc_id, text (null: empty) and spans: packed (first, end) int32 pairs of words that recurring windows cover.

    A window is 35 words of one row; it recurs if its words start at any other place of the table, in that row or
    another, a repeated row included. First the windows that may recur are told by a phrase that they name; their
    stretches are stored, recurring passages among them confirmed, compiled into sharded automata, and then all
    stretches of all documents run through the automata, which alone say where passages stand.

    Rows shorter than a window, null and empty texts have no spans; rows with a null doc_id count like others; rows that
    are equal share a key and their spans; an empty table gives none; other columns are ignored. A text takes about ten
    times its bytes in a task, so one of 64 MB is safe.
    """
    named = _named(docs)
    # stored by key, so that texts are shuffled once, for the phrases, and not again for the spans
    rows = _common.stage_by(named.join(repeated_phrases(named), "key", "left"), "key", "documents")
    found = _common.stage(stretches(rows.where("phrases is not null")), "stretches")
    passages = _common.stage(confirmed(found, group, share), "passages")
    spans = located(found, passages, shard, group, share)
    # of one key only the spans with a row's own check; other rows of that key are a chance of 64 bits
    of_doc = _common.stage(spans.groupBy("key").agg(F.collect_set(F.struct("check", "spans")).alias("found")), "spans")
    size = F.aggregate("found", F.lit(64), lambda a, x: a + F.length(x["spans"]) + 24)
    own = F.transform(F.filter("found", lambda x: x["check"] == F.col("check")), lambda x: x["spans"])
    return rows.drop("phrases").join(_common.bounded(of_doc, size), "key", "left").select("doc_id", "text", own.alias("spans"))


def removed(n: int, spans: Iterable[bytes] | None) -> np.ndarray:
    """Which of n words lie in a span."""
    edge = np.zeros(n + 1, np.int32)
    for x in spans or ():
        pairs = np.frombuffer(x, np.int32).reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            ids, spans = b.column(0).to_pylist(), b.column(2).to_pylist()
            for i, j, data, offs in _words.blocks(b.column(1)):
                w = _words.words(data, offs)
                for r in range(i, j):
                    a, e = int(w.first[r - i]), int(w.first[r - i + 1])
                    gone = removed(e - a, spans[r])
                    sha, first = hashlib.sha256(), True
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=1, append=1))  # kept from, kept until, ...
                    for s, t in edges.reshape(-1, 2).tolist():
                        for k in range(s, t, 100_000):
                            sha.update((b"" if first else b" ") + b" ".join(w.text(a + k, a + min(t, k + 100_000)).split()))
                            first = False
                    rows.append((ids[r], e - a, int(gone.sum()), sha.hexdigest()))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string()
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, kinds, strict=True)], names
            )

    return found.mapInArrow(_common.lean(digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


OP5_SQL = r"""
with d as (select row_number() over () as k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select k, unnest(generate_series(1, len(w) - 34)) as i, w from d where len(w) >= 35),
win as (select k, i, md5(array_to_string(w[i:i + 34], ' ')) as h from s),
rec as (select h from win group by h having count(*) > 1),
gone as (select distinct k, i + t.j as j from win join rec using (h), generate_series(0, 34) t(j)),
word as (select k, unnest(w) as x, generate_subscripts(w, 1) as j from d),
kept as (select k, string_agg(x, ' ' order by j) as text, count(*) as n from word anti join gone using (k, j) group by k)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept using (k)
"""
