"""Chat logs folded into final messages and rendered with a template (operator 1)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import _common

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that common chat templates use for control.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]",
)
_TAILS = "|".join(re.escape(x[1:]) for x in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?=(?:{_TAILS}))")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?=(?:{_TAILS}))")
EVENTS = "conv_id long, message long, seq long, kind string, role string, text string"
#: Sequence numbers from one turn of ``turns_to_events`` to the next.
STRIDE = 16
SEGMENTS = "conv_id long, pos long, formatted string, loss_start int, loss_end int"


def escape(text: str) -> str:
    """Puts a backslash behind the first character of each control string, one more where some stand there already.

    No control string is left, texts without any stay as they are, and ``unescape`` gives the text back.
    """
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text begins and ends there."""
    role = escape(role).replace("\\", "\\\\").replace("\n", "\\n")
    body = escape(text)
    head = f"{START}{role}\n"
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a rendered turn."""
    if not (formatted.startswith(START) and formatted.endswith(f"{END}\n")):
        raise ValueError("not a turn of this template")
    role, _, body = formatted[len(START) : -len(END) - 1].partition("\n")
    role = re.sub(r"\\(\\|n)", lambda m: "\\" if m[1] == "\\" else "\n", role)
    return unescape(role), unescape(body)


class Fold:
    """One conversation's final messages from its events, which come message by message; holds one message at a time.

    ``pos`` is the sequence number at which a message began. Kinds: message (complete in itself), start, delta
    (appends), edit (replaces the text), regenerate (drops the text, and all messages begun since this one up to the
    event), delete. Other kinds and deltas without a start open a message with the event's role. A regenerated branch
    that is itself inside a dropped one changes nothing.
    """

    def __init__(self) -> None:
        self.cut_until: int | None = None
        self.open: list | None = None

    def push(
        self, pos: int | None, message: int | None, seq: int | None, kind: str, role: str, text: str
    ) -> Iterator[tuple[int | None, str, str]]:
        if kind in ("message", "start") or self.open is None or self.open[0] != (pos, message):
            yield from self.flush()
            self.open = [(pos, message), role, [], None, False]
        own = self.open
        if kind == "edit":
            own[2] = [text]
        elif kind == "regenerate":
            own[2], own[3] = [text] if text else [], seq
        elif kind == "delete":
            own[4] = True
        else:
            own[2].append(text)

    def flush(self) -> Iterator[tuple[int | None, str, str]]:
        if self.open is not None:
            (pos, _), role, texts, regenerated, deleted = self.open
            self.open = None
            if self.cut_until is None or pos is None or pos >= self.cut_until:
                if regenerated is not None:
                    self.cut_until = max(regenerated, self.cut_until or regenerated)
                if not deleted:
                    yield pos, role, "".join(texts)


def _fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()
    names = ["conv_id", "pos", "formatted", "loss_start", "loss_end"]
    now, fold = (), Fold()

    def rendered(own: Iterable[tuple]) -> Iterator[tuple]:
        for pos, role, text in own:
            formatted, a, b = render_turn(role, text)
            yield now[0], pos, formatted, a if role == "assistant" else 0, b if role == "assistant" else 0

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names)

    for b in batches:
        rows: list[tuple] = []
        for conv_id, *event in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now != (conv_id,):
                rows += rendered(fold.flush())
                now, fold = (conv_id,), Fold()
            rows += rendered(fold.push(*event))
        if rows:
            yield batch(rows)
    if rows := list(rendered(fold.flush())):
        yield batch(rows)


def format_chats(events: DataFrame) -> DataFrame:
    """Renders each final message: conv_id, pos, formatted, loss_start, loss_end, in order within each partition.

    ``events``: conv_id, message (an id within the conversation), seq, kind, role, text, in any order and with messages
    that go on while others begin. Logs are dealt out by conversation; a message stands where its first event does
    (``pos``, its sequence number), and the events are sorted by that, then by sequence. A task folds them as a stream
    with one message in memory, so a conversation of any length is safe, but it stays in one task, as its digest is
    sequential. A conversation's text is its rows' ``formatted``, by pos; ``loss_start:loss_end`` (code points) is what
    a model is trained on, an assistant's text. Null role or text counts as empty, null kind as message; a null conv_id
    is a conversation of its own; an event without message is one of its own; null sequence numbers come first; equal
    ones by kind, role and text; rows that repeat a message are messages too. An empty table gives no rows; other
    columns are ignored.
    """
    own = events.select(
        F.col("conv_id").cast("long"), F.col("message").cast("long"), F.col("seq").cast("long"),
        F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    n = _common.parts(events.sparkSession)
    begin = F.min("seq").over(Window.partitionBy("conv_id", "message"))
    own = own.repartition(n, "conv_id").withColumn("pos", F.when(F.col("message").isNull(), F.col("seq")).otherwise(begin))
    own = own.sortWithinPartitions("conv_id", "pos", "message", "seq", "kind", "role", "text")
    return own.select("conv_id", "pos", "message", "seq", "kind", "role", "text").mapInArrow(_common.lean(_fold), SEGMENTS)


def turns_to_events(turns: DataFrame) -> DataFrame:
    """The log of a chat service that ends in the given turns: conv_id, message, seq, kind, role, text.

    Every turn is streamed: a start and three deltas. Of four turns one is edited, after the next one has begun; one is
    regenerated, which takes with it an answer to its first draft; and beside one a message begins that is deleted. Turns
    go by turn (null first), role and text; repeated rows are turns of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    own = turns.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"), (F.row_number().over(order) - 1).cast("long").alias("n"))
    third = F.ceil(F.length("text") / 3).cast("int")
    base, stray = F.col("n") * STRIDE, -1 - F.col("n")
    turn = F.pmod("n", F.lit(4))

    def event(at: int, kind: str, text: Column, message: Column = F.col("n"), role: Column | None = None) -> Column:
        role = F.lit(None).cast("string") if role is None else role
        return F.struct(message.alias("message"), (base + at).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    parts = [F.substring(F.col("text"), third * k + 1, third) for k in range(3)]
    start, none = event(0, "start", F.lit(""), role=F.col("role")), F.lit("")
    streamed = [event(10 + k, "delta", x) for k, x in enumerate(parts)]
    edited = [event(1, "delta", F.lit("a draft")), event(STRIDE + 8, "edit", F.col("text"))]
    again = [
        event(1, "delta", F.lit("a draft")), event(3, "message", F.lit("dropped"), stray, F.lit("user")), event(5, "regenerate", none), *streamed,
    ]
    beside = [event(3, "start", F.lit("withdrawn"), stray, F.lit("user")), event(12, "delete", none, stray), *streamed]
    log = F.when(turn == 1, F.array(start, *edited)).when(turn == 2, F.array(start, *again)).when(turn == 3, F.array(start, *beside))
    return own.select("conv_id", F.explode(log.otherwise(F.array(start, *streamed))).alias("e")).select("conv_id", "e.*")


def digests(segments: DataFrame) -> DataFrame:
    """Reads ``format_chats`` rows back: one row for each conversation with digests of turns and of the masked text."""
    kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list) -> pa.RecordBatch:
            rows = [(c, n, a.hexdigest(), k, b.hexdigest(), f) for c, n, a, k, b, f in rows]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names)

        now: list | None = None
        for b in batches:
            rows = []
            for conv_id, _, formatted, i, j in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now[0] != conv_id:
                    if now is not None:
                        rows.append(now)
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(formatted)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                loss = unescape(formatted[i:j])
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += len(formatted)
            if rows:
                yield batch(rows)
        if now is not None:
            yield batch([now])

    return segments.mapInArrow(
        _common.lean(read),
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], table.schema)
    return digests(format_chats(turns_to_events(table.unionByName(probe))))


OP1_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, case when role = 'assistant' then text else '' end as loss,
    regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|\|startoftext\|>|s>|/s>|unk>|INST\]|/INST\])', '\1\2\\\3', 'g') as body
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  sum(length(loss))::bigint as loss_chars,
  sha256(string_agg(loss, '' order by turn nulls first, role, text)) as loss_sha256,
  sum(length(role) + length(body) + 24)::bigint as formatted_chars
from e group by conv_id
"""
