"""Chat formatting with prefix-target expansion.

A conversation becomes one stream of formatted turns.  Every assistant turn is
an example of its own: its context is the stream before its reply, and only the
characters of the reply are trainable.  ``expand`` writes every example out with
its whole context; ``digest`` stores these examples and reads them back.
``render`` gives one of them.

A turn reads ``### role:``, a line feed, the text, a line feed, ``</turn>``, a
line feed.  Inside texts a backslash, ``###`` and ``</turn>`` get a backslash in
front; inside roles a backslash and a line feed do.  ``parse_turn`` undoes it.

Rows of a conversation are ordered by turn, then role and text; they pass
through a task one at a time.  The examples of a conversation are dealt out in
parts of about PART_CHARS, each to a task of its own that reads the turns from
the beginning; an example of more than HELD_CHARS is a part alone, and its text
leaves while it is read.  So no task holds more than HELD_CHARS of a
conversation, however long, though all examples together grow with the square of
its turns, as asked for.

Defined cases: a null text or role counts as empty; a null conversation id is a
conversation of its own, a null turn comes first; repeated rows are turns of
their own; a conversation without assistant turns has no example and an empty
loss; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch, shuffle_partitions

TRAINABLE = "assistant"
OPEN, CLOSE = "### ", "\n</turn>\n"
#: Characters of a row of an example, of a text that a task holds, and of the examples that a part writes.
PIECE_CHARS, HELD_CHARS, PART_CHARS = 1 << 17, 1 << 23, 1 << 25
#: Rows of examples that Spark's Parquet reader lays out together; a piece may hold a large turn.
READ_ROWS = 64

_UNESCAPE = re.compile(r"\\(\\|###|</turn>)")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where in it the text begins and ends."""
    head = OPEN + role.replace("\\", "\\\\").replace("\n", "\\n") + ":\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    line, _, rest = formatted[len(OPEN) :].partition("\n")  # a role holds no line feed of its own
    role = re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", line[:-1])
    return role, unescape(rest[: -len(CLOSE)])


def turns_of(text: str) -> list[str]:
    """The formatted turns of which a text consists; no turn holds CLOSE before its end."""
    *turns, rest = text.split(CLOSE)
    if rest:
        raise ValueError("a text doesn't end with a turn")
    return [t + CLOSE for t in turns]


def mark_of(start: int, formatted: str) -> int:
    """A turn at its place in the stream as a number; marks of a context are added up, in any order."""
    return int.from_bytes(hashlib.blake2b(f"{start}:{formatted}".encode(), digest_size=8).digest(), "little")


_MARKS = (1 << 63) - 1


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(columns, types, strict=True)], names)


def _format_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to formatted turns with their offsets in the stream of the conversation."""
    current, started = None, False
    for batch in batches:
        out: list[tuple] = []
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if not started or conv != current:
                current, started = conv, True
                position, offset, example, context, part, written = 0, 0, 0, 0, 0, 0
            piece, begin, end = format_turn(role or "", text or "")
            trained, after = role == TRAINABLE, offset + len(piece)
            if trained and after <= HELD_CHARS:
                written += after
            if trained and (after > HELD_CHARS or written > PART_CHARS):
                part, written = part + 1, after
            spans = (example, offset + begin, offset + end, context) if trained else (None,) * 4
            out.append((conv, position, piece, offset, *spans, example, part))
            context = context + mark_of(offset, piece) & _MARKS
            position += 1
            offset = after
            example += trained
        yield _batch(out, STREAM)


STREAM = "conv_id long, position long, formatted string, start long, example long, loss_start long, loss_end long, context_mark long, ahead long, part long"
EXAMPLES = "conv_id long, example long, piece long, start long, text string, own_start long, loss_start long, loss_end long, context_mark long"


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Formatted turns in stream order; a row with ``example`` set ends that example.

    Example k of a conversation is its stream up to the end of that row, with
    the characters from loss_start to loss_end trainable; ``context_mark`` sums
    the marks of the rows before it.  ``ahead`` is the example in which a turn
    comes first, ``part`` the first part that needs it.
    """
    n = shuffle_partitions(conversations.sparkSession)
    turns = conversations.select("conv_id", "turn", "role", "text").repartition(n, "conv_id")
    return turns.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format_rows, STREAM)


def render(stream: DataFrame, conv_id: int, example: int) -> tuple[str, int, int]:
    """The text of one example and its trainable span."""
    row = stream.where((F.col("conv_id") == conv_id) & (F.col("example") == example)).first()
    context = stream.where((F.col("conv_id") == conv_id) & (F.col("position") <= row["position"])).orderBy("position")
    return "".join(r["formatted"] for r in context.toLocalIterator()), row["loss_start"], row["loss_end"]


class _Part:
    """The turns that a part of a conversation has read, in pieces, and the examples that it writes.

    ``only`` is the one example of a part that is written while it is read.
    Where ``closing`` is set, turns that no example follows are written too.
    """

    def __init__(self, conv: int | None, part: int, only: int | None, closing: bool):
        self.conv, self.part, self.only, self.closing = conv, part, only, closing
        self.full: list[tuple[int, str]] = []
        self.open: list[str] = []
        self.start = self.size = self.left = 0  # the open piece, and the pieces that have left already
        self.ahead, self.own_at = -1, None  # where the turns began that belong to no earlier example
        self.over = False  # no example of this part follows

    def _row(self, example: int | None, piece: int, start: int, text: str, spans: tuple = (None,) * 3) -> tuple:
        own = example in (None, self.ahead) and self.own_at is not None and self.own_at < start + len(text)
        return (self.conv, example, piece, start, text, max(start, self.own_at) if own else None, *spans)

    def _turn_piece(self, end: int) -> tuple[int, str]:
        done = self.start, "".join(self.open)
        self.open, self.start, self.size = [], end, 0
        return done

    def _rest(self, end: int) -> Iterator[tuple]:
        """Turns that have been read since the last example."""
        for start, text in [*self.full, self._turn_piece(end)]:
            if self.closing and self.own_at is not None and self.own_at < start + len(text):
                begin = max(start, self.own_at)
                yield self._row(None, self.left, begin, text[begin - start :])
                self.left += 1
        self.full = []

    def add(self, formatted: str, start: int, ahead: int, part: int, example: int | None, spans: tuple) -> Iterator[tuple]:
        end = start + len(formatted)
        if self.own_at is None or ahead != self.ahead:
            self.ahead, self.own_at = ahead, start
        if self.over and not self.closing:
            return
        self.open.append(formatted)
        self.size += len(formatted)
        if example is not None and part == self.part:
            for i, (at, text) in enumerate(self.full):
                yield self._row(example, i, at, text)
            self.open = ["".join(self.open)]
            yield self._row(example, self.left + len(self.full), self.start, self.open[0], spans)
            if self.only is not None:
                self._turn_piece(end)
                self.only, self.left, self.over = None, 0, True
        if example is not None:
            self.own_at = None
        if self.only is None and not self.over and end > HELD_CHARS:
            self.over = True
            yield from self._rest(end)
        if self.size >= PIECE_CHARS:
            if self.over:
                yield from self._rest(end)
            elif self.only is None:
                self.full.append(self._turn_piece(end))
            else:
                yield self._row(self.only, self.left, *self._turn_piece(end))
                self.left += 1


_DEALT = ("conv_id", "for_part", "only", "closing", "formatted", "start", "ahead", "part", "example", "loss_start", "loss_end", "context_mark")


def _expand_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    size, part, end = 0, None, 0
    for batch in batches:
        for conv, for_part, only, closing, formatted, start, ahead, of, example, *spans in zip(*(batch.column(c).to_pylist() for c in _DEALT), strict=True):
            if part is None or (conv, for_part) != (part.conv, part.part):
                out.extend(part._rest(end) if part is not None else ())
                part = _Part(conv, for_part, only, closing)
            end = start + len(formatted)
            for row in part.add(formatted, start, ahead, of, example, tuple(spans)):
                out.append(row)
                size += len(row[4])
                if size > PIECE_CHARS:
                    yield _batch(out, EXAMPLES)
                    out, size = [], 0
    if part is not None:
        out.extend(part._rest(end))
    yield _batch(out, EXAMPLES)


def expand(stream: DataFrame, rest: bool = False) -> DataFrame:
    """Every example with its whole context, and its trainable span.

    An example is one row, a longer one than PIECE_CHARS several, cut between
    turns: ``piece`` numbers them, ``start`` is where ``text`` stands in the
    example, ``own_start`` where its turns begin that are in no earlier one; the
    last row has the span, in characters of the whole example.  With ``rest``,
    the turns after the last example come too, as rows without ``example``.
    """
    alone = F.when(F.col("example").isNotNull() & (F.col("start") + F.length("formatted") > HELD_CHARS), F.col("part"))
    split = stream.where("part > 0").groupBy(F.col("conv_id").alias("split_id")).agg(F.max("part").alias("last"), F.min(alone).alias("alone_from"), F.min(F.col("example") - alone).alias("shift"))
    last, for_part = F.coalesce("last", F.lit(0)), F.col("for_part")
    dealt = stream.join(split, F.col("conv_id").eqNullSafe(F.col("split_id")), "left")
    dealt = dealt.select("*", F.explode(F.sequence("part", last)).alias("for_part"))
    dealt = dealt.withColumn("only", F.when(for_part >= F.col("alone_from"), for_part + F.col("shift"))).withColumn("closing", for_part == last)
    dealt = dealt.repartition(shuffle_partitions(stream.sparkSession), "conv_id", "for_part").sortWithinPartitions("conv_id", "for_part", "position")
    examples = dealt.select(*_DEALT).mapInArrow(_expand_rows, EXAMPLES)
    return examples if rest else examples.where("example is not null")


_READ = "conv_id long, example long, piece long, own string, own_start long, loss_start long, loss_end long, context_mark long, mark long, chars long"


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per piece of a stored example, the turns that are new in it, and the mark and characters of its context."""
    for batch in batches:
        out: list[tuple] = []
        for conv, example, piece, start, text, own_start, loss_start, loss_end, context in zip(*(batch.column(c.split()[0]).to_pylist() for c in EXAMPLES.split(", ")), strict=True):
            at, mark = start, 0
            turns = turns_of(text) if example is not None else []
            for turn in turns[: len(turns) - (loss_start is not None)]:
                mark += mark_of(at, turn)
                at += len(turn)
            out.append((conv, example, piece, None if own_start is None else text[own_start - start :], own_start, loss_start, loss_end, context, mark & _MARKS, at - start))
        yield _batch(out, _READ)


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation, what reading its examples back gives: the turns in which each differs from the one before, and its reply."""
    done: list[tuple] = []
    current, state, mark, chars = None, None, 0, 0

    def close() -> None:
        if state is not None:
            n, turns, loss_chars, loss, length, examples, contexts, match = state
            done.append((current, n, turns.hexdigest(), loss_chars, loss.hexdigest(), length, examples, contexts, match))

    for batch in batches:
        for conv, own, own_start, loss_start, loss_end, context, own_mark, own_chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "own", "own_start", "loss_start", "loss_end", "context_mark", "mark", "chars")), strict=True):
            if state is None or conv != current:
                close()
                current, state, mark, chars = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0, True], 0, 0
            if own is not None:
                state[7] &= own_start == state[4]
                for turn in turns_of(own):
                    role, text = parse_turn(turn)
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(own)
            mark, chars = mark + own_mark & _MARKS, chars + own_chars
            if loss_start is not None:
                trained = unescape(own[loss_start - own_start : loss_end - own_start])
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[5] += 1
                state[6] += chars
                state[7] &= mark == context
                mark, chars = 0, 0
        if len(done) > 5000:
            yield _batch(done, _DIGEST)
            done = []
    close()
    if done:
        yield _batch(done, _DIGEST)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, context_chars long, contexts_match boolean"


@contextmanager
def _few_rows_together(spark: SparkSession) -> Iterator[None]:
    """While results are written, the reader takes READ_ROWS at a time: 4,096 long texts would not fit into its memory."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(name)
    spark.conf.set(name, READ_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """Format, write every example out, read the examples back, and digest each conversation.

    ``contexts_match`` says that the context read in each example is the one
    that was formatted for it; ``context_chars`` sums their lengths.
    """
    with Scratch(spark, "chat_format") as scratch:
        stream = scratch.table(format_conversations(conversations), "stream")
        examples = scratch.table(expand(stream, rest=True), "examples")
        scratch.drop(stream)
        back = examples.mapInArrow(_read_rows, _READ).repartition(shuffle_partitions(spark), "conv_id")
        back = back.sortWithinPartitions("conv_id", F.col("example").asc_nulls_last(), "piece")
        with _few_rows_together(spark):
            return scratch.keep(back.mapInArrow(_digest_rows, _DIGEST))
