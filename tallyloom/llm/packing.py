"""Packing tokenised documents into sequences by minimum bin slack.

A bin starts with the longest piece left; a subset-sum dynamic programme over
the lengths still available, kept as the bits of one integer, finds the fullest
combination for the rest, and the combination is removed.  Only lengths matter
to it, so the plan is made from the histogram of lengths (at most ``capacity``
rows, however large the input): a combination that is the fullest stays the
fullest while its lengths last, so it is applied as many times as they do.
Pieces then find their place by rank among the pieces of equal length.  Ranks
come from per-task counters and one prefix sum, never from one task a length;
the sums meet the pieces by task and length in a merge join, so no table of them
is ever sent to all tasks.

Defined cases: a null text counts as empty and gives one piece holding only the
end id; only documents longer than a sequence are cut; repeated rows are packed
as rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch
from tallyloom.llm.tables import parts_of

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker remembers, and the text it splits at a time.
CACHED_WORDS = 1_000_000
CHUNK_CHARS = 2_000_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class WordEncoder:
    """Token ids of texts, word by word.

    The tokenizer drops white space and its pre-tokens never cross it, so a text
    has the ids of its words one after another; a bounded memory of words spares
    the tokenizer the frequent ones.  Where the tokenizer lowers letters and
    parts them from the marks that follow, a word's marks and case don't make
    it a new one.
    """

    #: Marks at a word's end; an apostrophe isn't one, as it may open a suffix.
    MARKS = b".,;:!?)]}\"-*|%$#@_&"
    _ENDS = frozenset(b"abcdefghijklmnopqrstuvwxyz0123456789")

    def __init__(self, path: str, cached_words: int | None = None):
        self._most = cached_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._known: dict[bytes, bytes] = {}
        self._parts_marks = self._parts_them()
        self._pack = [struct.Struct(f"<{n}I").pack for n in range(32)]

    def _parts_them(self) -> bool:
        """Whether letters are lowered and parted from following marks, which stay one piece."""
        own, marks = self._tokenizer, self.MARKS.decode()
        lowers = own.normalizer is not None and own.normalizer.normalize_str("AZé") == "azé"
        pieces = own.pre_tokenizer.pre_tokenize_str if own.pre_tokenizer is not None else None
        return lowers and pieces is not None and all([at for _, at in pieces(x + marks)] == [(0, 1), (1, 1 + len(marks))] for x in "az09")

    def _parts(self, word: bytes) -> tuple[bytes, bytes]:
        """A word without its case and the marks that end it, and those marks."""
        if not self._parts_marks or b"'" in word:
            return word, b""
        low = word.lower()  # A to Z only
        core = low.rstrip(self.MARKS)
        return (core, low[len(core) :]) if core and core[-1] in self._ENDS else (low, b"")

    def _learn(self, words: list[bytes]) -> None:
        known, parts = self._known, list(map(self._parts, words))
        new = list({p for pair in parts for p in pair if p and p not in known})
        encoded = self._tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        for w, e in zip(new, encoded, strict=True):
            ids = e.ids
            known[w] = self._pack[len(ids)](*ids) if len(ids) < len(self._pack) else np.array(ids, "<u4").tobytes()
        for w, (core, marks) in zip(words, parts, strict=True):
            known[w] = known[core] + known[marks] if marks else known[core]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        begin = 0
        while begin < len(texts):
            end, chars = begin, 0
            while end < len(texts) and chars < CHUNK_CHARS:
                chars += len(texts[end] or "")
                end += 1
            words = [(t or "").encode().split() for t in texts[begin:end]]
            known = self._known
            new = list(set().union(*words).difference(known))
            if len(known) + len(new) > (self._most or CACHED_WORDS):
                known.clear()
                new = list(set().union(*words))
            self._learn(new)
            for ws in words:
                yield b"".join(map(known.__getitem__, ws))
            begin = end


@lru_cache(maxsize=1)
def _encoder(path: str, cached_words: int | None) -> WordEncoder:
    """One encoder a worker, whose memory of words outlives a task."""
    return WordEncoder(path, cached_words)


def _cut(path: str, capacity: int, end_id: int, with_ids: bool, cached_words: int | None):
    """Rows of pieces, each with its task and its rank there among equal lengths."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = _encoder(path, cached_words), TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        close = np.array([end_id], "<u4").tobytes()
        # Where memory is shared with other stages, rows pass in smaller parts too.
        for batch in batches if cached_words is None else chain.from_iterable(map(parts_of, batches)):
            cols: list[list] = [[] for _ in range(8)]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist()), strict=True):
                ids += close
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    for c, v in zip(cols, (doc_id, piece, at // 4, n, zlib.crc32(part), task, ranks[n], part if with_ids else None), strict=True):
                        c.append(v)
                    ranks[n] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"]
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            n = 8 if with_ids else 7
            yield pa.RecordBatch.from_arrays(arrays[:n], names[:n])

    return cut


def fullest(available: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in available if x <= room), reverse=True):
        copies, power = min(available[length], room // length), 1
        while copies > 0:  # powers of two cover every number of copies
            take = min(power, copies)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            copies -= take
            power *= 2
        if reach >> room:
            break
    target, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not (before >> target) & 1:
            chosen[length] = chosen.get(length, 0) + take
            target -= length * take
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Combinations of lengths, longest first inside each, and how often each is used."""
    left = {k: v for k, v in histogram.items() if v > 0}
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        bin_ = fullest({k: v for k, v in left.items() if v > 0}, capacity - seed)
        left[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(left[k] // n for k, n in bin_.items())
        for k, n in bin_.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        plan.append((dict(sorted(bin_.items(), reverse=True)), times))
    return plan


def _places(plan: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows of length, first rank, copies a bin, first sequence, offset; ordered by the first two."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for bin_, times in plan:
        offset = 0
        for length, copies in bin_.items():
            rows.append((length, used.get(length, 0), copies, sequence, offset))
            used[length] = used.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


_RANK_BITS = 48  # a length and a rank share one 64-bit key


def _place(shared, names: list[str]):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        keys = (rows[:, 0] << _RANK_BITS) | rows[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = rows[np.searchsorted(keys, (length << _RANK_BITS) | rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 3] + nth // row[:, 2], row[:, 4] + nth % row[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return place


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cached_words: int | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and the ids if asked for).

    ``cached_words`` (CACHED_WORDS if not given) are remembered by a worker, some 200 bytes each.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = PIECES + ", ids binary" * with_ids
    with Scratch(spark, "pack") as scratch:
        cut = docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity, end_id, with_ids, cached_words), PIECES + ", task long, rank long" + ", ids binary" * with_ids)
        pieces = scratch.keep(cut, "pieces")
        counts = scratch.table(pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "counts")
        histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
        shared = spark.sparkContext.broadcast(_places(plan_bins(histogram, capacity)))
        before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
        first = counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("first"))
        first = scratch.keep(first, "first")
        ranked = pieces.join(first.hint("merge"), ["task", "length"]).withColumn("rank", F.col("rank") + F.col("first"))
        return ranked.select(*names, "rank").mapInArrow(_place(shared, names), kinds + ", sequence_id long, offset long")
