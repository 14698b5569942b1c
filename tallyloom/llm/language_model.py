"""Log-likelihoods of whole documents under a gated recurrent model of the corpus.

Words of all training documents are counted; the counts give the base score, the
frequent words and suffix classes of the network, and the distribution of other
words within a suffix class (absolute discounting; what the discount frees goes
to unseen words).  The network starts from the unigram frequencies, is trained
once by one task on about WARM_TOKENS tokens, and then on all training documents
in groups of about GROUP_TOKENS: each group moves the weights, and the moves are
averaged by the symbols seen.  A text is never cut, and its state never dropped.

Texts are split into words twice, to count and to store their symbols; training
and scoring read the stored symbols.  The words that any task must know (at most
DICTIONARY) are broadcast.  Rarer words of a document leave as rows, and meet the
table of counts in a join.

Defined cases: a null text counts as empty: it has one token, its end; without
training documents the counts are 0 and the network stays as it began; a null id
is neither held out nor learned from; repeated rows are rows of their own, learned
from as often as they occur; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import gru
from tallyloom.llm.scratch import Scratch, shuffle_partitions

DICTIONARY = 131_072
#: Tokens, on average, that one task learns from first, and that a group holds afterwards.
WARM_TOKENS, GROUP_TOKENS = 1_000_000, 2_000_000
#: Few lanes make many steps, which is what a fresh network needs.
WARM_LANES = 32
#: Texts over so many symbols enter their lanes first.
LONG = 2048
#: Bytes of stored symbols that a task scores together.
HELD_BYTES = 8_000_000
DISCOUNT = 0.6
#: Bytes of texts that a task splits into words together; a longer text is split alone.
SPLIT_BYTES = 8_000_000
SLICE = 1024
END = b""


def words_of(text: str | None) -> list[bytes]:
    """Words with A to Z in lower case, and the end."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    words.append(END)
    return words


def words_by_text(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of many texts, one after another and without the ends, and the number of each word's text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(column.cast(pa.string()).fill_null("")))
    words, lengths = split.flatten(), split.value_lengths().to_numpy(zero_copy_only=False)
    there = pc.not_equal(words, "")  # white space around a text leaves empty ones
    at = np.repeat(np.arange(len(lengths)), lengths)[there.to_numpy(zero_copy_only=False)]
    return words.filter(there).cast(pa.binary()), at


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SPLIT_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        counted = words_by_text(batch.column("text"))[0].value_counts()
        words, numbers = (pa.concat_arrays([counted.field(i), more]) for i, more in enumerate((pa.array([END], pa.binary()), pa.array([batch.num_rows], pa.int64()))))
        yield pa.RecordBatch.from_arrays([words, numbers], ["word", "c"])


@dataclass
class Vocabulary:
    """What tasks know about words: bounded by DICTIONARY words and gru.TAIL classes."""

    words: list[bytes]  # the first are the network's frequent words
    counts: np.ndarray
    heads: int
    suffixes: dict[bytes, int]  # tail class by the last two bytes; others are class 0
    mass: np.ndarray  # training tokens by tail class
    types: np.ndarray  # their distinct words
    total: int
    distinct: int
    least: int  # words counted less often are not in ``words``

    def __post_init__(self):
        self._index = {w: i for i, w in enumerate(self.words)}
        self._symbol = np.array([i if i < self.heads else gru.HEAD + self.suffixes.get(w[-2:], 0) for i, w in enumerate(self.words)], np.int32)
        self.end = self._index[END]

    def tails(self, words: pa.Array) -> np.ndarray:
        """The tail class of each word."""
        suffixes = pa.array(list(self.suffixes), pa.binary())
        found = pc.index_in(pc.binary_slice(words, -2), suffixes).fill_null(-1).to_numpy()
        return np.array([*self.suffixes.values(), 0], np.int32)[found]

    def symbols(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The network's symbol of each word, and its place in ``words`` (or -1)."""
        index = pc.index_in(words, pa.array(self.words, pa.binary())).fill_null(-1).to_numpy()
        out, other = self._symbol[index], np.flatnonzero(index < 0)
        out[other] = gru.HEAD + self.tails(words.take(pa.array(other)))
        return out, index

    def symbol_counts(self) -> np.ndarray:
        out = np.zeros(gru.HEAD + gru.TAIL)
        out[: self.heads] = self.counts[: self.heads]
        out[gru.HEAD :] = self.mass
        return out


def count_words(scratch: Scratch, taught: DataFrame) -> DataFrame:
    """Every word of the training documents with its number; the end is the empty word."""
    parts = taught.select("text").mapInArrow(_count_rows, "word binary, c long")
    return scratch.table(parts.groupBy("word").agg(F.sum("c").alias("c")), "counts")


def vocabulary(counts: DataFrame, dictionary: int = DICTIONARY) -> Vocabulary:
    total, distinct = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1))).first())
    # The least count with at most `dictionary` words, from a histogram of an eighth of a power of two a step.
    step = F.floor(F.log2("c") * 8).cast("int")
    histogram = sorted(((r[0], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    room, lowest = dictionary - 1, None
    for at, n in histogram:
        if n > room:
            break
        room, lowest = room - n, at
    known = counts.where((step >= lowest) | (F.col("word") == F.lit(END))).collect() if lowest is not None else counts.where(F.col("word") == F.lit(END)).collect()
    least = max(1, int(np.ceil(2 ** (lowest / 8) - 1e-9))) if lowest is not None else 1 << 62
    ranked = sorted(((r["c"], bytes(r["word"])) for r in known), key=lambda x: (x[1] != END, -x[0], x[1])) or [(0, END)]
    words, numbers = [w for _, w in ranked], np.array([c for c, _ in ranked], np.int64)
    heads = min(gru.HEAD, len(words))
    # At most 65,793 suffixes of up to two bytes.
    suffix = F.substring("word", -2, 2)
    rows = {bytes(r["suffix"]): [r["mass"], r["types"]] for r in counts.groupBy(suffix.alias("suffix")).agg(F.sum("c").alias("mass"), F.count(F.lit(1)).alias("types")).collect()}
    for w, c in zip(words[:heads], numbers[:heads].tolist(), strict=True):
        if w[-2:] in rows:
            rows[w[-2:]][0] -= c
            rows[w[-2:]][1] -= 1
    top = sorted(rows, key=lambda s: (-rows[s][0], s))[: gru.TAIL - 1]
    suffixes = {s: i + 1 for i, s in enumerate(top)}
    mass, types = np.zeros(gru.TAIL), np.zeros(gru.TAIL)
    for s, (m, t) in rows.items():
        mass[suffixes.get(s, 0)] += m
        types[suffixes.get(s, 0)] += t
    return Vocabulary(words, numbers, heads, suffixes, mass, types, total, distinct, least)


_PREPARED = "row long, doc_id long, n_tokens long, known long, base double, inner double, symbols binary, rare array<struct<word: binary, tail: int, n: int>>"


def _prepare_rows(shared):
    """Per document: its symbols, all that the broadcast vocabulary can tell, and its rarer words."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        log_counts, log_mass = np.log10(v.counts + 0.1), np.log10(np.maximum(v.mass, 1e-9))
        inner = np.log10(np.maximum(v.counts - DISCOUNT, 1e-9))
        log_mass[v.mass <= 0] = 0
        for batch in _slices(batches):
            n = batch.num_rows
            words, at = words_by_text(batch.column("text"))
            symbols, index = v.symbols(words)
            known, tail = index >= 0, symbols >= gru.HEAD
            lengths = np.bincount(at, minlength=n) + 1
            laid = np.full(len(words) + n, v.end, "<i2")  # every text with its end
            laid[np.arange(len(words)) + at] = symbols
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            base = np.bincount(at[known], log_counts[index[known]], n) + log_counts[v.end]
            within = np.bincount(at[known & tail], inner[index[known & tail]], n) - np.bincount(at[tail], log_mass[symbols[tail] - gru.HEAD], n)
            seen = np.bincount(at[known], v.counts[index[known]] > 0, n).astype(np.int64) + int(v.counts[v.end] > 0)
            # Rarer words, counted by text.
            coded = words.take(pa.array(np.flatnonzero(~known))).dictionary_encode()
            kinds = max(1, len(coded.dictionary))
            pairs, numbers = np.unique(at[~known] * kinds + coded.indices.to_numpy(), return_counts=True)
            of = pairs % kinds
            listed = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(of)), pa.array(v.tails(coded.dictionary)[of], pa.int32()), pa.array(numbers, pa.int32())], ["word", "tail", "n"])
            offsets = pa.array(np.searchsorted(pairs, np.arange(n + 1) * kinds), pa.int32())
            stored = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 2).astype(np.int32)), pa.py_buffer(laid)])
            made = [pa.array(lengths, pa.int64()), pa.array(seen), pa.array(base), pa.array(within.astype(np.float64)), stored]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *made, pa.ListArray.from_arrays(offsets, listed)], ["row", "doc_id", "n_tokens", "known", "base", "inner", "symbols", "rare"])

    return prepare


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<i2") for x in column.to_pylist()]


def _warm_rows(shared):
    """One task's weights, and the squares of its gradients, after all its texts."""

    def warm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        trainer = gru.Trainer(gru.fresh(v.symbol_counts()))
        trainer.train([t for b in batches for t in _texts(b.column("symbols"))], v.end, WARM_LANES)
        yield pa.RecordBatch.from_arrays([pa.array([trainer.flat.tobytes()], pa.binary()), pa.array([trainer.squares.tobytes()], pa.binary())], ["flat", "squares"])

    return warm


def _train_rows(shared, weights):
    """Per group of texts: how far it moves the weights, times the symbols seen, in slices."""

    def moved(group: int, texts: list[np.ndarray]) -> pa.RecordBatch:
        flat, squares = weights.value
        trainer = gru.Trainer(flat, squares)
        # The longest first, so that no lane is left alone with one.
        trainer.train(sorted(texts, key=lambda t: -max(len(t), LONG)), shared.value.end)
        way = (trainer.flat - flat) * np.float32(trainer.seen)
        at = range(0, gru.SIZE, SLICE)
        columns = [pa.array(list(at), pa.int32()), pa.array([group] * len(at), pa.int64()), pa.array([way[i : i + SLICE].tobytes() for i in at], pa.binary()), pa.array([trainer.seen] * len(at), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["at", "part", "moved", "seen"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts, size = None, [], 0
        for batch in batches:
            for group, text in zip(batch.column("part").to_pylist(), _texts(batch.column("symbols")), strict=True):
                # A group that very many equal rows have filled is trained in parts.
                if texts and (group != now or size >= 2 * GROUP_TOKENS):
                    yield moved(now, texts)
                    texts, size = [], 0
                now = group
                texts.append(text)
                size += len(text)
        if texts:
            yield moved(now, texts)

    return train


def _mean_slices(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((p, m, n) for b in batches for p, m, n in zip(*(b.column(c).to_pylist() for c in ("part", "moved", "seen")), strict=True))
    total = np.zeros(len(rows[0][1]) // 4)
    for _, way, _ in rows:  # in the order of the groups, however they were dealt
        total += np.frombuffer(way, np.float32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([(total / sum(n for _, _, n in rows)).tobytes()], pa.binary())], ["at", "moved"])


def learn(spark: SparkSession, taught: DataFrame, shared, n_tokens: int) -> np.ndarray:
    """The network's weights: unigram start, warm-up, then every training document.

    ``taught`` has doc_id and symbols.  Which texts form the warm-up and which a
    group, and their order, follow from hashes of ids and symbols, so the weights
    don't depend on how rows are dealt.
    """
    rank = F.xxhash64(F.lit(17), "doc_id", "symbols").alias("rank")
    rows = taught.select("doc_id", "symbols", rank)
    share = min(1 << 20, -(-WARM_TOKENS * (1 << 20) // max(1, n_tokens)))
    some = rows.where(F.pmod("rank", F.lit(1 << 20)) < share).repartition(1).sortWithinPartitions("rank", "doc_id", "symbols")
    found = some.select("symbols").mapInArrow(_warm_rows(shared), "flat binary, squares binary").first()  # two vectors of weights
    if found is None:  # no text fell to the warm-up
        untrained = gru.Trainer(gru.fresh(shared.value.symbol_counts()))
        found = untrained.flat.tobytes(), untrained.squares.tobytes()
    start, squares = (np.frombuffer(bytes(x), np.float32) for x in found)
    weights = spark.sparkContext.broadcast((start, squares))
    groups = max(1, -(-n_tokens // GROUP_TOKENS))
    rows = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(18), "doc_id", "symbols"), F.lit(groups)))
    rows = rows.repartition(shuffle_partitions(spark), "part").sortWithinPartitions("part", "rank", "doc_id", "symbols")
    moves = rows.select("part", "symbols").mapInArrow(_train_rows(shared, weights), "at int, part long, moved binary, seen long")
    flat = start.astype(np.float64)
    for r in moves.groupBy("at").applyInArrow(_mean_slices, "at int, moved binary").collect():  # one model's weights
        flat[r["at"] : r["at"] + SLICE] += np.frombuffer(bytes(r["moved"]), np.float64)
    return flat.astype(np.float32)


_SCORED = "row long, doc_id long, n_tokens long, known long, base double, model double"


def _score_rows(shared, weights):
    """Per prepared document, the log10 probability of its symbols and of the words inside their classes."""

    def scored(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        logs = gru.score(weights.value, _texts(rows.column("symbols")), shared.value.end) / np.log(10)
        model = pa.array(logs + rows.column("inner").to_numpy(zero_copy_only=False))
        names = ["row", "doc_id", "n_tokens", "known", "base"]
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), model], [*names, "model"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column("symbols").nbytes
            if size >= HELD_BYTES:
                yield scored(held)
                held, size = [], 0
        if held:
            yield scored(held)

    return score


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 10


def score_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    with Scratch(spark, "language_model") as scratch:
        taught = docs.where(remainder(F.col("doc_id")) != 0).select("text")
        counts = count_words(scratch, taught)
        v = vocabulary(counts)
        shared = spark.sparkContext.broadcast(v)
        numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        prepared = scratch.table(numbered.mapInArrow(_prepare_rows(shared), _PREPARED), "prepared")
        weights = spark.sparkContext.broadcast(learn(spark, prepared.where(remainder(F.col("doc_id")) != 0), shared, v.total))
        parts = prepared.drop("rare").mapInArrow(_score_rows(shared, weights), _SCORED)
        rare = prepared.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.tail", "r.n")
        met = rare.join(counts.where(F.col("c") < v.least), "word", "left")
        c = F.coalesce("c", F.lit(0))
        unseen = F.array(*(F.lit(float(np.log10(DISCOUNT * t) if t else 0.0)) for t in v.types))
        inner = F.when(c > 0, F.log10(F.greatest(c - DISCOUNT, F.lit(1e-9)))).otherwise(F.element_at(unseen, F.col("tail") + 1))
        sums = met.groupBy("row").agg(F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10(c + 0.1)).alias("more_base"), F.sum(F.col("n") * inner).alias("more_model"))
        whole = float(np.log10(v.total + 0.1 * (v.distinct + 1)))
        out = parts.join(sums, "row", "left")
        held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
        out = out.select(
            "doc_id",
            held.alias("held_out"),
            "n_tokens",
            (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
            F.lit(v.total).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
            (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score"),
        )
        return scratch.keep(out)
