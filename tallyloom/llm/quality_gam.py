"""Quality scores from a generalised additive model with pairwise interactions.

Each document becomes a few numbers about its whole text.  The model is a sum of
one lookup table per number and one per chosen pair of numbers; both are learned
by boosting in turn, feature after feature, with trees of at most four leaves on
the gradient of the logistic loss.  Pairs are those whose best tree helps most
once the single tables are done.  A score needs only bin numbers and additions.

Learning runs on the driver over at most ``MAX_LABELLED`` labelled rows, those
of smallest hash of their id: a documented bound.  Scoring covers every row.

Defined cases: a null text counts as empty and is scored like it; a document
with several labels gives a training row for each, and of rows that repeat an id
the smallest text teaches; without any label every score is 0.5; null ids are scored and never held out; labels without a document or
without a quality are passed over; repeated rows get equal scores.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import textstats as ts
from tallyloom.llm.tables import map_rows

MAX_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS = 32, 12, 8
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 60, 0.1, 2.0
THRESHOLD = 0.7

FEATURES = (
    "log_words", "symbols", "capitals", "digits", "stops", "no_letter_words", "repeats_next", "longest_run",
    "distinct", "top_word", "word_length", "word_spread", "same_lines", "line_words", "open_lines", "odd_ends",
)


def describe(text: str) -> list[float]:
    """The numbers about one text, in the order of FEATURES."""
    words = text.split()
    n = len(words)
    kinds = np.bincount(ts.KINDS[ts.code_points(text)], minlength=7)
    letters = int(kinds[ts.LOWER] + kinds[ts.UPPER])
    solid = max(1, int(kinds.sum() - kinds[ts.WHITE]))
    if not n:
        return [0.0] * len(FEATURES)
    counts = Counter(words)
    number = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    change = np.flatnonzero(ids[1:] != ids[:-1])
    runs = np.diff(np.concatenate(([-1], change, [n - 1])))
    lengths = np.fromiter(map(len, words), np.float64, n)
    blank = sum(k for w, k in counts.items() if not any(map(str.isalpha, w)))
    odd = sum(k for w, k in counts.items() if not (w[-1].isalnum() or w[-1] in ts.STOPS))
    lines = [x for x in text.split("\n") if x.strip()]
    open_lines = sum(1 for x in lines if x.rstrip()[-1] not in ".?!:\"'")
    return [
        float(np.log1p(n)), kinds[ts.SYMBOL] / solid, kinds[ts.UPPER] / max(1, letters), kinds[ts.DIGIT] / solid, kinds[ts.STOP] / solid,
        blank / n, 1 - (len(change) + 1) / n, float(runs.max()) / n,
        float(np.log1p(len(counts)) / np.log1p(n)), counts.most_common(1)[0][1] / n, float(lengths.mean()), float(lengths.std()),
        1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), open_lines / len(lines), odd / n,
    ]


@dataclass
class Model:
    """Bin edges per number, a table per number, and tables for pairs of numbers."""

    edges: list[np.ndarray]
    pair_edges: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.pair_edges)]
        for j, e in enumerate(self.edges):
            total += self.tables[j][np.searchsorted(e, x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain of the best cut of a row of bins, and the first bin right of it."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    total_g, total_h = g.sum(), h.sum()
    if not len(gl):
        return 0.0, 0
    gain = gl**2 / (hl + RIDGE) + (total_g - gl) ** 2 / (total_h - hl + RIDGE) - total_g**2 / (total_h + RIDGE)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _leaf(g: np.ndarray, h: np.ndarray) -> float:
    return float(-g.sum() / (h.sum() + RIDGE))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values by bin of a tree of depth two."""
    out = np.empty(len(g))
    gain, cut = _best_cut(g, h)
    for part in (slice(0, cut), slice(cut, len(g))) if gain > 0 else (slice(0, len(g)),):
        gp, hp, o = g[part], h[part], out[part]
        inner_gain, inner = _best_cut(gp, hp)
        if inner_gain > 0:
            o[:inner], o[inner:] = _leaf(gp[:inner], hp[:inner]), _leaf(gp[inner:], hp[inner:])
        else:
            o[:] = _leaf(gp, hp)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the better tree that cuts one axis, then each side along the other."""
    best = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        gt, ht = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(gt)):
            out, gain = np.empty_like(gt), 0.0
            for part in (slice(0, cut), slice(cut, len(gt))):
                gp, hp = gt[part].sum(axis=0), ht[part].sum(axis=0)
                inner_gain, inner = _best_cut(gp, hp)
                gain += inner_gain + gp.sum() ** 2 / (hp.sum() + RIDGE)
                out[part, :inner], out[part, inner:] = _leaf(gp[:inner], hp[:inner]), _leaf(gp[inner:], hp[inner:])
            if gain > best[0]:
                best = (gain, out.T if turned else out)
    return best


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables of single numbers in turn, then those of the best pairs."""
    n, width = len(x), len(FEATURES)
    if not n:
        empty = [np.empty(0)] * width
        return Model(empty, empty, np.zeros((width, 1)), [], np.zeros((0, 1, 1)), 0.0)
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    edges, pair_edges = [_edges(x[:, j], BINS) for j in range(width)], [_edges(x[:, j], PAIR_BINS) for j in range(width)]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    tables, total = np.zeros((width, BINS)), np.full(n, base)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = gradient()
            step = RATE * _tree(*(np.bincount(bins[j], w, len(edges[j]) + 1) for w in (g, h)))
            tables[j, : len(step)] += step
            total += step[bins[j]]

    def grid(a: int, b: int, weights: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * PAIR_BINS + coarse[b], weights, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = gradient()
    gains = [(_pair_tree(grid(a, b, g), grid(a, b, h))[0], a, b) for a, b in combinations(range(width), 2)]
    pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    pair_tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(pairs):
            g, h = gradient()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))[1]
            pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return Model(edges, pair_edges, tables, pairs, pair_tables, base)


def _describe_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [describe(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["quality", "x"])


def _score_rows(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([describe(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            scores = model.score(x)
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(scores)], [*rest, "score"])

    return score


def _good_rows(model: Model):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([describe(t or "") for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return keep


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input's rows and columns, where the score reaches THRESHOLD."""
    return map_rows(docs, _good_rows(fit(spark, docs, labels)))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Learn from labelled rows that are not held out."""
    usable = labels.where("quality is not null").where(remainder(F.col("doc_id"), 4) != 2)
    chosen = usable.select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # at most max_labelled rows
    seen = rows.mapInArrow(_describe_rows, "quality int, x array<double>").collect()
    pairs = sorted((tuple(r["x"]), r["quality"]) for r in seen)
    x = np.array([p[0] for p in pairs]).reshape(-1, len(FEATURES))
    return learn(x, np.array([float(p[1] == 1) for p in pairs]))


def score_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(spark, docs, labels)
    scored = docs.select("doc_id", "text").mapInArrow(_score_rows(model), "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
