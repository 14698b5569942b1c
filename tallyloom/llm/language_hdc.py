"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point, so no
alphabet is fixed beforehand.  A run of three letters (word ends count as one
letter) becomes the product of its letters' vectors, the first rolled twice and
the second once; a text is the sum of its runs, a language the sum of its texts,
each text's runs scaled to a whole of equal size.
The language whose sum has the largest cosine with the text's is the prediction
and that cosine, at least 0, its score.

Sums are of whole numbers, so the profiles don't depend on how rows are dealt.
One task sends one vector per language, summed again in slices of dimensions.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as
is every text if no language could be learned; ties go to the first language in
text order; rows without a language teach nothing; null ids are neither held
out nor learned from; repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import textstats as ts
from tallyloom.llm.tables import map_rows

DIMENSIONS = 1024
SEED = 20260
#: Runs of letters whose vectors a worker remembers (4 KB each).
MAX_RUNS = 16_000
SLICE = 128
#: A text's runs count in shares of 2**SHARE_BITS, so that one long text doesn't make the
#: profile; shorter texts than LEAST_RUNS count for less.
SHARE_BITS, LEAST_RUNS = 20, 100
UNKNOWN = "und"
#: A text of at least JUDGED_RUNS runs whose best cosine is below LEAST_COSINE is in no learned language.
LEAST_COSINE, JUDGED_RUNS = 0.2, 100
_SPACE = 32


def runs_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of three letters in a text, as 63-bit codes, and their counts."""
    empty = np.empty(0, np.int64)
    points = ts.code_points((text or "").lower()).astype(np.int64)
    letter = ts.LETTERS[points]
    if not letter.any():
        return empty, empty
    points[~letter] = _SPACE
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of several white characters stays
    points = points[keep]
    points = np.concatenate(([_SPACE], points if letter[-1] else points[:-1], [_SPACE]))
    return np.unique((points[:-2] << 42) | (points[1:-1] << 21) | points[2:], return_counts=True)


class Runs:
    """Vectors of runs, made when first met and remembered up to a limit."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self._letters: dict[int, np.ndarray] = {}
        self._row: dict[int, int] = {}
        self._rows = np.empty((MAX_RUNS, dimensions), np.float32)

    def _letter(self, point: int) -> np.ndarray:
        if (v := self._letters.get(point)) is None:
            if len(self._letters) > 4096:
                self._letters.clear()
            draw = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions)
            v = self._letters[point] = (2 * draw - 1).astype(np.float32)
        return v

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the runs' vectors, each as often as it occurs."""
        total = np.zeros(self.dimensions)
        for at in range(0, len(codes), 4096):
            part = codes[at : at + 4096].tolist()
            if len(self._row) + len(part) > MAX_RUNS:
                self._row.clear()
            for code in part:
                if code not in self._row:
                    a, b, c = (self._letter(code >> s & 0x1FFFFF) for s in (42, 21, 0))
                    self._rows[len(self._row)] = np.roll(a, 2) * np.roll(b, 1) * c
                    self._row[code] = len(self._row)
            index = np.fromiter(map(self._row.__getitem__, part), np.int64, len(part))
            weights = counts[at : at + 4096]
            # Single precision is exact while no sum can reach 2**24.
            kind = np.float32 if weights.sum() < 1 << 24 else np.float64
            total += weights.astype(kind) @ self._rows[index].astype(kind, copy=False)
        return total


def _partial_profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs, sums = Runs(), {}
    for batch in batches:
        gathered: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            codes, counts = runs_of(text)
            if len(codes):
                gathered.setdefault(lang, []).append((codes, (counts << SHARE_BITS) // max(int(counts.sum()), LEAST_RUNS)))
        for lang, parts in gathered.items():
            codes, back = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([n for _, n in parts]))
            total = sums.setdefault(lang, np.zeros(DIMENSIONS, np.int64))
            total += runs.bundle(codes, counts).round().astype(np.int64)
    for lang, total in sums.items():
        at = range(0, DIMENSIONS, SLICE)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(at), pa.string()), pa.array(list(at), pa.int32()), pa.array([total[i : i + SLICE].tolist() for i in at], pa.list_(pa.int64()))],
            ["lang", "at", "part"],
        )


def _sum_slices(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLICE, np.int64)
    for batch in batches:
        for part in batch.column("part").to_pylist():
            total += np.array(part, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tolist()], pa.list_(pa.int64()))], ["lang", "at", "part"])


def learn_profiles(docs: DataFrame) -> dict[str, np.ndarray]:
    """A vector of whole numbers per language; the driver gets languages times DIMENSIONS numbers."""
    taught = docs.where("lang is not null and text is not null").select("lang", "text")
    parts = taught.mapInArrow(_partial_profiles, "lang string, at int, part array<long>")
    profiles: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "at").applyInArrow(_sum_slices, "lang string, at int, part array<long>").collect():
        profiles.setdefault(row["lang"], np.zeros(DIMENSIONS, np.int64))[row["at"] : row["at"] + SLICE] = row["part"]
    return dict(sorted(profiles.items()))


class Judge:
    """The nearest language of a text, its cosine and the text's number of runs."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.names, self._runs = list(profiles), Runs()
        self._matrix = np.array([v / max(np.linalg.norm(v.astype(float)), 1e-9) for v in profiles.values()]).reshape(-1, DIMENSIONS)

    def __call__(self, text: str | None) -> tuple[str, float, int]:
        codes, counts = runs_of(text)
        size = int(counts.sum())
        if not size or not self.names:
            return UNKNOWN, 0.0, size
        vector = self._runs.bundle(codes, counts)
        cosines = self._matrix @ vector / max(np.linalg.norm(vector), 1e-9)
        best = int(np.argmax(cosines))
        return self.names[best], float(min(max(cosines[best], 0.0), 1.0)), size


def _predict(profiles: dict[str, np.ndarray]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles)
        for batch in batches:
            found = [judge(t) for t in batch.column("text").to_pylist()]
            langs, scores = [f[0] for f in found], [f[1] for f in found]
            rest = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*rest, "lang_pred", "score"])

    return predict


def _known_rows(profiles: dict[str, np.ndarray], languages: frozenset[str] | None):
    def stays(lang: str, score: float, size: int) -> bool:
        if not profiles:
            return size > 0
        return lang != UNKNOWN and (languages is None or lang in languages) and (size < JUDGED_RUNS or score >= LEAST_COSINE)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(profiles)
        for batch in batches:
            found = [judge(t) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("lang")
            if at >= 0 and pa.types.is_string(batch.schema.field(at).type):
                given = pc.fill_null(pc.equal(batch.column(at), ""), True)
                named = pa.array([f[0] if f[0] != UNKNOWN else None for f in found], pa.string())
                batch = batch.set_column(at, batch.schema.field(at), pc.if_else(given, pc.coalesce(named, batch.column(at)), batch.column(at)))
            yield batch.filter(pa.array([stays(*f) for f in found], pa.bool_()))

    return keep


def keep_known(docs: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """The input's rows and columns, without texts in no learned language, or in none of ``languages`` if given.

    A text goes if it has no letter, if the nearest language isn't wanted, or if
    it has at least JUDGED_RUNS runs and its cosine with the nearest language is
    below LEAST_COSINE; shorter texts scatter too widely to be judged by it.
    Where ``lang`` is null or empty, the prediction takes its place.  If no
    language could be learned, only texts without a letter go.
    """
    profiles = learn_profiles(docs.where(~held_out(F.col("doc_id"))))
    wanted = None if languages is None else frozenset(languages)
    return map_rows(docs, _known_rows(profiles, wanted))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    held = held_out(F.col("doc_id"))
    profiles = learn_profiles(docs.where(~held))
    rows = docs.select("doc_id", "text").mapInArrow(_predict(profiles), "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", F.coalesce(held & F.col("doc_id").isNotNull(), F.lit(False)).alias("held_out"), "lang_pred", "score")
