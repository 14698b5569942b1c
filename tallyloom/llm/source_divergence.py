"""How far the sources of a language differ in their words, by inclusion and exclusion over supports.

Each language keeps the terms found in at least MIN_DOCS of its documents.  A
group (a source within a language) gives each kept term the smoothed share
``p = 1 + floor(SCALE * (count + PRIOR) / (N + PRIOR * V))``, with N the group's
occurrences of kept terms and V their number.  Two groups differ by the sum of
``|p - q|`` over all kept terms, those that neither has included.

That sum is never taken term by term for each pair.  A term that a group lacks
has the constant share z = p(0), so

* each group's histogram of counts (how many terms it has n times) gives the sum
  of |p(n) - z'| for any other group's z', from running sums over its sorted
  shares, as if all its terms were one-sided;
* terms that both groups have are mended from the term's postings by
  ``|p - p'| - |p - z'| - |z - p'| + |z - z'|``;
* all others count ``|z - z'|`` each, a constant times their number.

Texts are read once.  Tasks count terms before anything shuffles, at most
HELD entries at a time, so a term or group of any weight sends one row a task
and source.  Mends are added up in numpy, by blocks of a term's sources; pairs
leave a task added up, never a term's pairs.  Shares are exact integers: their
products are decimals of 38 digits.

Defined cases: null text, language and source count as ''; repeated rows are
documents of their own; a group without kept terms has N = 0, and every group
meets every other of its language; a language that keeps no term gives pairs of
value 0 and no term; a language with one source has no pair; an empty table
gives an empty result.  A text of any length passes in pieces of PIECE bytes, so
one task holds its distinct terms, not its words.  The pairs are as many as the
groups of a language squared, since that is what is asked for.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.scratch import Scratch, shuffle_partitions

MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Counted terms that a task holds, bytes of a text split at a time, sources of a term in a block, pair sums that a task holds.
HELD, PIECE, BLOCK, PAIRS = 400_000, 1 << 20, 256, 1 << 20

#: Letters of ASCII in lower case, other ASCII to blanks; the bytes of all other characters stay.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"
_MENDS = "lang string, a string, b string, value long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, piece by piece."""
    at, plain = 0, text.translate(_TERMS)
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _COUNTED.split(", ")]
    found: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (times, docs) in found.items():
            terms = list(times)
            for i in range(0, len(terms), 50_000):
                part = terms[i : i + 50_000]
                columns = [pa.array([lang] * len(part), pa.binary()), pa.array([source] * len(part), pa.binary()), pa.array(part, pa.binary())]
                numbers = [pa.array([c[t] for t in part], pa.int64()) for c in (times, docs)]
                yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in columns), *numbers], names)
        found.clear()

    held = 0
    for batch in batches:
        columns = [batch.column(c).cast(pa.binary()).fill_null(b"") for c in ("lang", "source", "text")]
        for i in range(batch.num_rows):
            lang, source, text = (c[i].as_py() for c in columns)
            if (lang, source) not in found:
                found[lang, source] = Counter(), Counter()
            times, docs = found[lang, source]
            held -= len(times)
            own: set[bytes] = set()
            for part in terms_of(text):
                times.update(part)
                own.update(part)
            docs.update(own)
            held += len(times)
            if held > HELD:
                yield from flush()
                held = 0
    yield from flush()


def _mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings to sums of mends by pair of sources."""
    names: dict[str, int] = {}
    keys: list[np.ndarray] = []
    values: list[np.ndarray] = []
    size, lang_now = 0, None

    def add_up() -> tuple[np.ndarray, np.ndarray]:
        pairs, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, at, np.concatenate(values))
        return pairs, sums

    def emit() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if keys:
            pairs, sums = add_up()
            label = np.array(list(names), object)
            for i in range(0, len(pairs), 50_000):
                a, b = pairs[i : i + 50_000] >> 32, pairs[i : i + 50_000] & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array([lang_now] * len(a), pa.string()), pa.array(label[a], pa.string()), pa.array(label[b], pa.string()), pa.array(sums[i : i + 50_000])], ["lang", "a", "b", "value"])
        names.clear()
        keys.clear()
        values.clear()
        size = 0

    for lang, sources, p, z in _postings(batches):
        if lang != lang_now or size > PAIRS:
            if lang == lang_now and len(keys) > 1:
                pairs, sums = add_up()
                keys[:], values[:], size = [pairs], [sums], len(pairs)
            if lang != lang_now or size > PAIRS // 2:
                yield from emit()
                lang_now = lang
        at = np.fromiter((names.setdefault(s, len(names)) for s in sources), np.int64, len(sources))
        for i in range(0, len(at), BLOCK):
            # Every source of the block with those that follow it in the term's list.
            r, c = np.triu_indices(min(BLOCK, len(at) - i), 1, len(at) - i)
            r, c = r + i, c + i
            keys.append(at[r] << 32 | at[c])
            values.append(abs(p[r] - p[c]) - abs(p[r] - z[c]) - abs(z[r] - p[c]) + abs(z[r] - z[c]))
            size += len(r)
            if size > 4 * PAIRS:
                pairs, sums = add_up()
                keys[:], values[:], size = [pairs], [sums], len(pairs)
    yield from emit()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str], np.ndarray, np.ndarray]]:
    """Language, sources, shares and absent shares of each term with two sources at least; rows come sorted by language, term and source."""
    now: tuple | None = None
    rest: list[tuple] = []

    def term() -> tuple[str, list[str], np.ndarray, np.ndarray]:
        return now[0], [s for part in rest for s in part[0]], *(np.concatenate([part[k] for part in rest]) for k in (1, 2))

    for batch in batches:
        langs, terms, sources = (batch.column(c).to_pylist() for c in ("lang", "term", "source"))
        p, z = (batch.column(c).to_numpy() for c in ("p", "z"))
        i = 0
        while i < len(terms):
            j = i + 1
            while j < len(terms) and terms[j] == terms[i] and langs[j] == langs[i]:
                j += 1
            if (langs[i], terms[i]) != now:
                if rest and sum(len(part[0]) for part in rest) > 1:
                    yield term()
                now, rest = (langs[i], terms[i]), []
            rest.append((sources[i:j], p[i:j], z[i:j]))
            i = j
    if rest and sum(len(part[0]) for part in rest) > 1:
        yield term()


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * kept))``, exact; null where no term is kept."""
    whole = lambda c: c.cast("decimal(19,0)")
    over = F.lit(SCALE).cast("decimal(10,0)") * whole(count + PRIOR)
    under = whole(total + PRIOR * kept)
    return F.when(kept > 0, F.lit(1) + F.call_function("div", over, under))


def counted_terms(docs: DataFrame) -> DataFrame:
    """Occurrences and documents of each (lang, source, term), counted in tasks; a group's term may have several rows."""
    return docs.select("lang", "source", "text").mapInArrow(_count, _COUNTED)


def kept_postings(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, source, n) of the kept terms, with the language's own count and a mark on one row of each term.

    One shuffle by language and term; it holds at most one row of a term a task
    and source.
    """
    rows = counted_terms(docs).repartition(shuffle_partitions(docs.sparkSession), "lang", "term")
    summed = rows.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    marked = summed.withColumns({"lang_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "first": (F.row_number().over(w.orderBy("source")) == 1).cast("int")})
    return marked.where(F.col("lang_docs") >= min_docs).select("lang", "term", "source", "n", "lang_n", "first")


def divergence(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Rows of (lang, source, part, item, value, rank).

    Part ``pair``: every other source of the language by descending difference.
    Part ``term``: the terms that the group uses more than its language does, to
    rank ``top``.  Equal values rank by item.
    """
    with Scratch(spark, "source_divergence") as scratch:
        n = shuffle_partitions(spark)
        postings = scratch.table(kept_postings(docs, min_docs), "postings")
        names = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
        own = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("support"))
        langs = postings.groupBy("lang").agg(F.sum("first").alias("kept"), F.sum(F.col("lang_n") * F.col("first")).alias("lang_total"))
        groups = names.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "support", "kept", "lang_total"])
        groups = scratch.table(groups.withColumn("z", F.coalesce(share(F.lit(0), F.col("total"), F.col("kept")), F.lit(0))), "groups")
        priced = postings.join(groups.drop("support"), ["lang", "source"])
        priced = scratch.table(priced.withColumns({"p": share(F.col("n"), F.col("total"), F.col("kept")), "q": share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))}), "shares")

        # One-sided terms: each group's histogram meets the others' absent shares in one sorted run.
        shares = priced.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms"), F.first("p").alias("p"))
        other = groups.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"), F.col("support").alias("other_support"))
        pairs = groups.join(other, "lang").where("source <> other")
        none = F.lit(None).cast("string")
        asked = pairs.select("lang", "source", F.col("other_z").alias("p"), F.lit(0).cast("long").alias("terms"), "other")
        run = Window.partitionBy("lang", "source").orderBy("p")
        whole = Window.partitionBy("lang", "source")
        mass = F.col("terms") * F.col("p")
        summed = shares.select("lang", "source", "p", "terms", none.alias("other")).unionByName(asked)
        summed = summed.select("lang", "source", "other", "p", F.sum("terms").over(run).alias("below"), F.sum(mass).over(run).alias("below_mass"), F.sum("terms").over(whole).alias("all"), F.sum(mass).over(whole).alias("all_mass"))
        one_sided = summed.where("other is not null").select("lang", F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b"), (F.col("p") * (2 * F.col("below") - F.col("all")) + F.col("all_mass") - 2 * F.col("below_mass")).alias("value"))

        constants = pairs.where("source < other").select("lang", F.col("source").alias("a"), F.col("other").alias("b"), ((F.col("kept") - F.col("support") - F.col("other_support")) * F.abs(F.col("z") - F.col("other_z"))).alias("value"))
        sorted_postings = priced.select("lang", "term", "source", "p", "z").repartition(n, "lang", "term").sortWithinPartitions("lang", "term", "source")
        mends = sorted_postings.mapInArrow(_mend, _MENDS).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
        values = one_sided.unionByName(constants).unionByName(mends).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = values.withColumn("side", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        by_pair = both.select("lang", F.col("side.source").alias("source"), F.lit("pair").alias("part"), F.col("side.item").alias("item"), "value").withColumn("rank", F.row_number().over(order))
        more = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        by_term = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return scratch.keep(by_pair.unionByName(by_term))
