"""A training corpus from raw documents, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written as Parquet and read again as the next one's documents.  Texts in no
learned language go, then texts of low quality, then all but one of each group
of equal texts and of each component of near copies (five-word shingles,
similarity 0.8); what stays is packed into sequences, with its token ids.

All stages but the last hand on every column they get, whatever its name; the
last returns pieces, with the ids of their documents.  An empty table gives an
empty result.  Null ids are ids like others, except where a stage
prefers a known one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import exact_dedup, hyperminhash, language_hdc, quality_gam
from tallyloom.llm.packing import pack
from tallyloom.llm.scratch import Scratch
from tallyloom.llm.tables import read
from tallyloom.session import ship_code


#: Words whose ids a worker remembers while packing: it outlives the stage, and other stages share the workers.
CACHED_WORDS = 150_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language.

    Null, empty and letterless texts go, and texts of 100 runs or more that are
    near no learned language; a missing ``lang`` becomes the predicted one.
    Repeated rows share their fate.
    """
    ship_code(spark)
    return language_hdc.keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose score reaches the threshold; a null text is scored as an empty one; repeated rows share their fate."""
    return quality_gam.keep_good(spark, docs, read(spark, sf_dir, "labels"))


def equal_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts equal but for white space: the longest, then the smallest id (null last).

    Null and blank texts are one group; of rows that tie in all, one stays.
    """
    ship_code(spark)
    return exact_dedup.keep_one(spark, docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that of the smallest id; null and blank texts all stay, being copies of nothing."""
    return hyperminhash.keep_one(spark, docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids and places; a null or empty text is a piece that holds only the end id; repeated rows are pieces of their own."""
    import public_tokenizers

    return pack(spark, docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, cached_words=CACHED_WORDS)


STAGES = [
    ("language ID", language),
    ("quality classifier", quality),
    ("exact dedup", equal_texts),
    ("MinHash near-dedup", near_copies),
    ("best-fit packing", sequences),
]

#: The classifiers and the packing plan can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    with Scratch(spark, "pipeline") as scratch:
        docs = read(spark, sf_dir, "documents")
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        return scratch.keep(STAGES[-1][1](spark, docs, sf_dir))
