"""The corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import decontaminate, langid, packing, relative_lz, simhash
from turnmill.llm.common import cut, table

#: A text whose best language scores less is in none that was learned; a text of LONG bytes or more has
#: enough n-grams for the second bound. Labelled rows scored 0.139 at least, those of LONG bytes 0.305
#: (sf0.1, check_s, check_h); words and texts in Russian, Greek, Arabic, Chinese and Japanese 0.105 at
#: most, long Turkish, Finnish and keyboard noise 0.24. Polish, Italian, Dutch and C code (0.23 to 0.37)
#: overlap with labelled rows, so most of them stay.
MIN_LANGUAGE_SCORE, MIN_LONG_SCORE, LONG = 0.12, 0.25, 256


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that was learned; lang and columns named as the prediction's stay as given."""
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    mark = "_".join(docs.columns)  # no column has this name, or one that ends in it
    aside = {c: f"{c}_{mark}" for c in docs.columns if c in ("lang_pred", "score")}
    found = langid.predict(docs.withColumnsRenamed(aside), model)
    least = F.when(F.octet_length("text") < LONG, MIN_LANGUAGE_SCORE).otherwise(MIN_LONG_SCORE)
    kept = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= least))
    return kept.select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; a text that lost words is its other words joined by blanks, and n_chars follows."""
    return relative_lz.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids (little-endian, 32 bits)."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]

#: SQL has no kernels, fingerprints or tokenizers; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
