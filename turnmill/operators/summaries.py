"""Summaries per model, per file and per judge, and corpus totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

METRICS = ["rouge_l", "bleu_4", "meteor", "embedding_f1"]
MODEL_KEYS = ["model_name", "model_family", "model_type"]

# Names that differ between training and evaluation.
FAMILY_ALIASES = {"ministral": "mistral", "phi4": "phi"}


def family_name(column: str = "model_family"):
    """Family under its evaluation name."""
    c = F.col(column)
    for other, own in FAMILY_ALIASES.items():
        c = F.when(F.col(column) == other, own).otherwise(c)
    return c


def metric_model_summary(scored: DataFrame) -> DataFrame:
    """Mean and sample deviation of each metric per model, best first.

    A NULL family is a group of its own; a model with one row has a NULL deviation.
    """
    return (
        scored.groupBy(*MODEL_KEYS)
        .agg(
            F.count("turn_index").alias("n_turns"),
            *[F.avg(m).alias(f"avg_{m}") for m in METRICS],
            *[F.stddev_samp(m).alias(f"std_{m}") for m in METRICS],
        )
        .orderBy(
            F.desc_nulls_last("avg_embedding_f1"),
            F.desc_nulls_last("avg_meteor"),
            F.desc_nulls_last("avg_rouge_l"),
            "model_name",
        )
    )


def metric_file_summary(scored: DataFrame) -> DataFrame:
    """Mean of each metric per file and model, in key order."""
    keys = ["source_file", *MODEL_KEYS]
    return (
        scored.groupBy(*keys)
        .agg(
            F.count("turn_index").alias("n_turns"),
            *[F.avg(m).alias(f"avg_{m}") for m in METRICS],
        )
        .orderBy(*keys)
    )


def judge_model_summary(results: DataFrame) -> DataFrame:
    """Mean judge scores per model, best first; n_cases counts failed cases too."""
    return (
        results.groupBy("model_name")
        .agg(
            F.avg("realism_score").alias("avg_realism_score"),
            F.avg("look_real").alias("avg_look_real"),
            F.avg("deescalation_final_score").alias("avg_deescalation_score"),
            F.count("case_id").alias("n_cases"),
            F.count("error").alias("n_errors"),
        )
        .orderBy(
            F.desc_nulls_last("avg_realism_score"),
            F.desc_nulls_last("avg_deescalation_score"),
            "model_name",
        )
    )


def base_vs_finetuned(scored: DataFrame) -> DataFrame:
    """Per family and metric: base mean, fine-tuned mean and their difference."""
    wide = (
        scored.withColumn("model_family", family_name())
        .groupBy("model_family")
        .pivot("model_type", ["base", "fine_tuned"])
        .agg(*[F.avg(m).alias(m) for m in METRICS])
    )
    long = wide.select(
        "model_family",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(m).alias("metric"),
                        F.col(f"base_{m}").alias("base"),
                        F.col(f"fine_tuned_{m}").alias("fine_tuned"),
                    )
                    for m in METRICS
                ]
            )
        ).alias("_m"),
    ).select("model_family", "_m.*")
    return long.withColumn("delta", F.col("fine_tuned") - F.col("base"))


def metric_vs_judge(metrics: DataFrame, judged: DataFrame) -> DataFrame:
    """Automatic and judge means side by side; models known to one side only are kept."""
    return metrics.select("model_name", *[f"avg_{m}" for m in METRICS]).join(
        judged.select(
            "model_name", "avg_realism_score", "avg_look_real", "avg_deescalation_score"
        ),
        "model_name",
        "full",
    )


def corpus_stats(turns: DataFrame, tokens_per_word: float = 4.7 / 3.6) -> DataFrame:
    """One row: files, turns, words and an estimate of tokens."""
    text = F.btrim(F.coalesce("transcript", F.lit("")), F.lit(" \t\n\x0b\f\r"))
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))
    per_file = turns.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.sum(words).alias("w")
    )
    return per_file.agg(
        F.count("source_file").alias("n_files"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_turns"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("n_words"),
    ).withColumn("n_tokens", F.round(F.col("n_words") * tokens_per_word).cast("bigint"))
