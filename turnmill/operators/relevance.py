"""Two-stage relevance filter over annotated videos, with a reason for every rejected row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import flag_set, percent, safe_int

# Columns that reject a row when set, in the order in which they are reported.
CONTEXT_FLAGS = [
    "no_police_presence",
    "no_conversation_detected",
    "advertisement_content_detected",
    "training_range_context",
    "non_relevant_crime_only_context",
]

# Lowest accepted score per column.
SCORE_MINIMUMS = {
    "police_presence_signals_score": 2,
    "interaction_type_signals_score": 2,
    "deescalation_indicators_score": 1,
}

# Texts of the reasons.
ESCALATION_COLUMN = "escalation_indicators_score"
STAGE_1_REASON = "[Stage 1 – context filter] flags triggered: "
STAGE_2_REASON = "[Stage 2 – score filter] below threshold: "


def context_failures(columns: list[str], flags: list[str] | None = None) -> Column:
    """Names of the flags that are set; flags the data lacks are skipped."""
    found = [f for f in (flags or CONTEXT_FLAGS) if f in columns]
    if not found:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(flag_set(f), F.lit(f)) for f in found]))


def score_failures(
    columns: list[str], minimums: dict[str, int] | None = None, escalation_cap: int | None = None
) -> Column:
    """One text per score below its minimum, and per escalation score above the cap."""
    checks = [
        F.when(
            safe_int(c) < low, F.concat(F.lit(f"{c}="), safe_int(c), F.lit(f" (min {low})"))
        )
        for c, low in (minimums or SCORE_MINIMUMS).items()
        if c in columns
    ]
    if escalation_cap is not None and ESCALATION_COLUMN in columns:
        score = safe_int(ESCALATION_COLUMN)
        checks.append(
            F.when(
                score > escalation_cap,
                F.concat(F.lit(f"{ESCALATION_COLUMN}="), score, F.lit(f" (max {escalation_cap})")),
            )
        )
    if not checks:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*checks))


def filter_verdicts(
    df: DataFrame,
    flags: list[str] | None = None,
    minimums: dict[str, int] | None = None,
    escalation_cap: int | None = None,
) -> DataFrame:
    """Add stage (1, 2 or NULL when accepted), failures and rejection_reason ('' when accepted).

    A row that fails stage 1 is not looked at again, so it has the reasons of one stage only.
    """
    staged = df.withColumn("_context", context_failures(df.columns, flags)).withColumn(
        "_score",
        F.when(
            F.size("_context") == 0, score_failures(df.columns, minimums, escalation_cap)
        ).otherwise(F.array().cast("array<string>")),
    )
    stage = F.when(F.size("_context") > 0, 1).when(F.size("_score") > 0, 2)
    return (
        staged.withColumn("stage", stage.cast("tinyint"))
        .withColumn("failures", F.concat("_context", "_score"))
        .withColumn(
            "rejection_reason",
            F.when(
                F.col("stage") == 1,
                F.concat(F.lit(STAGE_1_REASON), F.array_join("failures", ", ")),
            )
            .when(
                F.col("stage") == 2,
                F.concat(F.lit(STAGE_2_REASON), F.array_join("failures", "; ")),
            )
            .otherwise(F.lit("")),
        )
        .drop("_context", "_score")
    )


def accepted(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("stage is null").drop("stage", "failures", "rejection_reason")


def rejected(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter("stage is not null")


def taxonomy_rule(police: int = 2, escalation: int = 3, deescalation: int = 3) -> Column:
    """The published rule: enough police signals, and escalation or de-escalation signals."""
    return (safe_int("police_presence_signals_score") >= police) & (
        (safe_int(ESCALATION_COLUMN) >= escalation)
        | (safe_int("deescalation_indicators_score") >= deescalation)
    )


def group_scores(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """Score per group of binary signals: how many are set, and the same as 'n/total'."""
    out = {}
    for name, signals in groups.items():
        score = sum((flag_set(s).cast("int") for s in signals), F.lit(0))
        out[f"{name}_score"] = score
        out[f"{name}_of"] = F.concat(score.cast("string"), F.lit(f"/{len(signals)}"))
    return df.withColumns(out)


def join_features(videos: DataFrame, features: DataFrame, key: str = "id") -> DataFrame:
    """Transcripts with their annotated features."""
    return videos.join(features, key, "inner")


def filter_summary(verdicts: DataFrame) -> DataFrame:
    """One row: totals, shares in percent, and rejections per stage."""
    counts = verdicts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.expr("stage is null")).alias("accepted"),
        F.count_if(F.expr("stage is not null")).alias("rejected"),
        F.count_if(F.expr("stage = 1")).alias("stage_1_rejected"),
        F.count_if(F.expr("stage = 2")).alias("stage_2_rejected"),
    )
    return counts.withColumns(
        {
            "accepted_pct": percent(F.col("accepted"), F.col("total")),
            "rejected_pct": percent(F.col("rejected"), F.col("total")),
        }
    )


def top_rejection_reasons(verdicts: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent reasons; equal counts are ordered by the text."""
    return (
        rejected(verdicts)
        .groupBy("rejection_reason")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "rejection_reason")
        .limit(n)
    )


def summary_lines(summary: DataFrame, reasons: DataFrame) -> DataFrame:
    """The report as ordered text lines (line_no, line)."""
    head = summary.select(
        F.posexplode(
            F.array(
                F.concat(F.lit("Total rows processed: "), "total"),
                F.concat(F.lit("Accepted: "), "accepted", F.lit(" ("), "accepted_pct", F.lit("%)")),
                F.concat(F.lit("Rejected: "), "rejected", F.lit(" ("), "rejected_pct", F.lit("%)")),
                F.concat(F.lit("Stage 1 (context flags): "), "stage_1_rejected"),
                F.concat(F.lit("Stage 2 (score thresholds): "), "stage_2_rejected"),
            )
        ).alias("line_no", "line")
    )
    top = reasons.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "rejection_reason"))).alias("r")
    ).select(F.posexplode("r").alias("p", "r"))
    return head.unionByName(
        top.select(
            (F.col("p") + 5).alias("line_no"),
            F.concat(F.lit("("), -F.col("r.o"), F.lit("x) "), "r.rejection_reason").alias("line"),
        )
    ).orderBy("line_no")
