"""Relevance filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.text import flag_set, safe_int
from turnmill.operators import relevance as R
from turnmill.plans import adapters as A
from turnmill.plans.registry import query, table

ANNOTATED = """annotated AS (
  SELECT d.doc_id AS id,
    CASE WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 0 END AS no_police_presence,
    CASE WHEN n_chars < 200 THEN 1 ELSE 0 END AS no_conversation_detected,
    toxic AS advertisement_content_detected,
    CASE WHEN lang = 'de' AND d.doc_id % 5 = 0 THEN 1 ELSE 0 END AS training_range_context,
    CASE WHEN d.doc_id % 17 = 0 THEN 1 ELSE 0 END AS non_relevant_crime_only_context,
    CAST(d.doc_id % 7 AS INT) AS police_presence_signals_score,
    CAST((d.doc_id // 7) % 7 AS INT) AS interaction_type_signals_score,
    CAST((d.doc_id // 49) % 4 AS INT) AS deescalation_indicators_score,
    CAST(n_chars % 7 AS INT) AS escalation_indicators_score
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _verdicts(cap: str = "NULL") -> str:
    return f"""{ANNOTATED},
judged AS (
  SELECT *,
    concat_ws(', ',
      CASE WHEN no_police_presence = 1 THEN 'no_police_presence' END,
      CASE WHEN no_conversation_detected = 1 THEN 'no_conversation_detected' END,
      CASE WHEN advertisement_content_detected = 1 THEN 'advertisement_content_detected' END,
      CASE WHEN training_range_context = 1 THEN 'training_range_context' END,
      CASE WHEN non_relevant_crime_only_context = 1 THEN 'non_relevant_crime_only_context' END
    ) AS ctx,
    concat_ws('; ',
      CASE WHEN police_presence_signals_score < 2
        THEN concat('police_presence_signals_score=', police_presence_signals_score, ' (min 2)') END,
      CASE WHEN interaction_type_signals_score < 2
        THEN concat('interaction_type_signals_score=', interaction_type_signals_score, ' (min 2)') END,
      CASE WHEN deescalation_indicators_score < 1
        THEN concat('deescalation_indicators_score=', deescalation_indicators_score, ' (min 1)') END,
      CASE WHEN escalation_indicators_score > {cap}
        THEN concat('escalation_indicators_score=', escalation_indicators_score, ' (max {cap})') END
    ) AS low
  FROM annotated),
verdicts AS (
  SELECT * EXCLUDE (ctx, low),
    CASE WHEN ctx <> '' THEN 1 WHEN low <> '' THEN 2 END AS stage,
    CASE WHEN ctx <> '' THEN concat('[Stage 1 – context filter] flags triggered: ', ctx)
         WHEN low <> '' THEN concat('[Stage 2 – score filter] below threshold: ', low)
         ELSE '' END AS rejection_reason
  FROM judged)"""


def verdicts(spark, sf, **options):
    return R.filter_verdicts(A.annotated(spark, sf), **options)


def _short(df):
    return df.select("id", F.col("stage").cast("int").alias("stage"), "rejection_reason")


@query("filter_verdicts", f"WITH {_verdicts()} SELECT id, stage, rejection_reason FROM verdicts")
def filter_verdicts(spark, sf):
    return _short(verdicts(spark, sf))


@query(
    "context_filter",
    f"""WITH {_verdicts()} SELECT id, rejection_reason FROM verdicts WHERE stage = 1""",
)
def context_filter(spark, sf):
    return verdicts(spark, sf).filter("stage = 1").select("id", "rejection_reason")


@query(
    "score_filter",
    f"""WITH {_verdicts()} SELECT id, rejection_reason FROM verdicts WHERE stage = 2""",
)
def score_filter(spark, sf):
    return verdicts(spark, sf).filter("stage = 2").select("id", "rejection_reason")


@query("escalation_cap", f"WITH {_verdicts('4')} SELECT id, stage, rejection_reason FROM verdicts")
def escalation_cap(spark, sf):
    return _short(verdicts(spark, sf, escalation_cap=4))


@query(
    "filter_accepted",
    f"""WITH {_verdicts()}
SELECT * EXCLUDE (stage, rejection_reason) FROM verdicts WHERE stage IS NULL""",
)
def filter_accepted(spark, sf):
    return R.accepted(verdicts(spark, sf))


@query(
    "filter_rejected",
    f"WITH {_verdicts()} SELECT * FROM verdicts WHERE stage IS NOT NULL",
)
def filter_rejected(spark, sf):
    return R.rejected(verdicts(spark, sf)).withColumn("stage", F.col("stage").cast("int")).drop(
        "failures"
    )


SUMMARY = """summary AS (
  SELECT count(*) AS total, count(*) FILTER (stage IS NULL) AS accepted,
    count(*) FILTER (stage IS NOT NULL) AS rejected,
    count(*) FILTER (stage = 1) AS stage_1_rejected,
    count(*) FILTER (stage = 2) AS stage_2_rejected,
    round(count(*) FILTER (stage IS NULL) * 100.0::DOUBLE / count(*), 1) AS accepted_pct,
    round(count(*) FILTER (stage IS NOT NULL) * 100.0::DOUBLE / count(*), 1) AS rejected_pct
  FROM verdicts)"""
TOP = """top AS (
  SELECT rejection_reason, count(*) AS n FROM verdicts WHERE stage IS NOT NULL
  GROUP BY rejection_reason ORDER BY n DESC, rejection_reason LIMIT 10)"""


@query("filter_summary", f"WITH {_verdicts()}, {SUMMARY} SELECT * FROM summary")
def filter_summary(spark, sf):
    return R.filter_summary(verdicts(spark, sf))


@query("top_rejection_reasons", f"WITH {_verdicts()}, {TOP} SELECT * FROM top")
def top_rejection_reasons(spark, sf):
    return R.top_rejection_reasons(verdicts(spark, sf))


@query(
    "filter_summary_report",
    f"""WITH {_verdicts()}, {SUMMARY}, {TOP}
SELECT 0 AS line_no, concat('Total rows processed: ', total) AS line FROM summary
UNION ALL SELECT 1, concat('Accepted: ', accepted, ' (', accepted_pct, '%)') FROM summary
UNION ALL SELECT 2, concat('Rejected: ', rejected, ' (', rejected_pct, '%)') FROM summary
UNION ALL SELECT 3, concat('Stage 1 (context flags): ', stage_1_rejected) FROM summary
UNION ALL SELECT 4, concat('Stage 2 (score thresholds): ', stage_2_rejected) FROM summary
UNION ALL SELECT CAST(4 + row_number() OVER (ORDER BY n DESC, rejection_reason) AS INT),
  concat('(', n, 'x) ', rejection_reason) FROM top""",
)
def filter_summary_report(spark, sf):
    v = verdicts(spark, sf)
    return R.summary_lines(R.filter_summary(v), R.top_rejection_reasons(v))


@query(
    "taxonomy_rule",
    f"""WITH {ANNOTATED} SELECT id FROM annotated
WHERE police_presence_signals_score >= 2
  AND (escalation_indicators_score >= 3 OR deescalation_indicators_score >= 3)""",
)
def taxonomy_rule(spark, sf):
    return A.annotated(spark, sf).filter(R.taxonomy_rule()).select("id")


_BITS = {
    "police": range(0, 6),
    "interaction": range(6, 12),
    "deescalation": range(12, 18),
}


def _bit_sum(bits) -> str:
    return " + ".join(f"(((doc_id * 31 + n_chars) >> {b}) & 1)" for b in bits)


@query(
    "group_scores",
    "SELECT doc_id AS id, "
    + ", ".join(
        f"CAST({_bit_sum(b)} AS INT) AS {g}_score, concat({_bit_sum(b)}, '/6') AS {g}_of"
        for g, b in _BITS.items()
    )
    + " FROM documents",
)
def group_scores(spark, sf):
    groups = {g: [f"{g}_{n}" for n in range(1, 7)] for g in _BITS}
    scored = R.group_scores(A.signals(spark, sf), groups)
    return scored.select("id", *[f"{g}_{s}" for g in groups for s in ("score", "of")])


@query(
    "join_features",
    """SELECT d.doc_id AS id, d.source, d.n_chars, d.text AS transcript, l.quality, l.toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
)
def join_features(spark, sf):
    videos = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "source", "n_chars", F.col("text").alias("transcript")
    )
    features = table(spark, sf, "labels").withColumnRenamed("doc_id", "id")
    return R.join_features(videos, features)


CELLS = ["1", "1.0", "0", "x", " 1 ", "2", None, "true", "-1"]


@query(
    "flag_and_score_cells",
    """SELECT doc_id AS id, doc_id % 9 IN (0, 4) AS flag,
  CASE doc_id % 9 WHEN 0 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 WHEN 8 THEN -1 ELSE 0 END AS score
FROM documents""",
)
def flag_and_score_cells(spark, sf):
    n = (F.col("doc_id") % len(CELLS) + 1).cast("int")
    cell = F.element_at(F.array(*[F.lit(c) for c in CELLS]), n)
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        flag_set(cell).alias("flag"),
        safe_int(cell).alias("score"),
    )
