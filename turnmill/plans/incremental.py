"""Incremental runs whose result must equal one run over everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.operators.relevance import filter_verdicts
from turnmill.plans import adapters as A
from turnmill.plans.diarization import MANIFEST
from turnmill.plans.registry import query, table
from turnmill.plans.relevance import _verdicts
from turnmill.session import new_dir
from turnmill.streaming import ingest


def _stream(spark, sf, name):
    """A driver table as a stream of its files."""
    schema = table(spark, sf, name).schema
    # A pattern, because a stream takes a plain path for a folder and the table may be one file.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def transcribe(pending):
    """Stand-in for the transcription call: ids that end in 7 fail."""
    failed = F.col("id").endswith("7")
    return pending.select(
        "id",
        F.when(~failed, F.concat(F.lit("text of "), "id")).alias("transcript"),
        F.when(failed, "Could not parse response.").alias("error"),
    )


@query(
    "ingest_incremental",
    f"""WITH {MANIFEST} SELECT id, CASE WHEN minutes > 45 THEN 'ignore'
  WHEN doc_id % 10 = 7 THEN 'failed' ELSE 'processed' END AS status FROM manifest""",
)
def ingest_incremental(spark, sf):
    """Two runs over the same manifest, of which the second finds nothing new, then one more try of
    the failed ids."""
    out = new_dir(spark, "ingest")
    docs = _stream(spark, sf, "documents")
    manifest = docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.lit("").alias("url"),
        (F.col("n_chars").cast("double") / 100).alias("minutes"),
    )
    for _ in range(2):
        ingest.ingest_incremental(manifest, out, transcribe)
    ingest.retry_failed(spark, A.manifest(spark, sf), out, transcribe)
    return ingest.final_status(spark, out)


@query(
    "running_filter_counts",
    f"""WITH {_verdicts()} SELECT CASE WHEN stage = 1 THEN 1 WHEN stage = 2 THEN 2 ELSE 0 END AS stage,
  count(*) AS n FROM verdicts GROUP BY ALL""",
)
def running_filter_counts(spark, sf):
    """Rejections per stage, kept up to date while videos arrive (0 = accepted)."""
    out = new_dir(spark, "running")
    docs = _stream(spark, sf, "documents")
    videos = A.annotate(docs, table(spark, sf, "labels"))
    staged = filter_verdicts(videos).select(F.coalesce("stage", F.lit(0)).cast("int").alias("stage"))
    ingest.running_counts(staged, "stage", out)
    return ingest.read_counts(spark, out, "stage int, n bigint")
