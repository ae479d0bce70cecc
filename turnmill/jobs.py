"""Whole runs from files to files, built from the operators.

Each run returns its result tables as they were written. Costly or random steps are written
once and read back, so that nothing after them calls a model again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators import (
    chat,
    dialogue,
    diarization,
    generation,
    judging,
    relevance,
    scenarios,
    scoring,
    summaries,
    videos,
)
from turnmill.operators.histories import Fold
from turnmill.operators.models import ModelSpec, select_models, skip_unconfigured
from turnmill.operators.transcription import parsed_transcriptions, transcribe_videos
from turnmill.sources import readers, writers
from turnmill.streaming import ingest


def _kept(df: DataFrame, path: str) -> DataFrame:
    """The table after it was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _tasks(spark: SparkSession, tasks: int | None) -> int:
    return tasks or spark.sparkContext.defaultParallelism


def merge_channels(spark: SparkSession, folder: str, out: str) -> DataFrame:
    """Channel files to one table of videos with global ids."""
    return _kept(videos.merge_channel_videos(readers.read_channel_videos(spark, folder)), out)


def filter_videos(
    annotated: DataFrame, out: str | None, escalation_cap: int | None = None
) -> dict[str, DataFrame]:
    """Accepted and rejected videos with a report. Without ``out`` nothing is written."""
    verdicts = relevance.filter_verdicts(annotated, escalation_cap=escalation_cap)
    if out:
        verdicts = _kept(verdicts, f"{out}/verdicts")
    tables = {
        "accepted": relevance.accepted(verdicts),
        "rejected": relevance.rejected(verdicts),
        "summary": relevance.filter_summary(verdicts),
        "reasons": relevance.top_rejection_reasons(verdicts),
    }
    if out:
        writers.write_table(tables["accepted"], f"{out}/accepted")
        writers.write_table(tables["rejected"], f"{out}/rejected")
        lines = relevance.summary_lines(tables["summary"], tables["reasons"])
        writers.write_summary(lines, f"{out}/summary")
    return tables


@dataclass(frozen=True)
class Plan:
    """A run before it runs: what it reads, what it would handle, and where it would write.

    report() only reads: no hook is called, nothing is written. run() does it.
    """

    inputs: DataFrame
    handled: DataFrame
    outputs: dict[str, str]
    steps: DataFrame
    run: Callable[[], object]

    def report(self) -> dict:
        """Counts per step, and the outputs."""
        return {"steps": {r.step: r.n for r in self.steps.collect()}, "outputs": self.outputs}


def _steps(**counted: DataFrame) -> DataFrame:
    """step, n: how many rows each of the tables has, in one table."""
    parts = [df.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n")) for name, df in counted.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def plan_diarization(
    manifest: DataFrame,
    manifest_stream: DataFrame,
    out: str,
    factory: Callable,
    limit: float = diarization.MAX_MINUTES,
    tasks: int | None = None,
) -> Plan:
    """diarize_arrivals over a manifest, which is given as a table too, so that it can be looked through.

    Its steps: ids of the manifest, those that are done, failed before, too long, and to transcribe.
    """
    status = ingest.final_status(manifest.sparkSession, out)
    ids = manifest.select("id", "url", "minutes").dropDuplicates(["id"])
    guarded = diarization.duration_guard(diarization.pending_videos(ids, status), limit)
    handled = guarded.filter("not too_long").drop("too_long")
    failed = handled.join(status.filter(F.col("status") == diarization.FAILED).select("id"), "id", "left_semi")
    done = ids.join(status.filter(F.col("status") != diarization.FAILED).select("id"), "id", "left_semi")
    return Plan(
        ids, handled, {name: f"{out}/{name}" for name in ("results", "status", "checkpoint")},
        _steps(manifest=ids, done=done, failed_before=failed, too_long=guarded.filter("too_long"), to_transcribe=handled),
        lambda: diarize_arrivals(manifest_stream, out, factory, limit, tasks, retry=manifest),
    )


def plan_training(
    records: DataFrame, out: str, family: str, key: str = "record_id", compat: bool = False
) -> Plan:
    """training_data before it runs. Its steps: records, valid ones, and rows for training and evaluation."""
    setup = chat.TRAINING_SETUPS[family]
    texts = chat.training_text(records, setup, compat).select(key, "text")
    split = chat.train_eval_split(texts, key, setup.eval_fraction)
    sides = {side: split.filter(F.col("split") == side) for side in ("train", "eval")}
    return Plan(
        records, split, {side: f"{out}/split={side}" for side in sides},
        _steps(records=records, texts=texts, **sides),
        lambda: training_data(records, out, family, key, compat),
    )


def diarize_arrivals(
    manifest_stream: DataFrame,
    out: str,
    factory: Callable,
    limit: float = diarization.MAX_MINUTES,
    tasks: int | None = None,
    retry: DataFrame | None = None,
) -> DataFrame:
    """Transcribe the videos of a manifest stream that are new, and return all turns so far.

    ``retry``, the manifest as a table, gives videos whose last try failed one more.
    """
    spark = manifest_stream.sparkSession

    def process(pending: DataFrame) -> DataFrame:
        responses = transcribe_videos(pending, factory, tasks=_tasks(spark, tasks))
        return parsed_transcriptions(responses)

    ingest.ingest_incremental(manifest_stream, out, process, limit)
    if retry is not None:
        ingest.retry_failed(spark, retry, out, process, limit)
    results = process(spark.createDataFrame([], "id string, url string, minutes double")).schema
    done = ingest.read_written(spark, f"{out}/results", results).filter("error is null")
    return diarization.export_turns(done.withColumnRenamed("id", "video_id"))


def training_data(
    records: DataFrame, out: str, family: str, key: str = "record_id", compat: bool = False
) -> dict[str, DataFrame]:
    """Chat records to the training texts of a model family, written by side: train and eval."""
    setup = chat.TRAINING_SETUPS[family]
    texts = chat.training_text(records, setup, compat).select(key, "text")
    split = chat.train_eval_split(texts, key, setup.eval_fraction)
    split.write.mode("overwrite").partitionBy("split").parquet(out)
    written = records.sparkSession.read.schema(split.schema).parquet(out)
    return {side: written.filter(F.col("split") == side).drop("split") for side in ("train", "eval")}


def generate(
    spark: SparkSession,
    scenario_path: str,
    out: str,
    specs: list[ModelSpec],
    factory: generation.Factory,
    models: list[str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Scenario files to generated conversations, failures beside them."""
    runnable = skip_unconfigured(select_models(specs, models))
    cases = scenarios.normalize_cases(readers.read_scenarios(spark, scenario_path))
    played = generation.generate_conversations(
        cases, runnable, factory, tasks=_tasks(spark, tasks)
    )
    return _kept(played, out)


def evaluate_replies(
    turns: DataFrame,
    out: str,
    specs: list[ModelSpec],
    factory: generation.Factory,
    models: list[str] | None = None,
    encoder: Callable[[], scoring.TokenEncoder] | None = None,
    tasks: int | None = None,
    folds: dict[str, Fold] | None = None,
) -> dict[str, DataFrame]:
    """Replies at every evaluation point, their scores, and summaries per model and file.

    Without an encoder embedding_f1 is NULL. With ``folds`` the factory's generators answer from
    them (FoldedGenerator), else from whole histories.
    """
    spark = turns.sparkSession
    runnable = skip_unconfigured(select_models(specs, models))
    spread = _tasks(spark, tasks)
    replies = _kept(
        generation.predict_folded(turns, runnable, folds, factory, tasks=spread)
        if folds
        else generation.predict_replies(turns, runnable, factory, tasks=spread),
        f"{out}/replies",
    )
    points = dialogue.turn_pairs(turns).drop("officer_input")
    scores = scoring.score_predictions(replies.join(points, ["source_file", "turn_index"]), encoder)
    if not encoder:
        scores = scores.withColumn("embedding_f1", F.lit(None).cast("double"))
    scored = _kept(scores, f"{out}/scored")
    return {
        "scored": scored,
        "models": _kept(summaries.metric_model_summary(scored), f"{out}/model_summary"),
        "files": _kept(summaries.metric_file_summary(scored), f"{out}/file_summary"),
    }


def judge(
    cases: DataFrame,
    out: str,
    factory: Callable[[], judging.Judge],
    models: list[str],
    tries: int = 3,
    wait_seconds: float = 2.0,
    tasks: int | None = None,
) -> dict[str, DataFrame]:
    """Judge cases with model outputs: answers, flat scores, and a summary per model."""
    pairs = judging.case_model_pairs(cases, models)
    spread_over = _tasks(cases.sparkSession, tasks)
    answers = _kept(
        judging.run_judge(pairs, factory, tries, wait_seconds, spread_over), f"{out}/answers"
    )
    scores = _kept(judging.flatten_judge(answers), f"{out}/scores")
    return {
        "scores": scores,
        "models": _kept(summaries.judge_model_summary(scores), f"{out}/model_summary"),
        "skipped": judging.skipped_pairs(cases, models),
    }
