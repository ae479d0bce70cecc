"""Judging of model conversations: pairs, prompts, verdict parsing and rubric checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions.json import OBJECT, variant_kind
from turnmill.functions.text import col, strip_ws
from turnmill.operators.generation import spread
from turnmill.operators.hooks import BATCH_SIZE, ask_all

REALISM_PROMPT = (
    "Rate how real the civilian in the target sounds, from 0 to 100, against the reference.\n"
    "Scenario Context: {scenario_context}\nCharacter Profile: {profile}\n"
    "Reference: {ground_truth}\nTarget: {target_conversation}\n"
    'Answer with JSON only: {"analysis": {}, "look_Real": 0, "Score": 0}'
)
DEESCALATION_PROMPT = (
    "Rate the outcome of the officer's work in this transcript, from 0 to 100.\n"
    "Transcript: {conversation_transcript}\n"
    'Answer with JSON only: {"reasoning": "", "outcome_category": "", "base_score": 0, '
    '"penalty_applied": "", "penalty_reasoning": "", "final_score": 0}'
)

# Rubric tiers, outcome bands (upper bounds) and penalties.
REALISM_HIGH, REALISM_LOW = 85, 50
OUTCOME_BANDS = [(25, "Escalation"), (50, "Containment"), (75, "De-escalation"), (100, "Resolution")]
PENALTIES = {"None": 0, "Repetitive Looping": 15, "Unrealistic Dialogue": 20, "Both": 35}

# The fences that an answer may stand in, and texts of error rows.
FENCES = (r"^```json\s*", r"^```\s*", r"\s*```\z")
EMPTY_ANSWER = "Empty judge response."
NO_OBJECT = "Could not find JSON object in response."
JUDGE_FAILED = "Judge failed after {tries} attempts: {cause}"


def case_model_pairs(cases: DataFrame, models: list[str]) -> DataFrame:
    """One row per case and selected model that has an output."""
    base = [c for c in cases.columns if c != "model_outputs"]
    return (
        cases.select(*base, F.explode("model_outputs").alias("model_name", "_o"))
        .filter(F.col("model_name").isin(models))
        .select(*base, "model_name", "_o.*")
    )


def skipped_pairs(cases: DataFrame, models: list[str]) -> DataFrame:
    """Selected models for which a case has no output."""
    wanted = F.array(*[F.lit(m) for m in models])
    present = F.coalesce(F.map_keys("model_outputs"), F.array().cast("array<string>"))
    return cases.select("case_id", F.explode(F.array_except(wanted, present)).alias("model_name"))


def render_prompt(template: str, values: dict[str, Column | str]) -> Column:
    """Put the values in one after the other, so a later {key} inside a value is filled too."""
    text = F.lit(template)
    for key, value in values.items():
        text = F.replace(text, F.lit("{" + key + "}"), F.coalesce(col(value), F.lit("")))
    return text


def with_prompts(pairs: DataFrame) -> DataFrame:
    """Add realism_prompt and deescalation_prompt."""
    names = ["scenario_context", "profile", "ground_truth", "target_conversation"]
    return pairs.withColumns(
        {
            "realism_prompt": render_prompt(REALISM_PROMPT, {n: n for n in names}),
            "deescalation_prompt": render_prompt(
                DEESCALATION_PROMPT, {"conversation_transcript": "conversation_transcript"}
            ),
        }
    )


def unfenced(raw: Column | str) -> Column:
    """Raw answer without surrounding code fences."""
    text = strip_ws(raw)
    for fence in FENCES:
        text = F.regexp_replace(text, F.lit(fence), F.lit(""))
    return text


def parse_judge_json(raw: Column | str) -> Column:
    """The answer as VARIANT: the whole text, else its part from the first { to the last }.

    NULL when neither is JSON.
    """
    text = unfenced(raw)
    return F.coalesce(
        F.try_parse_json(text),
        F.try_parse_json(F.regexp_extract(text, r"(?s)\{.*\}", 0)),
    )


def verdict_error(raw: Column, parsed: Column) -> Column:
    """Why an answer cannot be used; NULL when it is a JSON object."""
    return (
        F.when(raw.isNull(), EMPTY_ANSWER)
        .when(variant_kind(parsed) == OBJECT, None)
        .when(F.instr(unfenced(raw), "{") == 0, NO_OBJECT)
        .otherwise("Broken JSON in response.")
    )


def flatten_judge(
    answers: DataFrame, realism: str = "realism_raw", deescalation: str = "deescalation_raw"
) -> DataFrame:
    """Two raw answers per (case_id, model_name) to flat scores, verdict objects and error.

    When one of the answers cannot be used, the row has only its error.
    """
    parsed = answers.withColumns(
        {"_r": parse_judge_json(realism), "_d": parse_judge_json(deescalation)}
    )
    failed = F.coalesce(
        verdict_error(F.col(realism), F.col("_r")), verdict_error(F.col(deescalation), F.col("_d"))
    )
    if "error" in answers.columns:
        failed = F.coalesce(F.col("error"), failed)
    get = lambda v, name, kind: F.when(
        F.col("_failed").isNull(), F.try_variant_get(F.col(v), f"$.{name}", kind)
    )
    whole = lambda v: F.when(F.col("_failed").isNull(), F.to_json(v))
    return parsed.withColumn("_failed", failed).select(
        "case_id",
        "model_name",
        get("_r", "Score", "double").alias("realism_score"),
        get("_r", "look_Real", "double").alias("look_real"),
        get("_d", "final_score", "double").alias("deescalation_final_score"),
        get("_d", "base_score", "double").alias("deescalation_base_score"),
        get("_d", "outcome_category", "string").alias("deescalation_outcome_category"),
        get("_d", "penalty_applied", "string").alias("deescalation_penalty_applied"),
        whole("_r").alias("realism_result"),
        whole("_d").alias("deescalation_result"),
        F.col("_failed").alias("error"),
    )


def realism_tier(score: Column | str) -> Column:
    s = col(score)
    return (
        F.when(s >= REALISM_HIGH, "High Realism")
        .when(s > REALISM_LOW, "Marginal")
        .when(s.isNotNull(), "Artificial")
    )


def realism_check(flat: DataFrame) -> DataFrame:
    """Add the tier, and whether look_real agrees with the score."""
    expected = F.when(F.col("realism_score") >= REALISM_HIGH, 1.0).otherwise(0.0)
    return flat.withColumns(
        {
            "realism_tier": realism_tier("realism_score"),
            "look_real_ok": F.when(
                F.col("realism_score").isNotNull(), F.col("look_real").eqNullSafe(expected)
            ),
        }
    )


def outcome_check(flat: DataFrame) -> DataFrame:
    """Add the outcome and final score that the rubric gives, and whether the judge kept to it."""
    base = F.col("deescalation_base_score")
    band = F.lit(None).cast("string")
    for upper, name in reversed(OUTCOME_BANDS):
        band = F.when(base <= upper, name).otherwise(band)
    penalty = F.lit(None).cast("int")
    for name, points in PENALTIES.items():
        penalty = F.when(F.col("deescalation_penalty_applied") == name, points).otherwise(penalty)
    return flat.withColumns(
        {
            "expected_outcome": F.when(base.isNotNull(), band),
            "expected_final_score": F.greatest(base - penalty, F.lit(0.0)) + penalty * 0,
        }
    ).withColumns(
        {
            "outcome_ok": F.col("deescalation_outcome_category") == F.col("expected_outcome"),
            "final_score_ok": F.col("deescalation_final_score") == F.col("expected_final_score"),
        }
    )


class Judge(Protocol):
    """Answers a prompt with raw text. Raises when it cannot.

    A judge may also have ``judge_batch(prompts)``, which returns an answer, or an exception, for
    each of a list of prompts.
    """

    def judge(self, prompt: str) -> str: ...


def run_judge(
    pairs: DataFrame,
    factory: Callable[[], Judge],
    tries: int = 3,
    wait_seconds: float = 2.0,
    tasks: int | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Ask a judge for both prompts of each pair: realism_raw, deescalation_raw, error.

    One judge per task, asked for the prompts of ``batch_size`` pairs at a time; only prompts
    that failed are asked again, and a pair with a failed prompt has its error alone; ``tasks`` spreads pairs that come from few files. Write
    the answers before parsing them, so that a lost task does not ask again for used answers.
    """
    prompted = with_prompts(pairs).select(
        F.col("case_id").cast("string"), "model_name", "realism_prompt", "deescalation_prompt"
    )
    out = T.StructType.fromDDL(
        "case_id string, model_name string, realism_raw string, deescalation_raw string, error string"
    )

    names = pa.schema([(n, pa.string()) for n in out.fieldNames()])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = factory()
        for batch in batches:
            # The prompts of one call at a time become Python texts.
            for at in range(0, batch.num_rows, batch_size):
                some, rows = [tuple(r.values()) for r in batch.slice(at, batch_size).to_pylist()], []
                found = ask_all(
                    [p for _, _, *prompts in some for p in prompts],
                    judge.judge,
                    getattr(judge, "judge_batch", None),
                    tries, wait_seconds, wait_seconds,
                )
                for (case, model, *_), *raw in zip(some, found[::2], found[1::2]):
                    cause = next((r for r in raw if isinstance(r, Exception)), None)
                    failed = JUDGE_FAILED.format(tries=tries, cause=cause)
                    result = (*raw, None) if cause is None else (None, None, failed)
                    rows.append((case, model, *result))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=names)

    return spread(prompted, tasks, "model_name", "case_id").mapInArrow(ask, out)


def replay_judge(pairs: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded answers (case_id, model_name, realism_raw, deescalation_raw) for the pairs."""
    return pairs.select("case_id", "model_name").join(recorded, ["case_id", "model_name"], "left")
