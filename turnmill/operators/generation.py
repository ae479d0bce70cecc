"""Reply generation: a model hook that runs in Arrow batches over cases or histories."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.operators.dialogue import (
    DEFAULT_SYSTEM_PROMPT,
    SEGMENT_TURNS,
    SEGMENTS,
    build_transcript,
    history_segments,
)
from turnmill.operators.histories import Fold, LastBy, LastMessages, MessageCount, folded_histories
from turnmill.operators.hooks import BATCH_SIZE, ask_all, slices
from turnmill.operators.models import ModelSpec, case_model_grid
from turnmill.operators.ordering import CHUNK_ROWS
from turnmill.operators.scenarios import render_system_prompt
from turnmill.sources.schemas import GENERATED_TURNS


class ReplyGenerator(Protocol):
    """Answers a history of {role, content} messages. Raises when it cannot.

    A generator may also have ``generate_batch(histories, max_new_tokens, temperature, top_p)``,
    which returns a reply, or an exception, for each of a list of histories.
    """

    def generate(
        self, history: list[dict], max_new_tokens: int, temperature: float, top_p: float
    ) -> str: ...


#: Messages in the histories of one call, unless a single history is longer.
BATCH_MESSAGES = 100_000


@dataclass(frozen=True)
class Sampling:
    max_new_tokens: int = 128
    temperature: float = 0.6
    top_p: float = 0.9


class EchoGenerator:
    """Baseline: the number of messages so far and the last of them."""

    def generate(self, history, max_new_tokens, temperature, top_p) -> str:
        return f"{len(history)} {history[-1]['content']}"


class RepeatGenerator:
    """Baseline: the previous civilian reply, '' at the start."""

    def generate(self, history, max_new_tokens, temperature, top_p) -> str:
        return next((m["content"] for m in reversed(history) if m["role"] == "assistant"), "")


class FoldedGenerator(Protocol):
    """Answers the folds of a history: a dict with a value for each fold. Raises when it cannot.

    Like a ReplyGenerator it may have ``generate_batch`` for a list of them.
    """

    def generate(
        self, state: dict, max_new_tokens: int, temperature: float, top_p: float
    ) -> str: ...


#: What the folded baselines need of a history.
BASELINE_FOLDS = {"messages": MessageCount(), "last": LastMessages(1), "reply": LastBy("assistant")}


class FoldedEcho:
    """EchoGenerator from folds."""

    def generate(self, state, max_new_tokens, temperature, top_p) -> str:
        return f"{state['messages']} {state['last'][-1]['content']}"


class FoldedRepeat:
    """RepeatGenerator from folds."""

    def generate(self, state, max_new_tokens, temperature, top_p) -> str:
        return state["reply"] or ""


Factory = Callable[[dict], ReplyGenerator | FoldedGenerator]


def folded_factory(spec: dict) -> FoldedGenerator:
    return FoldedRepeat() if spec["model_name"].startswith("repeat") else FoldedEcho()


def builtin_factory(spec: dict) -> ReplyGenerator:
    return RepeatGenerator() if spec["model_name"].startswith("repeat") else EchoGenerator()


def spread(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows over a fixed number of tasks before costly calls.

    A given number keeps adaptive execution from merging the partitions, which it would do for
    their few bytes. None leaves the rows where they are.
    """
    return df.repartition(tasks, *keys) if tasks else df


class _Models:
    """One loaded generator at a time; rows come sorted by model."""

    def __init__(self, factory: Factory):
        self.factory, self.name, self.generator = factory, None, None

    def get(self, spec: dict) -> ReplyGenerator:
        if self.name != spec["model_name"]:
            self.close()
            self.generator, self.name = self.factory(spec), spec["model_name"]
        return self.generator

    def replies(self, spec: dict, histories: list[list[dict]], sampling: Sampling) -> list:
        """A reply, or the exception it failed with, for each history."""
        if not histories:
            return []
        try:
            generator = self.get(spec)
        except Exception as exc:
            return [exc] * len(histories)
        batch = getattr(generator, "generate_batch", None)
        return ask_all(
            histories,
            lambda h: generator.generate(h, **vars(sampling)),
            batch and (lambda hs: batch(hs, **vars(sampling))),
        )

    def close(self) -> None:
        if hasattr(self.generator, "unload"):
            self.generator.unload()
        self.generator = self.name = None


def generate_conversations(
    cases: DataFrame,
    specs: list[ModelSpec],
    factory: Factory = builtin_factory,
    sampling: Sampling = Sampling(),
    tasks: int | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Play each case with each model; every reply enters the history of the next one.

    cases: case_id, scenario_context, character_profile, police_turns, error. The state is local
    to a row, so no shuffle is needed; ``tasks`` spreads cases that come from few files. Rows are
    sorted by model within a task, and up to ``batch_size`` cases of one model are played side by
    side: a generator that takes lists gets the open histories of all of them at once. A failing case has its message in error and no conversation.
    Write the result before using it twice, so that a costly or random model is not called again.
    """
    prompted = case_model_grid(cases, specs).withColumn(
        "system_prompt", render_system_prompt("scenario_context", "character_profile")
    )
    kept = [f for f in prompted.schema if f.name not in ("system_prompt", "error")]
    out = T.StructType(
        [
            *kept,
            *T.StructType.fromDDL(f"generated_conversation {GENERATED_TURNS}, error string"),
        ]
    )

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = _Models(factory)
        for batch in batches:
            rows = batch.to_dict("records")
            played = [(None, row["error"]) for row in rows]
            for name in batch["model_name"].unique():
                open_ = [i for i, r in enumerate(rows) if r["model_name"] == name and r["error"] is None]
                for some in slices(open_, batch_size):
                    for i, result in zip(some, _play_cases(models, [rows[i] for i in some], sampling)):
                        played[i] = result
            yield batch.drop(columns=["system_prompt"]).assign(
                generated_conversation=[turns for turns, _ in played], error=[e for _, e in played]
            )[out.fieldNames()]
        models.close()

    ready = spread(prompted, tasks, "model_name", "case_id").sortWithinPartitions("model_name")
    played = ready.mapInPandas(play, out)
    return played.withColumn("conversation_transcript", build_transcript("generated_conversation"))


def _play_cases(models: _Models, rows: list[dict], sampling: Sampling) -> list[tuple]:
    """(turns, None) or (None, error text) of cases of one model, a round of replies at a time."""
    histories = [[{"role": "system", "content": row["system_prompt"]}] for row in rows]
    asked = [row["police_turns"] for row in rows]
    turns, errors = [[] for _ in rows], [None if a is not None else "No police turns." for a in asked]
    for i in range(max(len(a) for a in [*asked, ()] if a is not None)):
        live = [k for k, a in enumerate(asked) if errors[k] is None and i < len(a)]
        for k in live:
            histories[k].append({"role": "user", "content": asked[k][i]})
        for k, reply in zip(live, models.replies(rows[0], [histories[k] for k in live], sampling)):
            if isinstance(reply, Exception):
                errors[k] = str(reply)
                continue
            histories[k].append({"role": "assistant", "content": reply})
            turns[k].append({"turn_index": i, "police": asked[k][i], "civilian_generated": reply})
    return [(t if e is None else None, e) for t, e in zip(turns, errors)]


def predict_replies(
    turns: DataFrame,
    specs: list[ModelSpec],
    factory: Factory = builtin_factory,
    sampling: Sampling = Sampling(),
    system_prompt: str = DEFAULT_SYSTEM_PROMPT,
    compat: bool = False,
    segment_turns: int = SEGMENT_TURNS,
    segments: int = SEGMENTS,
    tasks: int | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Reply of each model at each evaluation point of the turns.

    The rows of a (model, file, segment) pass through one task in turn order. They build up one
    history, and the model is asked where a point comes, so no history is stored or shipped
    per point. A prompt of the whole history needs all earlier turns in its task: where a generator
    can do with folds of them, predict_folded spreads evenly. A generator that takes lists gets up to ``batch_size`` points at once, fewer where
    their histories together hold over BATCH_MESSAGES messages. A failed call leaves predicted_response NULL and its message in error; it is not
    scored as text. Write the result before using it twice.
    """
    keys = ["model_name", "source_file", "segment"]
    grid = case_model_grid(history_segments(turns, compat, segment_turns, segments), specs)
    gathered = spread(grid, tasks, *keys) if tasks else grid.repartition(*keys)
    ordered = gathered.sortWithinPartitions(*keys, "turn_index")
    kept = ["source_file", "turn_index", "model_name", "model_family", "model_type"]
    out = T.StructType(
        [
            *[f for f in grid.select(*kept).schema],
            *T.StructType.fromDDL("officer_input string, predicted_response string, error string"),
        ]
    )

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, group, history = _Models(factory), None, []
        for batch in batches:
            rows, points, messages = [], [], 0

            def answer():
                found = models.replies(points[0][0], [h for _, h in points], sampling) if points else []
                for (row, _), reply in zip(points, found):
                    failed = isinstance(reply, Exception)
                    result = (None, str(reply)) if failed else (reply, None)
                    rows.append((*[row[k] for k in kept], row["content"], *result))
                points.clear()

            for row in batch.to_dict("records"):
                if group != (here := tuple(row[k] for k in keys)):
                    if group and group[0] != here[0]:
                        answer()  # a call has points of one model
                        messages = 0
                    group, history = here, [{"role": "system", "content": system_prompt}]
                message = {"role": row["role"], "content": row["content"]}
                history.extend([message] * row["copies"])
                if row["asked"]:
                    points.append((row, list(history)))  # the messages themselves are shared
                    messages += len(history)
                    if len(points) >= batch_size or messages > BATCH_MESSAGES:
                        answer()
                        messages = 0
            answer()
            yield pd.DataFrame(rows, columns=out.fieldNames())
        models.close()

    return ordered.mapInPandas(predict, out)


def predict_folded(
    turns: DataFrame,
    specs: list[ModelSpec],
    folds: dict[str, Fold],
    factory: Factory = folded_factory,
    sampling: Sampling = Sampling(),
    tasks: int | None = None,
    batch_size: int = BATCH_SIZE,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """predict_replies for generators that answer from folds of a history: a count, the last messages
    (a windowed prompt), the last reply of a role.

    The turns are shuffled once, in chunks, and each point is answered by itself, so a conversation
    with most of all turns spreads over all tasks. Points of a task come sorted by model.
    """
    points = folded_histories(turns, folds, chunk_rows)
    grid = case_model_grid(points, specs)
    kept = ["source_file", "turn_index", "model_name", "model_family", "model_type", "officer_input"]
    out = T.StructType(
        [*grid.select(*kept).schema, *T.StructType.fromDDL("predicted_response string, error string")]
    )

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _Models(factory)
        for batch in batches:
            rows = batch.to_pylist()
            replies = [None] * len(rows)
            for name in dict.fromkeys(r["model_name"] for r in rows):
                for some in slices([i for i, r in enumerate(rows) if r["model_name"] == name], batch_size):
                    states = [{n: rows[i][n] for n in folds} for i in some]
                    for i, reply in zip(some, models.replies(rows[some[0]], states, sampling)):
                        replies[i] = reply
            failed = [isinstance(r, Exception) for r in replies]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in kept],
                    pa.array([None if f else r for r, f in zip(replies, failed)], pa.string()),
                    pa.array([str(r) if f else None for r, f in zip(replies, failed)], pa.string()),
                ],
                out.fieldNames(),
            )
        models.close()

    ready = spread(grid, tasks, "model_name", "source_file", "turn_index").sortWithinPartitions("model_name")
    return ready.mapInArrow(predict, out)


def generation_lines(conversations: DataFrame) -> DataFrame:
    """Generated turns as rows: case_id, model_name, turn_index, police, civilian_generated."""
    return conversations.select(
        "case_id", "model_name", F.explode("generated_conversation").alias("_t")
    ).select("case_id", "model_name", "_t.*")
