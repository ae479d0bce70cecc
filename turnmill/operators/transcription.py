"""The diarization call as a hook that runs in Arrow batches."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.operators.diarization import read_response
from turnmill.operators.generation import spread
from turnmill.operators.hooks import BATCH_SIZE, ask_all, slices

# Tries of a call, and the pauses between them in seconds.
TRIES, FIRST_WAIT, WAIT_STEP = 7, 10.0, 1.0

TRANSCRIBED = (
    "id string, response string, input_token bigint, output_token bigint, thought_token bigint, "
    "execution_time_sec double, error string"
)


class Transcriber(Protocol):
    """Returns response (JSON text) and token counts for a video. Raises when it cannot.

    A transcriber may also have ``transcribe_batch(videos)``, which returns the same, or an
    exception, for each of a list of (video_id, url).
    """

    def transcribe(self, video_id: str, url: str) -> dict: ...


def transcribe_videos(
    pending: DataFrame,
    factory: Callable[[], Transcriber],
    tries: int = TRIES,
    first_wait: float = FIRST_WAIT,
    wait_step: float = WAIT_STEP,
    tasks: int | None = None,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """Responses of pending videos (id, url), one transcriber per task, retries inside it.

    Up to ``batch_size`` videos are asked for at once, and only failed ones again. The time of a
    video is that of its own calls, and its part of the calls it shared.
    ``tasks`` spreads videos that come from few files. Write the result before using it twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transcriber = factory()
        batch_call = getattr(transcriber, "transcribe_batch", None)
        for batch in batches:
            rows = []
            for videos in slices(list(zip(batch["id"], batch["url"])), batch_size):
                spent = [0.0] * len(videos)

                def timed(call, asked):
                    started = time.monotonic()
                    try:
                        return call()
                    finally:
                        for i in asked:
                            spent[i] += (time.monotonic() - started) / len(asked)

                found = ask_all(
                    list(range(len(videos))),
                    lambda i: timed(lambda: transcriber.transcribe(*videos[i]), [i]),
                    batch_call and (lambda some: timed(lambda: batch_call([videos[i] for i in some]), some)),
                    tries, first_wait, wait_step,
                )
                for (video_id, _), answer, seconds in zip(videos, found, spent):
                    failed = isinstance(answer, Exception)
                    rows.append(
                        {**({} if failed else answer), "id": video_id,
                         "error": str(answer) if failed else None, "execution_time_sec": seconds}
                    )
            frame = pd.DataFrame(rows, columns=list(kinds)).convert_dtypes()
            # Where all videos of a batch failed, a text column has nothing to tell its type by.
            yield frame.astype({c: "string" for c, kind in kinds.items() if kind == "string"})

    kinds = dict(c.split() for c in TRANSCRIBED.split(", "))
    return spread(pending.select("id", "url"), tasks, "id").mapInPandas(run, TRANSCRIBED)


def parsed_transcriptions(responses: DataFrame) -> DataFrame:
    """Responses with their two lists; an unreadable response is a failure, not an empty video."""
    read = read_response(responses)
    unreadable = F.when(~F.col("parsed"), "Could not parse the structured response.")
    return read.withColumn("error", F.coalesce("error", unreadable)).drop("parsed")
