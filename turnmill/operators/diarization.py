"""Diarized videos: manifest and status, speaker labels, turn and dialogue exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.json import OBJECT, parse, variant_kind
from turnmill.functions.text import col, non_empty
from turnmill.sources.schemas import SEGMENTS, SPEAKERS, TRANSCRIPTION

# The mark of an unknown attribute, the duration limit, the dialogue heading.
UNKNOWN = "?"
MAX_MINUTES = 45
DIALOGUE_HEADING = "--- Detailed Conversation Log ---"
PROCESSED, IGNORED, FAILED = "processed", "ignore", "failed"


def known(c: Column) -> Column:
    """The text, or NULL when it is empty or marked unknown."""
    return F.nullif(non_empty(c), F.lit(UNKNOWN))


def speaker_label(name: Column, position: Column, role: Column, voice: Column) -> Column:
    """Name, else [position], else [role], else [Voice n]."""
    in_brackets = lambda c: F.concat(F.lit("["), c, F.lit("]"))
    return F.coalesce(
        known(name),
        in_brackets(known(position)),
        in_brackets(known(role)),
        F.concat(F.lit("[Voice "), voice.cast("string"), F.lit("]")),
    )


def read_response(df: DataFrame, response: str = "response") -> DataFrame:
    """Parse a diarization response (JSON text) into its two lists.

    An unreadable response gives empty lists and parsed = false.
    """
    parsed = F.from_json(F.col(response), TRANSCRIPTION)
    lists = {"task1_transcripts": SEGMENTS, "task2_speakers": SPEAKERS}
    ok = F.coalesce(variant_kind(parse(response)) == OBJECT, F.lit(False))
    return df.withColumn("_t", F.when(ok, parsed)).select(
        *df.columns,
        ok.alias("parsed"),
        *[F.coalesce(F.col("_t")[f], F.array().cast(t)).alias(f) for f, t in lists.items()],
    )


def labelled_segments() -> Column:
    """Segments of a nested record with the label of their speaker.

    Works inside the row. When a voice is listed twice, the last entry counts.
    """

    def label(segment: Column) -> Column:
        speaker = F.try_element_at(
            F.filter("task2_speakers", lambda s: s["voice"] == segment["voice"]), F.lit(-1)
        )
        return F.struct(
            segment["start"].alias("start_time"),
            speaker_label(
                speaker["name"], speaker["position"], speaker["role_in_video"], segment["voice"]
            ).alias("speaker_label"),
            segment["text"].alias("transcript"),
        )

    return F.transform("task1_transcripts", label)


def label_turns(transcriptions: DataFrame) -> DataFrame:
    """One row per segment: video_id, turn_index, start_time, speaker_label, transcript."""
    return transcriptions.select(
        "video_id", F.posexplode(labelled_segments()).alias("turn_index", "_s")
    ).select("video_id", "turn_index", "_s.*")


def export_turns(transcriptions: DataFrame) -> DataFrame:
    """Turn rows in the shape of the per-video files."""
    return label_turns(transcriptions).select(
        F.concat("video_id", F.lit(".csv")).alias("source_file"),
        "turn_index",
        "start_time",
        "speaker_label",
        "transcript",
    )


def dialogue_lines(transcriptions: DataFrame) -> DataFrame:
    """The readable dialogue of each video as ordered lines (video_id, line_no, line)."""
    spoken = F.transform(
        labelled_segments(),
        lambda s: F.concat(
            F.lit("["), F.coalesce(s["start_time"], F.lit("")), F.lit("] "),
            s["speaker_label"], F.lit(": "), F.coalesce(s["transcript"], F.lit("")),
        ),
    )
    heading = F.array(F.lit(DIALOGUE_HEADING), F.lit(""))
    return transcriptions.select(
        "video_id", F.posexplode(F.concat(heading, spoken)).alias("line_no", "line")
    )


def duration_guard(manifest: DataFrame, limit: float = MAX_MINUTES) -> DataFrame:
    """Add too_long. A missing or NaN length passes."""
    minutes = F.nanvl(F.coalesce(F.col("minutes"), F.lit(0.0)), F.lit(0.0))
    return manifest.withColumn("too_long", minutes > limit)


def pending_videos(manifest: DataFrame, status: DataFrame) -> DataFrame:
    """Manifest rows whose id has no final status yet."""
    done = status.filter(F.col("status").isin(PROCESSED, IGNORED)).select("id").distinct()
    return manifest.join(done, "id", "left_anti")


def single_video(manifest: DataFrame, video_id: str) -> DataFrame:
    """The row of one video, whatever its status."""
    return manifest.filter(F.col("id") == video_id)


def latest_status(status: DataFrame) -> DataFrame:
    """Each (id, status) once."""
    return status.dropDuplicates(["id", "status"])


def status_summary(status: DataFrame) -> DataFrame:
    """Number of ids per status."""
    return latest_status(status).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def token_usage(df: DataFrame) -> DataFrame:
    """Token counts with 0 for a missing count."""
    names = ["input_token", "output_token", "thought_token"]
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0)).cast("bigint") for n in names})


def diarization_log(df: DataFrame, model_name: str) -> DataFrame:
    """Log rows; videos that were only ignored have no tokens and no time."""
    return token_usage(df).select(
        "id",
        "input_token",
        "output_token",
        "thought_token",
        F.round(F.coalesce("execution_time_sec", F.lit(0.0)), 2).alias("execution_time_sec"),
        F.lit(model_name).alias("model_name"),
    )


def iso_duration_seconds(file_name: Column | str) -> Column:
    """Seconds of a trailing _PT1H2M3S in a file name without its extension; else NULL."""
    stem = F.regexp_replace(col(file_name), F.lit(r"(?<=[^/])\.[^./]*$"), F.lit(""))
    # Fixed value: the format of durations in file names.
    pattern = r"_PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda g: F.coalesce(
        F.regexp_extract(stem, pattern, g).try_cast("bigint"), F.lit(0)
    )
    return F.when(stem.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def timecode_format(file_name: Column | str) -> Column:
    """Time code asked for: with hours only when the file is known to last an hour or more."""
    return F.when(
        iso_duration_seconds(file_name) >= 3600, F.lit("MM:SS or H:MM:SS")
    ).otherwise(F.lit("MM:SS"))
