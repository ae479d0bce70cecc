"""Sinks. Parquet by default, with the text formats that people read as options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.session import written

#: Bytes of text that a file of a partitioned sink holds, about.
FILE_BYTES = 128 << 20
#: Keys, each with a folder and a file of its own, that a task of a partitioned sink writes, about.
TASK_KEYS = 1024

# Texts are written as they are: without these the CSV writer trims blanks at their ends.
CSV_TEXT = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """A whole table as Parquet, CSV (with header) or JSON lines."""
    options = CSV_TEXT if fmt == "csv" else {}
    df.write.mode(mode).format(fmt).options(**options).save(path)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line; NULL fields are left out."""
    df.write.mode(mode).json(path)


def json_bytes(df: DataFrame, key: str) -> Column:
    """Bytes of a row as a JSON line of its key's folder."""
    return F.octet_length(F.to_json(F.struct(*[c for c in df.columns if c != key]))) + 1


def dealt_by_key(
    df: DataFrame, key: str, size: Column, order: str | None = None, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """df dealt out for a write that makes a folder per ``key``: files of about ``file_bytes``.

    The bytes of every key decide. Keys that fit a file have one task each, which up to some TASK_KEYS share; a
    larger key is cut into as many parts as it fills files, in stretches of ``order`` (numbers)
    if given. So the files are at most the keys and the total by ``file_bytes``, and no task holds a
    hot key. df is read twice and must not be costly. Rows come sorted by key and order.
    """
    low, high = (F.min(order), F.max(order)) if order else (F.lit(0), F.lit(0))
    sizes = df.withColumn("_bytes", size).groupBy(F.col(key).alias("_key")).agg(
        F.sum("_bytes").alias("_bytes"), low.alias("_low"), high.alias("_high")
    )
    whole = sizes.agg(F.sum("_bytes").alias("n"), F.count(F.lit(1)).alias("keys")).first()
    total = whole.n or 0
    # At most total / file_bytes keys are larger than a file.
    large = sizes.where(F.col("_bytes") > file_bytes).select(
        "_key", F.ceil(F.col("_bytes") / file_bytes).alias("_parts"), "_low", "_high"
    )
    if order:
        share = (F.col(order) - F.col("_low")) * F.col("_parts") / (F.col("_high") - F.col("_low") + 1)
        part = F.floor(share)
    else:
        part = F.pmod(F.xxhash64(*df.columns), F.col("_parts"))
    spread = df.join(F.broadcast(large), F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(
        "_part", F.coalesce(part, F.lit(0))
    )
    # The parts of a key go to tasks in a row, so each is a file of its own and their names are in order.
    tasks = max(1, -(-total // file_bytes), -(-whole.keys // TASK_KEYS))
    free = F.lit(tasks + 1) - F.coalesce("_parts", F.lit(1))
    task = F.pmod(F.hash(key).cast("long"), free) + F.col("_part")
    dealt = spread.repartitionById(tasks, task.cast("int"))
    return dealt.sortWithinPartitions(key, *([order] if order else [])).select(*df.columns)


def write_by_model(
    df: DataFrame, path: str, text_column: str | None = None, file_bytes: int = FILE_BYTES
) -> None:
    """JSON lines per model under <path>/json, and the transcripts as text under <path>/txt.

    df is evaluated once: both are made from a table of it. Files are as dealt_by_key says.
    """
    rows = written(df, "by_model")
    dealt_by_key(rows, "model_name", json_bytes(rows, "model_name"), file_bytes=file_bytes).write.mode(
        "overwrite"
    ).partitionBy("model_name").json(f"{path}/json")
    if text_column:
        texts = rows.select("model_name", F.col(text_column).alias("value"))
        dealt_by_key(texts, "model_name", F.octet_length("value") + 1, file_bytes=file_bytes).write.mode(
            "overwrite"
        ).partitionBy("model_name").text(f"{path}/txt")


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with one)."""
    return df.filter("error is null").drop("error"), df.filter("error is not null")


def write_with_errors(df: DataFrame, path: str) -> None:
    """Results and failures side by side, from one evaluation of ``df``.

    The costly rows are written once, split by whether they failed.
    """
    df.withColumn("outcome", F.when(F.col("error").isNull(), "ok").otherwise("error")).write.mode(
        "overwrite"
    ).partitionBy("outcome").parquet(path)


def write_dialogues(
    lines: DataFrame, path: str, per_video: bool = False, file_bytes: int = FILE_BYTES
) -> None:
    """Dialogue lines (video_id, line_no, line) in order.

    One table by default. ``per_video`` writes readable text with a folder per video, whose files in
    order of their names are the dialogue: one file, or more of a video that fills more.
    """
    if per_video:
        rows = written(lines, "dialogues")
        dealt = dealt_by_key(rows, "video_id", F.octet_length("line") + 1, "line_no", file_bytes)
        dealt.select("video_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy(
            "video_id"
        ).text(path)
    else:
        lines.sortWithinPartitions("video_id", "line_no").write.mode("overwrite").parquet(path)


def write_turns(
    turns: DataFrame, path: str, per_file: bool = False, file_bytes: int = FILE_BYTES
) -> None:
    """Turn rows as CSV; turn_index keeps the order. ``per_file`` makes a folder per source file."""
    if per_file:
        rows = written(turns, "turns")
        dealt = dealt_by_key(rows, "source_file", json_bytes(rows, "source_file"), "turn_index", file_bytes)
        dealt.write.mode("overwrite").partitionBy("source_file").options(**CSV_TEXT).csv(path)
    else:
        ordered = turns.sortWithinPartitions("source_file", "turn_index")
        ordered.write.mode("overwrite").options(**CSV_TEXT).csv(path)


def append_log(df: DataFrame, path: str, run: str | None = None) -> None:
    """Add rows to a log.

    With the id of a ``run`` the rows are that run's: they are a partition of the log, and replace
    what the same run wrote before, so a repeated run stands in the log once. Without one, every call
    adds its rows.
    """
    if run is None:
        df.write.mode("append").parquet(path)
        return
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("run").parquet(path)


def write_summary(lines: DataFrame, path: str) -> None:
    """A short report, given as ordered lines, as one text file."""
    lines.orderBy("line_no").select(F.col("line").alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(path)
