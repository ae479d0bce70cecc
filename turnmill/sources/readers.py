"""Sources. Every reader returns a lazy DataFrame."""

from __future__ import annotations

import csv
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.functions.json import ARRAY, OBJECT, field, parse, variant_items, variant_kind, variant_text
from turnmill.functions.text import na_to_null
from turnmill.operators.diarization import IGNORED, PROCESSED
from turnmill.sources.json_arrays import json_items
from turnmill.sources.schemas import (
    JUDGE_CASE,
    RAW_VIDEO,
    TURN_COLUMNS,
    VIDEO_COLUMNS,
)

CSV_TEXT = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}


def file_part(name: str) -> Column:
    """A field of the scan's file metadata as plain text; it comes percent-encoded."""
    return F.url_decode(F.replace(F.col(f"_metadata.{name}"), F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def header_groups(spark: SparkSession, path: str, folders: bool = False) -> dict[str, list[str] | str]:
    """Files of a folder by their first line.

    A scan of many CSV files reads by position, so files whose columns differ must be read apart.
    Where all files have the same line, the folder itself is the group; otherwise the driver sees
    the name and line of each file one by one, never their rows. It lists the same files when it
    plans the scan.
    """
    lines = (
        spark.read.option("pathGlobFilter", "*.csv")
        .option("recursiveFileLookup", folders)
        .text(path)
        .select(
            "value",
            file_part("file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("start"),
            F.monotonically_increasing_id().alias("at"),
        )
        .filter("start = 0")
    )
    firsts = lines.groupBy("file").agg(F.min_by("value", "at").alias("line"))
    clean = lambda line: line.lstrip("\ufeff").rstrip("\r")
    if len(same := firsts.select("line").distinct().limit(2).collect()) < 2:
        return {clean(r.line): path for r in same if clean(r.line)}
    groups: dict[str, list[str]] = {}
    for r in firsts.toLocalIterator():
        groups.setdefault(clean(r.line), []).append(literal_path(r.file))
    return {line: sorted(files) for line, files in groups.items() if line}


#: A row's place in its task, in the lower bits of monotonically_increasing_id.
PLACE_BITS = 33
#: Rows of a file that share a line of the table of starts.
SPAN_ROWS = 65536


def read_csv_by_name(
    spark: SparkSession,
    path: str,
    columns: list[str],
    required: list[str] | None = None,
    header: list[str] | None = None,
    folders: bool = False,
) -> DataFrame:
    """CSV files of a folder, columns matched by name, as strings with source_file, part and file_pos.

    Columns that a file lacks are NULL; a file that lacks a required one is skipped, and so is
    an empty file. file_pos grows with the row's place in its file. When all files are known to
    have the same columns, give them as ``header``: the files are then read only once. With
    ``folders``, the files below <path>/<name>=<value> are the parts, in order of their names, of the
    source file <value>, as partitioned sinks write them.
    """
    groups = header_groups(spark, path, folders) if header is None else {",".join(header): path}
    folder = F.regexp_extract(file_part("file_path"), r"([^/]*)/[^/]*$", 1)
    source = F.url_decode(F.replace(F.regexp_replace(folder, "^[^=]*=", ""), F.lit("+"), F.lit("%2B")))
    frames = []
    for line, files in groups.items():
        names = [n.strip() for n in next(csv.reader([line]))]
        if not set(required or []) <= set(names):
            continue
        schema = ", ".join(f"`{n}` string" for n in names)
        reader = spark.read.schema(schema).options(
            **CSV_TEXT, pathGlobFilter="*.csv", recursiveFileLookup=folders
        )
        frame = reader.csv(files)
        frames.append(
            frame.select(
                *[F.col(f"`{c}`") for c in columns if c in names],
                (source if folders else file_part("file_name")).alias("source_file"),
                file_part("file_name").alias("part"),
                F.monotonically_increasing_id().alias("file_pos"),
            )
        )
    if not frames:
        empty = ", ".join(f"`{c}` string" for c in [*columns, "source_file", "part"]) + ", file_pos bigint"
        return spark.createDataFrame([], empty)
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame, allowMissingColumns=True)
    for c in columns:
        if c not in whole.columns:
            whole = whole.withColumn(c, F.lit(None).cast("string"))
    return whole.select(*[F.col(f"`{c}`") for c in columns], "source_file", "part", "file_pos")


def with_places(raw: DataFrame, folders: bool = False, span: int = SPAN_ROWS) -> DataFrame:
    """raw with _place, the 1-based row of its source file, and _rows, the rows of that file.

    Line breaks in cells keep a file in one task, which numbers its rows as it reads them. So the
    first number and the count of each file place all its rows, and with ``folders`` a file's start is
    the count of the parts before it. The starts are joined on (file, stretch of rows), so a
    large file is no hot key. The counts come from a scan of their own, which reads no cells.
    """
    spot = F.col("file_pos").bitwiseAND((1 << PLACE_BITS) - 1)
    numbered = raw.withColumn("_spot", spot)
    counts = numbered.groupBy("source_file", "part").agg(
        F.min("_spot").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    if folders:  # a row per part
        parts = Window.partitionBy("source_file").orderBy("part")
        counts = counts.withColumns(
            {
                "_before": F.sum("_n").over(parts.rowsBetween(Window.unboundedPreceding, -1)),
                "_rows": F.sum("_n").over(Window.partitionBy("source_file")),
            }
        )
    else:
        counts = counts.withColumns({"_before": F.lit(0), "_rows": F.col("_n")})
    stretch = lambda c: F.floor(c / span).cast("bigint")
    last = F.col("_first") + F.col("_n") - 1
    starts = counts.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_first")), stretch(last))))
    joined = numbered.withColumn("_stretch", stretch(F.col("_spot"))).join(
        starts, ["source_file", "part", "_stretch"], "left"
    )
    inside = F.col("_spot") - F.col("_first")
    sure = F.when((inside >= 0) & (inside < F.col("_n")), inside).otherwise(
        F.raise_error(F.lit("The files of a table changed while it was read."))
    )
    place = F.coalesce("_before", F.lit(0)) + sure.cast("bigint") + 1
    return joined.withColumn("_place", place).drop("_spot", "_stretch", "_first", "_n", "_before")


def read_channel_list(spark: SparkSession, path: str) -> DataFrame:
    """link, found by its name in each file's header."""
    return read_csv_by_name(spark, path, ["link"], ["link"]).select("link")


def read_channel_videos(
    spark: SparkSession, path: str, header: list[str] | None = None, folders: bool = False
) -> DataFrame:
    """Channel files of a folder with typed columns; 'N/A' and the like become NULL.

    index counts the rows of a file from 1. For ``header`` and ``folders`` see read_csv_by_name.
    """
    raw = with_places(read_csv_by_name(spark, path, list(VIDEO_COLUMNS), None, header, folders), folders)
    named = raw.select(
        *[na_to_null(F.col(f"`{c}`")).alias(n) for c, n in VIDEO_COLUMNS.items()],
        "source_file",
        "_place",
    )
    return named.withColumns(
        {
            "index": F.col("_place"),
            "views": F.col("views").try_cast("double").try_cast("bigint"),
            "upload_date": F.to_date(F.try_to_timestamp("upload_date", F.lit("yyyyMMdd"))),
            "duration_sec": F.col("duration_sec").try_cast("double").try_cast("int"),
        }
    ).drop("_place")


def read_raw_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Landed info records, one JSON object per line."""
    return spark.read.schema(RAW_VIDEO).json(path)


def read_annotated(spark: SparkSession, path: str, schema: str, encoding: str = "cp1252") -> DataFrame:
    """Merged transcript and feature table in a Windows code page; columns are found by name.

    A column that the file lacks is NULL, others are left out, and a value that its type cannot
    hold is NULL. The code page needs spark.sql.legacy.javaCharsets, which session.RECOMMENDED
    sets. A job converts the table once: see convert_annotated.
    """
    raw = spark.read.options(**CSV_TEXT, encoding=encoding).csv(path)
    return raw.select(
        *[
            (F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in T.StructType.fromDDL(schema)
        ]
    )


def convert_annotated(
    spark: SparkSession, path: str, out: str, schema: str, encoding: str = "cp1252"
) -> DataFrame:
    """read_annotated once, into Parquet below ``out``, and the table that was written.

    Text that the code page can't give back as it was read (bytes that it doesn't define) is an error:
    the table is then in another encoding.
    """
    rows = read_annotated(spark, path, schema, encoding)
    texts = [f.name for f in T.StructType.fromDDL(schema) if isinstance(f.dataType, T.StringType)]
    lost = F.lit(False)
    for name in texts:
        # A byte without a letter is read as this one; all others of a code page can be given back.
        lost = lost | F.coalesce(F.contains(F.col(f"`{name}`"), F.lit("\ufffd")), F.lit(False))
    checked = rows.where(
        F.when(lost, F.raise_error(F.lit(f"The table is not in {encoding}.")).cast("boolean")).otherwise(True)
    )
    checked.write.mode("overwrite").parquet(out)
    return spark.read.schema(rows.schema).parquet(out)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """id (always text), url, minutes, found by their names in each file's header."""
    raw = read_csv_by_name(spark, path, ["id", "URL", "minutes"], ["id"])
    return raw.select("id", F.col("URL").alias("url"), F.col("minutes").try_cast("double").alias("minutes"))


def read_status_json(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Status lists as (id, status) rows; an unreadable file (or line) gives no rows."""
    texts = spark.read.text(path, wholetext=not json_lines)
    lists = F.create_map(
        *[
            part
            for name in (PROCESSED, IGNORED)
            for part in (F.lit(name), field(F.col("v"), name, "array<string>"))
        ]
    )
    return (
        texts.select(parse("value").alias("v"))
        .select(F.explode(lists).alias("status", "ids"))
        .select(F.explode("ids").alias("id"), "status")
    )


def read_turns(
    spark: SparkSession, path: str, header: list[str] | None = None, folders: bool = False
) -> DataFrame:
    """Turn files of a folder: source_file, turn_index, start_time, speaker_label, transcript.

    A file without speaker_label or transcript, or with fewer than two rows, is skipped. For
    ``header`` and ``folders`` see read_csv_by_name.
    """
    raw = read_csv_by_name(spark, path, TURN_COLUMNS, ["speaker_label", "transcript"], header, folders)
    return with_places(raw, folders).filter("_rows >= 2").select(
        "source_file", (F.col("_place") - 1).cast("int").alias("turn_index"), *TURN_COLUMNS
    )


def read_chat_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Conversations, one JSON object per line, as text."""
    return spark.read.text(path).filter("trim(value) <> ''").withColumnRenamed("value", "record")


def scenario_items(v: Column) -> Column:
    """The cases under any accepted root: a list, {"cases": […]} or a single case."""
    listed = field(v, "cases")
    return (
        F.when(variant_kind(v) == ARRAY, variant_items(v))
        .when((variant_kind(v) == OBJECT) & listed.isNotNull(), variant_items(listed))
        .when(variant_kind(v) == OBJECT, F.array(v))
        .otherwise(
            F.raise_error(F.lit("Scenario JSON must be a list of cases or an object.")).cast(
                "array<variant>"
            )
        )
    )


def read_scenarios(spark: SparkSession, path: str, single: bool = False) -> DataFrame:
    """Scenario files as (source_file, pos, case), pos counting from 0 in each file.

    normalize_cases puts source_file into the ids that it makes, so an id stays the same when files
    are added. ``single`` leaves it NULL, for a path that is known to hold one file only. Large files are
    read by many tasks: see json_items.
    """
    items = json_items(spark, path, scenario_items(F.col("_v")))
    return items.withColumn("source_file", F.lit(None).cast("string")) if single else items


def read_judge_cases(spark: SparkSession, path: str, json_lines: bool = False) -> DataFrame:
    """Cases with model outputs, from one object per line or from arrays: see json_items.

    A model output without conversation_transcript uses its target_conversation, while an
    explicit null stays NULL.
    """
    if json_lines:
        cases = spark.read.text(path).filter("trim(value) <> ''").select(
            F.parse_json("value").alias("v")
        )
    else:
        cases = json_items(spark, path, variant_items(F.col("_v"))).withColumnRenamed("case", "v")
    return judge_cases(cases)


def judge_cases(cases: DataFrame, v: str = "v") -> DataFrame:
    """Typed judge cases from variants."""
    case = F.col(v)

    def output(_, value: Column) -> Column:
        target = F.coalesce(variant_text(field(value, "target_conversation")), F.lit(""))
        given = field(value, "conversation_transcript")
        return F.struct(
            F.when(field(value, "target_conversation").isNull(), "")
            .otherwise(target)
            .alias("target_conversation"),
            F.when(given.isNull(), target).otherwise(variant_text(given)).alias(
                "conversation_transcript"
            ),
        )

    outputs = F.transform_values(
        field(case, "model_outputs").try_cast("map<string, variant>"), output
    )
    texts = [
        F.coalesce(variant_text(field(case, n)), F.lit("")).alias(n)
        for n in ("case_id", "scenario_context", "profile", "ground_truth")
    ]
    return cases.select(*texts, outputs.alias("model_outputs")).to(T.StructType.fromDDL(JUDGE_CASE))
