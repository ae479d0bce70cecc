"""Video metadata: normalise raw records, merge channels, pick and classify transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import col, non_empty
from turnmill.operators.ordering import dense_index, group_offsets

# Address and name formats, texts of placeholder rows.
WATCH_URL = "https://www.youtube.com/watch?v="
CHANNEL_FILE_SUFFIX = "_metadata_and_transcripts.csv"
DESCRIPTION_CHARS = 500
RESTRICTED_DESCRIPTION = "Content is members-only, age-restricted, or private."
RESTRICTED_TRANSCRIPT = "[Cannot access restricted content]"

# Texts that stand in for a transcript, by the status they mean.
TRANSCRIPT_MARKS = {
    "invalid_url": "[Invalid URL – could not extract video ID]",
    "disabled": "[Transcript disabled by uploader]",
    "rate_limited": "[Rate limit or request failed: ",
    "error": "[Error fetching transcript: ",
    "none_found": "[No transcript available – manual or automatic]",
    "restricted": RESTRICTED_TRANSCRIPT,
}


def channel_handle(link: Column | str) -> Column:
    """Text between the first and second '@'; NULL when there is none."""
    return F.when(F.instr(col(link), "@") > 0, F.split_part(col(link), F.lit("@"), F.lit(2)))


def channel_handles(links: DataFrame) -> DataFrame:
    """Links that name a channel, with its handle."""
    return links.withColumn("handle", channel_handle("link")).filter("handle is not null")


def trim_sentinel_rows(links: DataFrame, position: str) -> DataFrame:
    """Leave out the first and the last row by ``position``."""
    first = links.agg(F.min(position)).scalar()
    last = links.agg(F.max(position)).scalar()
    return links.filter((F.col(position) > first) & (F.col(position) < last))


def video_url(webpage_url: Column | str, video_id: Column | str) -> Column:
    """The page address of a video, built from its id when it is missing."""
    return F.coalesce(non_empty(webpage_url), F.concat(F.lit(WATCH_URL), col(video_id)))


def extract_video_id(url: Column | str) -> Column:
    """Text after the last 'v=' up to '&'; NULL when there is no 'v='."""
    tail = F.element_at(F.split(col(url), "v="), -1)
    return F.when(F.instr(col(url), "v=") > 0, F.split_part(tail, F.lit("&"), F.lit(1)))


def short_description(description: Column | str, limit: int | None = DESCRIPTION_CHARS) -> Column:
    """The first ``limit`` characters on one line, always closed by an ellipsis; None: all, as it is."""
    whole = F.coalesce(col(description), F.lit(""))
    if limit is None:
        return whole
    one_line = F.replace(whole, F.lit("\n"), F.lit(" "))
    return F.concat(F.substring(one_line, 1, limit), F.lit("…"))


def normalize_videos(raw: DataFrame, description_chars: int | None = DESCRIPTION_CHARS) -> DataFrame:
    """Raw info records to video rows; a record without title becomes a placeholder row.

    Expects index, video_id, webpage_url, title, uploader, view_count, upload_date (yyyyMMdd),
    duration and description. Unknown numbers and dates are NULL. ``description_chars`` None
    keeps descriptions whole.
    """
    restricted = non_empty("title").isNull()
    url = video_url("webpage_url", F.coalesce(F.col("video_id"), F.lit("")))
    open_only = lambda c: F.when(~restricted, c)
    return raw.select(
        "index",
        F.when(restricted, F.concat(F.lit("[RESTRICTED] ID: "), F.coalesce("video_id", F.lit(""))))
        .otherwise(F.col("title"))
        .alias("title"),
        F.when(restricted, url).otherwise(F.coalesce("webpage_url", F.lit(""))).alias("url"),
        open_only(F.coalesce("uploader", F.lit("Unknown"))).alias("uploader"),
        open_only(F.col("view_count").try_cast("double").try_cast("bigint")).alias("views"),
        open_only(F.to_date(F.try_to_timestamp("upload_date", F.lit("yyyyMMdd")))).alias(
            "upload_date"
        ),
        open_only(F.coalesce(F.col("duration").try_cast("double").try_cast("int"), F.lit(0))).alias("duration_sec"),
        F.when(restricted, F.lit(RESTRICTED_DESCRIPTION))
        .otherwise(short_description("description", description_chars))
        .alias("description"),
        F.when(restricted, F.lit(RESTRICTED_TRANSCRIPT)).otherwise(F.lit("")).alias("transcript"),
    )


def drop_null_entries(entries: DataFrame, entry: str) -> DataFrame:
    """Entries of a channel listing that hold something."""
    return entries.filter(F.col(entry).isNotNull())


def index_within_channel(entries: DataFrame, channel: str, position: str) -> DataFrame:
    """1-based index of each entry in its channel, balanced for very large channels."""
    return dense_index(entries, channel, position, "index")


def channel_name(source_file: Column | str, compat: bool = False) -> Column:
    """Channel of a metadata file; ``compat`` cuts at the first underscore instead."""
    if compat:
        return F.split_part(col(source_file), F.lit("_"), F.lit(1))
    return F.regexp_replace(col(source_file), F.lit(f"({CHANNEL_FILE_SUFFIX}|\\.csv)$"), F.lit(""))


def merge_channel_videos(videos: DataFrame, compat: bool = False, span: int = 65536) -> DataFrame:
    """All channel files as one table with channel_name and a global id 0 … n-1.

    The id follows (source_file, index), index being 1-based and without gaps in its file, so
    it needs only the row count of each file, not a sort of the rows.
    """
    offsets = group_offsets(videos, "source_file", span=span)
    tagged = videos.withColumn("_chunk", chunk_of_index("index", span))
    # All rows match; a left join keeps the videos the side that is read in parts.
    merged = tagged.join(offsets, ["source_file", "_chunk"], "left")
    return merged.select(
        (F.col("_offset") + F.col("index") - 1).cast("bigint").alias("id"),
        *videos.columns,
        channel_name("source_file", compat).alias("channel_name"),
    )


def chunk_of_index(index: str, span: int) -> Column:
    """Chunk of a 1-based index."""
    return F.floor((F.col(index) - 1) / span).cast("bigint")


def merge_counts(videos: DataFrame) -> DataFrame:
    """Rows per source file, and one total row with source_file NULL."""
    per_file = videos.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"))
    total = per_file.agg(F.lit(None).cast("string").alias("source_file"), F.sum("n").alias("n"))
    return per_file.unionByName(total.withColumn("n", F.coalesce("n", F.lit(0))))


def join_snippets(snippets: Column | str) -> Column:
    """Caption snippets (structs with text) as one text."""
    return F.array_join(F.transform(col(snippets), lambda s: s["text"]), " ")


def transcript_status(transcript: Column | str) -> Column:
    """ok, missing, or the reason that stands in place of the transcript."""
    text = col(transcript)
    status = F.when(text.isNull() | (text == ""), "missing")
    for name, mark in TRANSCRIPT_MARKS.items():
        status = status.when(text.startswith(mark), name)
    return status.otherwise("ok")


def split_transcript_status(df: DataFrame, transcript: str = "transcript") -> DataFrame:
    """Add transcript_status and clear the transcript of rows that hold only a reason."""
    return df.withColumn("transcript_status", transcript_status(transcript)).withColumn(
        transcript, F.when(F.col("transcript_status") == "ok", F.col(transcript))
    )


def transcript_pick(videos: DataFrame, candidates: DataFrame, key: str = "video_id") -> DataFrame:
    """The best transcript of each video: lowest priority number, else the no-transcript text.

    The best candidate is an aggregate, so copies shrink before the shuffle.
    """
    best = candidates.groupBy(key).agg(F.min(F.struct("priority", "lang", "text")).alias("_best"))
    return videos.join(best, key, "left").select(
        *[videos[c] for c in videos.columns],
        F.col("_best.lang").alias("lang"),
        F.coalesce("_best.text", F.lit(TRANSCRIPT_MARKS["none_found"])).alias("transcript"),
    )


def transcribe_pending(videos: DataFrame, finished: DataFrame, key: str = "video_id") -> DataFrame:
    """Videos that have no finished transcript yet."""
    return videos.join(finished.select(key).distinct(), key, "left_anti")
