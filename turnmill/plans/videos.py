"""Video metadata queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.operators import videos as V
from turnmill.plans import adapters as A
from turnmill.plans.registry import query, table

LINKS = """links AS (
  SELECT DISTINCT CASE source
    WHEN 'src7' THEN 'https://www.youtube.com/src7'
    WHEN 'src8' THEN 'https://www.youtube.com/@src8/videos@x'
    ELSE concat('https://www.youtube.com/@', source) END AS link
  FROM documents)"""


@query(
    "channel_handle",
    f"WITH {LINKS} SELECT link, split_part(link, '@', 2) AS handle FROM links WHERE link LIKE '%@%'",
)
def channel_handle(spark, sf):
    return V.channel_handles(A.channel_links(spark, sf))


@query(
    "trim_sentinel_rows",
    """SELECT page_id, url FROM pages
WHERE page_id > (SELECT min(page_id) FROM pages) AND page_id < (SELECT max(page_id) FROM pages)""",
)
def trim_sentinel_rows(spark, sf):
    return V.trim_sentinel_rows(table(spark, sf, "pages").select("page_id", "url"), "page_id")


# Beside some documents there are copies that lack something: see adapters.raw_videos.
RAW = """raw AS (
  SELECT doc_id, text, source, n_chars, false AS odd FROM documents
  UNION ALL SELECT -1 - doc_id, text, source, n_chars, true FROM documents WHERE doc_id % 23 = 0 OR doc_id % 29 = 0),
told AS (
  SELECT *, odd AND (-1 - doc_id) % 23 = 0 AS untitled, odd AND (-1 - doc_id) % 29 = 0 AS undescribed FROM raw)"""
NORMALIZED = f"""WITH {RAW} SELECT CAST(doc_id + 1 AS INT) AS index,
  CASE WHEN untitled THEN concat('[RESTRICTED] ID: v', doc_id) ELSE text END AS title,
  CASE WHEN doc_id % 5 <> 0 THEN concat('https://video.example/', doc_id)
       WHEN untitled THEN concat('https://www.youtube.com/watch?v=v', doc_id)
       ELSE '' END AS url,
  CASE WHEN NOT untitled THEN
    CASE WHEN doc_id % 11 = 0 THEN 'Unknown' ELSE source END END AS uploader,
  CASE WHEN NOT untitled AND doc_id % 13 <> 0 THEN doc_id * 7 END AS views,
  CASE WHEN NOT untitled
    THEN concat('2024-01-', lpad(CAST(abs(doc_id) % 28 + 1 AS VARCHAR), 2, '0')) END AS upload_date,
  CASE WHEN NOT untitled THEN
    CASE WHEN doc_id % 19 = 0 THEN 0 ELSE CAST(n_chars AS INT) END END AS duration_sec,
  CASE WHEN untitled THEN 'Content is members-only, age-restricted, or private.'
       WHEN undescribed THEN '…'
       ELSE concat(substring(replace(text, chr(10), ' '), 1, 500), '…') END AS description,
  CASE WHEN untitled THEN '[Cannot access restricted content]' ELSE '' END AS transcript
FROM told"""


@query("normalize_video", NORMALIZED)
def normalize_video(spark, sf):
    return V.normalize_videos(A.raw_videos(spark, sf)).withColumn(
        "upload_date", F.col("upload_date").cast("string")
    )


@query(
    "restricted_placeholder",
    f"SELECT index, title, url, description, transcript FROM ({NORMALIZED}) "
    "WHERE title LIKE '[RESTRICTED]%'",
)
def restricted_placeholder(spark, sf):
    return (
        V.normalize_videos(A.raw_videos(spark, sf))
        .filter(F.col("title").startswith("[RESTRICTED]"))
        .select("index", "title", "url", "description", "transcript")
    )


@query(
    "drop_null_entries",
    f"WITH {RAW} SELECT doc_id AS id, text AS entry FROM told WHERE NOT untitled",
)
def drop_null_entries(spark, sf):
    entries = A.raw_videos(spark, sf).select(
        (F.col("index") - 1).cast("bigint").alias("id"), F.col("title").alias("entry")
    )
    return V.drop_null_entries(entries, "entry")


@query(
    "video_url",
    f"""WITH {RAW} SELECT doc_id AS id, CASE WHEN doc_id % 5 <> 0 THEN concat('https://video.example/', doc_id)
  ELSE concat('https://www.youtube.com/watch?v=v', doc_id) END AS url FROM told""",
)
def video_url(spark, sf):
    return A.raw_videos(spark, sf).select(
        (F.col("index") - 1).cast("bigint").alias("id"),
        V.video_url("webpage_url", "video_id").alias("url"),
    )


URLS = """urls AS (
  SELECT page_id AS id, CASE WHEN page_id % 10 = 0 THEN url
    WHEN page_id % 3 = 0 THEN concat('https://www.youtube.com/watch?v=', page_id, '&t=1')
    ELSE concat('https://www.youtube.com/watch?v=', page_id) END AS url FROM pages)"""


@query(
    "extract_video_id",
    f"""WITH {URLS} SELECT id, url,
  CASE WHEN contains(url, 'v=') THEN split_part(string_split(url, 'v=')[-1], '&', 1) END AS video_id
FROM urls""",
)
def extract_video_id(spark, sf):
    return A.video_urls(spark, sf).withColumn("video_id", V.extract_video_id("url"))


VIDEOS = """videos AS (
  SELECT concat(source, '_metadata_and_transcripts.csv') AS source_file, doc_id,
    CASE WHEN doc_id >= 0 THEN text END AS title,
    CAST(n_chars AS INT) AS duration_sec, 'About ' || text AS description, text AS transcript,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) AS index, source
  FROM (SELECT doc_id, text, source, n_chars FROM documents
    UNION ALL SELECT -1 - doc_id, text, source, n_chars FROM documents WHERE doc_id % 23 = 0))"""


@query(
    "index_within_channel", f"WITH {VIDEOS} SELECT source_file, doc_id, index FROM videos"
)
def index_within_channel(spark, sf):
    return A.channel_videos(spark, sf).select("source_file", "doc_id", "index")


@query(
    "merge_channel_videos",
    f"""WITH {VIDEOS} SELECT row_number() OVER (ORDER BY source_file, index) - 1 AS id,
  source_file, doc_id, title, duration_sec, description, transcript, index,
  source AS channel_name FROM videos""",
)
def merge_channel_videos(spark, sf):
    return V.merge_channel_videos(A.channel_videos(spark, sf))


@query(
    "merge_counts",
    f"""WITH {VIDEOS} SELECT source_file, count(*) AS n FROM videos GROUP BY source_file
UNION ALL SELECT NULL, count(*) FROM videos""",
)
def merge_counts(spark, sf):
    return V.merge_counts(A.channel_videos(spark, sf).select("source_file"))


@query(
    "join_snippets",
    """SELECT page_id AS id, concat(substring(url, 1, 5), ' ', page_id, ' ', substring(url, 6)) AS transcript
FROM pages""",
)
def join_snippets(spark, sf):
    parts = [F.substring("url", 1, 5), F.col("page_id").cast("string"), F.expr("substring(url, 6)")]
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"),
        V.join_snippets(F.array(*[F.struct(p.alias("text")) for p in parts])).alias("transcript"),
    )


@query(
    "transcript_status",
    """SELECT page_id AS id, 'ok' AS transcript_status, html AS transcript FROM pages
UNION ALL SELECT -1 - page_id,
  CASE page_id % 9 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid_url' WHEN 2 THEN 'disabled'
    WHEN 3 THEN 'rate_limited' WHEN 4 THEN 'error' WHEN 5 THEN 'none_found' ELSE 'restricted' END, NULL
FROM pages WHERE page_id % 9 < 7""",
)
def transcript_status(spark, sf):
    """Every whole page, and marks beside them."""
    return V.split_transcript_status(A.transcripts(spark, sf))


@query(
    "transcript_pick",
    """SELECT page_id AS video_id,
  CASE WHEN page_id % 4 <> 0 THEN 'en' WHEN page_id % 12 <> 0 THEN 'en-auto' END AS lang,
  CASE WHEN page_id % 4 <> 0 THEN concat('en: ', html)
       WHEN page_id % 12 <> 0 THEN concat('en-auto: ', html)
       ELSE '[No transcript available – manual or automatic]' END AS transcript
FROM pages""",
)
def transcript_pick(spark, sf):
    videos = table(spark, sf, "pages").select(F.col("page_id").alias("video_id"))
    return V.transcript_pick(videos, A.transcript_candidates(spark, sf))


@query(
    "transcribe_resume",
    "SELECT page_id AS video_id, url FROM pages WHERE page_id % 4 = 0",
)
def transcribe_resume(spark, sf):
    videos = table(spark, sf, "pages").select(F.col("page_id").alias("video_id"), "url")
    finished = A.transcript_candidates(spark, sf).filter("priority = 1")
    return V.transcribe_pending(videos, finished)
