"""Diarization queries."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from turnmill.operators import diarization as D
from turnmill.operators import transcription as X
from turnmill.plans import adapters as A
from turnmill.plans.registry import query, table

MANIFEST = """manifest AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, doc_id,
    concat('https://www.youtube.com/watch?v=', doc_id) AS url,
    CAST(n_chars AS DOUBLE) / 100 AS minutes FROM documents)"""


@query(
    "pending_videos",
    f"""WITH {MANIFEST} SELECT id, url, minutes FROM manifest
WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0""",
)
def pending_videos(spark, sf):
    return D.pending_videos(A.manifest(spark, sf), A.status(spark, sf))


@query("single_id", f"WITH {MANIFEST} SELECT id, url, minutes FROM manifest WHERE id = '15'")
def single_id(spark, sf):
    """One video by its id, also when it was processed before."""
    return D.single_video(A.manifest(spark, sf), "15")


@query(
    "duration_guard",
    f"WITH {MANIFEST} SELECT id, minutes, minutes > 45 AS too_long FROM manifest",
)
def duration_guard(spark, sf):
    return D.duration_guard(A.manifest(spark, sf)).drop("url")


STATUS = """status AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'processed' AS status FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'ignore' FROM documents WHERE doc_id % 5 = 0)"""


@query(
    "status_summary", f"WITH {STATUS} SELECT status, count(*) AS n FROM status GROUP BY status"
)
def status_summary(spark, sf):
    return D.status_summary(A.status(spark, sf))


@query("latest_status", f"WITH {STATUS} SELECT id, status FROM status")
def latest_status(spark, sf):
    marks = A.status(spark, sf)
    return D.latest_status(marks.unionByName(marks.filter("status = 'ignore'")))


@query(
    "token_usage",
    """SELECT CAST(doc_id AS VARCHAR) AS id,
  CASE WHEN doc_id % 3 <> 0 THEN doc_id * 10 ELSE 0 END AS input_token,
  CASE WHEN doc_id % 4 <> 0 THEN doc_id * 2 ELSE 0 END AS output_token,
  CASE WHEN doc_id % 2 <> 0 THEN doc_id ELSE 0 END AS thought_token,
  CASE WHEN doc_id % 5 <> 0 THEN round(CAST(n_chars AS DOUBLE) / 8, 2) ELSE 0 END
    AS execution_time_sec,
  'baseline' AS model_name
FROM documents""",
)
def token_usage(spark, sf):
    return D.diarization_log(A.diarization_usage(spark, sf), "baseline")


LABELLED = """labelled AS (
  SELECT concat(conv_id, '_', turn // 64) AS video_id, CAST(turn % 64 AS INT) AS turn_index,
    format('{:02d}:{:02d}', turn * 7 // 60, turn * 7 % 60) AS start_time,
    CASE WHEN role NOT IN ('user', 'assistant') THEN '[Voice 3]'
      WHEN conv_id % 4 = 0 THEN concat('Person ', CASE role WHEN 'user' THEN 1 ELSE 2 END)
      WHEN conv_id % 4 = 1 THEN concat('[Rank ', CASE role WHEN 'user' THEN 1 ELSE 2 END, ']')
      WHEN conv_id % 4 = 2 THEN concat('[Role ', CASE role WHEN 'user' THEN 1 ELSE 2 END, ']')
      WHEN role = 'user' THEN 'Last'
      ELSE '[Voice 2]' END AS speaker_label,
    text AS transcript
  FROM conversations)"""


@query("label_turns", f"WITH {LABELLED} SELECT * FROM labelled")
def label_turns(spark, sf):
    return D.label_turns(A.transcriptions(spark, sf))


@query(
    "export_turns",
    f"""WITH {LABELLED} SELECT concat(video_id, '.csv') AS source_file,
  * EXCLUDE (video_id) FROM labelled""",
)
def export_turns(spark, sf):
    return D.export_turns(A.transcriptions(spark, sf))


@query(
    "export_dialogue_txt",
    f"""WITH {LABELLED}
SELECT video_id, turn_index + 2 AS line_no,
  concat('[', start_time, '] ', speaker_label, ': ', transcript) AS line FROM labelled
UNION ALL SELECT DISTINCT video_id, 0, '--- Detailed Conversation Log ---' FROM labelled
UNION ALL SELECT DISTINCT video_id, 1, '' FROM labelled""",
)
def export_dialogue_txt(spark, sf):
    return D.dialogue_lines(A.transcriptions(spark, sf))


@query(
    "read_transcriptions",
    """SELECT concat(conv_id, '_', turn // 64) AS video_id, true AS parsed,
  CAST(count(*) AS INT) AS n_segments, 2 AS n_speakers,
  string_agg(text, chr(30) ORDER BY turn) AS texts
FROM conversations GROUP BY conv_id, turn // 64
UNION ALL
SELECT DISTINCT concat(conv_id, '_', turn // 64, '_broken'), false, 0, 0, ''
FROM conversations WHERE conv_id % 7 = 0""",
)
def read_transcriptions(spark, sf):
    return D.read_response(A.responses(spark, sf)).select(
        "video_id",
        "parsed",
        F.size("task1_transcripts").alias("n_segments"),
        F.size("task2_speakers").alias("n_speakers"),
        F.array_join(F.transform("task1_transcripts", lambda s: s["text"]), "\x1e").alias("texts"),
    )


class LineTranscriber:
    """Baseline transcriber: a segment for each line of the address; some ids are cut short or fail."""

    def transcribe(self, video_id: str, url: str) -> dict:
        number, _, kind = video_id.partition("_")
        if kind == "silent":
            raise ValueError("no audio")
        segments = [{"start": "00:00", "text": line, "voice": 1} for line in url.split("\n")]
        whole = json.dumps({"task1_transcripts": segments})
        return {"response": whole[:-3] if kind == "broken" else whole, "input_token": int(number)}


@query(
    "transcribe_videos",
    """WITH spoken AS (
  SELECT doc_id, kind, coalesce(text, '') AS said, CAST(n_chars AS DOUBLE) / 100 AS minutes
  FROM documents CROSS JOIN (VALUES (''), ('_broken'), ('_silent')) kinds(kind)
  WHERE kind = '' OR kind = '_broken' AND doc_id % 7 = 0 OR kind = '_silent' AND doc_id % 11 = 0)
SELECT concat(doc_id, kind) AS id,
  CASE WHEN kind = '' THEN CAST(len(string_split(said, chr(10))) AS INT) ELSE 0 END AS n_segments,
  CASE WHEN kind = '' THEN said ELSE '' END AS texts,
  CASE WHEN kind = '_silent' THEN 0 ELSE doc_id END AS input_token, 0::BIGINT AS output_token,
  CASE kind WHEN '_silent' THEN 'no audio' WHEN '_broken' THEN 'Could not parse the structured response.' END AS error
FROM spoken WHERE (kind <> '' OR doc_id % 3 <> 0 AND doc_id % 5 <> 0) AND minutes <= 45""",
)
def transcribe_videos(spark, sf):
    """All segments of the videos that are open and not too long."""
    pending = D.pending_videos(A.spoken(spark, sf), A.status(spark, sf))
    short = D.duration_guard(pending).filter("not too_long")
    responses = X.transcribe_videos(short, LineTranscriber, tries=2, first_wait=0, wait_step=0)
    texts = F.transform("task1_transcripts", lambda s: s["text"])
    return D.token_usage(X.parsed_transcriptions(responses)).select(
        "id",
        F.size("task1_transcripts").alias("n_segments"),
        F.array_join(texts, "\n").alias("texts"),
        "input_token",
        "output_token",
        "error",
    )


SUFFIXES = ["", "_PT1H2M3S", "_PT45M", "_PT", "_PT59M59S", "_PT2H", "_PT90S.x"]


@query(
    "iso_duration",
    """SELECT doc_id AS id,
  CAST(CASE doc_id % 7 WHEN 1 THEN 3723 WHEN 2 THEN 2700 WHEN 3 THEN 0 WHEN 4 THEN 3599
    WHEN 5 THEN 7200 END AS BIGINT) AS seconds,
  CASE WHEN doc_id % 7 IN (1, 5) THEN 'MM:SS or H:MM:SS' ELSE 'MM:SS' END AS timecode
FROM documents""",
)
def iso_duration(spark, sf):
    n = (F.col("doc_id") % len(SUFFIXES) + 1).cast("int")
    name = F.concat(
        F.lit("/audio/clip"),
        F.col("doc_id"),
        F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), n),
        F.lit(".mp3"),
    )
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        D.iso_duration_seconds(name).alias("seconds"),
        D.timecode_format(name).alias("timecode"),
    )
