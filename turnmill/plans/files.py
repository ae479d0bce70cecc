"""Sinks and sources in turn: each query writes a whole table, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.operators import chat as C
from turnmill.operators import diarization as D
from turnmill.operators import generation as G
from turnmill.operators import judging as J
from turnmill.operators import relevance as R
from turnmill.operators import scenarios as Cases
from turnmill.operators import videos as V
from turnmill.plans import adapters as A
from turnmill.plans.diarization import LABELLED, MANIFEST, STATUS
from turnmill.plans.evaluation import CASES, GENERATED, JUDGED_CASES, VERDICTS, cases, flat
from turnmill.plans.registry import query, table
from turnmill.plans.relevance import _verdicts, verdicts
from turnmill.plans.training import MESSAGES
from turnmill.plans.videos import LINKS, NORMALIZED
from turnmill.session import new_dir
from turnmill.sources import readers, writers


@query("read_channel_list", f"WITH {LINKS} SELECT link FROM links")
def read_channel_list(spark, sf):
    out = new_dir(spark, "links")
    writers.write_table(A.channel_links(spark, sf), out, "csv")
    return readers.read_channel_list(spark, out)


@query("read_raw_metadata", NORMALIZED)
def read_raw_metadata(spark, sf):
    """Raw records as JSON lines; fields that a record lacks are simply not in its line."""
    out = new_dir(spark, "raw")
    writers.write_jsonl(A.raw_videos(spark, sf), out)
    return V.normalize_videos(readers.read_raw_metadata(spark, out)).withColumn(
        "upload_date", F.col("upload_date").cast("string")
    )


@query(
    "read_channel_videos",
    """WITH rows AS (
  SELECT doc_id, text, source, n_chars FROM documents
  UNION ALL SELECT -1 - doc_id, text, source, n_chars FROM documents WHERE doc_id % 23 = 0)
SELECT CASE WHEN doc_id >= 0 THEN text END AS title,
  CASE WHEN doc_id % 13 <> 0 THEN doc_id * 7 END AS views,
  CAST(n_chars AS INT) AS duration_sec, text AS description, '2024-01-31' AS upload_date,
  source AS source_file, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS index
FROM rows""",
)
def read_channel_videos(spark, sf):
    """Channel rows as CSV with their line breaks and quotes, and copies of some with 'N/A' for a title; a
    folder per channel, of one or more files."""
    out, i = new_dir(spark, "channels"), F.col("doc_id")
    rows = A.with_copies_of(table(spark, sf, "documents"), i % 23 == 0).select(
        F.when(F.col("odd"), "N/A").otherwise(F.col("text")).alias("Title"),
        F.when(i % 13 == 0, "N/A").otherwise((i * 7).cast("string")).alias("Views"),
        F.col("n_chars").alias("Duration (sec)"),
        F.lit("20240131").alias("Upload Date"),
        F.col("text").alias("Description"),
        "source",
        "doc_id",
    )
    dealt = writers.dealt_by_key(rows, "source", F.octet_length("Description") * 2, "doc_id", 1 << 20)
    dealt.write.partitionBy("source").options(**writers.CSV_TEXT).csv(out)
    return readers.read_channel_videos(spark, out, folders=True).select(
        "title", "views", "duration_sec", "description", F.col("upload_date").cast("string").alias("upload_date"),
        "source_file", "index",
    )


@query(
    "read_turns",
    f"""WITH {LABELLED} SELECT concat(video_id, '.csv') AS source_file, turn_index, start_time, speaker_label,
  transcript FROM labelled WHERE video_id IN (SELECT video_id FROM labelled GROUP BY ALL HAVING count(*) > 1)""",
)
def read_turns(spark, sf):
    """A folder per file of turns; a file of one turn is no conversation."""
    out = new_dir(spark, "turns")
    writers.write_turns(D.export_turns(A.transcriptions(spark, sf)), out, per_file=True)
    return readers.read_turns(spark, out, folders=True)


ANNOTATED = "id bigint, title string, no_police_presence int, escalation_indicators_score int, minutes double, missing string"


@query(
    "read_annotated",
    """SELECT doc_id AS id, text AS title, CASE quality WHEN 0 THEN 1 WHEN 1 THEN 0 END AS no_police_presence,
  CAST(n_chars % 7 AS INT) AS escalation_indicators_score, CAST(n_chars AS DOUBLE) / 100 AS minutes,
  CAST(NULL AS VARCHAR) AS missing
FROM documents LEFT JOIN labels USING (doc_id)""",
)
def read_annotated(spark, sf):
    """Whole texts and flags in a Windows code page, converted once."""
    out = new_dir(spark, "annotated")
    rows = table(spark, sf, "documents").withColumnsRenamed({"doc_id": "id", "text": "title"}).select(
        F.lit("x").alias("other"), "title", (F.col("n_chars").cast("double") / 100).alias("minutes"), "id"
    )
    rows = rows.join(A.annotated(spark, sf).select("id", "no_police_presence", "escalation_indicators_score"), "id")
    old = spark.conf.get("spark.sql.legacy.javaCharsets", None)
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        rows.write.options(**writers.CSV_TEXT, encoding="cp1252").csv(f"{out}/csv")
        return readers.convert_annotated(spark, f"{out}/csv", f"{out}/table", ANNOTATED)
    finally:
        if old is None:
            spark.conf.unset("spark.sql.legacy.javaCharsets")
        else:
            spark.conf.set("spark.sql.legacy.javaCharsets", old)


@query("read_manifest", f"WITH {MANIFEST} SELECT id, url, minutes FROM manifest")
def read_manifest(spark, sf):
    out = new_dir(spark, "manifest")
    # Another order than the reader's, and a column that it does not know.
    rows = A.manifest(spark, sf).select(F.col("url").alias("URL"), F.lit("t").alias("Title"), "minutes", "id")
    writers.write_table(rows, out, "csv")
    return readers.read_manifest(spark, out)


@query("read_status", f"WITH {STATUS} SELECT id, status FROM status")
def read_status(spark, sf):
    """Status lists as JSON objects, one per line."""
    out = new_dir(spark, "status")
    only = lambda s: F.array_compact(F.array(F.when(F.col("status") == s, F.col("id"))))
    lists = F.struct(only(D.PROCESSED).alias(D.PROCESSED), only(D.IGNORED).alias(D.IGNORED))
    A.status(spark, sf).select(F.to_json(lists).alias("value")).write.text(out)
    return readers.read_status_json(spark, out, json_lines=True)


@query(
    "write_table",
    f"""WITH {_verdicts()} SELECT CAST(id AS VARCHAR) AS id,
  CASE WHEN rejection_reason <> '' THEN rejection_reason END AS rejection_reason FROM verdicts""",
)
def write_table(spark, sf):
    """Accepted and rejected rows as CSV, with the reason only on the rejected ones."""
    out, whole = new_dir(spark, "filter"), verdicts(spark, sf).drop("failures")
    writers.write_table(R.accepted(verdicts(spark, sf)), f"{out}/accepted", "csv")
    writers.write_table(R.rejected(whole), f"{out}/rejected", "csv")
    read = lambda side: spark.read.csv(f"{out}/{side}", header=True, escape='"')
    accepted = read("accepted").select("id", F.lit(None).cast("string").alias("rejection_reason"))
    return accepted.unionByName(read("rejected").select("id", "rejection_reason"))


TOLD = f"""WITH {GENERATED}, told AS (
  SELECT case_id, model_name, string_agg(concat('Officer: ', police, chr(10), 'Civilian: ',
    civilian_generated), chr(10) ORDER BY turn_index) AS conversation_transcript,
    count(*) AS n_turns, string_agg(police, chr(30) ORDER BY turn_index) AS police,
    string_agg(civilian_generated, chr(30) ORDER BY turn_index) AS replies
  FROM generated GROUP BY ALL)"""


def _generated(spark, sf):
    good, _ = writers.split_errors(G.generate_conversations(cases(spark, sf), A.BASELINES))
    return good


@query("write_by_model", f"{TOLD} SELECT * FROM told")
def write_by_model(spark, sf):
    """JSON lines per model, all turns."""
    out = new_dir(spark, "by_model")
    writers.write_by_model(_generated(spark, sf), out)
    schema = (
        "case_id string, conversation_transcript string, model_name string, "
        "generated_conversation array<struct<police string, civilian_generated string>>"
    )
    all_of = lambda name: F.array_join(F.transform("generated_conversation", lambda t: t[name]), "\x1e")
    return spark.read.schema(schema).json(f"{out}/json").select(
        "case_id",
        "model_name",
        "conversation_transcript",
        F.size("generated_conversation").cast("bigint").alias("n_turns"),
        all_of("police").alias("police"),
        all_of("civilian_generated").alias("replies"),
    )


@query(
    "write_model_texts",
    f"""{TOLD}, lines AS (
  SELECT model_name, unnest(string_split(conversation_transcript, chr(10))) AS line FROM told)
SELECT model_name, line, count(*) AS n FROM lines GROUP BY ALL""",
)
def write_model_texts(spark, sf):
    """The transcripts per model as text, read back line by line."""
    out = new_dir(spark, "by_model")
    writers.write_by_model(_generated(spark, sf), out, "conversation_transcript")
    lines = spark.read.schema("value string, model_name string").text(f"{out}/txt")
    return lines.groupBy("model_name", F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("write_errors", f"WITH {VERDICTS} SELECT case_id, model_name, realism_score, error FROM flat")
def write_errors(spark, sf):
    """Judge rows and failures side by side, from one evaluation."""
    out = new_dir(spark, "judged")
    writers.write_with_errors(flat(spark, sf), out)
    return spark.read.parquet(out).select("case_id", "model_name", "realism_score", "error")


@query("write_jsonl", f"WITH {VERDICTS} SELECT case_id, model_name, realism_score, error FROM flat")
def write_jsonl(spark, sf):
    out = new_dir(spark, "judged")
    writers.write_jsonl(flat(spark, sf), out)
    schema = "case_id string, model_name string, realism_score double, error string"
    return spark.read.schema(schema).json(out)


@query(
    "write_dialogues",
    f"""WITH {LABELLED} SELECT video_id, turn_index + 2 AS line_no,
  concat('[', start_time, '] ', speaker_label, ': ', transcript) AS line FROM labelled
UNION ALL SELECT DISTINCT video_id, 0, '--- Detailed Conversation Log ---' FROM labelled
UNION ALL SELECT DISTINCT video_id, 1, '' FROM labelled""",
)
def write_dialogues(spark, sf):
    out = new_dir(spark, "dialogues")
    lines = D.dialogue_lines(A.transcriptions(spark, sf))
    writers.write_dialogues(lines, out)
    return spark.read.schema(lines.schema).parquet(out)


@query(
    "write_turns",
    f"""WITH {LABELLED} SELECT concat(video_id, '.csv') AS source_file, turn_index, start_time,
  speaker_label, transcript FROM labelled""",
)
def write_turns(spark, sf):
    out = new_dir(spark, "turns")
    turns = D.export_turns(A.transcriptions(spark, sf))
    writers.write_turns(turns, out)
    return spark.read.schema(turns.schema).options(**readers.CSV_TEXT).csv(out)


@query(
    "read_chat_jsonl",
    f"""WITH {MESSAGES} SELECT pos, role, content FROM messages""",
)
def read_chat_jsonl(spark, sf):
    out = new_dir(spark, "chat")
    A.chat_records(spark, sf).select("record").write.text(out)
    valid = C.coerce_conversation(readers.read_chat_jsonl(spark, out)).filter("valid")
    return valid.select(F.posexplode("messages").alias("pos", "_m")).select("pos", "_m.role", "_m.content")


@query(
    "read_scenarios",
    f"""WITH {CASES}, filed AS (
  SELECT *, CASE WHEN conv_id % 97 = 5 THEN 1 ELSE row_number() OVER (
    PARTITION BY conv_id % {A.SCENARIO_FILES}, conv_id % 97 = 5 ORDER BY conv_id, block, bad) + 1 END AS place
  FROM cases),
told AS (
  SELECT conv_id, block, bad, string_agg(police, chr(30) ORDER BY turn_index) AS police FROM said GROUP BY ALL)
SELECT CASE WHEN bad OR conv_id % 5 < 2 THEN case_id
    ELSE concat('case_', lpad(CAST(place AS VARCHAR), 4, '0')) END AS case_id,
  scenario_context, character_profile, coalesce(police, '') AS police, error
FROM filed LEFT JOIN told USING (conv_id, block, bad)
UNION ALL SELECT concat('head', i), '', '', 'x', NULL FROM range({A.SCENARIO_FILES}) t(i)""",
)
def read_scenarios(spark, sf):
    """Cases from files of all three roots; ids made by place have the file's name before them."""
    out = new_dir(spark, "scenarios")
    A.scenario_files(spark, sf, out)
    read = [readers.read_scenarios(spark, f"{out}/{part}") for part in ("arrays", "single")]
    normal = Cases.normalize_cases(read[0].unionByName(read[1]))
    return normal.select(
        F.regexp_replace("case_id", r"^part-[^/]*/", "").alias("case_id"),
        "scenario_context", "character_profile", F.array_join("police_turns", "\x1e").alias("police"), "error",
    )


@query(
    "read_judge_cases",
    f"""WITH {JUDGED_CASES} SELECT case_id, scenario_context, profile, ground_truth, model_name,
  target_conversation, conversation_transcript FROM outputs WHERE present""",
)
def read_judge_cases(spark, sf):
    out = new_dir(spark, "cases")
    writers.write_jsonl(A.judge_cases(spark, sf), out)
    read = readers.read_judge_cases(spark, out, json_lines=True)
    return J.case_model_pairs(read, [m.model_name for m in A.BASELINES])


@query(
    "append_run_log",
    """SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(CASE WHEN doc_id % 3 <> 0 THEN doc_id * 10 END, 0) AS input_token,
  coalesce(CASE WHEN doc_id % 4 <> 0 THEN doc_id * 2 END, 0) AS output_token,
  coalesce(CASE WHEN doc_id % 2 <> 0 THEN doc_id END, 0) AS thought_token,
  round(coalesce(CASE WHEN doc_id % 5 <> 0 THEN CAST(n_chars AS DOUBLE) / 8 END, 0.0), 2) AS execution_time_sec,
  'baseline' AS model_name, run FROM documents CROSS JOIN (VALUES ('first'), ('second')) runs(run)""",
)
def append_run_log(spark, sf):
    """Two runs in a log, of which the first was repeated."""
    out = new_dir(spark, "log")
    rows = D.diarization_log(A.diarization_usage(spark, sf), "baseline")
    for run in ("first", "second", "first"):
        writers.append_log(rows, out, run)
    return spark.read.schema(T.StructType([*rows.schema, T.StructField("run", T.StringType())])).parquet(out)
