import json

from pyspark.sql import functions as F

from turnmill import jobs
from turnmill.operators import chat
from turnmill.operators.generation import builtin_factory
from turnmill.operators.models import ModelSpec
from turnmill.operators.scoring import HashEncoder
from turnmill.operators.transcription import transcribe_videos
from turnmill.sources import readers

SPECS = [
    ModelSpec("echo", "e", "base"),
    ModelSpec("repeat", "e", "fine_tuned"),
    ModelSpec("later", "l", "base", "local_unsloth", "CHANGE_ME/x"),
]


def test_filter_run(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 0, 2, 2, 1), (2, 1, 2, 2, 1), (3, 0, 0, 2, 1)],
        "id int, no_police_presence int, police_presence_signals_score int, "
        "interaction_type_signals_score int, deescalation_indicators_score int",
    )
    dry = jobs.filter_videos(df, None)
    assert dry["summary"].first().accepted == 1 and not list(tmp_path.iterdir())
    out = str(tmp_path / "f")
    jobs.filter_videos(df, out)
    assert spark.read.parquet(f"{out}/rejected").count() == 2
    lines = [r.value for r in spark.read.text(f"{out}/summary").collect()]
    assert lines[0] == "Total rows processed: 3" and len(lines) == 7


def test_reply_run(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "start_time,speaker_label,transcript\n0:1,Officer,Step out.\n0:2,John,Step out. Why?\n"
        "0:3,Officer,Now!\n0:4,John,Step out. Why?\n"
    )
    turns = readers.read_turns(spark, str(tmp_path))
    got = jobs.evaluate_replies(turns, str(tmp_path / "out"), SPECS, builtin_factory)
    rows = {(r.model_name, r.turn_index): r for r in got["scored"].collect()}
    assert len(rows) == 4
    assert rows["repeat", 2].rouge_l == 1.0 and rows["repeat", 0].predicted_response == ""
    assert [r.n_turns for r in got["models"].collect()] == [2, 2]
    assert got["files"].count() == 2 and rows["echo", 0].embedding_f1 is None
    with_vectors = jobs.evaluate_replies(
        turns, str(tmp_path / "out2"), SPECS, builtin_factory, ["repeat"], encoder=HashEncoder
    )
    assert {r.turn_index: r.embedding_f1 for r in with_vectors["scored"].collect()} == {0: 0.0, 2: 1.0}


def test_generation_run(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"cases": [
        {"case_id": "a", "police_dialogue": ["Hi", "Go"]}, {"police_dialogue": []}]}))
    got = jobs.generate(spark, str(tmp_path / "s.json"), str(tmp_path / "out"), SPECS, builtin_factory)
    rows = {(r.case_id, r.model_name): r for r in got.collect()}
    assert set(rows) == {(c, m) for c in ("a", "s.json/case_0002") for m in ("echo", "repeat")}
    assert rows["a", "echo"].conversation_transcript.endswith("Civilian: 4 Go")
    assert rows["s.json/case_0002", "echo"].error.startswith("No police dialogue")


def test_judge_run(spark, tmp_path):
    class Fair:
        def judge(self, prompt):
            return '{"Score": 90, "look_Real": 1, "final_score": 60}'

    (tmp_path / "c.json").write_text(json.dumps([{"case_id": "a", "model_outputs": {
        "echo": {"target_conversation": "t"}}}]))
    cases = readers.read_judge_cases(spark, str(tmp_path / "c.json"))
    got = jobs.judge(cases, str(tmp_path / "out"), Fair, ["echo", "repeat"], wait_seconds=0)
    assert [tuple(r)[:4] for r in got["models"].collect()] == [("echo", 90.0, 1.0, 60.0)]
    assert [r.model_name for r in got["skipped"].collect()] == ["repeat"]


def test_merge_and_diarize_runs(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a_metadata_and_transcripts.csv").write_text("Index,Title,URL\n1,T,u\n2,S,v\n")
    merged = jobs.merge_channels(spark, str(src), str(tmp_path / "merged"))
    assert sorted(r.id for r in merged.collect()) == [0, 1]

    class Says:
        def transcribe(self, video_id, url):
            return {"response": '{"task1_transcripts":[{"start":"0:1","text":"Hi","voice":1}]}'}

    manifest = merged.select(
        F.col("id").cast("string").alias("id"), "url", (F.col("id") * 100.0).alias("minutes")
    )
    manifest.coalesce(1).write.json(str(tmp_path / "manifest"))
    stream = spark.readStream.schema("id string, url string, minutes double").json(str(tmp_path / "manifest"))
    turns = jobs.diarize_arrivals(stream, str(tmp_path / "out"), Says)
    assert [(r.source_file, r.speaker_label, r.transcript) for r in turns.collect()] == [
        ("0.csv", "[Voice 1]", "Hi")
    ]


def test_failed_videos_get_another_try(spark, tmp_path):
    class Says:
        def __init__(self, text):
            self.text = text

        def transcribe(self, video_id, url):
            return {"response": self.text}

    schema = "id string, url string, minutes double"
    source, out = tmp_path / "manifest", str(tmp_path / "out")
    source.mkdir()
    stream = lambda: spark.readStream.schema(schema).json(str(source))
    assert jobs.diarize_arrivals(stream(), out, lambda: Says("x")).count() == 0  # nothing arrived
    (source / "a.json").write_text('{"id": "1", "url": "u", "minutes": 1.0}\n')
    assert jobs.diarize_arrivals(stream(), out, lambda: Says("not JSON")).count() == 0
    whole = lambda: Says('{"task1_transcripts":[{"start":"0:1","text":"Hi","voice":1}]}')
    manifest = spark.read.schema(schema).json(str(source))
    assert jobs.diarize_arrivals(stream(), out, whole).count() == 0
    assert [r.transcript for r in jobs.diarize_arrivals(stream(), out, whole, retry=manifest).collect()] == ["Hi"]


def test_training_data_run(spark, tmp_path):
    rows = [(str(i), json.dumps({"messages": [{"role": "user", "content": f"q{i}"}]})) for i in range(40)] + [("x", "{}")]
    got = jobs.training_data(spark.createDataFrame(rows, "record_id string, record string"), str(tmp_path / "t"), "qwen")
    texts = {r.record_id: r.text for side in got.values() for r in side.collect()}
    assert set(texts) == {str(i) for i in range(40)} and "q7" in texts["7"] and got["eval"].count() > 0


def test_plans_report_without_running(spark, tmp_path):
    class Never:
        def transcribe(self, video_id, url):
            raise ValueError("called")

    class Says:
        def transcribe(self, video_id, url):
            if video_id == "b":
                return {"response": "no list"}
            return {"response": '{"task1_transcripts":[{"start":"0:1","text":"Hi","voice":1}]}'}

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id string, url string, minutes double"
    add = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(src)
    plan = lambda factory: jobs.plan_diarization(
        spark.read.schema(schema).json(src), spark.readStream.schema(schema).json(src), out, factory
    )
    add([("a", "u", 1.0), ("b", "u", 1.0), ("long", "u", 90.0)])
    first = plan(Never).report()
    assert first["steps"] == {"manifest": 3, "done": 0, "failed_before": 0, "too_long": 1, "to_transcribe": 2}
    assert first["outputs"]["results"] == f"{out}/results" and not (tmp_path / "out").exists()
    plan(Says).run()
    add([("c", "u", 1.0)])
    again = plan(Never).report()
    assert again["steps"] == {"manifest": 4, "done": 2, "failed_before": 1, "too_long": 0, "to_transcribe": 2}

    alone = spark.createDataFrame([("a", "u")], "id string, url string")
    failed = transcribe_videos(alone, Never, tries=1).first()
    assert (failed.id, failed.response, failed.error) == ("a", None, "called")

    records = spark.createDataFrame(
        [(f"r{i}", json.dumps({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]})) for i in range(40)]
        + [("bad", "{")], "record_id string, record string",
    )
    family = next(iter(chat.TRAINING_SETUPS))
    planned = jobs.plan_training(records, str(tmp_path / "train"), family)
    steps = planned.report()["steps"]
    assert steps["records"] == 41 and steps["texts"] == 40 == steps["train"] + steps["eval"]
    assert not (tmp_path / "train").exists()
    sides = planned.run()
    assert {s: df.count() for s, df in sides.items()} == {s: steps[s] for s in ("train", "eval")}
