import json

from turnmill.operators import diarization as D

RESPONSE = {
    "task1_transcripts": [
        {"start": "00:01", "text": "Stop.", "voice": 1},
        {"start": "00:02", "text": "Why?", "voice": 2},
        {"start": "00:03", "text": "Hm.", "voice": 3},
        {"start": "00:04", "text": "Go.", "voice": 4},
        {"start": "00:05", "text": "End.", "voice": 9},
    ],
    "task2_speakers": [
        {"voice": 1, "name": "First", "company": "?", "position": "?", "role_in_video": "?"},
        {"voice": 1, "name": "Last", "company": "?", "position": "?", "role_in_video": "?"},
        {"voice": 2, "name": "?", "company": "?", "position": "Driver", "role_in_video": "x"},
        {"voice": 3, "name": "", "company": "?", "position": "?", "role_in_video": "Witness"},
        {"voice": 4, "name": "?", "company": "?", "position": "?", "role_in_video": "?"},
    ],
}


def responses(spark):
    whole = json.dumps(RESPONSE)
    rows = [("a", whole), ("b", whole[:40]), ("c", None), ("d", "[]"), ("e", "{}")]
    return D.read_response(spark.createDataFrame(rows, "video_id string, response string"))


def test_unreadable_responses_are_empty(spark):
    got = {r.video_id: r for r in responses(spark).collect()}
    assert {i: r.parsed for i, r in got.items()} == {"a": True, "b": False, "c": False, "d": False, "e": True}
    assert all(len(got[i].task1_transcripts) == 0 for i in "bcde")
    assert len(got["a"].task2_speakers) == 5


def test_labels(spark):
    got = D.label_turns(responses(spark)).orderBy("turn_index").collect()
    assert [(r.turn_index, r.speaker_label) for r in got] == [
        (0, "Last"), (1, "[Driver]"), (2, "[Witness]"), (3, "[Voice 4]"), (4, "[Voice 9]"),
    ]


def test_dialogue_and_turn_export(spark):
    lines = D.dialogue_lines(responses(spark).filter("video_id = 'a'")).orderBy("line_no").collect()
    assert [r.line for r in lines[:3]] == [D.DIALOGUE_HEADING, "", "[00:01] Last: Stop."]
    empty = D.dialogue_lines(responses(spark).filter("video_id = 'b'")).count()
    assert empty == 2
    turns = D.export_turns(responses(spark)).orderBy("turn_index").collect()
    assert turns[1].asDict() == {
        "source_file": "a.csv", "turn_index": 1, "start_time": "00:02",
        "speaker_label": "[Driver]", "transcript": "Why?",
    }


def test_pending_and_duration(spark):
    manifest = spark.createDataFrame(
        [("007", "u", 45.0), ("2", "u", 45.01), ("3", "u", None), ("4", "u", float("nan")), ("5", "u", 1.0)],
        "id string, url string, minutes double",
    )
    long = {r.id: r.too_long for r in D.duration_guard(manifest).collect()}
    assert long == {"007": False, "2": True, "3": False, "4": False, "5": False}
    status = spark.createDataFrame(
        [("007", "processed"), ("007", "ignore"), ("007", "processed"), ("5", "failed")],
        "id string, status string",
    )
    assert sorted(r.id for r in D.pending_videos(manifest, status).collect()) == ["2", "3", "4", "5"]
    assert {r.status: r.n for r in D.status_summary(status).collect()} == {
        "processed": 1, "ignore": 1, "failed": 1,
    }
    assert D.single_video(manifest, "007").count() == 1


def test_log_and_durations(spark):
    df = spark.createDataFrame(
        [("a", 5, None, 1, 1.234), ("b", None, None, None, None)],
        "id string, input_token bigint, output_token bigint, thought_token bigint, "
        "execution_time_sec double",
    )
    got = {r.id: tuple(r)[1:] for r in D.diarization_log(df, "m").collect()}
    assert got == {"a": (5, 0, 1, 1.23, "m"), "b": (0, 0, 0, 0.0, "m")}
    names = ["x_PT1H2M3S.mp3", "/d/x_PT59M.mp3", "x_PT.mp3", "x.mp3", "x_PT1H", "x_PT1Hy.mp3"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    got = rows.select(D.iso_duration_seconds("n"), D.timecode_format("n")).collect()
    assert [r[0] for r in got] == [3723, 3540, 0, None, 3600, None]
    assert [r[1] for r in got] == ["MM:SS or H:MM:SS", "MM:SS", "MM:SS", "MM:SS", "MM:SS or H:MM:SS", "MM:SS"]
