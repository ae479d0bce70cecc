import json
import random
import re

import pytest
from pyspark.sql import functions as F

from turnmill.operators import scenarios as C
from turnmill.operators.videos import merge_channel_videos
from turnmill.sources import json_arrays
from turnmill.sources import readers as R
from turnmill.sources import writers as W


def put(folder, name, text, encoding="utf-8"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder)


def test_turn_files(spark, tmp_path):
    path = put(tmp_path, "b.csv", 'start_time,speaker_label,transcript\n0:1,Officer,"a, ""q""\nline"\n0:2,Civ,None\n')
    put(tmp_path, "a.csv", "transcript,start_time,speaker_label\nx,0:1,P\ny,0:2,\n")
    put(tmp_path, "short.csv", "start_time,speaker_label,transcript\n0:1,P,x\n")
    put(tmp_path, "other.csv", "start_time,text\n0:1,x\n0:2,y\n")
    put(tmp_path, "empty.csv", "")
    put(tmp_path, "c d%20+é[1].csv", "start_time,speaker_label,transcript\n0:1,P,x\n0:2,Q,y\n")
    put(tmp_path, "notes.txt", "speaker_label,transcript\na,b\nc,d\n")
    got = R.read_turns(spark, path).orderBy("source_file", "turn_index").collect()
    assert [(r.source_file, r.turn_index, r.speaker_label, r.transcript) for r in got] == [
        ("a.csv", 0, "P", "x"), ("a.csv", 1, None, "y"),
        ("b.csv", 0, "Officer", 'a, "q"\nline'), ("b.csv", 1, "Civ", "None"),
        ("c d%20+é[1].csv", 0, "P", "x"), ("c d%20+é[1].csv", 1, "Q", "y"),
    ]
    same = put(tmp_path / "same", "a.csv", "start_time,speaker_label,transcript\n0:1,P,x\n0:2,Q,y\n")
    known = R.read_turns(spark, same, ["start_time", "speaker_label", "transcript"])
    assert known.count() == 2 and known.filter("turn_index = 1").first().transcript == "y"


def test_channel_files(spark, tmp_path):
    head = "Index,Title,URL,Uploader,Views,Upload Date,Duration (sec),Description,Transcript\n"
    path = put(tmp_path, "b_c_metadata_and_transcripts.csv",
               head + '1,T1,u1,U,10,20240102,60,"d\nd",\n2,[RESTRICTED] ID: x,u2,N/A,N/A,N/A,N/A,d,t\n')
    put(tmp_path, "a_metadata_and_transcripts.csv", "Title,Index,URL\nT0,1,u0\n")
    put(tmp_path, "z.csv", head)
    videos = R.read_channel_videos(spark, path)
    got = merge_channel_videos(videos).orderBy("id").collect()
    assert [(r.id, r.channel_name, r.title) for r in got] == [
        (0, "a", "T0"), (1, "b_c", "T1"), (2, "b_c", "[RESTRICTED] ID: x"),
    ]
    assert (got[1].views, str(got[1].upload_date), got[1].description) == (10, "2024-01-02", "d\nd")
    assert (got[2].views, got[2].upload_date, got[2].uploader, got[0].views) == (None, None, None, None)


def test_windows_code_page(spark, tmp_path):
    path = put(tmp_path, "f.csv", "id,text\n1,é – ok\n", "cp1252")
    assert R.read_annotated(spark, path, "id int, text string").first().text == "é – ok"


def test_manifest_status_and_links(spark, tmp_path):
    path = put(tmp_path / "m", "m.csv", "id,URL,minutes\n007,u,44.5\n8,v,\n")
    rows = R.read_manifest(spark, path).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("007", "u", 44.5), ("8", "v", None)]
    status = put(tmp_path / "s", "s.json", '{"processed": ["1", "2"],\n "ignore": ["3"]}')
    assert sorted(tuple(r) for r in R.read_status_json(spark, status).collect()) == [
        ("1", "processed"), ("2", "processed"), ("3", "ignore"),
    ]
    broken = put(tmp_path / "x", "s.json", "{nope")
    assert R.read_status_json(spark, broken).count() == 0
    links = put(tmp_path / "l", "l.csv", "link\nhttps://y/@a\n")
    assert R.read_channel_list(spark, links).first().link == "https://y/@a"


def test_scenario_roots(spark, tmp_path):
    one = {"case_id": "x", "police_dialogue": ["a"]}
    for name, root in (("list", [one, {"police_dialogue": ["b"]}]), ("cases", {"cases": [one]}), ("one", one)):
        path = put(tmp_path / name, "f.json", json.dumps(root, indent=1))
        ids = lambda **kw: [r.case_id for r in C.normalize_cases(R.read_scenarios(spark, path, **kw)).orderBy("case_id").collect()]
        assert ids() == (["f.json/case_0002", "x"] if name == "list" else ["x"])
        assert ids(single=True) == (["case_0002", "x"] if name == "list" else ["x"])


def test_ids_stay_when_files_are_added(spark, tmp_path):
    path = put(tmp_path, "a.json", json.dumps([{"police_dialogue": ["a"]}, {"police_dialogue": ["b"]}]))
    ids = lambda: {r.case_id for r in C.normalize_cases(R.read_scenarios(spark, path)).collect()}
    before = ids()
    put(tmp_path, "b.json", json.dumps([{"police_dialogue": ["c"]}]))
    assert before == {"a.json/case_0001", "a.json/case_0002"} and ids() == before | {"b.json/case_0001"}


def random_json(draw, depth=0):
    kind = draw.random()
    if depth > 3 or kind < 0.35:
        return draw.choice([None, True, 7, -1.5, "", "a}b{", 'q"u\\"o', "\\", "]},[", "ü\n☃", '{"x":["}"]}'])
    if kind < 0.6:
        return [random_json(draw, depth + 1) for _ in range(draw.randint(0, 3))]
    return {draw.choice(['k', 'c}a', 'q"', "cases"]) + str(i): random_json(draw, depth + 1) for i in range(draw.randint(0, 3))}


@pytest.mark.parametrize("split", ["53b", "128m"])
def test_arrays_in_pieces_equal_the_parser(spark, tmp_path, split):
    draw, want = random.Random(11), {}
    for k in range(24):
        items = [random_json(draw) if draw.random() < 0.3 else {"i": i, "v": random_json(draw)} for i in range(draw.randint(0, 6))]
        indent = draw.choice([None, 1])
        if k % 2:
            root = {"cases": items, **({"meta": {"a": {"b": [1]}}, "n": "}"} if k % 4 == 1 and items and isinstance(items[-1], dict) else {})}
        else:
            root = items
        put(tmp_path, f"f {k}+.json", json.dumps(root, indent=indent, ensure_ascii=False) + draw.choice(["", "\n", " \n\n"]))
        want[f"f {k}+.json"] = items
    put(tmp_path, "one.json", json.dumps({"a": {"b": "}"}}))
    put(tmp_path, "late.json", json.dumps({"x": {"y": 1}, "cases": [{"z": 2}, 3]}))
    put(tmp_path, "mark.json", "\ufeff" + json.dumps([{"a": 1}, {"b": 2}]))
    want |= {"one.json": [{"a": {"b": "}"}}], "late.json": [{"z": 2}, 3], "mark.json": [{"a": 1}, {"b": 2}]}
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = R.read_scenarios(spark, str(tmp_path)).select("source_file", "pos", F.to_json("case").alias("j")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {}
    for r in sorted(rows, key=lambda r: (r.source_file, r.pos)):
        assert r.pos == len(got.setdefault(r.source_file, []))
        got[r.source_file].append(json.loads(r.j))
    assert got == {f: items for f, items in want.items() if items}


def test_a_large_array_is_read_by_many_tasks(spark, tmp_path):
    cases = [{"case_id": f"c{i}", "police_dialogue": [f"say }} {i}" * 20]} for i in range(9000)]
    path = put(tmp_path, "big.json", json.dumps(cases))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        parts = json_arrays.pieces(spark, path)
        assert parts.rdd.getNumPartitions() > 20
        share = parts.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] / parts.count()
        assert share < 0.1
        got = C.normalize_cases(R.read_scenarios(spark, path)).select("case_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.case_id for r in got} == {c["case_id"] for c in cases} and len(got) == 9000


def test_bad_json_is_an_error(spark, tmp_path):
    for k, text in enumerate(['[{"a": 1}, {"b": }]', '"text"', "[1, 2", "{nope}"]):
        path = put(tmp_path / str(k), "f.json", text)
        with pytest.raises(Exception):
            R.read_scenarios(spark, path).collect()
    assert R.read_scenarios(spark, put(tmp_path / "e", "f.json", "[ ]")).count() == 0


def test_judge_cases(spark, tmp_path):
    cases = [
        {"case_id": "c", "profile": {"a": 1}, "model_outputs": {
            "m1": {"target_conversation": "t"},
            "m2": {"target_conversation": "t", "conversation_transcript": None},
            "m3": {"target_conversation": "t", "conversation_transcript": "u"}}},
    ]
    for lines in (False, True):
        text = json.dumps(cases[0]) if lines else json.dumps(cases)
        path = put(tmp_path / str(lines), "f.json", text)
        got = R.read_judge_cases(spark, path, json_lines=lines).first()
        assert (got.case_id, got.profile, got.scenario_context) == ("c", '{"a":1}', "")
        assert {m: o.conversation_transcript for m, o in got.model_outputs.items()} == {
            "m1": "t", "m2": None, "m3": "u",
        }


def test_chat_and_raw_lines(spark, tmp_path):
    path = put(tmp_path / "c", "c.jsonl", '{"messages": []}\n\n{"conversations": []}\n')
    assert R.read_chat_jsonl(spark, path).count() == 2
    raw = put(tmp_path / "r", "r.json", '{"index": 1, "video_id": "v", "view_count": 5, "x": 1}\n')
    row = R.read_raw_metadata(spark, raw).first()
    assert (row.video_id, row.view_count, row.title) == ("v", "5", None)


def test_outputs(spark, tmp_path):
    df = spark.createDataFrame(
        [("c1", "m1", "l1\nl2", None), ("c1", "m2", "x", None), ("c2", "m1", None, "bad")],
        "case_id string, model_name string, conversation_transcript string, error string",
    )
    out = str(tmp_path / "by_model")
    good, bad = W.split_errors(df)
    W.write_by_model(good, out, "conversation_transcript")
    back = spark.read.json(f"{out}/json")
    assert {(r.case_id, r.model_name) for r in back.collect()} == {("c1", "m1"), ("c1", "m2")}
    assert bad.count() == 1
    W.write_with_errors(df, str(tmp_path / "both"))
    both = spark.read.parquet(str(tmp_path / "both"))
    assert {r.outcome: r["count"] for r in both.groupBy("outcome").count().collect()} == {"ok": 2, "error": 1}
    W.write_table(df, str(tmp_path / "csv"), "csv")
    read = spark.read.csv(str(tmp_path / "csv"), header=True, multiLine=True, escape='"')
    assert read.count() == 3
    W.append_log(df, str(tmp_path / "log"))
    W.append_log(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    for run, rows in (("r 1/x", df), ("r2", df.limit(1)), ("r 1/x", df)):
        W.append_log(rows, str(tmp_path / "runs"), run)
    logged = spark.read.parquet(str(tmp_path / "runs")).groupBy("run").count()
    assert {r.run: r["count"] for r in logged.collect()} == {"r 1/x": 3, "r2": 1}
    W.write_jsonl(df, str(tmp_path / "jsonl"))
    assert spark.read.text(str(tmp_path / "jsonl")).count() == 3


def test_ordered_text_outputs(spark, tmp_path):
    lines = spark.range(200).select(
        F.concat(F.lit("v"), F.col("id") % 2).alias("video_id"),
        F.col("id").alias("line_no"), F.col("id").cast("string").alias("line"),
    ).coalesce(1).orderBy(F.rand(1))
    out = str(tmp_path / "txt")
    W.write_dialogues(lines.coalesce(1), out, per_video=True)
    got = "".join(p.read_text() for p in sorted((tmp_path / "txt" / "video_id=v1").glob("*.txt")))
    assert got.split() == [str(i) for i in range(1, 200, 2)]
    W.write_summary(lines.limit(5), str(tmp_path / "summary"))
    turns = lines.selectExpr("video_id as source_file", "line_no as turn_index", "line as transcript")
    W.write_turns(turns, str(tmp_path / "turns"), per_file=True)
    assert spark.read.csv(str(tmp_path / "turns"), header=True).count() == 200


def files_of(path):
    return [p for p in path.rglob("part-*") if p.suffix != ".crc"]


@pytest.mark.parametrize("hot, keys", [(6000, 40), (0, 300)])
def test_files_of_skewed_and_of_many_keys(spark, tmp_path, hot, keys):
    """Files are at most the keys and the total size by that of a file, and no file is much larger."""
    rows = spark.range(hot + 8 * keys).repartition(9).select(
        F.when(F.col("id") < hot, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % keys)).alias("model_name"),
        F.col("id").alias("case_id"),
        F.concat(F.lit("text "), "id", F.lit("\nx" * 10)).alias("told"),
    )
    target = 16384
    W.write_by_model(rows, str(tmp_path / "out"), "told", file_bytes=target)
    n, total = keys + (hot > 0), 0
    for kind in ("json", "txt"):
        files = files_of(tmp_path / "out" / kind)
        total = sum(f.stat().st_size for f in files)
        assert len(files) <= n + total / target
        assert max(f.stat().st_size for f in files) < 1.2 * target
    back = spark.read.json(str(tmp_path / "out" / "json"))
    assert back.count() == rows.count() == back.select("case_id").distinct().count()
    assert spark.read.text(str(tmp_path / "out" / "txt")).count() == 11 * rows.count()


def test_a_long_dialogue_is_cut_in_order(spark, tmp_path):
    lines = spark.range(3000).repartition(5).select(
        F.when(F.col("id") < 2900, "long").otherwise("short").alias("video_id"),
        F.col("id").alias("line_no"), F.concat(F.lit("line "), "id").alias("line"),
    )
    W.write_dialogues(lines, str(tmp_path / "d"), per_video=True, file_bytes=8000)
    files = sorted(files_of(tmp_path / "d" / "video_id=long"))
    assert 2 < len(files) <= 2 + 2900 * 10 // 8000
    parts = [[int(x.split()[1]) for x in f.read_text().splitlines()] for f in files]
    assert sum(parts, []) == list(range(2900))
    assert len(files_of(tmp_path / "d" / "video_id=short")) == 1


def windows(df):
    """Partition and order of each window in the plan, without column numbers."""
    text = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    return re.findall(r"Window \[.*\], \[(.*?)\], \[(.*?)\]", text) + re.findall(r"Window \[.*\], \[([^\]]*)\]$", text, re.M)


def test_places_need_no_window_over_a_file(spark, tmp_path):
    big = "speaker_label,transcript\n" + "".join(f'P{i},"line {i}\nand more"\n' for i in range(2000))
    path = put(tmp_path / "t", "big.csv", big)
    for k in range(5):
        put(tmp_path / "t", f"s{k}.csv", "transcript,speaker_label\n" + "".join(f"t{k}.{i},A\n" for i in range(k)))
    got = R.read_turns(spark, path)
    assert windows(got) == []
    rows = got.collect()
    assert sorted((r.turn_index, r.speaker_label) for r in rows if r.source_file == "big.csv") == [
        (i, f"P{i}") for i in range(2000)
    ]
    assert sorted((r.source_file, r.turn_index, r.transcript) for r in rows if r.source_file != "big.csv") == [
        (f"s{k}.csv", i, f"t{k}.{i}") for k in (2, 3, 4) for i in range(k)
    ]
    raw = R.read_csv_by_name(spark, path, ["transcript"])
    assert R.with_places(raw, span=16).where("source_file = 'big.csv'").count() == 2000
    merged = merge_channel_videos(
        got.selectExpr("source_file", "cast(turn_index + 1 as bigint) as index", "transcript"), span=64
    )
    assert all(part and part != "source_file" for part, *_ in windows(merged))
    assert sorted(r.id for r in merged.collect()) == list(range(2009))


def test_parts_of_a_file_are_read_in_order(spark, tmp_path):
    turns = spark.range(900).repartition(6).select(
        F.when(F.col("id") < 800, "a b%+.csv").otherwise("c.csv").alias("source_file"),
        F.when(F.col("id") < 800, F.col("id")).otherwise(F.col("id") - 800).cast("int").alias("turn_index"),
        F.lit("0:0").alias("start_time"), F.lit("P").alias("speaker_label"), F.concat(F.lit("t"), "id").alias("transcript"),
    )
    W.write_turns(turns, str(tmp_path / "out"), per_file=True, file_bytes=4000)
    assert len(files_of(tmp_path / "out")) > 3
    key = ["source_file", "turn_index", "transcript"]
    back = R.read_turns(spark, str(tmp_path / "out"), folders=True).select(*key)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, turns.select(*key).collect()))


def test_annotated_tables_are_converted_once(spark, tmp_path):
    put(tmp_path / "a", "a.csv", 'id,title,x\n1,"caf\u00e9 \u20ac \u201cq\u201d\nline",9\n2,,1\n', "cp1252")
    got = R.convert_annotated(spark, str(tmp_path / "a"), str(tmp_path / "out"), "title string, id int, none string")
    assert sorted((r.id, r.title, r.none) for r in got.collect()) == [(1, "caf\u00e9 \u20ac \u201cq\u201d\nline", None), (2, None, None)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "b.csv").write_bytes(b"id,title\n1,\x81\x8d\n")  # bytes that the code page doesn't define
    with pytest.raises(Exception, match="not in cp1252"):
        R.convert_annotated(spark, str(tmp_path / "b"), str(tmp_path / "out2"), "title string, id int")


def test_many_small_keys_are_written_by_many_tasks(spark):
    df = spark.range(6000).selectExpr("concat('k', id div 2) as k", "id as n", "'text' as t")
    dealt = W.dealt_by_key(df, "k", F.lit(4), "n")
    assert dealt.rdd.getNumPartitions() == 3
    tasks = dealt.select("k", F.spark_partition_id().alias("p")).groupBy("k").agg(F.countDistinct("p").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert tasks.filter("n = 1 and rows = 2").count() == 3000
