from pyspark.sql import functions as F

from turnmill.operators import videos as V


def one(spark, column, cells):
    return [r[0] for r in spark.createDataFrame([(c,) for c in cells], "v string").select(column).collect()]


def test_channel_handle(spark):
    links = ["https://y/@Foo", "https://y/@Foo/videos", "https://y/@a@b", "https://y/none", None]
    assert one(spark, V.channel_handle("v"), links) == ["Foo", "Foo/videos", "a", None, None]


def test_video_id(spark):
    urls = ["w?v=abc", "w?v=abc&t=1", "x?v=1&v=2", "youtu.be/abc", "w?v=", None]
    assert one(spark, V.extract_video_id("v"), urls) == ["abc", "abc", "2", None, "", None]


def test_sentinels(spark):
    df = spark.createDataFrame([(i, f"l{i}") for i in range(4)], "n int, link string")
    assert [r.n for r in V.trim_sentinel_rows(df, "n").orderBy("n").collect()] == [1, 2]


def test_descriptions(spark):
    cells = ["x" * 500, "x" * 501, "a\nb", None, ""]
    got = one(spark, V.short_description("v"), cells)
    assert got == ["x" * 500 + "…", "x" * 500 + "…", "a b…", "…", "…"]


def test_normalize_and_placeholder(spark):
    schema = (
        "index int, video_id string, webpage_url string, title string, uploader string, "
        "view_count string, upload_date string, duration string, description string"
    )
    rows = [
        (1, "a", "https://p/a", "T", None, "12", "20240131", "60", "d"),
        (2, "b", None, "", "U", "N/A", "N/A", "N/A", None),
        (3, "c", "", None, "U", "5", "20240101", "1", "d"),
        (4, "d", None, "T", "U", "N/A", "bad", "x", None),
    ]
    got = V.normalize_videos(spark.createDataFrame(rows, schema)).orderBy("index").collect()
    assert (got[0].uploader, got[0].views, str(got[0].upload_date), got[0].duration_sec) == (
        "Unknown", 12, "2024-01-31", 60,
    )
    assert got[1].title == "[RESTRICTED] ID: b" and got[1].url == V.WATCH_URL + "b"
    assert got[1].transcript == V.RESTRICTED_TRANSCRIPT and got[1].duration_sec is None
    assert got[2].title == "[RESTRICTED] ID: c"
    assert (got[3].url, got[3].views, got[3].upload_date, got[3].duration_sec) == ("", None, None, 0)


def test_merge_gives_each_id_once(spark):
    rows = [
        (f, i + 1, f"{f}{i}")
        for f, n in (("b_x.csv", 5), ("a" + V.CHANNEL_FILE_SUFFIX, 9), ("my_chan" + V.CHANNEL_FILE_SUFFIX, 2))
        for i in range(n)
    ]
    df = spark.createDataFrame(rows, "source_file string, index bigint, title string").repartition(4)
    got = V.merge_channel_videos(df, span=4).orderBy("id").collect()
    assert [r.id for r in got] == list(range(16))
    assert [(r.source_file, r["index"]) for r in got] == sorted((f, i) for f, i, _ in rows)
    assert {r.channel_name for r in got} == {"a", "b_x", "my_chan"}
    assert {r.channel_name for r in V.merge_channel_videos(df, compat=True).collect()} == {"a", "b", "my"}
    counts = {r.source_file: r.n for r in V.merge_counts(df).collect()}
    assert counts[None] == 16 and counts["b_x.csv"] == 5


def test_transcript_status(spark):
    cells = [m + ("429]" if m.endswith(": ") else "") for m in V.TRANSCRIPT_MARKS.values()]
    assert one(spark, V.transcript_status("v"), [*cells, "", None, "hello"]) == [
        *V.TRANSCRIPT_MARKS, "missing", "missing", "ok",
    ]


def test_transcript_pick_and_resume(spark):
    videos = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    found = spark.createDataFrame(
        [("a", "en-auto", 2, "auto"), ("a", "en", 1, "manual"), ("b", "en-auto", 2, "auto")],
        "video_id string, lang string, priority int, text string",
    )
    got = {r.video_id: (r.lang, r.transcript) for r in V.transcript_pick(videos, found).collect()}
    assert got == {
        "a": ("en", "manual"), "b": ("en-auto", "auto"),
        "c": (None, V.TRANSCRIPT_MARKS["none_found"]),
    }
    assert [r.video_id for r in V.transcribe_pending(videos, found).collect()] == ["c"]


def test_snippets(spark):
    df = spark.sql("select array(named_struct('text', 'a'), named_struct('text', 'b')) as s")
    assert df.select(V.join_snippets("s")).first()[0] == "a b"
    assert df.select(F.size("s")).first()[0] == 2


def test_description_limit_can_be_switched_off(spark):
    long = "line\n" * 400
    df = spark.createDataFrame([(long,)], "d string").select(V.short_description("d"), V.short_description("d", None))
    assert len(df.first()[0]) == 501 and df.first()[1] == long
