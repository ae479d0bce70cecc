import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from turnmill.session import new_dir, shared_dir
from turnmill.sources import versions
from turnmill.streaming import ingest

MANIFEST = "id string, url string, minutes double"


def stream(spark, path):
    return spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).json(path)


def add(spark, path, rows):
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").json(path)


def test_each_id_once_and_failures_again(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")

    def process(pending, fail="f"):
        assert pending.columns == ["id", "url", "minutes"]
        return pending.select(
            "id",
            F.concat(F.lit("t"), "id").alias("transcript"),
            F.when(F.col("id").startswith(fail), "down").alias("error"),
        )

    add(spark, src, [("a", "u", 1.0), ("a", "u", 1.0), ("long", "u", 46.0)])
    add(spark, src, [("a", "u", 1.0), ("b", "u", None), ("f1", "u", 2.0)])
    ingest.ingest_incremental(stream(spark, src), out, process)
    status = lambda: {r.id: r.status for r in ingest.final_status(spark, out).collect()}
    assert status() == {"a": "processed", "b": "processed", "long": "ignore", "f1": "failed"}

    add(spark, src, [("b", "u", 1.0), ("c", "u", 3.0)])
    ingest.ingest_incremental(stream(spark, src), out, process)
    assert status()["c"] == "processed"
    results = spark.read.parquet(f"{out}/results")
    assert sorted(r.id for r in results.filter("error is null").collect()) == ["a", "b", "c"]

    manifest = spark.read.schema(MANIFEST).json(src)
    ingest.retry_failed(spark, manifest, out, lambda p: process(p, "none"))
    assert status()["f1"] == "processed"
    ingest.retry_failed(spark, manifest, out, process)
    assert sorted(r.id for r in spark.read.parquet(f"{out}/results").filter("error is null").collect()) == [
        "a", "b", "c", "f1",
    ]


def test_a_repeated_batch_replaces_its_rows(spark, tmp_path):
    out = str(tmp_path / "out")
    batch = spark.createDataFrame([("a", "u", 1.0), ("long", "u", 90.0)], MANIFEST)
    process = lambda p: p.select("id", F.lit(None).cast("string").alias("error"))
    for _ in range(2):
        ingest.process_batch(batch, 0, out, process)
    assert spark.read.parquet(f"{out}/results").count() == 1
    assert ingest.read_status(spark, f"{out}/status").count() == 2
    ingest.process_batch(batch, 1, out, process)
    assert spark.read.parquet(f"{out}/results").count() == 1


def test_fifty_batches_equal_one_run(spark, tmp_path):
    """Ids come again and again; a batch reads its own rows alone, and 50 batches end like one."""
    src = str(tmp_path / "in")
    rows = [(f"v{(7 * i) % 90}", f"u{i}", 50.0 if i % 30 == 4 else float(i % 40)) for i in range(250)]
    for k in range(50):
        add(spark, src, rows[5 * k : 5 * k + 5])
    process = lambda p: p.select("id", F.when(F.col("id").endswith("3"), "down").alias("error"))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # a task per key range and batch takes its time
    try:
        many, one = str(tmp_path / "many"), str(tmp_path / "one")
        batches = ingest.ingest_incremental(stream(spark, src), many, process)
        whole = spark.readStream.schema(MANIFEST).json(src)
        ingest.ingest_incremental(whole, one, process)
        assert len(batches) == 50 and {b["numInputRows"] for b in batches} == {5}
        touched = [b["stateOperators"][0]["numRowsUpdated"] for b in batches]
        assert max(touched) <= 5
        final = lambda out: {r.id: r.status for r in ingest.final_status(spark, out).collect()}
        # Of an id that is too long in some rows, the first row counts.
        plain = {i for i in final(one) if all(m <= 45 for j, _, m in rows if j == i)}
        assert len(plain) > 60 and {i: s for i, s in final(many).items() if i in plain} == {
            i: s for i, s in final(one).items() if i in plain
        }
        done = spark.read.parquet(f"{many}/results").filter("error is null")
        assert done.count() == done.select("id").distinct().count()
        # The next run hears of the failures, and tries those again that came once more.
        again = ingest.ingest_incremental(stream(spark, src), many, lambda p: p.select("id", F.lit(None).cast("string").alias("error")))
        assert sum(b["numInputRows"] for b in again) == ingest.read_status(spark, f"{many}/status").where("batch_id < 50").count()
        fixed = {i for i, n in Counter(j for j, _, _ in rows).items() if i.endswith("3") and n > 1 and i in plain}
        assert fixed and all(final(many)[i] == "processed" for i in fixed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)


def test_failures_are_tried_again_by_themselves(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    asked = []

    def process(pending):
        ids = [r.id for r in pending.collect()]
        asked.append(ids)
        return pending.select("id", F.lit("down").alias("error"))

    add(spark, src, [("a", "u", 1.0), ("b", None, None), (None, "u", 2.0)])
    for _ in range(4):
        ingest.ingest_incremental(stream(spark, src), out, process, max_tries=3)
    assert [len(x) for x in asked if x] == [3, 3, 3]


def test_running_counts(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    counts = lambda: {r.url: r.n for r in ingest.read_counts(spark, out, "url string, n bigint").collect()}
    assert counts() == {}
    add(spark, src, [("a", "x", 1.0), ("b", "y", 1.0), ("n", None, 1.0)])
    add(spark, src, [("c", "x", 1.0), ("n", None, 1.0)])
    ingest.running_counts(stream(spark, src), "url", out)
    add(spark, src, [("d", "x", 1.0)])
    ingest.running_counts(stream(spark, src), "url", out)
    assert counts() == {"x": 3, "y": 1, None: 2}
    assert len(versions.published(spark, f"{out}/running_counts")) == 2


def test_readers_find_a_whole_version_when_a_batch_dies(spark, tmp_path, monkeypatch):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    counts = lambda: {r.url: r.n for r in ingest.read_counts(spark, out, "url string, n bigint").collect()}
    add(spark, src, [("a", "x", 1.0)])
    ingest.running_counts(stream(spark, src), "url", out)
    add(spark, src, [("b", "x", 1.0), ("c", "y", 1.0)])

    def die(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(versions, "mark_published", die)  # between the write and its publication
        with pytest.raises(Exception, match="lost"):
            ingest.running_counts(stream(spark, src), "url", out)
    assert counts() == {"x": 1}
    ingest.running_counts(stream(spark, src), "url", out)
    assert counts() == {"x": 2, "y": 1}


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_dir(spark) == named
    assert new_dir(spark, "x") != new_dir(spark, "x")


def asks(history, max_tries):
    """pending_ids by hand: entries (batch, came, batch_id, status) of one id, whether the last batch asks."""
    stands, tries, counted, again, ask = None, 0, None, False, False
    for at in sorted({e[0] for e in history}):
        entries = [e for e in history if e[0] == at]
        for _, _, batch, said in sorted(e for e in entries if not e[1]):
            if said in ("processed", "ignore"):
                stands = said
            elif stands not in ("processed", "ignore"):
                stands, tries, counted = "failed", tries + (batch != counted), batch
        came = any(e[1] for e in entries)
        wanted = came or again or (stands == "failed" and tries < max_tries)
        ask = wanted and stands in (None, "failed")
        again = stands == "asked" and wanted
        stands = "asked" if ask else stands
    return ask


def test_histories_ask_as_by_hand(spark):
    draw = random.Random(3)
    entry = lambda at: draw.choice([(at, True, None, None), (at, False, draw.randrange(-2, 4), draw.choice(["failed", "failed", "failed", "ignore", "processed"]))])
    histories = [list({entry(draw.randrange(6)) for _ in range(draw.randint(1, 9))}) for _ in range(2000)]
    dated = [[(datetime.fromtimestamp(10**9 + at), *rest) for at, *rest in h] for h in histories]
    df = spark.createDataFrame(list(enumerate(dated)), "i int, told array<struct<at timestamp, came boolean, batch_id bigint, status string>>")
    for tries in (1, 2, 3):
        got = {r.i for r in df.filter(ingest._asks(F.array_sort("told"), tries)).collect()}
        assert got == {i for i, h in enumerate(histories) if asks(h, tries)} and 100 < len(got) < 1900


def test_state_of_ids_stays_in_the_jvm(spark, tmp_path):
    add(spark, str(tmp_path / "in"), [("a", "u", 1.0)])
    (tmp_path / "status").mkdir()
    status = spark.readStream.schema(ingest.STATUS_ROWS).parquet(str(tmp_path / "status"))
    plan = ingest.pending_ids(stream(spark, str(tmp_path / "in")), status)._jdf.queryExecution().analyzed().toString()
    assert "Pandas" not in plan and "Aggregate" in plan
