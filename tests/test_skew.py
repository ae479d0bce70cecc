"""A conversation with most of all rows must not end up in one task."""

from pyspark.sql import functions as F

from turnmill.operators import dialogue as D
from turnmill.operators import histories as H
from turnmill.operators import ordering as O
from turnmill.operators import videos as V

HOT, COLD = 6000, 40


def hot_turns(spark):
    hot = spark.range(HOT).select(F.lit("hot.csv").alias("source_file"), F.col("id").cast("int").alias("turn_index"))
    cold = spark.range(COLD * 10).select(
        F.concat(F.lit("c"), F.expr("id div 10")).alias("source_file"), (F.col("id") % 10).cast("int").alias("turn_index")
    )
    return hot.unionByName(cold).select(
        "*",
        F.when(F.col("turn_index") % 3 == 0, "Officer").otherwise("Civ").alias("speaker_label"),
        F.concat("source_file", F.lit(" "), "turn_index").alias("transcript"),
    )


def largest_share(spark, df):
    """Share of the rows that the fullest partition holds, without merging small partitions."""
    merged = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # The digest needs every column, so that no step is left out of the plan.
        parts = df.groupBy(F.spark_partition_id()).agg(
            F.count(F.lit(1)).alias("n"), F.max(F.xxhash64(*df.columns))
        )
        sizes = [r.n for r in parts.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", merged)
    return max(sizes) / sum(sizes)


def test_pairs_and_histories_spread(spark):
    turns = hot_turns(spark)
    assert largest_share(spark, D.turn_pairs(turns, chunk_rows=64)) < 0.5
    assert largest_share(spark, D.history_index(turns, chunk_rows=64)) < 0.5
    assert D.turn_pairs(turns, chunk_rows=64).count() == HOT // 3 + COLD * 3


def shuffled(spark, df):
    """Rows that all shuffles of an action write, and the most that a task of a shuffle reads."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def stages():
        none = gateway.new_array(gateway.jvm.double, 0)
        listed = store.stageList(None, False, False, none, gateway.jvm.java.util.ArrayList())
        return [listed.apply(i) for i in range(listed.size())]

    known = max((s.stageId() for s in stages()), default=-1)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = [s for s in stages() if s.stageId() > known]
    most = 0
    for s in new:
        tasks = store.taskList(s.stageId(), s.attemptId(), 10_000)
        for i in range(tasks.size()):
            metrics = tasks.apply(i).taskMetrics()
            if metrics.isDefined():
                most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
    return sum(s.shuffleWriteRecords() for s in new), most


def test_folded_histories_shuffle_the_turns_once(spark):
    """One conversation with all turns: rows shuffled are the turns and little more, in tasks of chunks."""
    folds = {"n": H.MessageCount(), "last": H.LastMessages(8), "reply": H.LastBy("assistant")}
    for n in (2000, 4000, 8000):
        turns = spark.range(n).selectExpr(
            "'hot.csv' as source_file", "cast(id as int) as turn_index",
            "if(id % 2 = 0, 'Officer', 'Civ') as speaker_label", "concat('t', id) as transcript",
        )
        rows, most = shuffled(spark, H.folded_histories(turns, folds, chunk_rows=64))
        assert n <= rows <= 1.1 * n
        assert most <= 8 * 66  # some chunks meet in a task of 64, never the conversation


def test_history_rows_grow_with_the_turns(spark):
    for n in (2000, 4000, 8000):
        turns = spark.range(n).selectExpr(
            "'hot.csv' as source_file", "cast(id as int) as turn_index",
            "if(id % 2 = 0, 'Officer', 'Civ') as speaker_label", "concat('t', id) as transcript",
        )
        parts = D.history_segments(turns, segment_turns=32, segments=8)
        got = parts.groupBy("segment").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked").cast("int")).alias("asked"))
        rows = got.collect()
        assert len(rows) <= 8 and sum(r.n for r in rows) <= 4.5 * (n + 8 * 32)  # whole chunks
        assert sum(r.asked for r in rows) == n // 2


def test_numbering_spreads(spark):
    turns = hot_turns(spark)
    numbered = O.dense_index(turns, "source_file", "turn_index", span=64)
    assert largest_share(spark, numbered) < 0.5
    merged = V.merge_channel_videos(numbered, span=64)
    assert largest_share(spark, merged) < 0.5
    ids = merged.agg(F.min("id"), F.max("id"), F.count_distinct("id")).first()
    total = HOT + COLD * 10
    assert tuple(ids) == (0, total - 1, total)


def test_copies_stay_few(spark):
    turns = hot_turns(spark)
    spread = O.spread_chunks(turns, "turn_index", ahead=True, behind=True, rows=64)
    assert spread.count() < turns.count() * 1.15
