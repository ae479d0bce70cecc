import random

from pyspark.sql import functions as F

from turnmill.operators import ordering as O


def frame(spark, sizes, seed=1):
    rows = [(k, i, f"{k}{i}") for k, n in sizes.items() for i in range(n)]
    random.Random(seed).shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, v string").repartition(3)


def test_neighbours_across_chunks(spark):
    sizes = {"a": 23, "b": 1, "c": 5, "d": 10}
    got = O.with_neighbours(
        frame(spark, sizes), "k", "i", ahead={"n": "v"}, behind={"p": "v"}, rows=5
    ).collect()
    assert len(got) == sum(sizes.values())
    for r in got:
        assert r.n == (f"{r.k}{r.i + 1}" if r.i + 1 < sizes[r.k] else None)
        assert r.p == (f"{r.k}{r.i - 1}" if r.i else None)


def test_dense_index_with_gaps(spark):
    rows = [("a", 7 * i) for i in range(40)] + [("b", 1000 + i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, o bigint")
    got = {(r.k, r.o): r["index"] for r in O.dense_index(df, "k", "o", span=16).collect()}
    assert got == {
        **{("a", 7 * i): i + 1 for i in range(40)},
        **{("b", 1000 + i): i + 1 for i in range(3)},
    }


def test_group_offsets_by_chunk(spark):
    got = O.group_offsets(frame(spark, {"a": 7, "b": 1, "c": 3}), "k", span=3)
    assert sorted((r.k, r._offset, r._chunk) for r in got.collect()) == [
        ("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("b", 7, 0), ("c", 8, 0),
    ]


def test_earlier_chunks(spark):
    df = frame(spark, {"a": 9, "b": 2}).withColumn("_chunk", O.chunk_of("i", 4))
    got = O.add_earlier_chunks(df, "k", {"before": F.sum("i")}).collect()
    for r in got:
        assert r.before == sum(range(4 * (r.i // 4)))
