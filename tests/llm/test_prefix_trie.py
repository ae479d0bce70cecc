"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from turnmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, sha string, place string, length string"


def rebuilt(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in convs.items()}
    h = lambda c: zlib.crc32(str(c).encode()) % 6
    return {c: own.get(c - c % 100, [])[: h(c)] + ts[h(c) :] for c, ts in own.items()}


def brute(convs):
    members, ends = {(): []}, {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
        ends.setdefault(tuple(convs[c]), []).append(c)
    if not convs:
        return set()
    children, leaves, saved = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        if p not in children:
            children[p] = 0
            leaves[p] = 1
        saved[p] = saved.get(p, 0) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        if p:
            up = p[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    return {
        (ms[0], len(p), members[p[:-1]][0] if p else None, len(ms), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        for p, ms in members.items()
    }


def trie_of(spark, rows, block):
    frame = spark.createDataFrame([(*r, "d", "s", "p", "l") for r in rows], SCHEMA)
    turns, lengths = prefix_trie.shared_openings(prefix_trie.turn_places(frame))
    return {tuple(r) for r in prefix_trie.prefix_trie(turns, lengths, block).collect()}


def talk():
    rnd = random.Random(4)
    texts = [None, "", "hello", "Größe ☃", "x" * 500, "x" * 499 + "y"]
    rows = []
    for c in [*range(0, 12), 100, 101, 199, 205, 206, 207, 333]:
        if c == 205 or rnd.random() < 0.9:
            turns = list(range(rnd.randint(1, 9)))
            rnd.shuffle(turns)
            rows += [(c, None if t == 8 else t * 3, rnd.choice(["user", None, "a"]), rnd.choice(texts)) for t in turns]
    return rows + [(None, 1, "user", "no conversation")]


@pytest.mark.parametrize("block", [3, 1 << 16])
def test_trie(spark, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    rows = talk()
    assert trie_of(spark, rows, block) == brute(rebuilt(rows))


def test_hot_conversation_and_copies(spark):
    """A chain of 400 turns, 60 copies of a talk, and ids that differ only in the last turn."""
    rows = [(700 + 100 * c, t, "user", f"copy {t}") for c in range(60) for t in range(4)]
    rows += [(9000, t, "user", f"{t}") for t in range(400)]
    rows += [(9100 + 100 * c, t, "user", f"{t}" if t < 300 else f"{c}") for c in range(3) for t in range(301)]
    assert trie_of(spark, rows, 256) == brute(rebuilt(rows))


def test_no_rows_and_repeated_rows(spark):
    assert trie_of(spark, [], 8) == set()
    rows = [(5, 0, "user", "a")] * 7 + [(6, None, None, None)]
    assert trie_of(spark, rows, 8) == brute(rebuilt(rows))


def test_places_pass_through_many_tasks(spark, monkeypatch):
    rows = [(c % 3, t, "user", f"{t}") for c in range(3) for t in range(500)]
    frame = spark.createDataFrame([(*r, "d", "s", "p", "l") for r in rows], SCHEMA).repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.turn_places(frame).select("conv_id", "place").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, got)) == [(c, p) for c in range(3) for p in range(1, 501)]


def test_decomposition_of_random_forests():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 9, 60, 300):
        for chain in (False, True):
            parent = [-1] + [i - 1 if chain else int(rnd.integers(max(0, i - 5), i)) for i in range(1, n)]
            depth = np.zeros(n, int)
            for i in range(1, n):
                depth[i] = depth[parent[i]] + 1
            order = np.lexsort((np.arange(n), depth))
            up = np.array([0 if p < 0 else p for p in parent])
            weight, values, want = np.ones(n, int), rnd.integers(0, 99, (2, n)), None
            want = values.copy()
            for i in reversed(np.argsort(depth, kind="stable")):
                if parent[i] >= 0:
                    weight[parent[i]] += weight[i]
                    want[:, parent[i]] += want[:, i]
            two = lambda x: np.concatenate([x[..., order]] * 2, axis=-1)  # noqa: E731, two components alike
            got = prefix_trie.decomposed(np.repeat([0, 1], n), two(depth), two(np.arange(n)), two(up), two(weight), two(values))
            assert (got == two(want)).all()


def test_query(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = {tuple(r) for r in prefix_trie.op11(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute(rebuilt([tuple(r) for r in rows.collect()]))
