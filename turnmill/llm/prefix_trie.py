"""The prefix trie of conversations, and sums over its subtrees by centroid decomposition.

Conversations with the same first d turns share the node of that prefix. A node is named by the
smallest of its members and its depth, so a conversation's nodes are found by (conv_id, depth),
and whether one node lies below another is one lookup. Sums over subtrees split the forest of parent
edges: every component's weighted centroid adds the total of what hangs below it along the path to
the component's top, and taking it out leaves components of half the weight at most. So the rounds
grow with the logarithm of the rows, however deep or bushy the trie is. A component of BLOCK rows
or fewer is split on by one task, many components at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.llm.common import cut, table
from turnmill.llm.registry import query

#: A component of so many rows (conversations in nodes) at most goes to one task.
BLOCK = 1 << 16
#: Turns of a conversation whose prefix hashes one window computes.
CHUNK = 1024


def turn_places(turns: DataFrame) -> DataFrame:
    """conv_id, place (1, 2, ... by turn, a null turn first), sha (of role and text), chars.

    A null role or text is empty. Turns with the same number are ordered by their sha. Rows without
    conv_id belong to no conversation and are left out. A sort over ranges numbers them, so that a
    conversation may pass through many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("sha"),
        F.length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("sha"), F.col("row_id")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            first = np.r_[True, conv[1:] != conv[:-1]]
            at = np.arange(len(conv))
            place = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
            begun = int(np.argmax(first[1:])) + 1 if first[1:].any() else len(conv)
            if last == conv[0]:
                place[:begun] += seen
            last, seen = conv[-1], int(place[-1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("conv_id", "sha", "chars")), pa.array(place), pa.array(np.full(len(conv), part, np.int32))],
                ["conv_id", "sha", "chars", "place", "part"],
            )

    schema = "conv_id long, sha string, chars long, place long, part int"
    line = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "places")
    # A conversation goes on in a task only as that task's first one: one row for each task at most.
    counts = line.groupBy("part", "conv_id").agg(F.max("place").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = counts.withColumn("before", F.sum("n").over(ahead)).where("before > 0").drop("n")
    joined = line.join(F.broadcast(later), ["conv_id", "part"], "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("place"), "sha", "chars")


def prefixes(turns: DataFrame) -> DataFrame:
    """turns (conv_id, depth from 1 without gaps, sha, chars, length) with a0, a1 and o0, o1: hashes of
    the sequences of the first depth - 1 and depth turns, of two longs.

    A sequence's hash is the exclusive or of its turns' hashes by depth, so chunks of a conversation
    are hashed apart; nodes() finds out whether two sequences ever share one.
    """
    keys, lanes = ["conv_id", "_chunk"], range(2)
    parts = turns.withColumn("_chunk", F.floor((F.col("depth") - 1) / CHUNK)).withColumns(
        {f"_t{i}": F.xxhash64(F.lit(i), F.col("sha"), F.col("depth")) for i in lanes}
    )
    ahead = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = parts.groupBy(*keys).agg(*[F.bit_xor(f"_t{i}").alias(f"_b{i}") for i in lanes])
    zero = F.lit(0).cast("long")
    before = chunks.select(*keys, *[F.coalesce(F.bit_xor(f"_b{i}").over(ahead), zero).alias(f"_b{i}") for i in lanes])
    here = Window.partitionBy(*keys).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    running = parts.withColumns({f"_r{i}": F.bit_xor(f"_t{i}").over(here) for i in lanes}).join(before, keys)
    own = [F.col(f"_r{i}").bitwiseXOR(F.col(f"_b{i}")) for i in lanes]
    return running.select(
        *turns.columns,
        *[o.alias(f"o{i}") for i, o in enumerate(own)],
        *[o.bitwiseXOR(F.col(f"_t{i}")).alias(f"a{i}") for i, o in enumerate(own)],
    )


def nodes(turns: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The trie of conversations: its nodes, and every conversation's path.

    turns: conv_id, depth, sha, chars, length (of the conversation). lengths: conv_id and length of every
    conversation, turnless ones too; one at least. Nodes are conv_id (smallest member), depth, n_convs,
    chars (of the last turn), weight (rows of members at this depth or deeper) and parent_conv_id. Paths
    are conv_id, depth, length, member (the node's conv_id) and up (its parent's) for depths of 1 or more.
    """
    rows = cut(prefixes(turns), "prefixes")
    # A node is the node above and the last turn. If no two nodes share a hash, hashes above name nodes.
    found = rows.groupBy("depth", "a0", "a1", "sha").agg(
        F.first("o0").alias("o0"),
        F.first("o1").alias("o1"),
        F.min("conv_id").alias("member"),
        F.count(F.lit(1)).alias("n_convs"),
        F.first("chars").alias("chars"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    named = cut(found, "nodes")
    if named.groupBy("depth", "o0", "o1").count().where("count > 1").limit(1).count():
        raise ValueError("Two sequences of turns share a hash.")
    whole = lengths.agg(F.min("conv_id").alias("c"), F.count(F.lit(1)).alias("n"), F.sum(F.col("length") + 1).alias("w")).first()
    name = named.select((F.col("depth") + 1).alias("depth"), F.col("o0").alias("a0"), F.col("o1").alias("a1"), F.col("member").alias("up"))
    linked = named.join(name, ["depth", "a0", "a1"], "left").withColumn("up", F.coalesce("up", F.lit(whole.c).cast("long")))
    linked = cut(linked.select("depth", "o0", "o1", "member", "up", "n_convs", "chars", "weight"), "links")
    root = lengths.sparkSession.createDataFrame(
        [(whole.c, 0, whole.n, 0, whole.w, None)],
        "conv_id long, depth long, n_convs long, chars long, weight long, parent_conv_id long",
    )
    trie = linked.select(
        F.col("member").alias("conv_id"), "depth", "n_convs", "chars", "weight", F.col("up").alias("parent_conv_id")
    ).union(root)
    key = ["depth", "o0", "o1"]
    paths = rows.select("conv_id", "length", *key).join(linked.select(*key, "member", "up"), key).drop("o0", "o1")
    return cut(trie, "trie"), cut(paths, "paths")


def subtree_sums(trie: DataFrame, paths: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """conv_id, depth, and the sums of the values (long columns of trie) over every node's subtree.

    In a component, weight is that of a node's subtree within it. The deepest node with over half of
    the top's weight is the centroid: each child's part below it weighs half at most, and what remains
    above it less than half. The components of over `block` rows are less than rows / block, so a
    row for each of them is broadcast.
    """
    sums = [f"{v}_sum" for v in values]
    state = trie.select("conv_id", "depth", F.col("parent_conv_id").alias("up"), "weight", *values).withColumns(
        {s: F.lit(0).cast("long") for s in sums}
    )
    first = trie.where("depth = 0").first().conv_id
    state = state.withColumn("top", F.lit(first).cast("long")).withColumn("top_depth", F.lit(0).cast("long"))
    key = ["top", "top_depth"]
    settled, finished = [], []
    while True:
        state = cut(state, "components")
        totals = state.groupBy(*key).agg(F.max("weight").alias("total")).where(F.col("total") > block)
        totals = cut(totals, "totals")
        if totals.isEmpty():
            settled.append(state)
            break
        settled.append(state.join(F.broadcast(totals), key, "left_anti"))
        active = state.join(F.broadcast(totals), key)
        centroids = active.where(2 * F.col("weight") > F.col("total")).groupBy(*key).agg(
            F.max("depth").alias("at"), F.max_by("conv_id", "depth").alias("centroid"), F.min("weight").alias("taken")
        )
        lower = F.col("depth") > F.col("at")
        # Of a node deeper than the centroid: the node one below the centroid's depth on its path. Of
        # others: the node at their depth on the centroid's path.
        seen = active.join(F.broadcast(cut(centroids, "centroids")), key).withColumns(
            {"_conv": F.when(lower, F.col("conv_id")).otherwise(F.col("centroid")), "_depth": F.when(lower, F.col("at") + 1).otherwise(F.col("depth"))}
        )
        steps = paths.select(F.col("conv_id").alias("_conv"), F.col("depth").alias("_depth"), "member", F.col("up").alias("member_up"))
        below = lower & (F.col("member_up") == F.col("centroid"))
        along = ~lower & ((F.col("depth") == 0) | (F.col("member") == F.col("conv_id")))
        marked = cut(
            seen.join(steps, ["_conv", "_depth"], "left")
            .withColumns({"below": F.coalesce(below, F.lit(False)), "along": F.coalesce(along, F.lit(False))})
            .withColumn("found", F.col("along") & (F.col("depth") == F.col("at"))),
            "marked",
        )
        part = marked.where("below or found").groupBy(*key).agg(*[F.sum(v).alias(f"_{v}") for v in values])
        added = marked.join(F.broadcast(cut(part, "parts")), key)
        added = added.withColumns({s: F.when(F.col("along"), F.col(s) + F.col(f"_{v}")).otherwise(F.col(s)) for v, s in zip(values, sums, strict=True)})
        finished.append(added.where("found").select("conv_id", "depth", *sums))
        state = added.where("not found").select(
            "conv_id", "depth", "up",
            F.when(F.col("along"), F.col("weight") - F.col("taken")).otherwise(F.col("weight")).alias("weight"),
            *values, *sums,
            F.when(F.col("below"), F.col("member")).otherwise(F.col("top")).alias("top"),
            F.when(F.col("below"), F.col("at") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        )
    for rows in settled:
        finished.append(_split_on(rows, values, sums))
    done = finished[0]
    for rows in finished[1:]:
        done = done.union(rows)
    return done


def _split_on(rows: DataFrame, values: list[str], sums: list[str]) -> DataFrame:
    """subtree_sums of components that a task holds whole."""
    names = ["top", "top_depth", "depth", "conv_id", "up", "weight", *values, *sums]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _whole_components(batches):
            got = dict(zip(names, cols, strict=True))
            added = decomposed(
                np.cumsum(np.r_[0, (np.diff(got["top"]) != 0) | (np.diff(got["top_depth"]) != 0)]),
                got["depth"] - got["top_depth"], got["conv_id"], got["up"], got["weight"], np.stack([got[v] for v in values]),
            )
            out = [got["conv_id"], got["depth"], *[got[s] + a for s, a in zip(sums, added, strict=True)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["conv_id", "depth", *sums])

    schema = ", ".join(f"{c} long" for c in ["conv_id", "depth", *sums])
    filled = rows.select(*names[:4], F.coalesce("up", F.lit(0)).alias("up"), *names[5:])
    return filled.repartition("top", "top_depth").sortWithinPartitions("top", "top_depth", "depth", "conv_id").mapInArrow(run, schema)


def _whole_components(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Sorted rows in pieces of whole components (of equal first two columns)."""
    held = None
    for batch in batches:
        cols = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0))
        last = int(change[-1]) + 1 if len(change) else 0
        if last:
            yield [c[:last] for c in cols]
        held = [c[last:] for c in cols]
    if held is not None and len(held[0]):
        yield held


def decomposed(comp: np.ndarray, depth: np.ndarray, conv: np.ndarray, up: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of values (kinds x nodes) within components 0, 1, ..., by centroids.

    Nodes are sorted by component, depth below the component's top, and conv; a node's parent has its
    `up` as conv. All components are split at once, until no node is left.
    """
    n = len(comp)
    ids, rank = np.unique(conv, return_inverse=True)
    wide = int(depth.max()) + 1
    place = (comp * wide + depth) * len(ids) + rank  # ascending
    above = np.minimum(np.searchsorted(ids, up), len(ids) - 1)
    parent = np.searchsorted(place, (comp * wide + depth - 1) * len(ids) + above)
    parent = np.where(depth > 0, parent, -1)
    sums, weight = np.zeros_like(values), weight.copy()
    top = np.searchsorted(comp, comp)  # of each node's component
    by_depth = np.argsort(depth, kind="stable")
    left = by_depth
    at = np.full(n, -1)
    while len(left):
        heavy = left[2 * weight[left] > weight[top[left]]]
        at[top[heavy]] = heavy  # the deepest comes last
        here = at[top[left]]
        mid = left[here == left]
        # Where each node's way up ends: at the centroid, at one of its children, or at the top.
        way = np.arange(n)
        ends = (left == here) | (left == top[left]) | (parent[left] == here)
        way[left] = np.where(ends, left, parent[left])
        while True:
            on = way[way[left]]
            if (on == way[left]).all():
                break
            way[left] = on
        end = way[left]
        below = (parent[end] == here) & (here != end) & (end != top[left])
        part = np.zeros_like(values)
        inside = below | (left == here)
        for kind in range(len(values)):
            np.add.at(part[kind], here[inside], values[kind, left[inside]])
        taken = weight[mid].copy()
        path, centre = mid.copy(), mid
        while len(path):
            sums[:, path] += part[:, centre]
            weight[path] -= taken
            more = path != top[path]
            path, centre, taken = parent[path[more]], centre[more], taken[more]
        top[left] = np.where(below, end, top[left])
        left = left[left != here]
    return sums


def end_hashes(ends: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of nodes (conv_id, depth) and the conversations (member) that end there.

    The hash is a chain over the sorted members, so a node's members pass one task, as a stream.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []

        def batch():
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            types = [pa.int64(), pa.int64(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["conv_id", "depth", "ends_sha256"])

        for rows in batches:
            for conv, depth, member in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "depth", "member")), strict=True):
                if key != (conv, depth):
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (conv, depth), hashlib.sha256(str(member).encode())
                else:
                    state.update(f",{member}".encode())
            yield batch()
            out = []
        if key is not None:
            out.append((*key, state.hexdigest()))
            yield batch()

    order = ["conv_id", "depth", "member"]
    sorted_ends = ends.select(*order).repartition("conv_id", "depth").sortWithinPartitions(*order)
    return sorted_ends.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    turns: conv_id, depth (1, 2, ... without gaps), sha (of the turn), chars (code points of its text),
    length. lengths: conv_id, length, one row per conversation, turnless ones too. saved_tokens sums
    (n_convs - 1) * chars over a node's subtree. Without conversations there is no node. Other columns
    are not looked at.
    """
    lengths = cut(lengths.select("conv_id", "length"), "lengths")
    schema = (
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string"
    )
    if lengths.isEmpty():
        return lengths.sparkSession.createDataFrame([], schema)
    trie, paths = nodes(turns.select("conv_id", "depth", "sha", "chars", "length"), lengths)
    children = trie.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    counted = trie.join(children.agg(F.count(F.lit(1)).alias("n_children")), ["conv_id", "depth"], "left")
    counted = cut(
        counted.withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("chars")),
        "counted",
    )
    sums = subtree_sums(counted, paths, ["n_leaves", "saved_tokens"], block)
    sums = sums.withColumnsRenamed({"n_leaves_sum": "n_leaves", "saved_tokens_sum": "saved_tokens"})
    root = counted.where("depth = 0").first().conv_id
    turnless = lengths.where("length = 0").select(F.lit(root).cast("long"), F.lit(0).cast("long"), "conv_id")
    ends = paths.where("depth = length").select(F.col("member").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    hashes = end_hashes(ends.union(turnless))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    rows = counted.drop("n_leaves", "saved_tokens").join(sums, ["conv_id", "depth"]).join(hashes, ["conv_id", "depth"], "left")
    return rows.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


#: Conversations of so many ids in a row take turns from the first of them, and less than HEADS of those.
FAMILY, HEADS = 100, 6


def shared_openings(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths of conversations that open with the first turns of their family's first one.

    places: conv_id, place, sha, chars. With h = crc32(conv_id in decimal) % HEADS, a conversation is the
    first h turns of conversation conv_id - conv_id % FAMILY (none if there is none), then its own after
    its first h.
    """
    own = cut(places.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "counts")
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    h = F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % FAMILY}).join(base, "base", "left")
    convs = convs.withColumn("opens", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("length", F.col("opens") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = cut(convs.select("conv_id", "base", "h", "opens", "length"), "openings")
    heads = places.where(F.col("place") < HEADS).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("place <= h").withColumn("depth", F.col("place"))
    rest = places.join(convs, "conv_id").where("place > h").withColumn("depth", F.col("opens") + F.col("place") - F.col("h"))
    columns = ["conv_id", "depth", "sha", "chars", "length"]
    return heads.select(*columns).union(rest.select(*columns)), convs.select("conv_id", "length")


@query("op11_centroid_prefix_trie")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt so that families share openings."""
    turns, lengths = shared_openings(cut(turn_places(table(spark, sf_dir, "conversations")), "turns"))
    return prefix_trie(turns, lengths)
