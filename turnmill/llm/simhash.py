"""SimHash near-duplicates found through popcounts of fingerprint segments.

A fingerprint is cut in segments of two bits; each half of the segments gives a vector of bit
counts. Counts differ by no more than bits do, so the Manhattan distance of two vectors bounds the
Hamming distance of the fingerprints from below. Of two fingerprints within 4 bits, one half is
within 2, so some grid point lies within 1 of both vectors: every fingerprint is filed under the
grid points within 1 of its vectors, points are joined by a shuffle, and pairs that meet are
verified by their exact Hamming distance.

Equal fingerprints are one before the join. Links within a grid point come out as a spanning
forest, never as all pairs; a point with more fingerprints than a block is split in blocks, whose
pairs go to tasks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.llm.common import cut, find_words, flat, ranges, runs, steps, table
from turnmill.llm.components import components
from turnmill.llm.registry import query

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
#: Fingerprints of one grid point that a task compares with each other.
BLOCK = 4096
_SEGMENT = 2
_PART = 200_000


def _normal(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased words of all texts with one blank after each; starts, ends, words before each text."""
    starts, ends, first = find_words(data, offsets)
    sizes = ends - starts + 1
    put = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()), 0x20, np.uint8)
    at = ranges(sizes - 1)
    letters = data[np.repeat(starts, sizes - 1) + at]
    out[np.repeat(put, sizes - 1) + at] = letters + np.where((letters >= 65) & (letters <= 90), 32, 0).astype(np.uint8)
    return out.tobytes(), put, put + sizes - 1, first


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, shingle_words: int = SHINGLE_WORDS) -> np.ndarray:
    """64-bit fingerprints of texts laid end to end, as uint64."""
    text, starts, ends, first = _normal(data, offsets)
    words = np.diff(first)
    counts = np.where(words == 0, 0, np.maximum(words - shingle_words + 1, 1))
    begin = np.repeat(first[:-1], counts) + ranges(counts)
    last = np.minimum(begin + shingle_words, np.repeat(first[1:], counts)) - 1
    ones = np.zeros((len(counts), 64), np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    for k in range(0, len(begin), _PART):
        part = slice(k, k + _PART)
        digest = xxhash.xxh64_intdigest
        spans = zip(starts[begin[part]].tolist(), ends[last[part]].tolist(), strict=True)
        h = np.array([digest(text[s:e], SEED) for s, e in spans], np.uint64)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.flatnonzero(np.diff(owner[part], prepend=-1))
        ones[owner[part][edges]] += np.add.reduceat(bits, edges, axis=0, dtype=np.int64)
    set_bits = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """id, fp (the fingerprint's 64 bits as a long) for every row. Null and blank texts: zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                fp = fingerprints_of(*flat(part.column("text")), shingle_words)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(fp.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def _counts(half: np.ndarray) -> np.ndarray:
    """Bit counts of the 16 two-bit segments of 32 bits, kept in the segments' own places."""
    return (half & np.uint64(0x55555555)) + ((half >> np.uint64(1)) & np.uint64(0x55555555))


def grid_points(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid points within 1 of either half's vector: (point, index of the fingerprint)."""
    points, owners = [], []
    every = np.arange(len(fp))
    for side in range(2):
        vector = _counts((fp >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF))
        tag = np.uint64(side << 32)
        points.append(vector | tag)
        owners.append(every)
        for k in range(0, 32, _SEGMENT):
            one = np.uint64(1 << k)
            count = (vector >> np.uint64(k)) & np.uint64(3)
            for can, moved in ((count < 2, vector + one), (count > 0, vector - one)):
                points.append(moved[can] | tag)
                owners.append(every[can])
    return np.concatenate(points), np.concatenate(owners)


def _forest(fp: np.ndarray, max_bits: int, other: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the components of fp (with other: of links between the two), one search step
    per fingerprint reached."""
    nodes = fp if other is None else np.concatenate([fp, other])
    left = np.arange(len(nodes))
    links = []
    while len(left):
        queue = [left[0]]
        left = left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(nodes[left] ^ nodes[i]) <= max_bits
            if near.any():
                found = left[near]
                links.extend((i, j) for j in found)
                queue.extend(found)
                left = left[~near]
    return [(int(nodes[i]), int(nodes[j])) for i, j in links]


def _meet(key: np.ndarray, fp: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of sorted runs of equal key."""
    begin = np.flatnonzero(np.diff(key, prepend=key[0] - np.uint64(1)) != 0) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(key)))
    out = []
    run = np.repeat(np.arange(len(size)), size)
    small = np.flatnonzero((size[run] > 1) & (size[run] <= 64)) if len(key) else run
    key_s, fp_s, run_s = key[small], fp[small], run[small]
    pairs_a, pairs_b = [], []
    for d in range(1, min(64, int(size.max(initial=1)))):
        if len(key_s) <= d:
            break
        hit = np.flatnonzero((run_s[d:] == run_s[:-d]) & (np.bitwise_count(fp_s[d:] ^ fp_s[:-d]) <= max_bits))
        pairs_a.append(hit)
        pairs_b.append(hit + d)
    if pairs_a:
        a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
        owner = run_s[a]
        many = np.bincount(owner, minlength=len(size))[owner] > 2 if len(a) else np.zeros(0, bool)
        out.append((fp_s[a[~many]], fp_s[b[~many]]))
        big = np.concatenate([np.unique(owner[many]), np.flatnonzero(size > 64)])
    else:
        big = np.flatnonzero(size > 64)
    for k in big.astype(int):
        links = _forest(fp[begin[k] : begin[k] + size[k]], max_bits)
        if links:
            out.append(tuple(np.array(links, np.uint64).T))
    return out


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect all fingerprints (column fp, distinct) within max_bits.

    A forest within each grid point, so a group of n copies gives some n links. max_bits: 0 to 4.
    """
    if not 0 <= max_bits <= 4:
        raise ValueError("Grid points within 1 of both sides find distances up to 4 bits.")

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(every), 20_000):
                point, owner = grid_points(every[k : k + 20_000])
                fp = every[k : k + 20_000][owner]
                yield pa.RecordBatch.from_arrays([pa.array(point.view(np.int64)), pa.array(fp.view(np.int64))], ["point", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, (_, fp) in runs(batches, "key"):
            found = _meet(key, fp.view(np.uint64), max_bits)
            a = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in found)])
            b = np.concatenate([np.zeros(0, np.uint64), *(y for _, y in found)])
            # A pair meets at several points; of those in this piece, one stays.
            a, b = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    filed = distinct.select("fp").mapInArrow(file, "point long, fp long")
    met = filed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("point")))
    # The window has brought points together and sorted them; they are compared where they are.
    small = met.where(F.col("n").between(2, block)).select(F.col("point").alias("key"), "fp")
    n_blocks = F.ceil(F.col("n") / block)
    mine = F.pmod(F.xxhash64("fp"), n_blocks)
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), n_blocks - 1),
        lambda j: F.xxhash64("point", F.least(mine, j), F.greatest(mine, j)),
    )
    large = met.where(F.col("n") > block).select(F.explode(pairs).alias("key"), "fp").repartition("key")
    return (
        small.sortWithinPartitions("key")
        .mapInArrow(meet, "a long, b long")
        .union(large.sortWithinPartitions("key").mapInArrow(meet, "a long, b long"))
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """id, fp, component_id of every row of docs: the smallest id that links of at most max_bits
    differing bits reach, the row's own included.

    Null or blank texts have fingerprint zero and link like any other. Repeated rows stay repeated
    rows with one component. A row without an id takes part with its fingerprint; its component_id
    is the smallest id of the others, null if there is none. Other columns of docs are not looked
    at. An empty table gives an empty result.
    """
    # Written once: the fingerprints are used three times.
    found = cut(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    alike = found.groupBy("fp").agg(F.min("id").alias("least_id"))
    linked = components(links(alike, max_bits), "near")
    grouped = alike.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    best = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    classes = grouped.join(best, "root").select(F.col("fp").alias("own"), "component_id")
    # An inner join, so that adaptive execution can split a fingerprint with very many rows.
    return found.join(classes, F.col("fp") == F.col("own")).select("id", "fp", "component_id")


@query("op5_simhash_popcount_grid")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of their group, with all their columns.

    doc_id is a key: of rows that repeat it one stays, the smallest text first. Rows without a
    doc_id cannot stand for a group and cannot be named by one; they all stay.
    """
    found = near_duplicates(docs.select("doc_id", "text")).where("id = component_id")
    named = found.select(F.col("id").alias("doc_id")).distinct()
    kept = docs.join(named, "doc_id", "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last())
    nth = "nth_" + "_".join(docs.columns)  # a name that no column has
    first = kept.withColumn(nth, F.row_number().over(order)).where(F.col(nth) == 1).drop(nth)
    return first.union(docs.where("doc_id is null"))
