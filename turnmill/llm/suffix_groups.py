"""Repeated byte strings by suffix arrays that are built in linear grouping.

A suffix's Lyndon prefix is the longest Lyndon word that it starts with. Suffixes with the same one
form a group, and groups in the order of their prefixes are already in suffix order; what is left
is the order within a group, which is that of the suffixes that follow the shared prefix.

The corpus is split for this by repeats.py: blocks of bytes that share an anchor can hold the same
100-byte string, and blocks that are equal as a whole settle each other by their hash. The others
of an anchor are laid end to end, their suffixes sorted by linear grouping, and suffixes that
neighbours share 100 bytes with are one repeated string: all but the first are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import flat, id_type, steps, table
from turnmill.llm.registry import query
from turnmill.llm.repeats import covered, repeated_spans

LENGTH = 100
#: Bytes of an anchor.
ANCHOR_BYTES = 16


def lyndon_groups(text: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix the start of its Lyndon-prefix group in suffix order, and the nearest
    earlier suffix of a lower group (-1 for none). text ends with its unique smallest symbol.

    Groups begin as those of equal first symbols and are taken from the highest down. A taken
    group is final; the suffixes that its members' pointers lead to go on with that group's
    prefix, once for each member, so they move to the upper end of their own group, those with
    more members higher, and become groups of their own.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group = [0] * n, [0] * n
    start, seen = 0, None
    for at, i in enumerate(order):
        if text[i] != seen:
            start, seen = at, text[i]
        place[i], group[i] = at, start
    size = {}
    for g in group:
        size[g] = size.get(g, 0) + 1
    before = [-2] * n
    end = n
    while end:
        start = group[order[end - 1]]
        times: dict[int, int] = {}
        for i in sorted(order[start:end]) if end - start > 1 else (order[start],):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        by_times: dict[int, dict[int, list[int]]] = {}
        for j, k in times.items():
            by_times.setdefault(k, {}).setdefault(group[j], []).append(j)
        for k in sorted(by_times, reverse=True) if len(by_times) > 1 else by_times:
            for g, members in by_times[k].items():
                if len(members) == size[g]:
                    continue
                top = g + size[g]
                for j in members:
                    top -= 1
                    other, at = order[top], place[j]
                    order[at], place[other] = other, at
                    order[top], place[j] = j, top
                for j in members:
                    group[j] = top
                size[top] = len(members)
                size[g] -= len(members)
        end = start
    return group, before


def suffix_array(symbols: list[int]) -> list[int]:
    """Starts of the suffixes of symbols in their order.

    Suffixes come out in ascending order: a suffix that is out is followed, within the groups of
    the suffixes just before it, by those whose Lyndon prefix ends where it starts; pointers to
    earlier smaller suffixes lead from one to the next.
    """
    if not symbols:
        return []
    text = [*symbols, min(symbols) - 1]
    group, before = lyndon_groups(text)
    n = len(text)
    free = {g: g for g in group}
    out = [-1] * n
    done = [False] * n
    out[0], done[n - 1] = n - 1, True
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out[1:]


def common_prefixes(symbols: list[int], array: list[int]) -> list[int]:
    """Symbols that each suffix of the array shares with the one before it."""
    n = len(symbols)
    rank, shared = [0] * n, [0] * n
    for at, i in enumerate(array):
        rank[i] = at
    h = 0
    for i in range(n):
        if rank[i]:
            j = array[rank[i] - 1]
            top = n - max(i, j)
            while h < top and symbols[i + h] == symbols[j + h]:
                h += 1
            shared[rank[i]] = h
            h = h - 1 if h else 0
        else:
            h = 0
    return shared


def _longest_shared(sides: list[bytes]) -> list[int]:
    """For each string the longest prefix that it shares with another one."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    best = [0] * len(sides)
    for i, j in zip(order, order[1:], strict=False):
        a, b = sides[i], sides[j]
        m = min(len(a), len(b))
        if a[:m] != b[:m]:
            m = int(np.argmin(np.frombuffer(a, np.uint8, m) == np.frombuffer(b, np.uint8, m)))
        best[i], best[j] = max(best[i], m), max(best[j], m)
    return best


def solver(length: int):
    """Windows of `length` bytes that another block, or an earlier place, has before.

    Equal windows of two blocks lie alike around the anchor. So only the stretch of a block can
    matter that reaches as far to each side as it equals some other block there.
    """

    def solve(blocks: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        raw = [values.tobytes() for _, _, values in blocks]
        left = _longest_shared([x[:at][::-1] for x, (_, at, _) in zip(raw, blocks, strict=True)])
        right = _longest_shared([x[at:] for x, (_, at, _) in zip(raw, blocks, strict=True)])
        symbols: list[int] = []
        starts, owners, shift = [], [], []
        for i, (_, at, _) in enumerate(blocks):
            if left[i] + right[i] >= length:
                starts.append(len(symbols))
                owners.append(i)
                shift.append(at - left[i])
                symbols.extend(raw[i][at - left[i] : at + right[i]])
                symbols.append(-1 - i)  # no string runs over the end of a block
        if len(owners) < 2:
            return []
        array = suffix_array(symbols)
        shared = common_prefixes(symbols, array)
        repeats, least, run = [], -1, []
        for at, h in zip(array, shared, strict=True):
            if h < length:
                repeats.extend(x for x in run if x != least)
                run, least = [at], at
            else:
                run.append(at)
                least = min(least, at)
        repeats.extend(x for x in run if x != least)
        out: list[tuple[int, int, int]] = []
        if not repeats:
            return out
        at = np.sort(np.array(repeats))
        owner = np.searchsorted(starts, at, "right") - 1
        new = np.flatnonzero((np.diff(at, prepend=-2) != 1) | (np.diff(owner, prepend=-1) != 0))
        for a, b in zip(new, np.append(new[1:], len(at)), strict=True):
            k = owner[a]
            out.append((owners[k], int(at[a] - starts[k] + shift[k]), int(b - a)))
        return out

    return solve


def byte_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans, kept, kept_sha256 for every row of docs.

    A byte of the UTF-8 text goes when a string of `length` bytes over it also starts earlier: in a
    smaller doc_id, or before in the same text. Strings are those of the input, and never cross
    texts. spans are the maximal removed runs (start, end), kept the other bytes, which may cut a
    character. Null texts are empty. Of rows with one doc_id but different texts the one with the
    smaller text hash (F.hash) counts as earlier; equal rows count as one and get equal results.
    Rows without a doc_id lose nothing and remove nothing. Other columns are not looked at.
    """
    spanned = repeated_spans(
        docs.select("doc_id", "text"), byte_symbols, solver(length), length, min(ANCHOR_BYTES, length), within=True
    ).select("row.doc_id", F.col("row.text").alias("text"), F.hash("row.text").alias("mark"), "spans")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                data, offsets = flat(part.column("text"))
                gone = covered(part.column("spans"), part.column("mark").to_numpy(), offsets, length)
                kept, spans = [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    mine = gone[a:b]
                    kept.append(data[a:b][~mine].tobytes())
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                    spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                sizes = np.array([len(x) for x in kept], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(offsets)),
                        pa.array(np.diff(offsets) - sizes),
                        pa.array([len(x) for x in spans], pa.int64()),
                        pa.array(spans, span),
                        pa.array(kept, pa.binary()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"],
                )

    schema = (
        f"doc_id {id_type(docs)}, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, "
        "kept binary, kept_sha256 string"
    )
    return spanned.mapInArrow(run, schema)


@query("op3_linear_grouping_suffixes")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated strings removed from all documents."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans", "kept")
