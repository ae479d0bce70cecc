"""Finding all windows of a fixed length that occur before, in any number of documents.

A window of `length` symbols is filed under its anchor: of the k-symbol pieces in it, the one with
the smallest hash, the leftmost of ties. Equal windows have equal anchors at equal places, so they
meet at the anchor's key. Neighbouring windows that share one occurrence of an anchor form a block;
a block travels as one row with the hash of its symbols (its variant), not as windows.

Equal variants settle each other: all but the first are repeats. Only where an anchor has more than
one variant are symbols needed, for the first block of each variant; those "open" blocks fetch
their symbols by document and are compared by the solver that the caller brings.

Hot keys: repeats within one slice of the input are settled there, and travel under a random key.
An anchor with very many open blocks is compared by whole windows instead, each under its own
hash, by the same match; no key ever gathers the symbols of an unbounded number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import Hashes, cut, flat, id_type, mixed, ranges, runs, steps

#: Windows that one vectorised step looks at.
PART = 1_000_000
#: Open blocks of one anchor whose symbols may meet in one task.
OPEN = 2_000

#: symbols(data, offsets) -> (values, symbols before each text); values are uint8 or uint64.
Symbols = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: solve([(doc_id, place of the anchor in the block, values)] in order) -> [(index, first window, windows)]
Solver = Callable[[list[tuple[int, int, np.ndarray]]], list[tuple[int, int, int]]]

_BLOCK = "anchor long, variant long, doc_id long, loc long, n int, done boolean"
_FOUND = "doc_id long, loc long, n int, open boolean, anchor long"


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of width values."""
    out, done = keys, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


def blocks_of(values: np.ndarray, first: np.ndarray, length: int, k: int):
    """Blocks of all windows: text number, place of the first window in its text, windows, anchor, variant."""
    out = []
    sizes = np.maximum(np.diff(first) - length + 1, 0)
    starts = np.repeat(first[:-1], sizes) + ranges(sizes)
    texts = np.repeat(np.arange(len(sizes)), sizes)
    for a in range(0, len(starts), PART):
        at, text = starts[a : a + PART], texts[a : a + PART]
        low, high = int(at[0]), int(at[-1]) + length
        hashes = Hashes(values[low:high])
        every = np.arange(high - low - k + 1)
        piece = hashes.of(every, every + k)
        keys = (piece & ~np.uint64(0xFFFFFFFF)) | every.astype(np.uint64)
        at = at - low
        anchor = (_least(keys, length - k + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        begin = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        n = np.diff(np.append(begin, len(at)))
        s = at[begin]
        variant = mixed(hashes.of(s, s + n - 1 + length) + (anchor[begin] - s).astype(np.uint64))
        out.append((text[begin], s + low - first[text[begin]], n, piece[anchor[begin]], variant))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """For rows sorted by keys, the index of the first row with the same keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _repeated(anchor, variant, doc, loc, within: bool) -> np.ndarray:
    """Whether a row, of rows sorted by anchor, variant, doc, loc, has an equal one at an earlier
    place; unless within, one in a smaller document."""
    first = _first_of(anchor, variant)
    return (doc != doc[first]) | (within & (loc != loc[first]))


def _settle(doc, loc, n, anchor, variant, within: bool) -> pa.RecordBatch:
    """Rows for match(): known repeats joined to long stretches under a random key, then the rest."""
    order = np.lexsort((loc, doc, variant, anchor))
    done = np.zeros(len(order), bool)
    done[order] = _repeated(anchor[order], variant[order], doc[order], loc[order], within)
    d, o, c = doc[done], loc[done], n[done]
    keep = np.lexsort((o, d))
    d, o, c = d[keep], o[keep], c[keep]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (o[1:] != o[:-1] + c[:-1])
    begin = np.flatnonzero(new)
    c = np.add.reduceat(c, begin) if len(begin) else c
    d, o = d[begin], o[begin]
    key = mixed(d.view(np.uint64) ^ mixed(o.view(np.uint64))).view(np.int64)
    live = ~done
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([anchor[live].view(np.int64), key])),
            pa.array(np.concatenate([variant[live].view(np.int64), np.zeros(len(key), np.int64)])),
            pa.array(np.concatenate([doc[live], d])),
            pa.array(np.concatenate([loc[live], o])),
            pa.array(np.concatenate([n[live], c]).astype(np.int32)),
            pa.array(np.concatenate([np.zeros(live.sum(), bool), np.ones(len(key), bool)])),
        ],
        ["anchor", "variant", "doc_id", "loc", "n", "done"],
    )


def match(blocks: DataFrame, within: bool) -> DataFrame:
    """Blocks that repeat an earlier one whole (open: false), and the first ones of anchors with
    several variants (open: true)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (anchor, variant, doc, loc, n, done) in runs(batches, "anchor"):
            done = done.astype(bool)
            repeat = _repeated(anchor, variant, doc, loc, within) & ~done
            kinds = np.flatnonzero(_first_of(anchor, variant) == np.arange(len(anchor)))
            owner = _first_of(anchor)
            several = np.bincount(owner[kinds], minlength=len(anchor))[owner] > 1
            open_ = several & ~repeat & ~done
            out = repeat | open_ | done
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[out]), pa.array(loc[out]), pa.array(n[out]), pa.array(open_[out]), pa.array(anchor[out])],
                ["doc_id", "loc", "n", "open", "anchor"],
            )

    return (
        blocks.repartition("anchor")
        .sortWithinPartitions("anchor", "variant", "doc_id", "loc")
        .mapInArrow(run, _FOUND)
    )


def _loc(mark: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Text hash and place in one long, which sorts by both."""
    return (mark.astype(np.int64) << 32) | start.astype(np.int64)


def repeated_spans(
    docs: DataFrame,
    symbols: Symbols,
    solve: Solver,
    length: int,
    k: int,
    within: bool,
) -> DataFrame:
    """docs as one column `row`, with a column `spans`: array of (mark, start, n), the repeated windows.

    n windows from symbol `start` on repeat one that starts earlier: in a smaller doc_id, or, if
    within, in the same text. mark is the text's hash, F.hash(row.text): rows that share a doc_id
    but not the text are told apart by it, equal rows get equal spans. Rows without a doc_id have
    no spans and are no source.
    """
    id_type(docs)
    by_id = docs.select(F.struct("*").alias("row")).repartition(F.col("row.doc_id"))
    source = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.hash("text").alias("mark")
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                values, first = symbols(*flat(part.column("text")))
                text, start, n, anchor, variant = blocks_of(values, first, length, k)
                doc = part.column("doc_id").to_numpy()[text]
                loc = _loc(part.column("mark").to_numpy()[text], start)
                yield _settle(doc, loc, n, anchor, variant, within)

    found = cut(match(source.mapInArrow(parse, _BLOCK), within), "blocks")
    opened = found.where("open")
    hot = opened.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_open")).where(F.col("n_open") > OPEN)
    opened = opened.join(hot, "anchor", "left").groupBy("doc_id").agg(
        F.collect_list(F.struct("loc", "n", "anchor", F.col("n_open").isNotNull().alias("hot"))).alias("open")
    )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Symbols of open blocks; the windows of hot anchors one by one, as blocks under their hash."""
        for batch in batches:
            batch = batch.filter(batch.column("open").is_valid())
            for part in steps(batch):
                values, first = symbols(*flat(part.column("text")))
                lists, ids, marks = part.column("open"), part.column("doc_id").to_numpy(), part.column("mark").to_numpy()
                at = lists.flatten()
                text = np.repeat(np.arange(len(part)), np.diff(lists.offsets.to_numpy()))
                loc, n = at.field("loc").to_numpy(), at.field("n").to_numpy().astype(np.int64)
                hot_ = at.field("hot").to_numpy(zero_copy_only=False)
                anchor = at.field("anchor").to_numpy()
                mine = np.flatnonzero((loc >> 32) == marks[text])
                start = (loc & 0xFFFFFFFF) + first[text]
                cold, warm = mine[~hot_[mine]], mine[hot_[mine]]
                content = [values[s : s + m - 1 + length].tobytes() for s, m in zip(start[cold].tolist(), n[cold].tolist(), strict=True)]
                place = _anchor_places(values, start[cold], n[cold], anchor[cold], length, k)
                yield _fetched(anchor[cold], place, ids[text[cold]], loc[cold], n[cold], content)
                if len(warm):
                    one = np.repeat(start[warm], n[warm]) + ranges(n[warm])
                    h = np.concatenate([
                        Hashes(values[s : s + m - 1 + length]).of(np.arange(m), np.arange(m) + length)
                        for s, m in zip(start[warm].tolist(), n[warm].tolist(), strict=True)
                    ])
                    owner = np.repeat(text[warm], n[warm])
                    place = _loc(marks[owner], one - first[owner])
                    settled = _settle(ids[owner], place, np.ones(len(one), np.int64), h, h, within)
                    yield pa.RecordBatch.from_arrays(
                        [*settled.columns, pa.nulls(settled.num_rows, pa.binary())], [*settled.schema.names, "content"]
                    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = symbols(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0].dtype
        group, key = [], None

        def solved():
            blocks = [(d, at, np.frombuffer(c, kind)) for d, _, at, c in group]
            rows = [(group[i][0], group[i][1] + a, n) for i, a, n in solve(blocks)]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32()))],
                ["doc_id", "loc", "n"],
            )

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "loc", "variant", "content")), strict=True):
                if row[0] != key:
                    if len(group) > 1:
                        yield solved()
                    group, key = [], row[0]
                if not group or row[1:3] != group[-1][:2]:  # rows of docs that are equal give it twice
                    group.append(row[1:])
        if len(group) > 1:
            yield solved()

    fetched = (
        by_id.join(opened, by_id["row.doc_id"] == opened["doc_id"], "left")
        .select(opened["doc_id"], F.col("row.text").alias("text"), F.hash("row.text").alias("mark"), "open")
        .mapInArrow(fetch, f"{_BLOCK}, content binary")
    )
    solved = (
        fetched.where("content is not null")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "doc_id", "loc")
        .mapInArrow(compare, "doc_id long, loc long, n int")
    )
    single = match(fetched.where("content is null").drop("content"), within).where("not open")
    spans = found.where("not open").select("doc_id", "loc", "n").union(solved).union(single.select("doc_id", "loc", "n"))
    listed = spans.groupBy("doc_id").agg(
        F.collect_list(
            F.struct(
                F.shiftright("loc", 32).cast("int").alias("mark"),
                F.col("loc").bitwiseAND(F.lit(0xFFFFFFFF)).alias("start"),
                "n",
            )
        ).alias("spans")
    )
    return by_id.join(listed, by_id["row.doc_id"] == listed["doc_id"], "left").select("row", "spans")


def _anchor_places(values, start, n, anchor, length: int, k: int) -> np.ndarray:
    """Where the anchor is in each block: the first place, of those in all its windows, with its hash."""
    places = np.zeros(len(start), np.int64)
    for a in range(0, len(start), 100_000):
        s, m = start[a : a + 100_000], n[a : a + 100_000]
        if not len(s):
            break
        low = int(s.min())
        hashes = Hashes(values[low : int((s + m).max()) - 1 + length])
        width = length - k - m + 2
        at = np.repeat(s + m - 1, width) + ranges(width) - low
        owner = np.repeat(np.arange(len(s)), width)
        hit = np.flatnonzero(hashes.of(at, at + k) == anchor[a : a + 100_000].view(np.uint64)[owner])
        block, first = np.unique(owner[hit], return_index=True)
        places[a + block] = at[hit[first]] + low - s[block]
    return places


def _fetched(anchor, place, doc, loc, n, content) -> pa.RecordBatch:
    """Open blocks; the column of the variant, settled by now, holds the place of the anchor."""
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchor),
            pa.array(place),
            pa.array(doc),
            pa.array(loc),
            pa.array(n.astype(np.int32)),
            pa.array(np.zeros(len(anchor), bool)),
            pa.array(content, pa.binary()),
        ],
        ["anchor", "variant", "doc_id", "loc", "n", "done", "content"],
    )


def covered(spans: pa.ListArray, mark: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
    """For symbols of texts laid end to end (first: symbols before each), whether a span covers them."""
    at = spans.flatten()
    text = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
    start, n = at.field("start").to_numpy(), at.field("n").to_numpy()
    mine = at.field("mark").to_numpy() == mark[text]
    begin = first[text[mine]] + start[mine]
    steps_ = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(steps_, begin, 1)
    np.add.at(steps_, begin + n[mine] - 1 + length, -1)
    return np.cumsum(steps_)[:-1] > 0
