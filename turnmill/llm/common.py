"""Tables, written cuts of lineage, and Arrow helpers that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from turnmill.session import new_dir

#: Bytes of text that one step of a vectorised loop holds, unless one text is longer.
STEP_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a table written in the shared folder: lineage ends there."""
    path = new_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_type(docs: DataFrame, name: str = "doc_id") -> str:
    """The type of an id that is a whole number; tasks take it as long, results have it again."""
    kind = docs.schema[name].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{name} must be a whole number, not {kind.simpleString()}.")
    return kind.simpleString()


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each text starts in them (one entry more than
    texts). A null text is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, name: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most limit bytes of text, or of one row."""
    if not batch.num_rows:
        return
    _, offsets = flat(batch.column(name))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, "right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each text."""
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_ODD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all bits depend on all bits."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, as many as asked for so far."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> Powers:
        while len(self.up) <= n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))])
        return self


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_ODD))
_POWERS = Powers(0xD1342543DE82EF95)


class Hashes:
    """Hashes of any stretch of a sequence of bytes or of 64-bit values, from running sums."""

    def __init__(self, values: np.ndarray):
        values = _BYTES[values] if values.dtype == np.uint8 else values
        self.powers = _POWERS.to(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.powers.up[: len(values)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[starts:ends]; the length counts too."""
        h = (self.sums[ends] - self.sums[starts]) * self.powers.down[starts]
        return mixed(h + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


_LANE_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, limit: int = STEP_BYTES) -> np.ndarray:
    """Hashes of words of the bytes, some megabytes at a time, so that long texts take no more memory.

    A word is taken as numbers of eight bytes. Each is scrambled together with its place, so that no
    pattern of letters lines up with a pattern of powers; words of up to eight bytes never share a hash.
    """
    out, i = np.zeros(len(starts), np.uint64), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + limit, "right")))
        low = starts[i]
        size = ends[i:j] - starts[i:j]
        lanes = (size + 7) // 8
        place = ranges(lanes)
        at = np.repeat(starts[i:j] - low, lanes) + 8 * place
        held = np.concatenate([data[low : ends[j - 1]], np.zeros(8, np.uint8)])
        value = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(held, 8)[at]).view("<u8")[:, 0]
        value &= _LANE_MASK[np.minimum(np.repeat(ends[i:j] - low, lanes) - at, 8)]
        keys = mixed(np.arange(1, int(lanes.max(initial=0)) + 1, dtype=np.uint64) * np.uint64(_ODD))
        summed = np.add.reduceat(mixed(value ^ keys[place]), np.cumsum(lanes) - lanes)
        out[i:j] = mixed(summed + size.astype(np.uint64) * np.uint64(_ODD))
        i = j
    return out


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of counts, one after the other."""
    counts = np.asarray(counts, np.int64)
    if not len(counts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) - np.repeat(ends - counts, counts)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Sorted rows of long columns in pieces that hold every key whole: the key, all columns."""
    held = None
    for batch in batches:
        cols = [np.asarray(c.to_numpy(zero_copy_only=False)) for c in batch.columns]
        cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols, strict=True)]
        k = cols[batch.schema.get_field_index(key)]
        last = int(np.searchsorted(k, k[-1], "left")) if len(k) else 0
        if last:
            yield k[:last], [c[:last] for c in cols]
        held, at = [c[last:] for c in cols], batch.schema.get_field_index(key)
    if held is not None and len(held[0]):
        yield held[at], held
