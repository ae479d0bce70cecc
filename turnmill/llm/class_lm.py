"""A class-based bigram language model (Brown et al. 1992) with exchange clustering.

P(w | v) = P(class(w) | class(v)) * P(w | class(w)). The most frequent words are put into classes
by exchange: each word in turn moves to the class that gives the training text's class bigrams the
highest likelihood, until few words move. Then every other word that was seen often enough
joins the class that makes its own neighbours likeliest, all words at once from counts that a
shuffle gathers (the distributed exchange of Uszkoreit and Brants 2008), in a few rounds. Rare
words, unknown ones included, share one class, in which a word's probability comes from its count.
A text's end is a class and a token of its own, and also what the first word follows.

Counts cover all training texts: words by a shuffle into a written table, bigrams of clustered
words and of classes, and neighbours of other words by others. Tasks know the head words (a table
of bounded size). Words beyond the head are in written tables: their bigrams, classes and counts are
joined by word, so that results do not depend on where the head ends. So nothing grows with the
corpus but tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import cut, find_words, flat, mixed, steps, table, word_hashes
from turnmill.llm.registry import query
from turnmill.session import new_dir
from turnmill.sources.versions import delete_folder

#: Words whose counts and classes every task holds: 2**18 rows of 24 bytes. Those of others are joined.
HEAD = 1 << 18
#: Words that are clustered, and their classes. Their bigram table has CLUSTERED**2 cells at most.
CLUSTERED, CLASSES = 2048, 48
#: A word seen so often joins one of these classes; rarer ones have too few neighbours to tell.
SEEN = 5
#: Rounds in which the words beyond the clustered ones choose their classes.
ROUNDS = 2
#: The exchange ends when a pass moves a smaller share of the words, or after so many passes.
MOVED, PASSES = 0.002, 12
#: Pseudo-counts of a class given the class before it, spread like the classes' own frequencies.
SMOOTHING = 2.0
#: The hash that stands for a text's end.
END = 0x5BD1E995A1B2C3D7


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts and of each text's end, and the tokens before each text."""
    data = lowered(data)
    starts, ends, first = find_words(data, offsets)
    words = word_hashes(data, starts, ends)
    out = np.insert(words, first[1:], np.uint64(END))
    return out, first + np.arange(len(first))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 1, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """h, c: the hash and the count of every token of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                h, c = np.unique(tokens(*flat(part.column("text")))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])

    return docs.select("text").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Symbols:
    """Numbers of some words; ``rest`` for any other word, ``rest + 1`` for a text's end."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, rest: int):
        order = np.argsort(hashes)
        self.hashes, self.numbers, self.rest = hashes[order], numbers[order], rest

    @property
    def size(self) -> int:
        return self.rest + 2

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), self.rest)
        at, hit = _find(self.hashes, h)
        out[hit] = self.numbers[at[hit]]
        out[h == np.uint64(END)] = self.rest + 1
        return out


def _find(ordered: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in an ordered array, and which of them are there."""
    if not len(ordered):
        return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
    at = np.searchsorted(ordered, h).clip(max=len(ordered) - 1)
    return at, ordered[at] == h


@dataclass
class Encoded:
    """Training texts as numbers, written: ids are rows of some megabytes of text, the places of the words
    in hashes, their number for a text's end, and one more for any other word. Of all numbers the
    lowest bytes come first, then the next ones: most of what follows is zero and takes no room."""

    ids: DataFrame
    hashes: np.ndarray
    path: str

    def numbers(self, kind: np.ndarray, rest: int) -> np.ndarray:
        """By id: the kind of each place, rest + 1 for a text's end, rest for other words."""
        return np.append(kind, [rest + 1, rest])

    @staticmethod
    def packed(ids: np.ndarray) -> bytes:
        return ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()

    @staticmethod
    def unpacked(row: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(row, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]

    def delete(self) -> None:
        """Everything that was counted from the table is with the caller, who has no more use for it."""
        delete_folder(self.ids.sparkSession, self.path)


def encode(docs: DataFrame, hashes: np.ndarray) -> Encoded:
    """The texts once, split and looked up; all that counts bigrams of these words reads the numbers."""
    order = np.argsort(hashes)
    share = docs.sparkSession.sparkContext.broadcast((hashes[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, order = share.value
        for batch in batches:
            for part in steps(batch):
                h = tokens(*flat(part.column("text")))[0]
                at, hit = _find(ordered, h)
                ids = np.where(hit, order[at] if len(order) else 0, len(order) + 1)
                ids[h == np.uint64(END)] = len(order)
                yield pa.RecordBatch.from_arrays([pa.array([Encoded.packed(ids)], pa.binary())], ["ids"])

    spark, path = docs.sparkSession, new_dir(docs.sparkSession, "encoded")
    docs.select("text").mapInArrow(run, "ids binary").write.option("compression", "zstd").parquet(path)
    return Encoded(spark.read.schema("ids binary").parquet(path), hashes, path)


#: Rows of a batch that a task gives out.
_OUT = 1 << 18


def _cells(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """code, c of the cells that are not 0."""
    code = np.flatnonzero(counts)
    for at in range(0, max(len(code), 1), _OUT):
        part = code[at : at + _OUT]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[part].astype(np.int64))], ["code", "c"])


def encoded_bigrams(encoded: Encoded, numbers: np.ndarray) -> np.ndarray:
    """Bigrams of the symbols that the ids stand for, as a square matrix. A task sums up its own texts."""
    m = int(numbers.max()) + 1
    share = encoded.ids.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, counts = share.value, np.zeros(m * m, np.int64)
        for batch in batches:
            for ids in batch.column("ids"):
                s = numbers[Encoded.unpacked(ids.as_py())]
                if len(s):
                    # A text's first word follows an end.
                    np.add.at(counts, np.concatenate([[m - 1], s[:-1]]) * m + s, 1)
        yield from _cells(counts)

    cells = encoded.ids.mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(m * m)
    out[cells["code"].to_numpy()] = cells["c"].to_numpy()
    return out.reshape(m, m)


def bigram_counts(docs: DataFrame, symbols: Symbols) -> np.ndarray:
    """Bigrams of the symbols in all texts, as a square matrix."""
    encoded = encode(docs, symbols.hashes)
    return encoded_bigrams(encoded, encoded.numbers(symbols.numbers, symbols.rest))


def transitions(pairs: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), smoothed."""
    after = pairs.sum(0)
    common = (after + 0.5) / (after + 0.5).sum()
    return np.log10((pairs + SMOOTHING * common) / (pairs.sum(1) + SMOOTHING)[:, None])


#: Words whose cells travel together, as one row of a task.
_BLOCK = 256


def _blocks(counts: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """block, word, near, c: the cells that are not 0 of words of `width` cells each, a row for a block of
    words; word (in its block), near and c are little-endian numbers as short as they can be."""
    near_type = "<u1" if width <= 256 else "<u4"
    size = _BLOCK * width
    for at in range(0, max(len(counts), 1), 64 * size):
        code = np.flatnonzero(counts[at : at + 64 * size])
        c = counts[at + code]
        first = np.searchsorted(code, np.arange(65) * size)
        rows = []
        for i in np.flatnonzero(np.diff(first)):
            own, n = code[first[i] : first[i + 1]] - i * size, c[first[i] : first[i + 1]]
            kind = next(t for t in ("<i1", "<i2", "<i4", "<i8") if np.abs(n).max() <= np.iinfo(t).max)
            cells = [(own // width).astype("<u1"), (own % width).astype(near_type), n.astype(kind)]
            rows.append((at // size + int(i), *(x.tobytes() for x in cells)))
        columns = [pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int64()] + [pa.binary()] * 3)]
        yield pa.RecordBatch.from_arrays(columns, ["block", "word", "near", "c"])


_BLOCKS = "block long, word binary, near binary, c binary"


def encoded_neighbours(encoded: Encoded, numbers: np.ndarray, places: np.ndarray) -> DataFrame:
    """Blocks of cells: for the words of the ids in `places`, numbered in that order, their counts with
    the class before and after them. near: the class, or for the class after it the class and the number
    of symbols. A task sums up its own texts."""
    k = int(numbers.max()) + 1
    wanted = np.full(len(numbers), -1)
    wanted[places] = np.arange(len(places))
    share = encoded.ids.sparkSession.sparkContext.broadcast((numbers, wanted))
    size = len(places) * 2 * k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (numbers, wanted), counts = share.value, np.zeros(size, np.int32)
        for batch in batches:
            for row in batch.column("ids"):
                ids = Encoded.unpacked(row.as_py())
                s, word = numbers[ids], wanted[ids]
                hit = word >= 0
                before = np.concatenate([[k - 1], s[:-1]])[hit]
                after = np.concatenate([s[1:], [k - 1]])[hit]  # an end is never a word, so none is cut off
                base = word[hit] * (2 * k)
                np.add.at(counts, base + before, 1)
                np.add.at(counts, base + k + after, 1)
        yield from _blocks(counts, 2 * k)

    return encoded.ids.mapInArrow(run, _BLOCKS)


class Gains:
    """What there is to choose from: the class in which the occurrences of a word and what follows them are
    likeliest. The text's end and the common class are not chosen. Ties go to the first class."""

    def __init__(self, pairs: np.ndarray):
        self.k = k = len(pairs)
        step = transitions(pairs)
        self.gains = np.concatenate([step, step.T])[:, : k - 2]
        self.sizes = pairs.sum(0)[: k - 2]

    def best(self, counts: np.ndarray) -> np.ndarray:
        """The choice of each row of counts by near, as in encoded_neighbours()."""
        seen = counts[:, : self.k].sum(1)[:, None]
        return (counts @ self.gains - seen * np.log10(self.sizes + seen)).argmax(1)


def choices(cells: DataFrame, pairs: np.ndarray) -> DataFrame:
    """word, class: the choices of words from rows of cells (word, near, c: arrays; a word may have several)."""
    gains = Gains(pairs)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.slice(start, 4096)
                near, c = part.column("near"), part.column("c")
                row = np.repeat(np.arange(len(part)), near.value_lengths().to_numpy())
                counts = np.zeros((len(part), 2 * gains.k))
                np.add.at(counts, (row, near.flatten().to_numpy()), c.flatten().to_numpy())
                yield pa.RecordBatch.from_arrays([part.column("word"), pa.array(gains.best(counts))], ["word", "class"])

    whole = lambda name: F.flatten(F.collect_list(name)).alias(name)
    return cells.repartition("word").groupBy("word").agg(whole("near"), whole("c")).mapInArrow(choose, "word long, class long")


def head_choices(cells: DataFrame, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The choices of words (hashes) that the driver has; cells: encoded_neighbours() of all of them in
    order of their hashes, and others added to them. A task sums up one block after the other."""
    gains = Gains(pairs)
    width = 2 * gains.k

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts = None, np.zeros((_BLOCK, width))
        names = ["word", "class"]

        def chosen() -> pa.RecordBatch:
            word = np.flatnonzero(counts.any(1))
            return pa.RecordBatch.from_arrays([pa.array(held * _BLOCK + word), pa.array(gains.best(counts[word]))], names)

        for batch in batches:
            for block, *cell in zip(*(batch.column(x).to_pylist() for x in ("block", "word", "near", "c"))):
                if held is not None and block != held:
                    yield chosen()
                    counts[:] = 0
                held, n = block, len(cell[0])
                word, near, c = (np.frombuffer(x, f"<{t}{len(x) // n}") for x, t in zip(cell, "uui"))
                np.add.at(counts, (word, near), c)
        if held is not None:
            yield chosen()

    found = cells.repartition("block").sortWithinPartitions("block").mapInArrow(choose, "word long, class long").toArrow()
    out = np.full(len(words), len(pairs) - 2)
    out[np.argsort(words)[found["word"].to_numpy()]] = found["class"].to_numpy()
    return out


def best_classes(docs: DataFrame, symbols: Symbols, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The choices of some words from their neighbours among the symbols."""
    encoded = encode(docs, np.concatenate([symbols.hashes, np.sort(words)]))
    kind = np.concatenate([symbols.numbers, np.full(len(words), symbols.rest)])
    places = len(symbols.hashes) + np.arange(len(words))
    return head_choices(encoded_neighbours(encoded, encoded.numbers(kind, symbols.rest), places), words, pairs)


class Tables:
    """Written tables that go when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(path := new_dir(self.spark, name))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        while self.paths:
            delete_folder(self.spark, self.paths.pop())


@dataclass
class Beyond:
    """Words beyond the head that are seen often enough, with what the rounds need to know of them.

    words: h, c. near: word, before, after: the places of the head words before and after its occurrences,
    one entry each. both: l, r, n: bigrams of two words beyond the head, null for rare ones. classes: word,
    class. by_head: side, class, place, n: counts of words of a class before (side 0) or after (side 1) the
    head word at that place. by_class: both with classes beside the words.
    """

    tables: Tables
    words: DataFrame
    near: DataFrame
    both: DataFrame
    classes: DataFrame | None = None
    by_head: DataFrame | None = None
    by_class: DataFrame | None = None


def beyond(docs: DataFrame, head: np.ndarray, words: DataFrame, tables: Tables) -> Beyond:
    """The bigrams of `words` (h, c), all beyond the head; head: hashes.

    Words beyond the head are at most 1 in len(head) of the tokens each, so no key of these joins has
    many rows.
    """
    order = np.argsort(head)
    share = docs.sparkSession.sparkContext.broadcast((head[order], order))
    size = len(head) + 1  # of places on one side, 0 for a word beyond the head

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ordered, order = share.value
        for batch in batches:
            for part in steps(batch):
                h = np.concatenate([[np.uint64(END)], tokens(*flat(part.column("text")))[0]])
                at, hit = _find(ordered, h)
                place = np.where(hit, order[at] + 1, 0)
                some = np.flatnonzero(~hit)  # ends are in the head: there is a token on either side
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[some].view(np.int64)),
                        pa.array(place[some - 1] * size + place[some + 1]),
                        pa.array(h[some + 1].view(np.int64), mask=hit[some + 1]),
                    ],
                    ["word", "sides", "other"],
                )

    rows = docs.select("text").mapInArrow(run, "word long, sides long, other long")
    marked = lambda key, name: words.select(F.col("h").alias(key), F.lit(True).alias(name))
    found = rows.join(marked("key", "open"), F.col("word") == F.col("key"), "left").where("open OR other IS NOT NULL")
    at = {"before": f"sides div {size}", "after": f"sides % {size}"}
    listed = [F.collect_list(F.expr(f"IF(open AND {x} > 0, CAST({x} - 1 AS INT), NULL)")).alias(side) for side, x in at.items()]
    found = tables.cut(found.groupBy("word", "open").agg(*listed, F.collect_list("other").alias("others")), "open_bigrams")
    pairs = found.select("word", "open", F.explode("others").alias("other")).repartition("other")
    pairs = pairs.groupBy("other", "word", "open").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.join(marked("key", "known"), F.col("other") == F.col("key"), "left")
    both = pairs.where("open OR known").select(F.expr("IF(open, word, NULL)").alias("l"), F.expr("IF(known, other, NULL)").alias("r"), "n")
    return Beyond(tables, words, found.where("open").select("word", "before", "after"), tables.cut(both, "open_pairs"))


def with_classes(x: Beyond, classes: DataFrame) -> Beyond:
    """The same with the words' classes (word, class) known."""
    sides = "concat(transform(after, p -> struct(0 AS side, p AS place)), transform(before, p -> struct(1 AS side, p AS place)))"
    by_head = x.near.join(classes, "word").select("class", F.explode(F.expr(sides)).alias("at"))
    by_head = by_head.groupBy("at.side", "class", "at.place").agg(F.count(F.lit(1)).alias("n"))
    both = x.both
    for side, name in (("l", "a"), ("r", "b")):
        key = F.coalesce(F.col(side), F.xxhash64("l", "r", "n"))  # a rare word's rows are spread
        found = classes.select(F.col("word").alias("key"), F.col("class").alias(name))
        both = both.join(found, key == F.col("key"), "left").drop("key").withColumn(name, F.expr(f"IF({side} IS NULL, NULL, {name})"))
    written = [x.tables.cut(by_head, "classes_by_head"), x.tables.cut(both, "classes_of_pairs")]
    return Beyond(x.tables, x.words, x.near, x.both, classes, *written)


def moved_pairs(x: Beyond, kind: np.ndarray, rest: int) -> np.ndarray:
    """What the classes of words beyond the head add to bigram_counts() of the head's symbols, which
    has them all in the common class. kind: the classes of the head."""
    m = rest + 2
    share = x.words.sparkSession.sparkContext.broadcast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side, own, place, n = (batch.column(c).to_numpy() for c in ("side", "class", "place", "n"))
            near = share.value[place]
            code = lambda own: np.where(side == 0, own * m + near, near * m + own)
            code, at = np.unique(np.concatenate([code(own), code(np.full(len(own), rest))]), return_inverse=True)
            c = np.bincount(at, np.concatenate([n, -n]), len(code)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(c)], ["code", "c"])

    of = lambda a, b, n: F.struct((a * m + b).cast("long").alias("code"), n.alias("c"))
    a, b = F.coalesce("a", F.lit(rest)), F.coalesce("b", F.lit(rest))
    both = F.explode(F.array(of(a, b, F.col("n")), of(F.lit(rest), F.lit(rest), -F.col("n")))).alias("x")
    cells = x.by_head.mapInArrow(run, "code long, c long").union(x.by_class.select(both).select("x.code", "x.c"))
    cells = cells.groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(m * m)
    out[cells["code"].to_numpy()] = cells["c"].to_numpy()
    return out.reshape(m, m)


def moved_neighbours(x: Beyond, head: np.ndarray, others: np.ndarray, rest: int) -> DataFrame:
    """Blocks of what the classes of words beyond the head add to the cells of the head words at `others`."""
    m = rest + 2
    number = np.full(len(head), -1)  # in order of hashes, as head_choices() takes them
    number[others[np.argsort(head[others])]] = np.arange(len(others))
    share = x.words.sparkSession.sparkContext.broadcast(number)
    size = len(others) * 2 * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, counts = share.value, np.zeros(size, np.int32)
        for batch in batches:
            side, own, place, n = (batch.column(c).to_numpy() for c in ("side", "class", "place", "n"))
            keep = number[place] >= 0
            base, n = number[place[keep]] * (2 * m) + side[keep].astype(np.int64) * m, n[keep]
            np.add.at(counts, base + own[keep], n)
            np.add.at(counts, base + rest, -n)
        yield from _blocks(counts, 2 * m)

    return x.by_head.mapInArrow(run, _BLOCKS)


def open_neighbours(x: Beyond, kind: np.ndarray, rest: int) -> DataFrame:
    """Rows of cells (word, near, c: arrays) of the words beyond the head; kind: the classes of the head.

    Such a word is so rare that its counts are 32-bit numbers.
    """
    m = rest + 2
    share = x.words.sparkSession.sparkContext.broadcast(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for side, add in (("before", 0), ("after", m)):
                places = batch.column(side)
                row = np.repeat(np.arange(len(batch)), places.value_lengths().to_numpy())
                codes.append(row * (2 * m) + share.value[places.flatten().to_numpy()] + add)
            code, c = np.unique(np.concatenate(codes), return_counts=True)
            first = pa.array(np.searchsorted(code, np.arange(len(batch) + 1) * (2 * m)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(first, pa.array(v)) for v in ((code % (2 * m)).astype(np.int16), c.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("word"), *lists], ["word", "near", "c"])

    cells = x.near.mapInArrow(run, "word long, near array<smallint>, c array<int>")
    none = F.lit(None).cast("long")
    both = x.both.withColumns({"a": none, "b": none}) if x.by_class is None else x.by_class
    for word, near in ((F.col("l"), F.coalesce("b", F.lit(rest)) + m), (F.col("r"), F.coalesce("a", F.lit(rest)))):
        one = both.where(word.isNotNull())
        cells = cells.union(one.select(word, F.array(near.cast("smallint")), F.array(F.col("n").cast("int"))))
    return cells


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, moved: float = MOVED, passes: int = PASSES) -> np.ndarray:
    """The class of each symbol. The last two symbols keep classes of their own.

    The likelihood of a class bigram model is sum N(c,d) log N(c,d) less sum N(c) log N(c) over
    both sides. Taking a word out of its class and putting it into another changes two rows and
    two columns of N, so every target is tried on the current counts and the best one kept.
    """
    n = len(bigrams)
    m = n - 2
    k = min(classes, m)
    label = np.concatenate([np.arange(m) % max(k, 1), [k, k + 1]])
    member = np.zeros((n, k + 2))
    member[np.arange(n), label] = 1
    left, right = bigrams.T @ member, bigrams @ member  # by word: counts with the class before, after
    table_ = member.T @ bigrams @ member
    for _ in range(passes if k > 1 else 0):
        changes = 0
        for w in range(m):
            old, own = label[w], bigrams[w, w]
            row, col = right[w].copy(), left[w].copy()
            row[old] -= own
            col[old] -= own  # now without the word's bigram with itself
            table_[old] -= row
            table_[:, old] -= col
            table_[old, old] -= own
            t = table_
            # The gain of adding the word to class b, for all b at once.
            rows, cols = t[:k] + row, t[:, :k].T + col
            gain = (_xlogx(rows) - _xlogx(t[:k])).sum(1) + (_xlogx(cols) - _xlogx(t[:, :k].T)).sum(1)
            b = np.arange(k)
            cross = t[b, b]
            gain += _xlogx(cross + row[b] + col[b] + own) - _xlogx(rows[b, b]) - _xlogx(cols[b, b]) + _xlogx(cross)
            # Whatever the target, each class has again its bigrams with the word.
            out, in_ = (t.sum(1) + col)[:k], (t.sum(0) + row)[:k]
            gain -= _xlogx(out + row.sum() + own) - _xlogx(out) + _xlogx(in_ + col.sum() + own) - _xlogx(in_)
            best = int(gain.argmax())
            if gain[best] <= gain[old] + 1e-9:
                best = old
            table_[best] += row
            table_[:, best] += col
            table_[best, best] += own
            if best != old:
                changes += 1
                label[w] = best
                left[:, old] -= bigrams[w]
                left[:, best] += bigrams[w]
                right[:, old] -= bigrams[:, w]
                right[:, best] += bigrams[:, w]
        if changes <= moved * m:
            break
    return label


@dataclass
class Model:
    """Head words by hash: hash, count, class, log10 P(word | class); log10 of class transitions;
    log10 of the denominators of base scores and of words in the common class; class numbers.
    beyond: word, class, emission of the words beyond the head that joined a class, or None; sizes:
    tokens of the classes."""

    hashes: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    emission: np.ndarray
    transition: np.ndarray
    base_total: float
    rest_total: float
    rest: int
    train_tokens: int
    vocabulary: int
    beyond: DataFrame | None = None
    sizes: np.ndarray | None = None


def most_frequent(counts: DataFrame, head: int, first: int) -> DataFrame:
    """The rows of the word `first` and of the most frequent others, ties by hash; `head` rows at most.

    How many words there are by the bits of their counts tells which can't be among them: the sort gets
    a few times `head` rows, not so many from each task.
    """
    bits = F.length(F.bin("c")).alias("bits")
    found = counts.groupBy(bits).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("bits")).collect()
    least, held = 1, 0
    for row in found:
        least, held = 1 << (row.bits - 1), held + row.n
        if held >= head:
            break
    kept = counts.where((F.col("c") >= least) | (F.col("h") == first))
    return kept.orderBy(F.col("h") != first, F.desc("c"), "h").limit(head)


def fit(
    docs: DataFrame,
    counts: DataFrame,
    head: int = HEAD,
    clustered: int = CLUSTERED,
    classes: int = CLASSES,
    seen: int = SEEN,
    rounds: int = ROUNDS,
) -> Model:
    """A model of training texts, whose token counts are given."""
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n, v = int(total[0] or 0), int(total[1])
    # A text's end and the most frequent words, ties by hash: the driver gets `head` rows at most.
    end_hash = int(np.uint64(END).view(np.int64))
    top = most_frequent(counts, head, end_hash).toArrow()
    h = top["h"].to_numpy().view(np.uint64)
    c = top["c"].to_numpy()
    words = np.flatnonzero(h != np.uint64(END))
    picked = words[:clustered]
    encoded = encode(docs, h)
    alone = np.full(len(h), len(picked))
    alone[picked] = np.arange(len(picked))
    grams = encoded_bigrams(encoded, encoded.numbers(alone, len(picked)))
    label = exchange(grams, classes)
    rest, end = int(label[-2]), int(label[-1])
    kind = np.full(len(h), rest)
    kind[picked] = label[:-2]
    kind[h == np.uint64(END)] = end
    known = lambda: encoded.numbers(np.minimum(kind, rest), rest)
    member = np.eye(rest + 2)[label]
    pairs = member.T @ grams @ member
    others = words[clustered:]
    others = others[c[others] >= seen]
    more, tables = None, Tables(docs.sparkSession)
    if rest and rounds and len(h) == head and c[-1] >= seen:
        later = (F.col("c") < int(c[-1])) | ((F.col("c") == int(c[-1])) & (F.col("h") > top["h"][-1].as_py()))
        open_ = tables.cut(counts.where(later & (F.col("c") >= seen) & (F.col("h") != end_hash)).select("h", "c"), "open_words")
        more = beyond(docs, h, open_, tables) if open_.head(1) else None
    turns = rounds if (len(others) or more) and rest else 0
    if not turns:
        encoded.delete()
    for turn in range(turns):
        cells = encoded_neighbours(encoded, known(), others[np.argsort(h[others])])
        joined = None
        if more:
            if more.classes is not None:
                cells = cells.union(moved_neighbours(more, h, others, rest))
            joined = tables.cut(choices(open_neighbours(more, kind, rest), pairs), "open_classes")
        kind[others] = head_choices(cells, h[others], pairs)
        pairs = encoded_bigrams(encoded, known())
        if turn == turns - 1:
            encoded.delete()
        if more:
            more = with_classes(more, joined)
            pairs = pairs + moved_pairs(more, kind, rest)
    after = pairs.sum(0)
    # Words of the common class, with one unknown word more; half a count is added to each.
    inside = kind < rest
    tail = v - int(inside.sum()) - (more.words.count() if more else 0) - (1 if n else 0)
    rest_total = np.log10(after[rest] + 0.5 * (tail + 1))
    emission = np.zeros(len(h))
    emission[inside] = np.log10(c[inside] / after[kind[inside]])
    emission[kind == rest] = np.log10(c[kind == rest] + 0.5) - rest_total
    order = np.argsort(h)
    base_total = float(np.log10(n + 0.5 * (v + 1)))
    found = None
    if more:
        share = F.log10(F.col("c") / F.get(F.lit(after.tolist()), F.col("class").cast("int")))
        found = more.words.join(more.classes, F.col("h") == F.col("word")).select("word", "class", share.alias("emission"))
        found = cut(found, "open_emissions")
    tables.delete()
    return Model(
        h[order], c[order], kind[order], emission[order], transitions(pairs), base_total, float(rest_total), rest, n, v, found, after
    )


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def score(docs: DataFrame, counts: DataFrame, model: Model, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, n_known, base_score, score, perplexity for every row of docs.

    Scores are log10 probabilities of the whole text: base_score of its tokens by themselves with
    half a count added to each, score of the class model. A null or blank text is its end alone.
    Rows that repeat id and text get equal results, one row each; a null id is like any other.
    Other columns are not looked at.

    A word beyond the head is one row, which gets its count and class by a join and goes on to its text.
    """
    wide = model.beyond is not None
    size = len(model.transition) + 1  # of classes beside a word, 0 for none to look at
    share = docs.sparkSession.sparkContext.broadcast(
        (model.hashes, model.counts, model.classes, model.emission, model.transition, model.base_total, model.rest_total, model.rest)
    )
    names = ["mark", "n", "own", "id", "h", "place"]  # what varies side by side, so that rows compress

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, head_counts, classes, emission, transition, base_total, rest_total, rest = share.value
        end = len(transition) - 1
        for batch in batches:
            for part in steps(batch):
                h, first = tokens(*flat(part.column("text")))
                text = np.repeat(np.arange(len(part)), np.diff(first))
                at, hit = _find(hashes, h)
                safe = np.where(hit, at, 0)
                c = np.where(hit, head_counts[safe], 0) if len(hashes) else np.zeros(len(h))
                kind = np.where(hit, classes[safe], rest) if len(hashes) else np.full(len(h), rest)
                kind[h == np.uint64(END)] = end
                before = np.concatenate([[end], kind[:-1]])
                after = np.concatenate([kind[1:], [end]])
                tail = ~hit & (kind != end)
                behind, ahead = np.concatenate([[False], tail[:-1]]), np.concatenate([tail[1:], [False]])
                out = transition[before, kind]
                if wide:  # transitions of words beyond the head wait for their classes
                    out[tail | behind] = 0
                else:
                    out[tail] -= rest_total
                out = out + np.where(hit, emission[safe] if len(hashes) else 0, 0)
                base = np.where(hit, np.log10(c + 0.5), 0) - base_total
                base[~hit & (kind == end)] += np.log10(0.5)  # no training text at all
                # Other words wait for their counts, with the classes beside them, or in non-wide models once
                # for each text. Where the word beside is such a word too, both have their places in the text.
                where = np.flatnonzero(tail)
                row, th, place, n = text[where], h[where], np.zeros(len(where), np.int64), np.ones(len(where), np.int64)
                if wide:
                    spot = np.where(behind | ahead, np.arange(1, len(h) + 1) - first[text], 0)[where]
                    place = np.where(behind, 0, before + 1)[where] * size + np.where(ahead, 0, after + 1)[where]
                    place += spot * (size * size)
                elif len(where):
                    pair, n = np.unique(np.stack([row.astype(np.uint64), th]), axis=1, return_counts=True)
                    row, th, place = pair[0].astype(np.int64), pair[1], np.zeros(len(n), np.int64)
                # A text's own row gets a key that no word has, but spread like words.
                key = np.zeros(0, np.uint64) if not len(part) else mixed(np.arange(len(part), dtype=np.uint64)) ^ h[first[:-1]]
                sums = [np.diff(first), _sums(c > 0, first).astype(np.int64), _sums(base, first), _sums(out, first)]
                own = pa.StructArray.from_arrays([pa.array(x) for x in sums], ["tokens", "known", "base", "model"])
                row = pa.array(np.concatenate([np.arange(len(part)), row]))
                none = np.zeros(len(part), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("mark").take(row),
                        pa.array(np.concatenate([none, n])),
                        own.take(pa.array(np.arange(len(row)), mask=np.arange(len(row)) >= len(part))),
                        part.column("id").take(row),
                        pa.array(np.concatenate([mixed(key), th]).view(np.int64)),
                        pa.array(np.concatenate([none, place])),
                    ],
                    names,
                )

    kind = docs.schema[id_col].dataType.simpleString()
    # Where no id comes twice, it tells the texts apart, and rows need not carry their hashes.
    again = docs.groupBy(id_col).count().where("count > 1").head(1)
    mark = F.xxhash64(text_col) if again else F.lit(0).cast("long")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), mark.alias("mark"))
    own = "own struct<tokens: long, known: long, base: double, model: double>"
    rows = base.mapInArrow(run, f"mark long, n long, {own}, id {kind}, h long, place long")
    words = counts.select(F.col("h").alias("word"), "c")
    if wide:
        words = words.join(model.beyond.select("word", "class"), "word", "left")
    else:
        words = words.withColumn("class", F.lit(None).cast("long"))
    got = rows.join(words, F.col("h") == F.col("word"), "left")
    c = F.coalesce("c", F.lit(0))
    place = F.col("place") * size + F.coalesce("class", F.lit(model.rest))
    got = got.select("mark", "n", "own", "id", place.alias("place"), c.alias("c"))
    got = got.repartition("id", "mark")  # as whole numbers: sums by part of a text would be longer than what they sum up

    c = F.col("c")
    waiting = F.log10(c + 0.5)
    adds, linked = waiting, F.lit(0.0)
    if wide:
        table_, sizes = F.lit(model.transition.ravel().tolist()), F.lit(model.sizes.tolist())
        step = lambda a, b: F.get(table_, (a * (size - 1) + b).cast("int"))
        own_class, after = F.expr(f"place % {size}"), F.expr(f"place div {size} % {size} - 1")
        before, spot = F.expr(f"place div {size**2} % {size} - 1"), F.expr(f"place div {size**3}")
        emission = F.log10(c / F.get(sizes, own_class.cast("int")))
        adds = F.when(own_class == model.rest, waiting - float(model.rest_total)).otherwise(emission)
        adds += F.when(before >= 0, step(before, own_class)).otherwise(0) + F.when(after >= 0, step(own_class, after)).otherwise(0)
        pending = F.when((F.col("n") > 0) & (spot > 0), F.struct(spot.alias("spot"), own_class.alias("class")))
        chain = F.sort_array(F.collect_set(pending))
        met = lambda x, y: F.when(y["spot"] == x["spot"] + 1, step(x["class"], y["class"])).otherwise(0.0)
        linked = F.aggregate(F.zip_with("chain", F.slice("chain", 2, F.greatest(F.size("chain") - 1, F.lit(0))), met), F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    seen = F.col("n") > 0
    each = got.groupBy("id", "mark").agg(
        F.count("own").alias("rows"),
        F.sum("own.tokens").alias("tokens"),
        F.sum(F.when(seen, F.when(c > 0, F.col("n")).otherwise(0)).otherwise(F.col("own.known"))).alias("known"),
        F.sum(F.when(seen, F.col("n") * waiting).otherwise(F.col("own.base"))).alias("base"),
        F.sum(F.when(seen, F.col("n") * adds).otherwise(F.col("own.model"))).alias("model"),
        *([chain.alias("chain")] if wide else []),
    )
    one = lambda name: F.col(name) / F.col("rows")  # noqa: E731  equal rows have summed up, and their chains are one
    each = each.select(
        "id",
        one("tokens").cast("long").alias("n_tokens"),
        one("known").cast("long").alias("n_known"),
        one("base").alias("base_score"),
        (one("model") + linked).alias("score"),
        F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("copy"),
    ).drop("copy")
    return each.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


@query("op6_class_bigram_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from four in five."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    training = docs.where(~held_out(F.col("doc_id")))
    counts = cut(word_counts(training), "word_counts")
    model = fit(training, counts)
    return score(docs, counts, model).select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )
