"""Packing along a space-filling curve.

Every document's token counts, hashed to a vector of buckets, are projected to a few dimensions by
fixed random signs; the point's place on a Hilbert curve is the document's key. Documents are
sorted by key over ranges, laid end to end in that order, and the line is cut every `size` tokens:
neighbours on the curve, which are alike, share sequences, and only the last sequence is padded.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from turnmill.llm.common import cut, flat, id_type, ranges, steps, table
from turnmill.llm.registry import query

SIZE = 4096
END = 2
BUCKETS, DIMENSIONS, BITS = 1024, 4, 12
#: Words, and pieces of words, whose ids a task remembers.
REMEMBERED = 400_000
_SEGMENT = 1_000_000
#: Fixed values of the tokenizer's file: how it splits, and the strings that it takes whole.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_CONTROL = b"<|"


def _byte_symbols() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is a
    visible Latin-1 character, else the next one from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    rest = [b for b in range(256) if b not in set(seen)]
    return {b: chr(b) for b in seen} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


class Encoder:
    """Token ids of texts.

    The tokenizer drops white space and looks at one word at a time, so a word's ids are the same
    in every text and are remembered. New words of Latin letters are split here, by the tokenizer's
    own pattern, and only their new pieces go to its merges; other words, and texts with a control
    string's opening, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.symbols = _byte_symbols()

    def encode(self, text: bytes) -> np.ndarray:
        if _CONTROL in text:
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4")
        out, start = [], 0
        while start < len(text):
            # A segment ends after white space, so that its list of words is bounded.
            end = start + _SEGMENT
            while end < len(text) and text[end - 1] not in b" \t\n\v\f\r":
                end += 1
            out.append(self._segment(text[start:end].split()))
            start = end
        return np.frombuffer(b"".join(out), "<u4")

    def _segment(self, words: list[bytes]) -> bytes:
        known = self.words
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            if len(self.pieces) > REMEMBERED:
                self.pieces.clear()
            for w in set(words).difference(known):
                known[w] = self._word(w)
            return b"".join([known[w] for w in words])

    def _word(self, word: bytes) -> bytes:
        if word.isalpha():
            return self._piece(word.lower().decode())
        if word[:-1].isalpha() and word[-1] in b".,;:!?":
            return self._piece(word[:-1].lower().decode()) + self._piece(chr(word[-1]))
        text = unicodedata.normalize("NFC", word.decode())
        # Printable characters up to U+024F, but for U+0130, are the same in all Unicode tables.
        if not text.isprintable() or max(text) > "\u024f" or "\u0130" in text:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([self._piece(x) for x in _SPLIT.findall(text.lower())])

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            symbols = piece if piece.isascii() else "".join([self.symbols[b] for b in piece.encode()])
            ids = self.pieces[piece] = array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()
        return ids


def _signs() -> np.ndarray:
    return np.random.default_rng(7).choice([-1.0, 1.0], (BUCKETS, DIMENSIONS))


def curve_keys(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids lie end to end; first: ids before each."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 10)
    sums = np.add.reduceat(_signs()[bucket], first[:-1], axis=0)
    mean = sums / np.diff(first)[:, None]
    cells = ((mean + 0.5) * (1 << BITS)).clip(0, (1 << BITS) - 1).astype(np.int64)
    return hilbert(cells, BITS)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of rows of coordinates (Skilling 2004)."""
    x = cells.copy().T
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = top
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> b) & 1)
    return key


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """row_id, doc_id, key, n, ids (little-endian 32-bit, the end id last) for every row, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = Encoder(path), np.array([END], "<u4")
        for batch in batches:
            for part in steps(batch):
                data, offsets = flat(part.column("text"))
                raw = data.tobytes()
                ids = [np.concatenate([enc.encode(raw[a:b]), end]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                n = np.array([len(x) for x in ids], np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row_id"),
                        part.column("doc_id"),
                        pa.array(curve_keys(np.concatenate(ids), first)),
                        pa.array(n),
                        pa.array([x.astype("<u2" if small else "<u4").tobytes() for x in ids], pa.binary()),
                    ],
                    ["row_id", "doc_id", "key", "n", "ids"],
                )

    small = Tokenizer.from_file(path).get_vocab_size() <= 1 << 16
    base = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    return cut(base.mapInArrow(run, "row_id long, doc_id long, key long, n long, ids binary"), "token_ids")


def places(tokens: DataFrame) -> DataFrame:
    """row_id, place: the tokens before each row on the line of all documents in curve order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            start = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("n"), pa.array(start), pa.array(np.full(len(n), part, np.int32))],
                ["row_id", "n", "start", "part"],
            )

    order = ["key", "doc_id", "row_id"]
    # Ids split the range of a key that very many copies share.
    line = cut(
        tokens.select(*order, "n")
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .mapInArrow(run, "row_id long, n long, start long, part int"),
        "line",
    )
    # One row for each task of the sort: what is collected and broadcast has no more.
    base, before = [], 0
    for part, n in sorted(line.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        base.append((part, before))
        before += n
    begins = line.sparkSession.createDataFrame(base, "part int, base long")
    return line.join(F.broadcast(begins), "part").select("row_id", (F.col("start") + F.col("base")).alias("place"))


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every row of docs lies in exactly one piece; pieces fill sequence 0, 1, ... without
    gaps, and only the last sequence can be short. A null or empty text is its end id alone. Rows
    that repeat a doc_id, or have none, are packed one by one like any other. An empty table gives
    no pieces. Other columns are not looked at.
    """
    path = path or public_tokenizers.path("word_bpe_49k.json")
    kind = id_type(docs)
    tokens = tokenized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "ids"):
                place, n = part.column("place").to_numpy(), part.column("n").to_numpy()
                pieces = (place + n - 1) // size - place // size + 1
                row = np.repeat(np.arange(len(n)), pieces)
                sequence = place[row] // size + ranges(pieces)
                begin = np.maximum(sequence * size, place[row])
                length = np.minimum((sequence + 1) * size, (place + n)[row]) - begin
                start = begin - place[row]
                raw = part.column("ids").to_pylist()
                width = [len(x) // int(k) for x, k in zip(raw, n, strict=True)]
                whole = [np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(raw, width, strict=True)]
                ids = [whole[r][s : s + k].tobytes() for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row)),
                        pa.array(start),
                        pa.array(length),
                        pa.array(ids, pa.binary()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array(n[row]),
                        pa.array(sequence),
                        pa.array(begin - sequence * size),
                    ],
                    ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    schema = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    pieces = tokens.drop("key").join(places(tokens), "row_id").select("doc_id", "n", "ids", "place").mapInArrow(run, schema)
    return pieces.withColumn("doc_id", F.col("doc_id").cast(kind))


@query("op7_hilbert_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed along the curve."""
    return pack(table(spark, sf_dir, "documents")).drop("ids")
