"""Repeated passages of words by relative Lempel-Ziv parsing.

A document is parsed against the blocks of all documents with a smaller doc_id, which are its
reference: repeats.py brings together the blocks that can share a window. The parse is greedy: a
factor starts where a window is found in the reference index and runs on while the next words equal
those of the reference block. A factor of at least a window is a duplicate span. A window that
straddles the end of a factor may still be in another reference block, so the search goes on with
the first window that the factor does not hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import find_words, flat, id_type, steps, table, word_hashes
from turnmill.llm.registry import query
from turnmill.llm.repeats import covered, repeated_spans

WINDOW_WORDS = 13
#: Words of an anchor.
ANCHOR_WORDS = 5


def word_symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word."""
    starts, ends, first = find_words(data, offsets)
    return word_hashes(data, starts, ends), first


def parse(words: bytes, window: int, index: dict[bytes, tuple[bytes, int]], width: int = 8) -> list[tuple[int, int]]:
    """Factors (start, end) of a block, in words of `width` bytes, against the blocks in the index."""
    factors, size, p = [], len(words) // width, 0
    while p + window <= size:
        hit = index.get(words[p * width : (p + window) * width])
        if hit is None:
            p += 1
            continue
        block, at = hit
        end = p + window
        while end < size and words[end * width : (end + 1) * width] == block[(at + end - p) * width : (at + end - p + 1) * width]:
            end += 1
        factors.append((p, end))
        p = end - window + 1  # windows over the boundary are looked up on their own
    return factors


def solver(window: int):
    """Spans of windows that start in a block of a smaller document."""

    def solve(blocks: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        index: dict[bytes, tuple[bytes, int]] = {}
        found, waiting, doc = [], [], None
        for i, (owner, _, values) in enumerate(blocks):
            if owner != doc:  # a document's own blocks join the reference when it is done
                for words in waiting:
                    for p in range(len(words) // 8 - window + 1):
                        index.setdefault(words[p * 8 : (p + window) * 8], (words, p))
                waiting, doc = [], owner
            words = values.tobytes()
            found.extend((i, s, e - s - window + 1) for s, e in parse(words, window, index))
            waiting.append(words)
        return found

    return solve


def with_spans(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """docs as `row`, with `spans`; see repeated_spans."""
    return repeated_spans(docs, word_symbols, solver(window), window, min(ANCHOR_WORDS, window), within=False)


def remove_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, kept_sha256 for every row of docs.

    A word goes when a window of `window` words over it also starts in a document with a smaller
    doc_id; windows are those of the input. kept_text joins the other words by blanks. Null and
    blank texts have no words and keep the empty text. Rows that share a doc_id never remove from
    each other; rows without one lose nothing and remove nothing. Other columns are not looked at.
    """
    spanned = with_spans(docs.select("doc_id", "text"), window).select(
        "row.doc_id", F.col("row.text").alias("text"), F.hash("row.text").alias("mark"), "spans"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                data, offsets = flat(part.column("text"))
                starts, ends, first = find_words(data, offsets)
                gone = covered(part.column("spans"), part.column("mark").to_numpy(), first, window)
                kept, raw = [], data.tobytes()
                s, e = starts.tolist(), ends.tolist()
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    kept.append(b" ".join([raw[s[i] : e[i]] for i in a + np.flatnonzero(~gone[a:b])]))
                removed = np.concatenate([[0], np.cumsum(gone)])[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(first)),
                        pa.array(np.diff(removed)),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    return spanned.mapInArrow(run, f"doc_id {id_type(docs)}, n_words long, n_removed long, kept_text string, kept_sha256 string")


@query("op9_relative_lempel_ziv")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of repeated passages removed from all documents."""
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def without_repeats(docs: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """All rows and columns of docs. A text that loses words by remove_repeats' rule becomes its
    other words joined by blanks, and n_chars, where there is such a column, its length; other
    texts stay as they are."""
    spanned = with_spans(docs, window)
    hit = spanned.select("row", F.col("row.text").alias("text"), F.hash("row.text").alias("mark"), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                data, offsets = flat(part.column("text"))
                starts, ends, first = find_words(data, offsets)
                gone = covered(part.column("spans"), part.column("mark").to_numpy(), first, window)
                raw, s, e, kept = data.tobytes(), starts.tolist(), ends.tolist(), []
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    lost = gone[a:b].any()
                    kept.append(b" ".join([raw[s[i] : e[i]] for i in a + np.flatnonzero(~gone[a:b])]) if lost else None)
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "cut_text"])

    schema = f"row {spanned.schema['row'].dataType.simpleString()}, cut_text string"
    new = {"text": F.coalesce("cut_text", "row.text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("cut_text").isNull(), F.col("row.n_chars")).otherwise(F.length("cut_text").cast(kind))
    return hit.mapInArrow(run, schema).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
