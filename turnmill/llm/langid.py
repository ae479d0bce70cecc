"""Language identification with string kernels.

A text is the set of its blended-spectrum n-grams (1 to 3 bytes of the lower-cased text, everything
but letters a blank). The presence kernel of two texts is the number of n-grams they share, divided
by the geometric mean of their numbers of n-grams. Nystroem landmarks, the same number of training
texts per language, stand for the training set: n-grams outside all landmarks count in a text's own
number only, so that a text in no learned language scores low. Kernel values with the landmarks are
whitened by the landmarks' own kernel matrix, and a one-versus-rest ridge regression on them gives a
score per language. A batch of texts is scored by two matrix products: with the landmarks' n-grams,
then with the regression's weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.llm.common import flat, id_type, steps, table
from turnmill.llm.registry import query

UNKNOWN = "und"
#: Landmarks and further training texts of each language: the bound of the sample that is fitted.
LANDMARKS = 32
SAMPLE = 200
#: A session with more languages than this is refused, so that the model's size is bounded.
MAX_LANGUAGES = 300
RIDGE = 1e-3
#: Parts in which the rows of a language are ranked before their least are ranked together.
PARTS = 32
_CODES = (1 << 24) + (1 << 16) + (1 << 8)
_ROWS = 64

#: Bytes that stay: letters a-z and all bytes beyond ASCII; others count as a blank.
_KEEP = np.full(256, 0x20, np.uint8)
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of texts laid end to end, and the text of each, with repeats."""
    b = _KEEP[data].astype(np.int32)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    two = text[1:] == text[:-1]
    three = text[2:] == text[:-2]
    pair = (b[:-1] << 8) | b[1:]
    triple = (pair[:-1] << 8) | b[2:]
    return (
        np.concatenate([triple[three], pair[two] + (1 << 24), b + ((1 << 24) + (1 << 16))]),
        np.concatenate([text[2:][three], text[1:][two], text]),
    )


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return flat(pc.utf8_lower(column))


@dataclass
class Model:
    """Languages, the column of each n-gram code, the landmarks' n-grams, and the weights."""

    languages: list[str]
    codes: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def kernel(self, present: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Kernel of rows of n-gram presence with the landmarks; size: the n-grams of each row, those
        outside all landmarks too."""
        own = np.sqrt(np.maximum(size, 1))
        theirs = np.sqrt(np.maximum(self.landmarks.sum(1), 1))
        return (present @ self.landmarks.T) / own[:, None] / theirs[None, :]

    def scores(self, data: np.ndarray, offsets: np.ndarray, column: np.ndarray) -> np.ndarray:
        """A score for each text and language; column: the column of each code, -1 for none."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        for a in range(0, len(out), _ROWS):
            where = offsets[a : a + _ROWS + 1]
            present = np.zeros((len(where) - 1, len(self.codes)), np.float32)
            others = []
            for part in _pieces(where):
                codes, text = ngrams(data[part[0] : part[-1]], part - part[0])
                at = column[codes]
                present[text[at >= 0], at[at >= 0]] = 1
                others.append(np.unique(text[at < 0] * _CODES + codes[at < 0]))
            other = np.bincount(np.unique(np.concatenate(others)) // _CODES, minlength=len(present))
            out[a : a + _ROWS] = self.kernel(present, present.sum(1) + other) @ self.weights
        return out

    def columns(self) -> np.ndarray:
        column = np.full(_CODES, -1, np.int32)
        column[self.codes] = np.arange(len(self.codes), dtype=np.int32)
        return column


def _pieces(where: np.ndarray, limit: int = 1_000_000) -> Iterator[np.ndarray]:
    """Offsets of the texts, cut so that a piece has a bounded number of bytes. A piece starts two
    bytes before the last one's end, so that no n-gram is lost; presence does not mind repeats."""
    low, high = int(where[0]), int(where[-1])
    while True:
        end = min(low + limit, high)
        yield np.clip(where, low, end)
        if end == high:
            return
        low = end - 2


def training(doc_id: Column, lang: Column) -> Column:
    """Whether a row is learned from: a language, an id, and crc32 of the id as text mod 4 not 2."""
    return lang.isNotNull() & doc_id.isNotNull() & ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, landmarks: int = LANDMARKS, sample: int = SAMPLE, ridge: float = RIDGE) -> Model | None:
    """A model of the languages in docs (doc_id, text, lang), or None without any.

    Of each language the `landmarks + sample` training rows with the smallest hash of their id are
    used, whole texts; every other row with a language only counts as one that could have been.
    """
    id_type(docs)
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    able = docs.where(training(F.col("doc_id"), F.col("lang"))).where(F.col("text").rlike("\\p{L}"))
    least = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("hash", "doc_id"))
    picked = (
        able.select("lang", "doc_id")
        .distinct()
        .withColumn("hash", F.xxhash64("doc_id"))
        # The least of each part first, so that a language's last task reads a fixed number of rows.
        .withColumn("part", F.pmod("hash", F.lit(PARTS)))
        .withColumn("nth", least("lang", "part"))
        .where(F.col("nth") <= landmarks + sample)
        .withColumn("nth", least("lang"))
        .where(F.col("nth") <= landmarks + sample)
        .select("lang", "doc_id", "nth")
        .limit((landmarks + sample) * MAX_LANGUAGES + 1)
        .collect()
    )
    languages = sorted({r.lang for r in picked})
    if not languages:
        return None
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} languages.")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                data, offsets = _lower(part.column("text"))
                out = []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    found = [np.unique(ngrams(data[p[0] : p[-1]], p - p[0])[0]) for p in _pieces(np.array([a, b]))]
                    out.append(np.unique(np.concatenate(found)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), part.column("doc_id"), pa.array(out, pa.list_(pa.int32()))], ["lang", "doc_id", "codes"]
                )

    ids = sorted({r.doc_id for r in picked})
    rows = (
        able.where(F.col("doc_id").isin(ids))
        .groupBy("lang", "doc_id")
        .agg(F.min("text").alias("text"))  # one of the rows that repeat an id
        .mapInArrow(sets, "lang string, doc_id long, codes array<int>")
        .toArrow()
        .sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    )
    nth = {(r.lang, r.doc_id): r.nth for r in picked}
    first = {}
    for lang, doc_id, codes in zip(*(rows[c].to_pylist() for c in ("lang", "doc_id", "codes")), strict=True):
        first.setdefault((lang, doc_id), np.array(codes, np.int64))
    chosen = sorted(k for k in first if nth[k] <= landmarks)
    codes = np.unique(np.concatenate([first[k] for k in chosen]))
    marks = np.zeros((len(chosen), len(codes)), np.float32)
    for i, k in enumerate(chosen):
        marks[i, np.searchsorted(codes, first[k])] = 1
    model = Model(languages, codes, marks, np.zeros((len(chosen), len(languages))))
    own, vectors = np.linalg.eigh(model.kernel(marks, marks.sum(1)).astype(float))
    good = own > 1e-6 * own.max()
    whiten = vectors[:, good] / np.sqrt(own[good])
    keys = sorted(first)
    kernel = np.zeros((len(keys), len(chosen)))
    for i, k in enumerate(keys):
        present = np.zeros((1, len(codes)), np.float32)
        at = np.searchsorted(codes, first[k]).clip(max=len(codes) - 1)
        present[0, at[codes[at] == first[k]]] = 1
        kernel[i] = model.kernel(present, np.array([len(first[k])]))[0]
    z = kernel @ whiten
    goal = np.array([[lang == x for x in languages] for lang, _ in keys], float)
    # Every language weighs the same, however many of its texts were found.
    weight = (1 / goal.sum(0))[goal.argmax(1)][:, None]
    solved = np.linalg.solve(z.T @ (weight * z) + ridge * np.eye(z.shape[1]), z.T @ (weight * goal))
    model.weights = whiten @ solved
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score appended, all rows and columns kept.

    `und` with score 0 where the text is null or has no letter, or nothing was learned. Text that
    shares no n-gram with a landmark scores 0 for every language and gets the first one. Ties go to
    the language that sorts first. Where docs has columns of these names, the new ones replace them.
    """
    base = docs.drop("lang_pred", "score")
    if model is None:
        return base.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    # Bounded by the landmarks and languages.
    share = docs.sparkSession.sparkContext.broadcast((model.languages, model.codes, model.landmarks, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*share.value)
        column, names = model.columns(), np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for part in steps(batch, text_col):
                text = part.column(text_col)
                scores = model.scores(*_lower(text), column)
                found = pc.match_substring_regex(text, r"\p{L}").fill_null(False).to_numpy(zero_copy_only=False)
                best = np.where(found, scores.argmax(1), len(names) - 1)
                score = np.where(found, scores.max(1).clip(0, 1), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names[best], pa.string()), pa.array(score)],
                    [*part.schema.names, "lang_pred", "score"],
                )

    return base.mapInArrow(run, base.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)}).schema)


@query("op4_string_kernel_language")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from three in four."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
