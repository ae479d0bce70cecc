"""Similarity of predicted and reference replies."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.text import col
from turnmill.functions.tokens import overlap
from turnmill.operators.dialogue import clean_text

TEXT_METRICS = ["rouge_l", "bleu_4", "meteor"]


def score_rouge_l(prediction: Column | str, reference: Column | str) -> Column:
    return overlap(col(prediction), col(reference), ["rouge_l"])["rouge_l"]


def score_bleu4(prediction: Column | str, reference: Column | str) -> Column:
    return overlap(col(prediction), col(reference), ["bleu_4"])["bleu_4"]


def score_meteor(prediction: Column | str, reference: Column | str, stems: bool = False) -> Column:
    """METEOR of equal words; with ``stems`` words left over pair up by their stems as well."""
    name = "meteor_stems" if stems else "meteor"
    return overlap(col(prediction), col(reference), [name])[name]


def score_predictions(
    predictions: DataFrame, encoder: Callable[[], TokenEncoder] | None = None, stems: bool = False
) -> DataFrame:
    """Add rouge_l, bleu_4 and meteor (see score_meteor), and embedding_f1 when there is an encoder.

    They are computed in Arrow stages next to the row's own texts: no key, no join. Rows with an
    error keep NULL scores.
    """
    failed = F.col("error").isNotNull() if "error" in predictions.columns else F.lit(False)
    # Blanks around a text do not change its words, so only the encoder needs it trimmed.
    words = F.col("predicted_response"), F.col("reference_response")
    names = {m: f"{m}_stems" if stems and m == "meteor" else m for m in TEXT_METRICS}
    scored = predictions.withColumn("_s", overlap(*words, list(names.values())))
    found = {m: F.col("_s")[n] for m, n in names.items()}
    if encoder:
        texts = clean_text("predicted_response"), clean_text("reference_response")
        scored = scored.withColumn("_e", score_encoded_f1(*texts, encoder))
        found["embedding_f1"] = F.col("_e.f1")
    return scored.withColumns({m: F.when(~failed, c) for m, c in found.items()}).drop("_s", "_e")


def _normalized(block: list | np.ndarray) -> np.ndarray:
    if not isinstance(block, np.ndarray) or block.dtype == object:
        block = np.stack([np.asarray(v, dtype="float64") for v in block])
    vectors = block.astype("float64", copy=False)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


class TokenEncoder(Protocol):
    """Vectors of the tokens of each text."""

    def encode(self, texts: list[str]) -> list[list[list[float]]]: ...


class HashEncoder:
    """Baseline: one of 16 unit vectors per word, by the first digit of its MD5."""

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        unit = np.eye(16)
        words = [t.split() for t in texts]
        place = {w: hashlib.md5(w.encode()).digest()[0] >> 4 for w in {w for ws in words for w in ws}}
        return [unit[[place[w] for w in ws]] for ws in words]


def score_encoded_f1(
    prediction: Column | str,
    reference: Column | str,
    factory: Callable[[], TokenEncoder] = HashEncoder,
    batch_size: int = 16,
) -> Column:
    """Greedy-match precision, recall and F1 of two texts, as a struct.

    Encodes and compares inside the Arrow batch, one encoder per task: no vectors are stored or
    shuffled. Texts without tokens score 0.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for preds, refs in batches:
            rows = []
            for start in range(0, len(preds), batch_size):
                some = slice(start, start + batch_size)
                pairs = zip(
                    encoder.encode([x or "" for x in preds[some]]),
                    encoder.encode([x or "" for x in refs[some]]),
                )
                rows += [_pair_f1(p, r) for p, r in pairs]
            yield pd.DataFrame(rows, columns=["precision", "recall", "f1"], dtype="float64")

    return F.pandas_udf(run, "precision double, recall double, f1 double")(
        col(prediction), col(reference)
    )


def _pair_f1(pred: list, ref: list, block: int = 1024) -> tuple[float, float, float]:
    """Two blocks of vectors meet at a time, so a long text needs no whole matrix of cosines."""
    if not len(pred) or not len(ref):
        return 0.0, 0.0, 0.0
    best_pred, best_ref = np.full(len(pred), -np.inf), np.full(len(ref), -np.inf)
    for j in range(0, len(ref), block):
        theirs = _normalized(ref[j : j + block]).T
        for i in range(0, len(pred), block):
            cosines = _normalized(pred[i : i + block]) @ theirs
            own, other = best_pred[i : i + block], best_ref[j : j + block]
            np.maximum(own, cosines.max(axis=1), out=own)
            np.maximum(other, cosines.max(axis=0), out=other)
    precision, recall = best_pred.mean(), best_ref.mean()
    total = precision + recall
    return precision, recall, 2 * precision * recall / total if total else 0.0


def _best_matches(pred: pd.Series, ref: pd.Series) -> pd.DataFrame:
    """Per vector of either block, its best cosine among the vectors of the other one."""
    cosines = [_normalized(p) @ _normalized(r).T for p, r in zip(pred, ref)]
    return pd.DataFrame(
        {"pred": [c.max(axis=1) for c in cosines], "ref": [c.max(axis=0) for c in cosines]}
    )


def embedding_f1(tokens: DataFrame, block_tokens: int = 512) -> DataFrame:
    """Greedy-match precision, recall and F1 of token vectors per (pair_id, model_name).

    tokens: pair_id, model_name, side (pred or ref), pos (unique in its side), vec. Each side is
    cut into blocks of consecutive positions. Every two blocks of a pair meet once, spread by the
    block of the reference, so a long text uses many tasks and a task holds two blocks at a time.
    A side without vectors scores 0.
    """
    keys = ["pair_id", "model_name"]
    block = F.floor(F.col("pos") / block_tokens).cast("bigint")
    of_side = lambda side, c: F.when(F.col("side") == side, c)

    def vectors(side: str) -> Column:
        found = F.sort_array(F.collect_list(of_side(side, F.struct("pos", "vec"))))
        return F.transform(found, lambda t: t["vec"])

    blocks = tokens.groupBy(*keys, block.alias("block")).agg(
        vectors("pred").alias("pred"), vectors("ref").alias("ref")
    )
    spans = tokens.groupBy(*keys).agg(
        F.max(of_side("pred", block)).alias("last_pred"),
        F.max(of_side("ref", block)).alias("last_ref"),
    )
    first = F.lit(0).cast("bigint")
    wanted = spans.select(
        *keys, "last_ref", F.explode(F.sequence(first, "last_pred")).alias("block")
    )
    asking = (
        blocks.select(*keys, "block", "pred")
        .join(wanted, [*keys, "block"])
        .withColumn("ref_block", F.explode(F.sequence(first, "last_ref")))
    )
    answering = blocks.filter(F.size("ref") > 0).select(
        *keys, F.col("block").alias("ref_block"), "ref"
    )
    best = F.pandas_udf(_best_matches, "pred array<double>, ref array<double>")
    met = (
        asking.filter(F.size("pred") > 0)
        .join(answering, [*keys, "ref_block"])
        .withColumn("best", best("pred", "ref"))
    )
    sides = F.array(
        F.struct(F.lit("pred").alias("side"), F.col("block").alias("at"), F.col("best.pred").alias("c")),
        F.struct(F.lit("ref").alias("side"), F.col("ref_block").alias("at"), F.col("best.ref").alias("c")),
    )
    per_token = (
        met.select(*keys, F.inline(sides))
        .select(*keys, "side", "at", F.posexplode("c").alias("i", "cosine"))
        .groupBy(*keys, "side", "at", "i")
        .agg(F.max("cosine").alias("cosine"))
    )
    means = per_token.groupBy(*keys).agg(
        F.avg(of_side("pred", F.col("cosine"))).alias("precision"),
        F.avg(of_side("ref", F.col("cosine"))).alias("recall"),
    )
    scored = spans.select(*keys).join(means, keys, "left").fillna(0.0, ["precision", "recall"])
    total = F.col("precision") + F.col("recall")
    return scored.withColumn(
        "f1",
        F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total),
    )
