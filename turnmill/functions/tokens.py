"""Word splitting rules, and per-pair text overlap scores.

The words are found by column expressions. The scores need only the words of one row, so
they run as one Arrow batch stage next to them, without a shuffle, and there on all words of a batch
as arrays of numbers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions.stems import stem
from turnmill.functions.text import col

# The public "13a" rules that put blanks around punctuation. The blank, which the public
# rule also widens, is left out: words end there anyway.
BLEU_SPLITS = [
    (r"""[!"#$%&()*+:;<=>?@/\[\\\]^_`{|}~]""", " $0 "),
    ("([^0-9])([.,])", "$1 $2 "),
    ("([.,])([^0-9])", " $1 $2"),
    ("([0-9])-", "$1 - "),
]
BLEU_ENTITIES = {"&quot;": '"', "&amp;": "&", "&lt;": "<", "&gt;": ">"}

# Punctuation, sentence ends and English contractions stand as words of their own.
METEOR_SPLITS = [
    (r"[\[\](){}<>\"?!,;:@#$%&*]|\.\.\.", " $0 "),
    (r"(?<!\.)\.(?=\s|\z)", " ."),
    (r"(?:n't|'(?:[smd]|ll|re|ve))(?=\s|\z)", " $0"),
]


def _spaced(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, F.lit(pattern), F.lit(replacement))
    return text


def rouge_words(text: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9, parted by blanks."""
    return F.regexp_replace(F.lower(col(text)), F.lit("[^a-z0-9]+"), F.lit(" "))


def bleu_words(text: Column | str) -> Column:
    """Words in their own case, parted by white space."""
    plain = col(text)
    for old, new in {"<skipped>": "", "-\n": "", "\n": " ", **BLEU_ENTITIES}.items():
        plain = F.replace(plain, F.lit(old), F.lit(new))
    return _spaced(F.concat(F.lit(" "), plain, F.lit(" ")), BLEU_SPLITS)


def meteor_words(text: Column | str) -> Column:
    """Lower-case words with punctuation apart, parted by white space."""
    return _spaced(F.lower(col(text)), METEOR_SPLITS)


class Words:
    """The words of many texts as numbers: text i has words[starts[i]:starts[i + 1]]."""

    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.starts = words, starts
        self.counts = np.diff(starts)
        self.row = np.repeat(np.arange(len(self.counts)), self.counts)
        self.place = np.arange(len(words)) - starts[self.row]


def numbered(*columns: pa.Array) -> tuple[list[Words], pa.Array]:
    """The words of text columns, numbered together, and the words themselves. NULL has none."""
    parts, starts = [], []
    for column in columns:
        split = pc.utf8_split_whitespace(pc.fill_null(column.cast(pa.large_string()), ""))
        flat, rows = pc.list_flatten(split), pc.list_parent_indices(split)
        kept = pc.not_equal(flat, "")  # at the ends of a text
        parts.append(flat.filter(kept))
        counts = np.bincount(rows.filter(kept).to_numpy(zero_copy_only=False), minlength=len(column))
        starts.append(np.concatenate([[0], np.cumsum(counts)]))
    coded = pa.chunked_array(parts, type=pa.large_string()).combine_chunks().dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return [Words(w, s) for w, s in zip(np.split(ids, cuts), starts, strict=True)], coded.dictionary


def _together(*columns: np.ndarray) -> np.ndarray:
    """One number for each distinct row of the columns, 0, 1, 2 …"""
    out = columns[0]
    for column in columns[1:]:
        out = out * (int(column.max(initial=0)) + 1) + column
    return pd.factorize(out)[0]


def _safe_ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


#: Words of a reference in one machine word of the bit rows.
LANE = 64


def common_lengths(pred: Words, ref: Words) -> np.ndarray:
    """Lengths of the longest common subsequences: a bit per reference word, in lanes of 64, for many
    texts at once. A step takes the next predicted word of all texts that have one."""
    n = len(pred.counts)
    common = np.zeros(n, np.int64)
    # Bits of each (text, word) of the references.
    both = np.concatenate([ref.row, pred.row]) * (max(ref.words.max(initial=0), pred.words.max(initial=0)) + 1)
    both += np.concatenate([ref.words, pred.words])
    number, keys = pd.factorize(both)
    of_ref, of_pred = number[: len(ref.words)], number[len(ref.words) :]
    lanes = -(-ref.counts // LANE)
    kinds = np.maximum(1, 2 ** np.ceil(np.log2(np.maximum(lanes, 1))).astype(int))
    for wide in np.unique(kinds):
        rows = np.flatnonzero((kinds == wide) & (ref.counts > 0) & (pred.counts > 0))
        if not len(rows):
            continue
        rows = rows[np.argsort(-pred.counts[rows], kind="stable")]
        mine = np.zeros(n, bool)
        mine[rows] = True
        own = mine[ref.row]
        used, index = np.unique(of_ref[own], return_inverse=True)
        bits = np.zeros((len(used) + 1, wide), np.uint64)
        lane, bit = np.divmod(ref.place[own], LANE)
        np.bitwise_or.at(bits, (index, lane), np.uint64(1) << bit.astype(np.uint64))
        where = np.full(len(keys), len(used))
        where[used] = np.arange(len(used))
        free = np.full((len(rows), wide), ~np.uint64(0), np.uint64)
        lengths = pred.counts[rows]
        begin = pred.starts[rows]
        for step in range(int(lengths[0])):
            live = int(np.searchsorted(-lengths, -step, "left"))  # texts with a word at this step
            at = where[of_pred[begin[:live] + step]]
            open_ = free[:live]
            hit = open_ & bits[at]
            kept = open_ - hit  # hit is part of open_: no borrow
            total = open_ + hit
            if wide > 1:
                carry = total < open_
                for k in range(1, wide):
                    more = carry[:, k - 1].astype(np.uint64)
                    total[:, k] += more
                    carry[:, k] |= (total[:, k] < more)
            free[:live] = total | kept
        size = ref.counts[rows][:, None] - LANE * np.arange(wide)
        full = np.where(size >= LANE, ~np.uint64(0), (np.uint64(1) << np.clip(size, 0, LANE - 1).astype(np.uint64)) - np.uint64(1))
        common[rows] = np.bitwise_count(~free & full).sum(axis=1)
    return common


def rouge_l(pred: Words, ref: Words) -> np.ndarray:
    """F1 of the longest common subsequence."""
    return _safe_ratio(2.0 * common_lengths(pred, ref), (pred.counts + ref.counts).astype(float))


def bleu_4(pred: Words, ref: Words, order: int = 4) -> np.ndarray:
    """Smoothed sentence BLEU: (m + 1) / (p + 1) per order, times the brevity penalty."""
    n = len(pred.counts)
    log_sum = np.zeros(n)
    sides, cut = (pred, ref), len(pred.words)
    # Starts of runs of words: side, place among all its words, and a number for (text, run).
    words = np.concatenate([pred.words, ref.words])
    row = np.concatenate([pred.row, ref.row])
    room = np.concatenate([w.counts[w.row] - w.place for w in sides])
    at = np.arange(len(words))
    run = row
    for size in range(1, order + 1):
        run = _together(run, words[at + size - 1])
        mine = at < cut
        total = int(run.max(initial=-1)) + 1
        have, want = np.bincount(run[mine], minlength=total), np.bincount(run[~mine], minlength=total)
        shared = np.minimum(have, want)
        row_of = np.zeros(total, np.int64)
        row_of[run] = row[at]
        matched = np.bincount(row_of, shared, minlength=n)
        log_sum += np.log((matched + 1.0) / (np.maximum(pred.counts - size + 1, 0) + 1.0))
        # Only a run that both texts have can be the start of a longer one.
        kept = (shared[run] > 0) & (room[at] > size)
        at, run = at[kept], run[kept]
    ratio = _safe_ratio(pred.counts.astype(float), ref.counts.astype(float))
    inverse = _safe_ratio(ref.counts.astype(float), pred.counts.astype(float))
    brevity = np.where(ratio > 1.0, 1.0, np.exp(1.0 - inverse))
    return np.where((pred.counts > 0) & (ref.counts > 0), np.exp(log_sum / order) * brevity, 0.0)


def _aligned(pred: Words, ref: Words, words: list[np.ndarray], left: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of equal words that are left: the last copies of a word in both texts pair up, then the ones
    before. Indices into all words of each side."""
    sides = [np.flatnonzero(k) for k in left]
    group = _together(
        np.concatenate([pred.row[sides[0]], ref.row[sides[1]]]), np.concatenate([w[s] for w, s in zip(words, sides, strict=True)])
    )
    groups = [group[: len(sides[0])], group[len(sides[0]) :]]
    total = int(group.max(initial=-1)) + 1
    order = [np.lexsort((-s, g)) for s, g in zip(sides, groups, strict=True)]
    counts = [np.bincount(g, minlength=total) for g in groups]
    starts = [np.cumsum(c) - c for c in counts]
    ranked = groups[0][order[0]]
    rank = np.arange(len(ranked)) - starts[0][ranked]
    paired = rank < counts[1][ranked]
    other = starts[1][ranked[paired]] + rank[paired]
    return sides[0][order[0][paired]], sides[1][order[1][other]]


def meteor(pred: Words, ref: Words, stems: np.ndarray | None = None) -> np.ndarray:
    """METEOR of equal words, and of words with equal stems among those left, if stems (a number for
    each word) are given. Chunks are penalised."""
    n = len(pred.counts)
    left = [np.ones(len(pred.words), bool), np.ones(len(ref.words), bool)]
    pairs = []
    for words in [[pred.words, ref.words]] + ([] if stems is None else [[stems[pred.words], stems[ref.words]]]):
        found = _aligned(pred, ref, words, left)
        for k, at in zip(left, found, strict=True):
            k[at] = False
        pairs.append(found)
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.argsort(i)
    i, j = i[order], j[order]
    row = pred.row[i]
    joined = (np.diff(i) == 1) & (np.diff(j) == 1) & (np.diff(row) == 0)
    m = np.bincount(row, minlength=n).astype(float)
    chunks = m - np.bincount(row[1:][joined], minlength=n)
    precision, recall = _safe_ratio(m, pred.counts.astype(float)), _safe_ratio(m, ref.counts.astype(float))
    f_mean = _safe_ratio(precision * recall, 0.9 * precision + 0.1 * recall)
    return (1.0 - 0.5 * _safe_ratio(chunks, m) ** 3) * f_mean


def _exact(score):
    return lambda pred, ref, words: score(pred, ref)


def _meteor_stems(pred: Words, ref: Words, words: pa.Array) -> np.ndarray:
    numbers: dict[str, int] = {}
    return meteor(pred, ref, np.array([numbers.setdefault(stem(w), len(numbers)) for w in words.to_pylist()], np.int64))


METRICS = {
    "rouge_l": (rouge_words, _exact(rouge_l)),
    "bleu_4": (bleu_words, _exact(bleu_4)),
    "meteor": (meteor_words, _exact(meteor)),
    "meteor_stems": (meteor_words, _meteor_stems),
}

#: Rows that are scored together, and bytes of their words for one metric.
STEP_ROWS, STEP_BYTES = 4096, 1 << 20


def steps(*columns: pa.Array) -> list[tuple[int, int]]:
    """Starts and lengths of runs of rows that hold STEP_ROWS and about STEP_BYTES at most, or one row."""
    sizes = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    ends, cuts = np.concatenate([[0], np.cumsum(sizes)]), [0]
    while (at := cuts[-1]) < len(sizes):
        filled = int(np.searchsorted(ends, ends[at] + STEP_BYTES, "right")) - 1
        cuts.append(min(max(filled, at + 1), at + STEP_ROWS, len(sizes)))
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def overlap(prediction: Column, reference: Column, metrics: list[str]) -> Column:
    """The named scores of two texts as a struct. All texts of a batch are scored at once."""
    scores = [METRICS[m][1] for m in metrics]

    def run(words: pa.Array) -> pa.Array:
        columns = words.flatten()
        out = [[] for _ in metrics]
        for k, score in enumerate(scores):
            sides = columns[2 * k : 2 * k + 2]
            for step in steps(*sides):
                (pred, ref), names = numbered(*[c.slice(*step) for c in sides])
                out[k].append(score(pred, ref, names))
        found = [pa.array(np.concatenate(x) if x else np.zeros(0)) for x in out]
        return pa.StructArray.from_arrays(found, metrics)

    words = [METRICS[m][0](side) for m in metrics for side in (prediction, reference)]
    udf = F.arrow_udf(run, ", ".join(f"{m} double" for m in metrics))
    return udf(F.struct(*[w.alias(f"w{i}") for i, w in enumerate(words)]))
