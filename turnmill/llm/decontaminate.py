"""Benchmark decontamination by pigeonhole edit matching.

A test item may differ from its copy in a document by a budget of k edits. Cut in k + 1 pieces, at
least one piece is untouched, so exact hits of pieces (one automaton for all) give every candidate;
the stretch of text around a hit is verified with Myers' bit-parallel edit distance.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from turnmill.llm.common import table
from turnmill.llm.registry import query

#: One edit is allowed for so many characters of an item.
CHARS_PER_EDIT = 16
#: Characters of items that one pass over the documents looks for; more items take more passes.
PASS_CHARS = 4_000_000

Item = tuple[int, str, int]  # id, normal text, edit budget


def normal(text: str | None) -> str:
    """Lower case, one blank between words."""
    return " ".join((text or "").lower().split())


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 stretches of nearly the same length, with their places."""
    n = budget + 1
    at = [len(text) * i // n for i in range(n + 1)]
    return [(a, text[a:b]) for a, b in zip(at, at[1:], strict=False)]


def myers(masks: dict[str, int], m: int, text: str, budget: int) -> int:
    """The smallest edit distance of a pattern of m characters (masks: its places by character) and
    any stretch of text; budget + 1 if that is more than budget."""
    high = 1 << (m - 1)
    all_ = (1 << m) - 1
    plus, minus, score, best = all_, 0, m, min(m, budget + 1)
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(xh | plus) & all_)
        down = plus & xh
        if up & high:
            score += 1
        elif down & high:
            score -= 1
        if score < best:
            best = score
        up = (up << 1) & all_  # row 0 is 0 everywhere: a match may start anywhere
        plus = ((down << 1) & all_) | (~(xv | up) & all_)
        minus = up & xv
    return best


class Matcher:
    """Finds items in texts."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.masks: dict[int, dict[str, int]] = {}
        at = defaultdict(list)
        for i, (_, text, budget) in enumerate(items):
            for place, piece in pieces(text, budget):
                at[piece].append((i, place))
        self.automaton = ahocorasick.Automaton()
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()
        self.any = bool(at)

    def _distance(self, i: int, region: str) -> int:
        _, text, budget = self.items[i]
        if text in region:
            return 0
        if not budget:
            return 1
        if i not in self.masks:
            masks: dict[str, int] = {}
            for k, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << k
            self.masks[i] = masks
        return myers(self.masks[i], len(text), region, budget)

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, smallest distance) of all items within their budget."""
        whole = normal(text)
        if not self.any or not whole:
            return []
        regions = defaultdict(list)
        for end, (size, where) in self.automaton.iter(whole):
            for i, place in where:
                _, item, budget = self.items[i]
                start = end - size + 1 - place
                low, high = max(0, start - budget), start + len(item) + budget
                mine = regions[i]
                if mine and low <= mine[-1][1]:  # hits come in order of their ends
                    mine[-1] = (min(low, mine[-1][0]), max(high, mine[-1][1]))
                else:
                    mine.append((low, high))
        out = []
        for i, found in regions.items():
            best = min(self._distance(i, whole[a:b]) for a, b in found)
            if best <= self.items[i][2]:
                out.append((self.items[i][0], best))
        return sorted(out)


def passes(benchmark: DataFrame, chars_per_edit: int, pass_chars: int) -> Iterator[Broadcast]:
    """Matchers' items, in as many lists as keep each within pass_chars of text (or one item)."""
    items = benchmark.where("item_id is not null and trim(text) <> ''").select("item_id", "text").distinct()
    n = int(items.agg(F.ceil(F.sum(F.length("text")) / pass_chars)).first()[0] or 0)
    for k in range(n):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        texts = [(r.item_id, normal(r.text)) for r in mine]
        yield benchmark.sparkSession.sparkContext.broadcast(sorted((i, t, len(t) // chars_per_edit) for i, t in texts if t))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, pass_chars: int = PASS_CHARS
) -> DataFrame:
    """doc_id, item_id, distance: every item of benchmark (item_id, text) that a row of docs holds
    with at most one edit for chars_per_edit characters, and its smallest number of edits.

    Case and runs of white space do not count. Items shorter than chars_per_edit must occur as they
    are; items without text or id are left out, like rows with null or blank texts. Rows without a
    doc_id, or that repeat one, are looked at one by one and give rows of their own. Items that
    repeat an id are all looked for. Other columns are not looked at.
    """

    kinds = [df.schema[c].dataType.simpleString() for df, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance long"
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)

    def matches(share: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(share.value)
            for batch in batches:
                rows = []
                for i, text in enumerate(batch.column("text")):
                    rows.extend((i, item, distance) for item, distance in matcher.find(text.as_py()))
                at, items, distances = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(at, pa.int64())), pa.array(items, item_type), pa.array(distances, pa.int64())],
                    ["doc_id", "item_id", "distance"],
                )

        return run

    out = None
    for share in passes(benchmark, chars_per_edit, pass_chars):
        found = docs.select("doc_id", "text").mapInArrow(matches(share), schema)
        out = found if out is None else out.union(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns; see contaminated()."""

    def keep(share: Broadcast):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(share.value)
            for batch in batches:
                free = [not matcher.find(text.as_py()) for text in batch.column("text")]
                yield batch.filter(pa.array(free, pa.bool_()))

        return run

    for share in passes(benchmark, chars_per_edit, pass_chars):
        docs = docs.mapInArrow(keep(share), docs.schema)
    return docs


@query("op10_pigeonhole_edit_matching")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items of the benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
