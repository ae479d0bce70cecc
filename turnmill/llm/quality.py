"""Quality rules as a ledger of bits.

Every rule is evaluated once per document: the ledger keeps its measurements and one bit for each
rule that failed. Policies choose rules by a mask and are applied, compared and taken apart on the
bits alone, so a new policy version never reads a text again. Everything is a column expression;
nothing is shuffled until bits are counted.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import table
from turnmill.llm.registry import query

SPACE = "[\\x20\\x09-\\x0D]"
SYMBOLS = "#*$%&|<>"
WINDOW = 3


def kept_chars(text: Column, pattern: str) -> Column:
    """The number of code points that are left when the pattern's matches are taken out."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def window_hashes(found: Column, size: int = WINDOW) -> Column:
    """64-bit hashes of all windows of size words; found must be a bound value."""
    hashes = F.transform(
        F.sequence(F.lit(1), F.size(found) - size + 1),
        lambda i: F.xxhash64(*[F.get(found, i + (k - 1)) for k in range(size)]),
    )
    return F.when(F.size(found) >= size, hashes).otherwise(F.expr("cast(array() as array<bigint>)"))


def repeated_words(hashes: Column, size: int = WINDOW) -> Column:
    """Words in windows found twice or more. Sorted by hash, equal windows are neighbours; their
    places, sorted, cover up to size words each, less what the next one covers."""

    def places(filed: Column) -> Column:
        near = lambda x, k: F.coalesce(F.get(filed, k)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(filed, lambda x, k: near(x, k - 1) | near(x, k + 1)), lambda x: x["i"])

    filed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.aggregate(
        F.array_sort(let(filed, places)),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-size).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(size), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )


def measures(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_bangs, n_upper,
    n_letters, n_lines (long). A null text is empty."""

    def of(t: Column, w: Column, h: Column, lines: Column) -> Column:
        # Most texts repeat no window; only the others are sorted with places.
        repeats = F.size(h) > F.size(F.array_distinct(h))
        values = {
            "n_words": F.size(w),
            "word_chars": kept_chars(t, SPACE + "+"),
            "n_symbols": kept_chars(t, "[^#*$%&|<>]+"),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": F.when(repeats, repeated_words(h)).otherwise(0),
            "n_bangs": kept_chars(t, "[^!]+"),
            "n_upper": kept_chars(t, "\\P{Lu}+"),
            "n_letters": kept_chars(t, "\\P{L}+"),
            "n_lines": F.size(lines),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in values.items()])

    return let(
        F.coalesce(text, F.lit("")),
        lambda t: let(words(t), lambda w: let(window_hashes(w), lambda h: let(lines_of(t), lambda x: of(t, w, h, x)))),
    )


@dataclass(frozen=True)
class Rule:
    """A named rule, its bit, and when a document fails it. Bits are never given to another rule."""

    name: str
    bit: int
    fails: str


RULES = (
    Rule("too_few_words", 0, "n_words < 50"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", 2, "20 * n_symbols > word_chars"),
    Rule("duplicate_lines", 3, "2 * n_dup_lines > n_lines"),
    Rule("exclamations", 4, "20 * n_bangs > word_chars"),
    Rule("shouting", 5, "2 * n_upper > n_letters"),
    Rule("long_words", 6, "word_chars > 20 * n_words"),
    Rule("few_letters", 7, "2 * n_letters < word_chars"),
)

#: Policies by version: the rules that reject.
POLICIES = {
    1: ("too_few_words", "repeated_words"),
    2: ("too_few_words", "repeated_words", "symbols", "duplicate_lines", "exclamations", "shouting", "long_words", "few_letters"),
}


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    bits = {r.name: r.bit for r in rules}
    return sum(1 << bits[n] for n in set(names))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with the columns measures (struct) and failed (long): bit b is set when rule b failed.

    Null and blank texts have no words, and fail what that fails. A rule whose condition is null
    does not fail. Rows are judged one by one, repeated rows alike, whatever their other columns;
    where docs has columns of these names, the new ones replace them. No rows give no rows.
    """
    base = docs.drop("measures", "failed").withColumn("measures", measures(F.col(text_col)))
    bits = [
        F.when(F.expr(re.sub(r"\b([a-z_]*[a-z])\b", r"measures.\1", r.fails)), F.lit(1 << r.bit)).otherwise(0)
        for r in rules
    ]
    return base.withColumn("failed", reduce(Column.bitwiseOR, bits, F.lit(0)).cast("long"))


def verdict(failed: Column, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a policy keeps a document, from its bits."""
    return failed.bitwiseAND(F.lit(mask(names, rules))) == 0


def ablations(found: DataFrame, policies: dict[int, tuple[str, ...]] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """version, rule, n_failed, n_alone for each rule of each policy: documents that fail it, and
    those that fail no other rule of the policy, which the policy without it would keep. rule is
    null for the policy as a whole: n_failed are all that it rejects, n_alone is null.

    Bits are counted by pattern first, so what is shuffled is one row for each pattern that occurs.
    """
    patterns = found.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    bits = {r.name: r.bit for r in rules}
    rows = [
        F.struct(F.lit(v).alias("version"), F.lit(name).cast("string").alias("rule"), F.lit(mask(names, rules)).cast("long").alias("mask"), F.lit(1 << bits[name] if name else mask(names, rules)).cast("long").alias("mine"))
        for v, names in policies.items()
        for name in (*names, None)
    ]
    each = patterns.select("failed", "n", F.explode(F.array(*rows)).alias("p")).select("failed", "n", "p.*")
    hit = F.col("failed").bitwiseAND(F.col("mine")) != 0
    alone = F.col("failed").bitwiseAND(F.col("mask")) == F.col("mine")
    return each.groupBy("version", "rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.when(F.col("rule").isNotNull(), F.sum(F.when(alone, F.col("n")).otherwise(0))).alias("n_alone"),
    )


_ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
    [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^!]+', '', 'g')) AS n_bangs,
    length(regexp_replace(t, '\P{Lu}+', '', 'g')) AS n_upper,
    length(regexp_replace(t, '\P{L}+', '', 'g')) AS n_letters,
    len(l) AS n_lines
  FROM w LEFT JOIN r USING (doc_id)
), b AS (
  SELECT *, FAILED AS failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM b
"""
_FAILED = " + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)


@query("op2_rule_bit_ledger", _ORACLE.replace("FAILED AS", f"({_FAILED})::BIGINT AS"))
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the latest policy."""
    found = ledger(table(spark, sf_dir, "documents"))
    base = ~verdict(F.col("failed"), POLICIES[1])
    return found.select(
        "doc_id",
        *[f"measures.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base.alias("base_failed"),
        verdict(F.col("failed"), POLICIES[max(POLICIES)]).alias("kept"),
        "failed",
    )
