"""Large JSON arrays, read by many tasks.

A scan with "}" as line separator cuts a file into pieces wherever its splits are. Whether a piece starts
in a string, and how deep, depends on all pieces before; each split sums up what it does from either
start, a prefix over the splits of a file says which it was, and so every piece knows where it
stands. An element ends where a piece comes back to the depth of the array. Only pieces of one
element come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnmill.functions.json import variant_items
from turnmill.operators.ordering import add_earlier_chunks
from turnmill.session import written

LIST, CASES, OTHER = "list", "cases", "other"
#: How a file starts whose elements are found: an array, or an object that starts with one under "cases".
LIST_ROOT, CASES_ROOT = r"^\x{FEFF}?\s*\[", r'^\x{FEFF}?\s*\{\s*"cases"\s*:\s*\['
#: Elements of a file that are numbered together.
NUMBERED = 4096


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of files up to a "}": value, file, source_file, split, id, quotes, and the change of depth of
    a piece that starts outside (out) and inside a string (within), and of its "}" if that is no text."""
    scan = spark.read.option("lineSep", "}").text(path)
    told = scan.select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("source_file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        F.regexp_replace("value", r"(?s)\\.", "").alias("_plain"),
    )
    bare = lambda text: F.regexp_replace(text, '"[^"]*("|$)', "")
    depth = lambda code: _count(code, "{[") - _count(code, "]")
    quotes = _count(F.col("_plain"), '"')
    inner = F.regexp_replace("_plain", '^[^"]*("|$)', "")
    return told.select(
        *["value", "file", "source_file", "split", "id"],
        quotes.alias("quotes"),
        (depth(bare(F.col("_plain"))) - (quotes % 2 == 0).cast("int")).alias("out"),
        (depth(bare(inner)) - (quotes % 2 == 1).cast("int")).alias("within"),
    )


def _before(df: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Sums over the earlier splits of a file: a row for each split."""
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("file", "split", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(n) for n, c in sums.items()])


def marked_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Pieces in their place: source_file, file, root, split, id, text (with its "}"), ends (an element
    ends with it) and _ended (elements that ended before it in its split). Written once."""
    raw = written(pieces(spark, path), "pieces")
    roots = raw.where("split = 0").groupBy("file").agg(F.min_by("value", "id").alias("_head")).select(
        "file",
        F.when(F.col("_head").rlike(LIST_ROOT), LIST).when(F.col("_head").rlike(CASES_ROOT), CASES).otherwise(OTHER).alias("root"),
    )
    here = Window.partitionBy("file", "split").orderBy("id")
    ahead, so_far = here.rowsBetween(Window.unboundedPreceding, -1), here.rowsBetween(Window.unboundedPreceding, 0)
    # In a string or not, as seen from the start of the split.
    odd = F.coalesce(F.sum("quotes").over(ahead), F.lit(0)) % 2
    seen = raw.withColumn("_odd", odd).withColumns(
        {
            "_from_out": F.when(F.col("_odd") == 0, F.col("out")).otherwise(F.col("within")),
            "_from_within": F.when(F.col("_odd") == 0, F.col("within")).otherwise(F.col("out")),
        }
    )
    totals = seen.groupBy("file", "split").agg(*[F.sum(c).alias(c) for c in ("quotes", "_from_out", "_from_within")])
    strings = _before(totals, {"_quotes": F.col("quotes")}).withColumn("_open", F.col("_quotes") % 2)
    changed = totals.join(strings, ["file", "split"]).withColumn(
        "_change", F.when(F.col("_open") == 0, F.col("_from_out")).otherwise(F.col("_from_within"))
    )
    depths = _before(changed, {"_depth": F.col("_change")})
    starts = strings.join(depths, ["file", "split"]).join(roots, "file").select("file", "split", "_open", "_depth", "root")
    placed = seen.join(starts, ["file", "split"])
    change = F.when(F.col("_open") == 0, F.col("_from_out")).otherwise(F.col("_from_within"))
    closed = (F.col("_open") + F.col("_odd") + F.col("quotes")) % 2 == 0
    base = F.when(F.col("root") == LIST, 1).when(F.col("root") == CASES, 2).otherwise(-9)
    deep = placed.withColumn("_after", F.col("_depth") + F.sum(change).over(so_far))
    ends = closed & (F.col("_after") == base)
    found = deep.withColumn("ends", ends).withColumn(
        "_ended", F.coalesce(F.sum(F.col("ends").cast("int")).over(ahead), F.lit(0))
    )
    # Valid JSON is below depth 0 only after a last piece that has no "}".
    text = F.when(F.col("_after") >= 0, F.concat("value", F.lit("}"))).otherwise(F.col("value"))
    kept = found.select("source_file", "file", "root", "split", "id", text.alias("text"), "ends", "_ended")
    return written(kept, "marked_pieces")


def json_items(spark: SparkSession, path: str, whole: Column, strict: bool = True) -> DataFrame:
    """Elements of the arrays in JSON files: source_file, pos (from 0 in each file) and case (variant).

    A file that is an array, or an object that starts with one under "cases", is read by a task per split
    of the scan, and an element comes together by itself. Elements need not be objects, but what stands
    between two objects comes together with the second. Of any other file, which comes together as
    ``_v``, ``whole`` gives the elements (array<variant> or NULL). With ``strict`` text that is not JSON
    is an error, else it gives no elements.
    """
    parsed = F.parse_json if strict else F.try_parse_json
    marked = marked_pieces(spark, path)
    count = marked.groupBy("file", "split").agg(F.sum(F.col("ends").cast("int")).alias("n"))
    placed = marked.join(_before(count, {"_first": F.col("n")}), ["file", "split"])
    parts = placed.groupBy("file", "source_file", "root", (F.col("_first") + F.col("_ended")).alias("element")).agg(
        F.sort_array(F.collect_list(F.struct("split", "id", "text"))).alias("_p"), F.max("ends").alias("_whole")
    )
    text = F.array_join(F.transform("_p", lambda p: p["text"]), "")
    head = F.regexp_replace(text, F.when(F.col("root") == LIST, LIST_ROOT).otherwise(CASES_ROOT), F.lit(""))
    inner = F.when(F.col("element") == 0, head).otherwise(F.regexp_replace(text, r"^\s*,", ""))
    listed = parts.where(F.col("root") != OTHER).select(
        "file", "source_file", "element", "_whole", inner.alias("_t")
    )
    # What follows the array starts with its "]"; what else a file ends with may hold elements that are no objects.
    ending = listed.where(~F.col("_whole") | F.col("_t").rlike(r"^\s*\]")).groupBy("file").agg(F.min("element").alias("_end"))
    closing = F.regexp_replace("_t", r"(?s)\]\s*\}?\s*$", "")
    rest = F.when(F.col("_t").rlike(r"^\s*\]"), "").when(F.col("_whole"), F.col("_t")).otherwise(closing)
    elements = (
        listed.join(ending, "file", "left")
        .where("_end is null or element <= _end")
        .withColumn("_t", rest)
        .where("trim(_t) <> ''")
        .select("file", "source_file", "element", variant_items(parsed(F.concat(F.lit("["), "_t", F.lit("]")))).alias("items"))
    )
    others = parts.where(F.col("root") == OTHER).withColumn("_v", parsed(text)).select(
        "file", "source_file", F.lit(0).cast("bigint").alias("element"), whole.alias("items")
    )
    chunked = elements.unionByName(others).withColumn("_chunk", F.floor(F.col("element") / NUMBERED).cast("bigint"))
    size = F.coalesce(F.size("items"), F.lit(0))
    within = Window.partitionBy("file", "_chunk").orderBy("element").rowsBetween(Window.unboundedPreceding, -1)
    numbered = add_earlier_chunks(
        chunked.withColumn("_n", F.greatest(size, F.lit(0))).withColumn("_here", F.coalesce(F.sum("_n").over(within), F.lit(0))),
        "file", {"_earlier": F.sum("_n")},
    )
    spread = numbered.select("source_file", F.posexplode("items").alias("_i", "case"), (F.col("_here") + F.col("_earlier")).alias("_at"))
    name = F.url_decode(F.replace(F.col("source_file"), F.lit("+"), F.lit("%2B")))
    return spread.select(name.alias("source_file"), (F.col("_at") + F.col("_i")).cast("int").alias("pos"), "case")
