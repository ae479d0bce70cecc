"""String and number helpers with the edge rules that the operators rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that Python's str.strip() removes.
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts that pandas.read_csv reads as missing by default.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    """Trim every Unicode white space, not only blanks."""
    return F.btrim(col(c), F.lit(PY_WHITESPACE))


def non_empty(c: Column | str) -> Column:
    """The text, or NULL when it is empty."""
    return F.nullif(col(c), F.lit(""))


def na_to_null(c: Column | str) -> Column:
    """NULL for the cell texts that stand for a missing value."""
    return F.when(~col(c).isin(NA_TOKENS), col(c))


def flag_set(c: Column | str) -> Column:
    """True when the value reads as the integer 1; anything unreadable is false."""
    return F.coalesce(col(c).try_cast("int") == 1, F.lit(False))


def safe_int(c: Column | str) -> Column:
    """The value as an integer, 0 when it cannot be read."""
    return F.coalesce(col(c).try_cast("int"), F.lit(0))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """100 * part / whole, and 0.0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        F.round(part.cast("double") * 100 / whole, digits)
    )
