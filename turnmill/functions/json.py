"""Helpers for records whose shape differs from row to row, held as VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions.text import col

OBJECT, ARRAY, STRING, NULL = "OBJECT", "ARRAY", "STRING", "VOID"

# JSON values that count as not given.
EMPTY_VALUES = ["null", '""', "0", "0.0", "false", "{}", "[]"]


def variant_kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID (JSON null) or a scalar type; NULL when there is no value."""
    return F.split_part(F.schema_of_variant(v), F.lit("<"), F.lit(1))


def field(v: Column, name: str, kind: str = "variant") -> Column:
    """One field of an object; NULL when it is absent or of another type."""
    return F.try_variant_get(v, f"$.{name}", kind)


def variant_text(v: Column) -> Column:
    """A string as it is, anything else as compact JSON, NULL for JSON null."""
    return F.try_variant_get(v, "$", "string")


def given(v: Column) -> Column:
    """The variant, or NULL when it holds nothing: null, '', 0, false, {} or []."""
    return F.when(~F.to_json(v).isin(EMPTY_VALUES), v)


def first_given(v: Column, names: list[str]) -> Column:
    """The first field among ``names`` that holds something."""
    return F.coalesce(*[given(field(v, n)) for n in names])


def variant_items(v: Column) -> Column:
    """The elements of an array variant; NULL when it is no array."""
    return v.try_cast("array<variant>")


def parse(c: Column | str) -> Column:
    return F.try_parse_json(col(c))
