"""Scenario cases: one shape out of records that name and nest their fields differently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.json import (
    ARRAY,
    OBJECT,
    first_given,
    variant_items,
    variant_kind,
    variant_text,
)
from turnmill.functions.text import col, strip_ws

# Accepted names of each field, the first one that holds something counts.
CONTEXT_NAMES = ["scenario_context", "scenario", "context"]
PROFILE_NAMES = ["character_profile", "profile", "civilian_profile", "suspect_profile"]
DIALOGUE_NAMES = ["police_dialogue", "police_dialog", "officer_dialogue", "officer_turns"]
TURN_TEXT_NAMES = ["text", "transcript", "content", "dialogue", "utterance"]
ID_NAMES = ["case_id", "id"]

# Texts of error rows.
NO_LIST = "police_dialogue must be a list."
NO_DIALOGUE = "No police dialogue found for case_id="

ROLEPLAY_PROMPT = (
    "Play the civilian of this scene and answer the officer in character, briefly and naturally.\n\n"
    "Scenario Context:\n{scenario_context}\n\nCharacter Profile:\n{character_profile}"
)


def case_id(case: Column, pos: Column, source_file: Column | None = None) -> Column:
    """Own id as text, else case_0001 … by place, after the name of the file where there is one."""
    made = F.format_string("case_%04d", pos + 1)
    if source_file is not None:
        made = F.concat(F.coalesce(F.concat(source_file, F.lit("/")), F.lit("")), made)
    return F.coalesce(variant_text(first_given(case, ID_NAMES)), made)


def field_text(case: Column, names: list[str]) -> Column:
    """First filled field as trimmed text; objects and lists as compact JSON; '' when none."""
    return F.coalesce(strip_ws(variant_text(first_given(case, names))), F.lit(""))


def turn_of(item: Column) -> Column:
    """Text of one dialogue item: a string, or an object with a text under a known name."""
    return strip_ws(
        F.coalesce(
            F.when(
                variant_kind(item) == OBJECT, variant_text(first_given(item, TURN_TEXT_NAMES))
            ).otherwise(variant_text(item)),
            F.lit(""),
        )
    )


def police_turns(dialogue: Column) -> Column:
    """Texts of a dialogue list without the blank ones; NULL when it is no list."""
    return F.filter(F.transform(variant_items(dialogue), turn_of), lambda t: t != "")


def normalize_cases(cases: DataFrame) -> DataFrame:
    """(pos, case) to case_id, scenario_context, character_profile, police_turns, error."""
    dialogue = F.col("_dialogue")
    shaped = cases.withColumn("_dialogue", first_given(F.col("case"), DIALOGUE_NAMES)).select(
        case_id(
            F.col("case"), F.col("pos"), F.col("source_file") if "source_file" in cases.columns else None
        ).alias("case_id"),
        field_text(F.col("case"), CONTEXT_NAMES).alias("scenario_context"),
        field_text(F.col("case"), PROFILE_NAMES).alias("character_profile"),
        F.when(variant_kind(dialogue) == ARRAY, police_turns(dialogue)).alias("_turns"),
        (dialogue.isNotNull() & (variant_kind(dialogue) != ARRAY)).alias("_no_list"),
    )
    return shaped.select(
        "case_id",
        "scenario_context",
        "character_profile",
        F.coalesce("_turns", F.array().cast("array<string>")).alias("police_turns"),
        F.when(F.col("_no_list"), NO_LIST)
        .when(
            F.coalesce(F.size("_turns"), F.lit(0)) == 0,
            F.concat(F.lit(NO_DIALOGUE), "case_id"),
        )
        .alias("error"),
    )


def render_system_prompt(
    context: Column | str, profile: Column | str, template: str = ROLEPLAY_PROMPT
) -> Column:
    """Fill a template that has {scenario_context} and {character_profile}, both at once."""
    head, rest = template.split("{scenario_context}")
    middle, tail = rest.split("{character_profile}")
    return F.concat(F.lit(head), col(context), F.lit(middle), col(profile), F.lit(tail))
