"""Dialogue turns: roles, evaluation points, histories, prompts and reply clean-up."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnmill.functions.text import PY_WHITESPACE, col, strip_ws
from turnmill.operators.ordering import (
    CHUNK_ROWS,
    add_earlier_chunks,
    chunk_of,
    chunk_window,
    drop_edge_copies,
    spread_chunks,
    with_neighbours,
)

# A speaker label that contains one of these belongs to the authority side.
AUTHORITY_KEYWORDS = [
    "Deputy",
    "Officer",
    "Dispatcher",
    "Law enforcement",
    "Property owner",
    "Sergeant",
    "Lieutenant",
    "Trooper",
    "Police",
    "Sheriff",
    "Corporal",
    "Agent",
]

# Names of the speakers in rendered text, by chat role.
ROLE_NAMES = {"system": "System", "user": "Officer", "assistant": "Civilian"}

# Where a raw reply ends, and which leading names are cut, per profile.
STOP_MARKERS = {
    "metric": ["<|im_end|>", "<|endoftext|>", "</s>", "Officer:", "User:", "System:"],
    "generation": [
        "<|im_end|>", "<|endoftext|>", "</s>", "Officer:", "Police:", "Deputy:", "User:", "System:",
    ],
}
SPEAKER_PREFIXES = {
    "metric": ["Civilian:", "Suspect:", "Subject:", "Assistant:"],
    "generation": [
        "Civilian:", "Suspect:", "Subject:", "Assistant:", "Character:", "Response:",
    ],
}

#: A conversation is cut into segments of so many turns, and into so many segments at most.
SEGMENT_TURNS, SEGMENTS = 256, 16

DEFAULT_SYSTEM_PROMPT = (
    "Play the civilian in this police encounter. Answer with the civilian's next words only."
)


def speaker_role(label: Column | str) -> Column:
    """user for the authority side, assistant for everyone else and for a missing label."""
    pattern = "|".join(k.lower() for k in AUTHORITY_KEYWORDS)
    is_authority = F.coalesce(F.lower(col(label)).rlike(pattern), F.lit(False))
    return F.when(is_authority, "user").otherwise("assistant")


def turn_text(transcript: Column | str, compat: bool = False) -> Column:
    """Text of a turn; a missing one is empty, or 'nan' with ``compat``."""
    return F.coalesce(col(transcript), F.lit("nan" if compat else ""))


def role_turns(turns: DataFrame, compat: bool = False) -> DataFrame:
    """source_file, turn_index (0, 1, 2 … in its file), role, content."""
    return turns.select(
        "source_file",
        "turn_index",
        speaker_role("speaker_label").alias("role"),
        turn_text("transcript", compat).alias("content"),
    )


def is_point() -> Column:
    """An authority turn that a civilian turn follows directly."""
    return F.coalesce((F.col("role") == "user") & (F.col("_next_role") == "assistant"), F.lit(False))


def turn_pairs(turns: DataFrame, compat: bool = False, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Evaluation points: source_file, turn_index, officer_input, reference_response."""
    paired = with_neighbours(
        role_turns(turns, compat),
        "source_file",
        "turn_index",
        ahead={"_next_role": "role", "_next_text": "content"},
        rows=chunk_rows,
    )
    return paired.filter(is_point()).select(
        "source_file",
        "turn_index",
        F.col("content").alias("officer_input"),
        F.col("_next_text").alias("reference_response"),
    )


def prompt_line(role: Column, content: Column) -> Column:
    """'Officer: …' and the like; a role without a name gives NULL."""
    name = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair]), role
    )
    return F.concat(name, F.lit(": "), content)


def history_index(
    turns: DataFrame, compat: bool = False, chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """The histories of all evaluation points, in a form as long as the turns themselves.

    The history of a point holds all turns up to it, so it is the start of its conversation.
    Per turn: is_point, points_before (how many points come earlier) and prompt_chars, the
    length of the rendered prompt text up to and with this turn. The history of the point with
    points_before = p is every turn whose points_before is at most p, up to that point.
    With ``compat`` a reply right after an authority turn stands in later histories twice.
    """
    w = chunk_window("source_file", "turn_index")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Measured before the shuffle, so that the chunk totals need no texts.
    measured = role_turns(turns, compat).withColumn(
        "_line", F.length(prompt_line(F.col("role"), F.col("content"))) + 1
    )
    spread = spread_chunks(measured, "turn_index", True, compat, chunk_rows)
    neighbours = {"_next_role": F.lead("role").over(w)}
    if compat:
        neighbours["_previous_role"] = F.lag("role").over(w)
    marked = with_copies(
        spread.withColumns(neighbours).withColumn("is_point", is_point()), compat
    )
    own = F.col("_chunk") == F.col("_home")
    counted = marked.withColumns(
        {
            "_point": F.when(own & F.col("is_point"), 1).otherwise(0).cast("bigint"),
            "_chars": F.when(own, F.col("_line") * F.col("copies")).otherwise(0).cast("bigint"),
        }
    ).withColumns(
        {"_points": F.sum("_point").over(so_far), "_length": F.sum("_chars").over(so_far)}
    )
    whole = add_earlier_chunks(
        drop_edge_copies(counted),
        "source_file",
        {"_points_0": F.sum("_point"), "_length_0": F.sum("_chars")},
    )
    return whole.select(
        "source_file",
        "turn_index",
        "role",
        "content",
        "copies",
        "is_point",
        (F.col("_points") + F.col("_points_0") - F.col("_point")).alias("points_before"),
        (F.col("_length") + F.col("_length_0") - 1).alias("prompt_chars"),
    )


def with_copies(marked: DataFrame, compat: bool) -> DataFrame:
    """How often a turn stands in the histories that hold it."""
    if not compat:
        return marked.withColumn("copies", F.lit(1))
    follows_authority = F.coalesce(F.col("_previous_role") == "user", F.lit(False))
    return marked.withColumn(
        "copies", F.when((F.col("role") == "assistant") & follows_authority, 2).otherwise(1)
    )


def history_segments(
    turns: DataFrame,
    compat: bool = False,
    segment_turns: int = SEGMENT_TURNS,
    segments: int = SEGMENTS,
) -> DataFrame:
    """Turns cut into segments, each with the turns of its conversation that come before it.

    Read in turn order, the rows of one (source_file, segment) build up the history of every
    point of that segment, so a long conversation spreads over up to ``segments`` tasks. A turn
    stands in its own segment and in later ones, about (segments + 1) / 2 times on average, so
    the rows grow in line with the turns. asked marks the points that belong to the segment itself.
    """
    w = chunk_window("source_file", "turn_index")
    neighbours = {"_next_role": F.lead("role").over(w)}
    if compat:
        neighbours["_previous_role"] = F.lag("role").over(w)
    spread = spread_chunks(role_turns(turns, compat), "turn_index", True, compat, segment_turns)
    marked = with_copies(
        drop_edge_copies(spread.withColumns(neighbours).withColumn("is_point", is_point())), compat
    )
    # The last chunk of each file, once per chunk, so that the join has no hot key and
    # meets the turns where the window left them. All turns match; a left join keeps them the
    # side that is read in parts, however small the tables look to the planner.
    spans = (
        turns.groupBy("source_file")
        .agg(F.max(chunk_of("turn_index", segment_turns)).alias("_last"))
        .select(
            "source_file",
            "_last",
            F.explode(F.sequence(F.lit(0).cast("bigint"), "_last")).alias("_chunk"),
            (F.floor(F.col("_last") / segments) + 1).alias("_width"),
        )
    )
    of = lambda chunk: F.floor(F.col(chunk) / F.col("_width"))
    return (
        marked.join(spans, ["source_file", "_chunk"], "left")
        .withColumn("segment", F.explode(F.sequence(of("_chunk"), of("_last"))))
        .select(
            "source_file",
            "segment",
            "turn_index",
            "role",
            "content",
            "copies",
            (F.col("is_point") & (of("_chunk") == F.col("segment"))).alias("asked"),
        )
    )


def render_plain_prompt(history: Column | str) -> Column:
    """One line per message with its speaker, closed by 'Civilian:'."""
    lines = F.transform(col(history), lambda m: prompt_line(m["role"], m["content"]))
    return F.array_join(F.array_append(F.array_compact(lines), "Civilian:"), "\n")


def split_system_message(history: Column | str) -> tuple[Column, Column]:
    """(system text, messages without system ones) for models that take them apart."""
    messages = col(history)
    system = F.array_join(
        F.transform(F.filter(messages, lambda m: m["role"] == "system"), lambda m: m["content"]),
        "\n",
    )
    return system, F.filter(messages, lambda m: m["role"] != "system")


def clean_reply(reply: Column | str, profile: str = "metric") -> Column:
    """Raw model text to the bare reply: cut at stop markers, then cut leading speaker names."""
    text = strip_ws(F.coalesce(col(reply), F.lit("")))
    if profile == "generation":
        text = F.regexp_replace(text, F.lit(r"^```[^\n]*\n"), F.lit(""))
        text = strip_ws(F.replace(text, F.lit("```"), F.lit("")))
    for marker in STOP_MARKERS[profile]:
        text = F.substring_index(text, marker, 1)
    # Each name is cut at most once and in this order, with the white space behind it.
    blank = f"[{re.escape(PY_WHITESPACE)}]*"
    names = "".join(f"(?:{re.escape(p)}{blank})?" for p in SPEAKER_PREFIXES[profile])
    return F.regexp_replace(strip_ws(text), F.lit(f"(?i)^{names}"), F.lit(""))


def clean_text(text: Column | str) -> Column:
    """Trimmed text; a missing or blank one is a single blank."""
    trimmed = strip_ws(F.coalesce(col(text), F.lit("")))
    return F.when(trimmed == "", " ").otherwise(trimmed)


def build_transcript(conversation: Column | str) -> Column:
    """Generated turns (police, civilian_generated) as lines of text."""
    return F.array_join(
        F.flatten(
            F.transform(
                col(conversation),
                lambda t: F.array(
                    F.concat(F.lit("Officer: "), t["police"]),
                    F.concat(F.lit("Civilian: "), t["civilian_generated"]),
                ),
            )
        ),
        "\n",
    )
