"""Histories as folds: what a hook needs of the turns before a point, without the turns themselves.

A conversation is cut into chunks of consecutive turns. Every chunk gives one small summary per fold,
partly made before any shuffle; a prefix scan over the summaries of a conversation gives the state that
a chunk starts with. The state joins its chunk as one more row of the only shuffle of the turns, so
that all points of a chunk are answered from its own turns and that row: the shuffled rows are the
turns, a copied edge row and a state per chunk, and no task needs more than chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from turnmill.operators.dialogue import (
    DEFAULT_SYSTEM_PROMPT,
    is_point,
    prompt_line,
    role_turns,
    with_copies,
)
from turnmill.operators.ordering import CHUNK_ROWS, chunk_of, chunk_window, drop_edge_copies, spread_chunks
from turnmill.session import written

#: Turns of a chunk that a whole history refers to.
CHAIN_TURNS = 256


def message() -> Column:
    return F.struct("role", "content")


class Fold:
    """A value of all turns up to a point (with it), from values of chunks.

    summary is an aggregate of a chunk's turns; scan is the state that a chunk starts with, from the
    summaries of all earlier chunks (in a window ordered by chunk); value is a turn's, from its chunk's
    state and the chunk's turns so far (in a window ordered by turn). Turns have role, content,
    turn_index and _chunk; chunks hold ``rows`` turns, but for the last one.
    """

    def summary(self, rows: int) -> Column:
        raise NotImplementedError

    def scan(self, summary: Column, earlier: WindowSpec) -> Column:
        raise NotImplementedError

    def value(self, state: Column, so_far: WindowSpec, rows: int) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class MessageCount(Fold):
    """How many messages there are, the system message with them."""

    def summary(self, rows):
        return F.count(F.lit(1))

    def scan(self, summary, earlier):
        return F.sum(summary).over(earlier)

    def value(self, state, so_far, rows):
        return F.coalesce(state, F.lit(0)) + F.count("role").over(so_far) + 1


@dataclass(frozen=True)
class PromptChars(Fold):
    """Length of the turns' lines as a plain prompt renders them, without system line and close."""

    def _line(self) -> Column:
        return F.length(prompt_line(F.col("role"), F.col("content"))) + 1

    def summary(self, rows):
        return F.sum(self._line())

    def scan(self, summary, earlier):
        return F.sum(summary).over(earlier)

    def value(self, state, so_far, rows):
        return F.coalesce(state, F.lit(0)) + F.sum(self._line()).over(so_far) - 1


@dataclass(frozen=True)
class LastBy(Fold):
    """The last text of a role, NULL before its first."""

    role: str

    def _own(self) -> Column:
        return F.when(F.col("role") == self.role, F.col("content"))

    def summary(self, rows):
        return F.max_by(F.col("content"), F.when(F.col("role") == self.role, F.col("turn_index")))

    def scan(self, summary, earlier):
        return F.last(summary, ignorenulls=True).over(earlier)

    def value(self, state, so_far, rows):
        return F.coalesce(F.last(self._own(), ignorenulls=True).over(so_far), state)


@dataclass(frozen=True)
class LastMessages(Fold):
    """The last n messages, as a windowed prompt holds them; n is at most the rows of a chunk."""

    n: int

    def summary(self, rows):
        if not 0 < self.n <= rows:
            raise ValueError(f"A window of {self.n} messages doesn't fit chunks of {rows} turns.")
        late = F.col("turn_index") % rows >= rows - self.n
        told = F.collect_list(F.when(late, F.struct("turn_index", message().alias("message"))))
        return F.transform(F.sort_array(told), lambda t: t["message"])

    def scan(self, summary, earlier):
        # A chunk with successors is full, so the chunk before has all that can be needed.
        return F.last(summary).over(earlier)

    def value(self, state, so_far, rows):
        near = so_far.rowsBetween(1 - self.n, Window.currentRow)
        own = F.collect_list(F.when(F.col("role").isNotNull(), message())).over(near)
        both = F.concat(F.coalesce(state, F.expr("cast(array() as array<struct<role: string, content: string>>)")), own)
        return F.slice(both, F.greatest(F.size(both) - self.n + 1, F.lit(1)), F.lit(self.n))


def folded_histories(turns: DataFrame, folds: dict[str, Fold], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Evaluation points with their histories folded: source_file, turn_index, officer_input and a
    column per fold.

    The histories are those of dialogue_history, with the real replies. A file's turn_index counts
    0, 1, 2 … without gaps. Rows that shuffle: the turns, two per chunk, and chunk summaries.
    """
    talk = role_turns(turns)
    earlier = Window.partitionBy("source_file").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = (
        talk.withColumn("_chunk", chunk_of("turn_index", chunk_rows))
        .groupBy("source_file", "_chunk")
        .agg(*[f.summary(chunk_rows).alias(n) for n, f in folds.items()])
    )
    states = sums.select(
        "source_file", "_chunk", F.struct(*[f.scan(F.col(n), earlier).alias(n) for n, f in folds.items()]).alias("_state")
    )
    # The first chunk of a file starts with nothing and needs no row.
    heads = states.where("_chunk > 0").withColumn("_home", F.col("_chunk"))
    rows = spread_chunks(talk, "turn_index", True, rows=chunk_rows)
    w = chunk_window("source_file", "turn_index")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    state = F.first("_state").over(so_far)  # the row without turn_index comes first
    told = rows.unionByName(heads, allowMissingColumns=True).withColumns(
        {"_start": state, "_next_role": F.lead("role").over(w)}
    )
    values = {n: f.value(F.col("_start")[n], so_far, chunk_rows) for n, f in folds.items()}
    whole = told.withColumns({f"_v_{n}": v for n, v in values.items()})
    points = drop_edge_copies(whole).where(is_point())
    return points.select(
        "source_file", "turn_index", F.col("content").alias("officer_input"),
        *[F.col(f"_v_{n}").alias(n) for n in folds],
    )


def history_chunks(marked: DataFrame) -> DataFrame:
    """One row per (source_file, chunk) with its messages in order: source_file, chunk,
    messages (turn_index, is_point, copies, message).

    marked: source_file, _chunk, turn_index, role, content, copies, is_point. A row holds one chunk.
    """
    row = F.struct("turn_index", "is_point", "copies", message().alias("message"))
    return (
        marked.groupBy("source_file", F.col("_chunk").alias("chunk"))
        .agg(F.sort_array(F.collect_list(row)).alias("messages"))
        .select("source_file", "chunk", "messages")
    )


def chained(chunks: DataFrame, select: Column | None = None) -> DataFrame:
    """Every chunk that has points, with its chain: the messages of all earlier chunks.

    A chunk refers to the earlier ones by number, and meets each of them on (source_file, chunk), so a
    message travels once for a chunk that needs it, not for each of its points; what comes together
    in a row is the prompt that the row is to hold.
    """
    asked = chunks.where(F.exists("messages", lambda m: m["is_point"]))
    refs = asked.where("chunk > 0").select(
        "source_file", "chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunk") - 1)).alias("ref")
    )
    linked = refs.join(
        chunks.select("source_file", F.col("chunk").alias("ref"), "messages"), ["source_file", "ref"]
    )
    before = linked.groupBy("source_file", "chunk").agg(F.sort_array(F.collect_list(F.struct("ref", "messages"))).alias("_parts"))
    earlier = F.flatten(F.transform(F.col("_parts"), lambda p: p["messages"]))
    none = F.slice("messages", F.lit(1), F.lit(0))
    return asked.join(before, ["source_file", "chunk"], "left").select(
        "source_file", "chunk", "messages", F.coalesce(earlier, none).alias("earlier")
    )


def merged_copies(messages: Column, compat: bool) -> Column:
    """The messages themselves, as often as they stand in a history."""
    if not compat:
        return F.transform(messages, lambda m: m["message"])
    return F.flatten(F.transform(messages, lambda m: F.array_repeat(m["message"], m["copies"])))



def dialogue_history(
    turns: DataFrame,
    system_prompt: str = DEFAULT_SYSTEM_PROMPT,
    compat: bool = False,
    chunk_turns: int = CHAIN_TURNS,
) -> DataFrame:
    """Whole history per evaluation point: source_file, turn_index, history (role, content).

    The real replies are in the history, not generated ones. The turns are written once, by chunk; a
    point has its chunk and, through it, the chain of earlier ones. A row is as long as its
    conversation up to the point: where a count, the last messages or the like will do, take
    folded_histories, and where the prefix form is enough, history_index.
    """
    w = chunk_window("source_file", "turn_index")
    neighbours = {"_next_role": F.lead("role").over(w)}
    if compat:
        neighbours["_previous_role"] = F.lag("role").over(w)
    spread = spread_chunks(role_turns(turns, compat), "turn_index", True, compat, chunk_turns)
    marked = with_copies(spread.withColumns(neighbours).withColumn("is_point", is_point()), compat)
    chunks = written(history_chunks(drop_edge_copies(marked)), "history_chunks")
    whole = chained(chunks).select(
        "source_file", "messages", merged_copies(F.col("earlier"), compat).alias("_earlier"),
        F.explode(F.filter(F.transform("messages", lambda m, i: F.struct(m["turn_index"], m["is_point"], i.alias("i"))), lambda m: m["is_point"])).alias("_p"),
    )
    own = merged_copies(F.slice("messages", F.lit(1), F.col("_p.i") + 1), compat)
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")))
    return whole.select(
        "source_file", F.col("_p.turn_index").alias("turn_index"), F.concat(system, F.col("_earlier"), own).alias("history")
    )
