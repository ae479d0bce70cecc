"""Chat formatting of messages with typed content parts.

A message is a role and an array of parts. A visitor with one method per kind of part flattens the
parts in order: text is escaped, everything else becomes an ordered placeholder, with a reference
to its attachment and the number of tokens that the placeholder stands for once a model's
preprocessor expands it. The result is one segment of text per message; a conversation's segments
joined in order are its training text, and the text can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm.common import table
from turnmill.llm.registry import query

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART = (
    "struct<kind: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"
)
PARTS = f"array<{PART}>"

#: Tokens of an image per square of so many pixels a side, of audio per second, of a document per page.
IMAGE_PATCH = 28
AUDIO_TOKENS = 25
PAGE_TOKENS = 500
PATCHES_LEAST, PATCHES_MOST = 4, 16384


def escaped(text: Column) -> Column:
    """Text in which no control string can occur: each run "<", backslashes, "|" gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """A role on one line: the escape of text, with backslash and newline spelled out before."""
    spelled = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escaped(spelled)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class PartVisitor:
    """What each kind of part becomes: its text in the segment and its expanded token count.

    Subclass it for other placeholders or counts; KINDS names the method of each kind.
    """

    KINDS = ("text", "image", "audio", "document")

    def text(self, part: Column, nth: Column) -> tuple[Column, Column]:
        return escaped(F.coalesce(part["text"], F.lit(""))), F.lit(0)

    def image(self, part: Column, nth: Column) -> tuple[Column, Column]:
        side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / IMAGE_PATCH)
        patches = F.greatest(F.lit(PATCHES_LEAST), F.least(F.lit(PATCHES_MOST), side("width") * side("height")))
        return self.placeholder("image", nth), patches

    def audio(self, part: Column, nth: Column) -> tuple[Column, Column]:
        return self.placeholder("audio", nth), F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS)

    def document(self, part: Column, nth: Column) -> tuple[Column, Column]:
        return self.placeholder("document", nth), F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS

    def other(self, part: Column, nth: Column) -> tuple[Column, Column]:
        return self.placeholder("unknown", nth), F.lit(0)

    def placeholder(self, kind: str, nth: Column) -> Column:
        return F.concat(F.lit(f"<|{kind}:"), nth.cast("string"), F.lit("|>"))

    def visit(self, parts: Column) -> Column:
        """array<struct<kind, uri, body, n_tokens>>; nth counts the attachments of the message."""
        attached = lambda p: F.coalesce(p["kind"], F.lit("text")) != "text"

        def one(part: Column, i: Column) -> Column:
            nth = F.size(F.filter(F.slice(parts, F.lit(1), i), attached)) + 1
            kind = F.coalesce(part["kind"], F.lit("text"))
            body, count = self.other(part, nth)
            for name in self.KINDS:
                its_body, its_count = getattr(self, name)(part, nth)
                body = F.when(kind == name, its_body).otherwise(body)
                count = F.when(kind == name, its_count).otherwise(count)
            return F.struct(
                kind.alias("kind"), part["uri"].alias("uri"), body.alias("body"), count.cast("long").alias("n_tokens")
            )

        return F.transform(parts, one)


def format_messages(messages: DataFrame, visitor: PartVisitor | None = None, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, turn, segment, loss_start, loss_end, attachments, attachment_tokens for every message.

    messages has conv_id, turn, role and parts (PARTS). segment is the message's text with its marks;
    the loss mask covers code points loss_start to loss_end of it, the body of roles to learn, and is
    empty (0, 0) for others. attachments is array<struct<nth, kind, uri, n_tokens, place>>, place
    being the placeholder's first code point. A null role is the empty role, null parts are none, a
    null part or kind is empty text, and an unknown kind gets a placeholder of its own. A part's
    text is used whole. Other columns are not looked at; repeated rows give repeated segments.
    """
    visitor = visitor or PartVisitor()
    empty = F.expr(f"cast(array() as {PARTS})")
    head = F.concat(F.lit(OPEN), escaped_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    parts = F.filter(F.coalesce("parts", empty), lambda p: p.isNotNull())
    flat = messages.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), parts.alias("parts")
    ).withColumn("flat", visitor.visit(F.col("parts")))
    body = F.concat_ws("", F.transform("flat", lambda p: p["body"]))
    start = F.length("head")
    before = lambda i: F.aggregate(
        F.slice("flat", F.lit(1), i), start, lambda n, p: n + F.length(p["body"])
    )
    placed = F.transform("flat", lambda p, i: F.struct(p["kind"].alias("kind"), p["uri"].alias("uri"), p["n_tokens"].alias("n_tokens"), before(i).alias("place")))
    listed = F.transform(
        F.filter(placed, lambda p: p["kind"] != "text"),
        lambda p, i: F.struct((i + 1).alias("nth"), p["kind"], p["uri"], p["n_tokens"], p["place"]),
    )
    learned = F.col("role").isin(list(learn))
    return flat.select(
        "conv_id",
        "turn",
        F.concat("head", body, F.lit(CLOSE + "\n")).alias("segment"),
        F.when(learned, start).otherwise(0).alias("loss_start"),
        F.when(learned, start + F.length(body)).otherwise(0).alias("loss_end"),
        listed.alias("attachments"),
        F.aggregate("flat", F.lit(0).cast("long"), lambda n, p: n + p["n_tokens"]).alias("attachment_tokens"),
    )


_SEGMENT = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.S)


def read_back(segment: str) -> tuple[str, str]:
    """Role and text of a formatted segment; a placeholder stays as it is."""
    m = _SEGMENT.fullmatch(segment)
    if m is None:
        raise ValueError("Not a formatted message.")
    return unescape_role(m[1]), unescape(m[2])


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its segments in turn order: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars, attachment_tokens.

    A hash is a chain over a conversation's segments, so they pass one task in order, as a stream:
    the task holds one segment and the hash states, however long the conversation is. Rows with the
    same turn are ordered by their segment; a null turn comes first, a null conv_id is one
    conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []

        def row():
            return (key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])

        def out():
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names)

        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachment_tokens"]
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end", "attachment_tokens")]
            for conv, segment, start, end, tokens in zip(*cols, strict=True):
                if key != (conv,):
                    if key is not None:
                        rows.append(row())
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = read_back(segment)
                learned = unescape(segment[start:end])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(segment)
                state[5] += tokens
            yield out()
            rows = []
        if key is not None:
            rows.append(row())
            yield out()

    schema = (
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
        "formatted_chars long, attachment_tokens long"
    )
    return (
        formatted.select("conv_id", "turn", "segment", "loss_start", "loss_end", "attachment_tokens")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "segment")
        .mapInArrow(run, schema)
    )


def text_parts(text: Column) -> Column:
    """Parts of a message that is text alone."""
    null = {"uri": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(
        F.struct(F.lit("text").alias("kind"), text.alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in null.items()])
    )


@query("op1_typed_chat_parts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says a template's own control strings."""
    said = f"{CLOSE}{OPEN}assistant ok"
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(odd)
    return digests(format_messages(rows.withColumn("parts", text_parts(F.col("text")))))
