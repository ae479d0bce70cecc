"""Chat records: shape checks, role names, training text and repeatable splits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions.json import ARRAY, OBJECT, field, parse, variant_items, variant_kind
from turnmill.functions.text import col, strip_ws

# Keys under which a record may hold its messages, and keys of a message.
MESSAGE_KEYS = ["messages", "conversations"]
ROLE_KEYS = ["role", "from"]
CONTENT_KEYS = ["content", "value"]

# Role names of each mapping, by chat role.
ROLE_MAPPINGS = {
    "standard": {"system": "system", "user": "user", "assistant": "assistant"},
    "gemma": {"system": "system", "user": "user", "assistant": "model"},
    "sharegpt": {"system": "system", "user": "human", "assistant": "gpt"},
}
CHAT_ROLES = {"human": "user", "gpt": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class ChatTemplate:
    """Text before all messages, and (before, after) each message by role."""

    start: str
    around: dict[str, tuple[str, str]]
    trim: bool = False
    fold_system: str | None = None


def _same(before: str, after: str, assistant: str = "assistant") -> dict[str, tuple[str, str]]:
    names = {"system": "system", "user": "user", "assistant": assistant}
    return {r: (before.replace("ROLE", n), after) for r, n in names.items()}


# Public chat formats of the model families. fold_system puts the system text
# in front of the first user message, with this text in between.
CHAT_TEMPLATES = {
    "chatml": ChatTemplate("", _same("<|im_start|>ROLE\n", "<|im_end|>\n")),
    "llama-3": ChatTemplate(
        "<|begin_of_text|>",
        _same("<|start_header_id|>ROLE<|end_header_id|>\n\n", "<|eot_id|>"),
        trim=True,
    ),
    "gemma": ChatTemplate(
        "<bos>",
        _same("<start_of_turn>ROLE\n", "<end_of_turn>\n", "model"),
        trim=True,
        fold_system="\n\n",
    ),
    "mistral": ChatTemplate(
        "<s>",
        {"system": ("", ""), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")},
        fold_system=" ",
    ),
    "phi-4": ChatTemplate("", _same("<|im_start|>ROLE<|im_sep|>", "<|im_end|>")),
    "falcon-3": ChatTemplate(
        "",
        {
            "system": ("<|system|>\n", "\n"),
            "user": ("<|user|>\n", "\n"),
            "assistant": ("<|assistant|>\n", "<|endoftext|>\n"),
        },
    ),
    "granite-3": ChatTemplate(
        "", _same("<|start_of_role|>ROLE<|end_of_role|>", "<|end_of_text|>\n")
    ),
}


@dataclass(frozen=True)
class TrainingSetup:
    template: str
    mapping: str
    message_key: str
    eval_fraction: float


# Template, role names, message key and evaluation share per model family.
TRAINING_SETUPS = {
    "qwen": TrainingSetup("chatml", "standard", "messages", 0.1),
    "llama": TrainingSetup("llama-3", "standard", "messages", 0.1),
    "gemma": TrainingSetup("gemma", "gemma", "messages", 0.03),
    "falcon": TrainingSetup("falcon-3", "standard", "messages", 0.1),
    "granite": TrainingSetup("granite-3", "standard", "messages", 0.03),
    "ministral": TrainingSetup("mistral", "sharegpt", "conversations", 0.1),
    "phi4": TrainingSetup("phi-4", "standard", "messages", 0.0),
}
SPLIT_SEED = 3407


def lookup_only(names: dict[str, str], key: Column) -> Column:
    """The name for a key, NULL when it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def lookup(names: dict[str, str], key: Column) -> Column:
    """The name for a key, or the key itself when it has none."""
    return F.coalesce(lookup_only(names, key), key)


def message_of(item: Column) -> Column:
    role = F.coalesce(*[field(item, k, "string") for k in ROLE_KEYS], F.lit(""))
    content = F.coalesce(*[field(item, k, "string") for k in CONTENT_KEYS], F.lit(""))
    return F.struct(lookup(CHAT_ROLES, role).alias("role"), content.alias("content"))


def coerce_conversation(records: DataFrame, record: str = "record") -> DataFrame:
    """JSON records to valid and messages (role, content).

    A list of objects is kept, a single object becomes a list of one. Anything else, also a
    list with a non-object in it, is not valid and has NULL messages.
    """
    convo = F.col("_convo")
    items = F.when(variant_kind(convo) == OBJECT, F.array(convo)).when(
        (variant_kind(convo) == ARRAY)
        & F.forall(variant_items(convo), lambda m: variant_kind(m) == OBJECT),
        variant_items(convo),
    )
    return (
        records.withColumn("_v", parse(record))
        .withColumn("_convo", F.coalesce(*[field(F.col("_v"), k) for k in MESSAGE_KEYS]))
        .withColumn("_items", items)
        .withColumn("valid", F.col("_items").isNotNull())
        .withColumn("messages", F.transform("_items", message_of))
        .drop("_v", "_convo", "_items")
    )


def map_roles(messages: Column | str, mapping: str) -> Column:
    """The messages with the role names of one mapping; other roles stay as they are."""
    return F.transform(
        col(messages),
        lambda m: F.struct(lookup(ROLE_MAPPINGS[mapping], m["role"]).alias("role"), m["content"]),
    )


def fold_system(messages: Column, between: str) -> Column:
    """A leading system message joined to the message after it."""
    first, second = F.try_element_at(messages, F.lit(1)), F.try_element_at(messages, F.lit(2))
    joined = F.struct(
        F.coalesce(second["role"], F.lit("user")).alias("role"),
        F.concat_ws(between, first["content"], second["content"]).alias("content"),
    )
    rest = F.slice(messages, F.lit(3), F.greatest(F.size(messages) - 2, F.lit(0)))
    return F.when(first["role"] == "system", F.concat(F.array(joined), rest)).otherwise(messages)


def render_chat_template(messages: Column | str, template: str) -> Column:
    """A conversation as one training text; NULL messages give ''."""
    t = CHAT_TEMPLATES[template]
    body = col(messages)
    if t.trim:
        body = F.transform(
            body, lambda m: F.struct(m["role"], strip_ws(m["content"]).alias("content"))
        )
    if t.fold_system is not None:
        body = fold_system(body, t.fold_system)

    def rendered(m: Column) -> Column:
        side = lambda n: F.coalesce(
            lookup_only({r: texts[n] for r, texts in t.around.items()}, m["role"]), F.lit("")
        )
        return F.concat(side(0), m["content"], side(1))

    text = F.concat(F.lit(t.start), F.array_join(F.transform(body, rendered), ""))
    return F.coalesce(text, F.lit(""))


def render_with(messages: Column | str, render: Callable[[list[dict]], str]) -> Column:
    """Training text by a template of one's own, in Arrow batches; a failure gives ''."""

    def run(batch: pd.Series) -> pd.Series:
        texts = []
        for convo in batch:
            try:
                texts.append(render([dict(m) for m in convo]))
            except Exception:
                texts.append("")
        return pd.Series(texts, dtype="object")

    return F.pandas_udf(run, "string")(col(messages))


def training_text(records: DataFrame, setup: TrainingSetup, compat: bool = False) -> DataFrame:
    """Records with messages and their training text; invalid ones are dropped (kept if compat)."""
    shaped = coerce_conversation(records)
    kept = shaped if compat else shaped.filter("valid")
    return kept.withColumn("text", render_chat_template("messages", setup.template))


def split_bucket(key: Column | str, seed: int = SPLIT_SEED) -> Column:
    """A number from 0 to 9999 that depends only on the key and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 10000


def train_eval_split(
    df: DataFrame, key: str, eval_fraction: float, seed: int = SPLIT_SEED
) -> DataFrame:
    """Add split (train or eval). A row keeps its side however the data grows."""
    limit = round(eval_fraction * 10000)
    return df.withColumn(
        "split", F.when(split_bucket(key, seed) < limit, "eval").otherwise("train")
    )


def split_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
