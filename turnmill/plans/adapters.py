"""Driver tables in the shapes that the operators read.

Nested records are built from blocks of BLOCK consecutive turns, so a record stays small
however long its conversation is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.operators.dialogue import role_turns
from turnmill.operators.models import ModelSpec, spec_array
from turnmill.operators.ordering import dense_index, with_neighbours
from turnmill.operators.videos import CHANNEL_FILE_SUFFIX, TRANSCRIPT_MARKS, WATCH_URL
from turnmill.plans.registry import table

BLOCK = 64

BASELINES = [
    ModelSpec("echo_base", "echo", "base"),
    ModelSpec("echo_finetuned", "echo", "fine_tuned"),
    ModelSpec("repeat_base", "repeat", "base"),
]


def annotated(spark: SparkSession, sf: str) -> DataFrame:
    return annotate(table(spark, sf, "documents"), table(spark, sf, "labels"))


def annotate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents with their labels as annotated videos: id, 5 flags, 4 scores."""
    one = lambda c: F.when(c, 1).otherwise(0)
    i = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        i.alias("id"),
        F.when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0).alias("no_police_presence"),
        one(F.col("n_chars") < 200).alias("no_conversation_detected"),
        F.col("toxic").alias("advertisement_content_detected"),
        one((F.col("lang") == "de") & (i % 5 == 0)).alias("training_range_context"),
        one(i % 17 == 0).alias("non_relevant_crime_only_context"),
        (i % 7).cast("int").alias("police_presence_signals_score"),
        (F.expr("doc_id div 7") % 7).cast("int").alias("interaction_type_signals_score"),
        (F.expr("doc_id div 49") % 4).cast("int").alias("deescalation_indicators_score"),
        (F.col("n_chars") % 7).cast("int").alias("escalation_indicators_score"),
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """Eighteen binary signals per video, from the bits of its id and length."""
    mixed = F.col("doc_id") * 31 + F.col("n_chars")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        *[
            F.shiftright(mixed, b).bitwiseAND(1).cast("int").alias(f"{g}_{b - 6 * k + 1}")
            for k, g in enumerate(["police", "interaction", "deescalation"])
            for b in range(6 * k, 6 * k + 6)
        ],
    )


def channel_links(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("source").distinct().select(
        F.when(F.col("source") == "src7", F.concat(F.lit("https://www.youtube.com/"), "source"))
        .when(
            F.col("source") == "src8",
            F.concat(F.lit("https://www.youtube.com/@"), "source", F.lit("/videos@x")),
        )
        .otherwise(F.concat(F.lit("https://www.youtube.com/@"), "source"))
        .alias("link")
    )


def with_copies_of(docs: DataFrame, where: Column) -> DataFrame:
    """documents, and beside those that meet a condition a copy under -1 - doc_id to leave things out of."""
    copy = docs.filter(where).withColumn("doc_id", -1 - F.col("doc_id"))
    return docs.withColumn("odd", F.lit(False)).unionByName(copy.withColumn("odd", F.lit(True)))


def raw_videos(spark: SparkSession, sf: str) -> DataFrame:
    """documents as raw info records, some without address or counts. Beside one in 23 there is a copy
    without title, beside one in 29 one without description."""
    i = F.col("doc_id")
    source = -1 - i
    docs = with_copies_of(table(spark, sf, "documents"), (i % 23 == 0) | (i % 29 == 0))
    keep = lambda c, n: F.when(i % n != 0, c)
    untold = lambda c, n: F.when(~(F.col("odd") & (source % n == 0)), c)
    return docs.select(
        (i + 1).cast("int").alias("index"),
        F.concat(F.lit("v"), i).alias("video_id"),
        keep(F.concat(F.lit("https://video.example/"), i), 5).alias("webpage_url"),
        untold(F.col("text"), 23).alias("title"),
        keep(F.col("source"), 11).alias("uploader"),
        F.when(i % 13 == 0, "N/A").otherwise((i * 7).cast("string")).alias("view_count"),
        F.concat(F.lit("202401"), F.lpad((F.abs(i) % 28 + 1).cast("string"), 2, "0")).alias("upload_date"),
        keep(F.col("n_chars").cast("string"), 19).alias("duration"),
        untold(F.col("text"), 29).alias("description"),
    )


def channel_videos(spark: SparkSession, sf: str) -> DataFrame:
    """documents as rows of channel files, one file per source; beside one in 23 a copy without title."""
    copies = with_copies_of(table(spark, sf, "documents"), F.col("doc_id") % 23 == 0)
    docs = copies.select(
        F.concat("source", F.lit(CHANNEL_FILE_SUFFIX)).alias("source_file"),
        "doc_id",
        F.when(~F.col("odd"), F.col("text")).alias("title"),
        F.col("n_chars").cast("int").alias("duration_sec"),
        F.concat(F.lit("About "), "text").alias("description"),
        F.col("text").alias("transcript"),
    )
    return dense_index(docs, "source_file", "doc_id", "index")


def video_urls(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("page_id")
    watch = F.concat(F.lit(WATCH_URL), i)
    return table(spark, sf, "pages").select(
        i.alias("id"),
        F.when(i % 10 == 0, F.col("url"))
        .when(i % 3 == 0, F.concat(watch, F.lit("&t=1")))
        .otherwise(watch)
        .alias("url"),
    )


def transcripts(spark: SparkSession, sf: str) -> DataFrame:
    """Transcript cells of all pages, and beside seven in nine of them, under -1 - id, a missing one or
    a mark that stands for one: every mark comes up."""
    i = F.col("page_id")
    pages = table(spark, sf, "pages")
    cell = F.when(i % 9 == 0, F.lit(None).cast("string"))
    for n, (name, mark) in enumerate(TRANSCRIPT_MARKS.items(), 1):
        cell = cell.when(i % 9 == n, mark + ("x]" if name in ("rate_limited", "error") else ""))
    marks = pages.filter(i % 9 <= len(TRANSCRIPT_MARKS)).select((-1 - i).alias("id"), cell.alias("transcript"))
    return pages.select(i.alias("id"), F.col("html").alias("transcript")).unionByName(marks)


def transcript_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Manual (priority 1) and generated (2) transcripts; some pages lack one or both."""
    i = F.col("page_id")
    made = lambda lang, p: F.struct(
        F.lit(lang).alias("lang"),
        F.lit(p).alias("priority"),
        F.concat(F.lit(f"{lang}: "), "html").alias("text"),
    )
    both = F.array_compact(
        F.array(F.when(i % 4 != 0, made("en", 1)), F.when(i % 12 != 0, made("en-auto", 2)))
    )
    return table(spark, sf, "pages").select(i.alias("video_id"), F.explode(both).alias("c")).select(
        "video_id", "c.*"
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit(WATCH_URL), "doc_id").alias("url"),
        (F.col("n_chars").cast("double") / 100).alias("minutes"),
    )


def spoken(spark: SparkSession, sf: str) -> DataFrame:
    """documents as videos whose address is what is said in them; beside one in 7 a video whose answer is
    broken, beside one in 11 one that fails."""
    i = F.col("doc_id")
    kinds = F.array_compact(F.array(F.lit(""), F.when(i % 7 == 0, "_broken"), F.when(i % 11 == 0, "_silent")))
    return table(spark, sf, "documents").withColumn("kind", F.explode(kinds)).select(
        F.concat(i, "kind").alias("id"),
        F.coalesce("text", F.lit("")).alias("url"),
        (F.col("n_chars").cast("double") / 100).alias("minutes"),
    )


def status(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    marks = F.array_compact(
        F.array(F.when(i % 3 == 0, F.lit("processed")), F.when(i % 5 == 0, F.lit("ignore")))
    )
    return table(spark, sf, "documents").select(
        i.cast("string").alias("id"), F.explode(marks).alias("status")
    )


def diarization_usage(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    some = lambda n, m: F.when(i % n != 0, i * m)
    return table(spark, sf, "documents").select(
        i.cast("string").alias("id"),
        some(3, 10).alias("input_token"),
        some(4, 2).alias("output_token"),
        some(2, 1).alias("thought_token"),
        F.when(i % 5 != 0, F.col("n_chars").cast("double") / 8).alias("execution_time_sec"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as turn rows."""
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("conv_"), "conv_id", F.lit(".csv")).alias("source_file"),
        F.col("turn").cast("int").alias("turn_index"),
        F.when(F.col("role") == "user", F.concat(F.lit("Officer "), F.col("conv_id") % 9))
        .when(F.col("role") == "system", "Dispatcher")
        .otherwise("Civilian")
        .alias("speaker_label"),
        F.col("text").alias("transcript"),
    )


LABELS = [
    "deputy smith", "LAW ENFORCEMENT 2", "[Officer]", "Travel agent", "[Voice 2]", "John Smith",
    None, "State trooper", "Mother",
]


def mixed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Turns whose labels run through the cases of the role rule."""
    n = (F.col("conv_id") * 3 + F.col("turn")) % len(LABELS)
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        F.element_at(F.array(*[F.lit(x) for x in LABELS]), (n + 1).cast("int")).alias(
            "speaker_label"
        ),
    )


def blocks(spark: SparkSession, sf: str, item: Column, where: Column | None = None) -> DataFrame:
    """conv_id, block and the ordered items of at most BLOCK turns."""
    conv = table(spark, sf, "conversations")
    if where is not None:
        conv = conv.filter(where)
    return (
        conv.withColumn("block", F.expr(f"turn div {BLOCK}"))
        .groupBy("conv_id", "block")
        .agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("item")))).alias("_i"))
        .select("conv_id", "block", F.transform("_i", lambda x: x["item"]).alias("items"))
    )


def block_id() -> Column:
    return F.concat(F.col("conv_id"), F.lit("_"), F.col("block"))


def transcriptions(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as nested diarization records."""
    clock = F.format_string("%02d:%02d", F.expr("turn * 7 div 60"), F.col("turn") * 7 % 60)
    voice = F.when(F.col("role") == "user", 1).when(F.col("role") == "assistant", 2).otherwise(3)
    segment = F.struct(clock.alias("start"), F.col("text").alias("text"), voice.alias("voice"))
    kind = F.col("conv_id") % 4

    def speaker(v: int) -> Column:
        name = F.when(kind == 0, f"Person {v}").when(kind == 3, "").otherwise("?")
        position = F.when(kind == 1, f"Rank {v}").otherwise("?")
        role = F.when(kind == 2, f"Role {v}").otherwise("?")
        return F.struct(
            F.lit(v).alias("voice"), name.alias("name"), F.lit("?").alias("company"),
            position.alias("position"), role.alias("role_in_video"),
        )

    twice = F.struct(
        F.lit(1).alias("voice"), F.lit("Last").alias("name"), F.lit("?").alias("company"),
        F.lit("?").alias("position"), F.lit("?").alias("role_in_video"),
    )
    speakers = F.when(kind == 3, F.array(speaker(1), twice)).otherwise(
        F.array(speaker(1), speaker(2))
    )
    return blocks(spark, sf, segment).select(
        block_id().alias("video_id"),
        F.col("items").alias("task1_transcripts"),
        speakers.alias("task2_speakers"),
    )


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """The nested records as response text, and beside those of one in seven a broken copy."""
    whole = F.to_json(F.struct("task1_transcripts", "task2_speakers"))
    made = transcriptions(spark, sf)
    broken = F.split_part("video_id", F.lit("_"), F.lit(1)).cast("bigint") % 7 == 0
    return made.select("video_id", whole.alias("response")).union(
        made.filter(broken).select(
            F.concat("video_id", F.lit("_broken")), F.substring(whole, F.lit(1), F.length(whole) - 2)
        )
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation points with the replies of three plain baselines."""
    near = with_neighbours(
        role_turns(turns(spark, sf)),
        "source_file",
        "turn_index",
        ahead={"next_role": "role", "reference_response": "content"},
        behind={"previous_role": "role", "previous_text": "content"},
    ).filter("role = 'user' and next_role = 'assistant'")
    words = F.split("reference_response", " ")
    half = F.array_join(F.slice(words, F.lit(1), F.ceil(F.size(words) / 2).cast("int")), " ")
    before = F.when(F.col("previous_role") == "assistant", F.col("previous_text")).otherwise("")
    reply = (
        F.when(F.col("model_name") == "echo_base", F.col("content"))
        .when(F.col("model_name") == "echo_finetuned", half)
        .otherwise(before)
    )
    return (
        near.withColumn("_m", F.explode(spec_array(BASELINES)))
        .select("*", "_m.model_name", "_m.model_family", "_m.model_type")
        .select(
            "source_file",
            "turn_index",
            "model_name",
            "model_family",
            "model_type",
            F.col("content").alias("officer_input"),
            "reference_response",
            reply.alias("predicted_response"),
        )
    )


def with_given_f1(predictions: DataFrame) -> DataFrame:
    """Predictions with embedding_f1, a score that came from elsewhere and is missing in places."""
    conv = F.regexp_extract("source_file", r"-?\d+", 0).try_cast("bigint")
    score = ((conv * 7 + F.col("turn_index") * 3 + F.length("model_name")) % 100) / F.lit(100.0)
    return predictions.withColumn("embedding_f1", F.when(conv % 5 != 0, score.cast("double")))


RAW_REPLIES = [
    ("Civilian: ", "\nOfficer: stop"),
    ("suspect:  ", "<|im_end|> more"),
    ("```text\n", "\n```"),
    ("Assistant: Civilian: ", "</s>"),
    ("Subject:", "\nUser: hi"),
    ("  ", "\n\n"),
    ("Response: ", "\nPolice: halt"),
    ("Character: ", "<|endoftext|>System: x"),
    ("", ""),
]


def raw_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Turn texts wrapped the way models wrap their replies."""
    n = ((F.col("conv_id") + F.col("turn")) % len(RAW_REPLIES) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(r[k]) for r in RAW_REPLIES]), n)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat(pick(0), "text", pick(1)).alias("reply")
    )


def scenario_cases(spark: SparkSession, sf: str) -> DataFrame:
    """User turns as scenario cases (pos, case) in five spellings; beside one in eleven, a case
    under its own id whose dialogue is no list."""
    kind = F.col("conv_id") % 5
    text = F.col("text")

    def keyed(name: str) -> Column:
        return F.to_json(F.struct(text.alias(name)))

    item = (
        F.when(kind == 0, F.to_json(F.array(text)))  # ["text"], unwrapped below
        .when(kind == 1, keyed("text"))
        .when(kind == 2, keyed("transcript"))
        .when(kind == 3, keyed("utterance"))
        .otherwise(keyed("content"))
    )
    bare = F.when(kind == 0, F.substring(item, F.lit(2), F.length(item) - 2)).otherwise(item)
    ident = (
        F.when(kind == 0, F.concat(F.lit('"case_id":"c'), block_id(), F.lit('",')))
        .when(kind == 1, F.concat(F.lit('"case_id":"","id":'), F.col("conv_id"), F.lit(",")))
        .otherwise(F.lit(""))
    )
    context = (
        F.when(kind == 0, F.lit('"scenario_context":" a street ",'))
        .when(kind == 1, F.lit('"scenario_context":"","scenario":"a shop",'))
        .when(kind == 2, F.lit('"scenario":{},"context":"a park",'))
        .otherwise(F.lit(""))
    )
    profile = (
        F.when(kind == 0, F.lit('"character_profile":{"mood":"calm","age":30},'))
        .when(kind == 1, F.lit('"profile":"angry",'))
        .when(kind == 2, F.lit('"character_profile":null,"civilian_profile":"tired",'))
        .when(kind == 3, F.lit('"suspect_profile":["a","b"],'))
        .otherwise(F.lit(""))
    )
    name = (
        F.when(kind == 0, F.lit("police_dialogue"))
        .when(kind == 1, F.lit("police_dialog"))
        .when(kind == 2, F.lit("officer_dialogue"))
        .otherwise(F.lit("officer_turns"))
    )
    listed = F.concat(F.lit('[" ",'), F.array_join("items", ","), F.lit("]"))
    record = lambda own, turns: F.parse_json(F.concat(
        F.lit("{"), own, context, profile, F.lit('"'), name, F.lit('":'), turns, F.lit("}")
    ))
    bad = record(F.concat(F.lit('"case_id":"bad_'), block_id(), F.lit('",')), F.lit('"not a list"'))
    made = blocks(spark, sf, bare, F.col("role") == "user")
    pos = F.col("conv_id").cast("int").alias("pos")
    return made.select(pos, record(ident, listed).alias("case"), "block", F.lit(False).alias("bad")).union(
        made.filter("conv_id % 11 = 10").select(pos, bad, "block", F.lit(True))
    )


#: Files of scenario_files beside those of single cases.
SCENARIO_FILES = 64


def scenario_files(spark: SparkSession, sf: str, out: str) -> None:
    """scenario_cases as JSON files: arrays, arrays under "cases", which both start with a case of
    their own, and beside them files of one case."""
    bucket = F.col("pos") % SCENARIO_FILES
    alone = F.col("pos") % 97 == 5
    rows = scenario_cases(spark, sf).withColumns({"bucket": bucket, "json": F.to_json("case")})
    head = F.concat(F.lit('{"case_id":"head'), "bucket", F.lit('","police_dialogue":["x"]}'))
    opening = F.concat(F.when(F.col("bucket") % 2 == 0, "[").otherwise('{"cases": ['), head)
    closing = F.when(F.col("bucket") % 2 == 0, "]").otherwise("]}")
    buckets = spark.range(SCENARIO_FILES).select(F.col("id").cast("int").alias("bucket"))
    order = ["bucket", "phase", "pos", "block", "bad"]
    edge = lambda n, text: buckets.select("bucket", F.lit(n).alias("phase"), *[F.lit(None).alias(c) for c in order[2:]], text.alias("value"))
    inner = rows.where(~alone).select("bucket", F.lit(1).alias("phase"), *order[2:], F.concat(F.lit(","), "json").alias("value"))
    lines = edge(0, opening).unionByName(inner).unionByName(edge(2, closing))
    dealt = lines.repartitionById(SCENARIO_FILES, F.col("bucket")).sortWithinPartitions(*order)
    dealt.select("bucket", "value").write.partitionBy("bucket").text(f"{out}/arrays")
    singles = rows.where(alone).select(F.concat_ws("_", "pos", "block", "bad").alias("bucket"), F.col("json").alias("value"))
    singles.write.partitionBy("bucket").text(f"{out}/single")


def judge_cases(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as judge cases with outputs of up to three models."""
    block = blocks(
        spark, sf, F.concat(F.col("role"), F.lit(": "), F.col("text"))
    ).withColumn("text", F.array_join("items", "\n"))

    def output(m: int, spec: ModelSpec) -> Column:
        target = F.concat(F.lit(f"{spec.model_name} "), F.col("text"))
        own = F.when(F.col("conv_id") % 3 == m, target).otherwise(
            F.concat(F.lit("T "), F.col("text"))
        )
        entry = F.struct(
            F.lit(spec.model_name).alias("key"),
            F.struct(
                target.alias("target_conversation"), own.alias("conversation_transcript")
            ).alias("value"),
        )
        return F.when((F.col("conv_id") + m) % 6 != 0, entry)

    outputs = F.map_from_entries(
        F.array_compact(F.array(*[output(m, s) for m, s in enumerate(BASELINES)]))
    )
    return block.select(
        block_id().alias("case_id"),
        F.concat(F.lit("Scene {profile} "), F.col("conv_id")).alias("scenario_context"),
        F.concat(F.lit("Profile "), F.col("conv_id") % 4).alias("profile"),
        F.col("text").alias("ground_truth"),
        outputs.alias("model_outputs"),
    )


def verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Raw judge answers for every block of every conversation and model, which quote the block and
    score it by its length: plain, fenced and wrapped JSON. Beside those of one conversation in six,
    answers that cannot be used."""
    block = blocks(
        spark, sf, F.concat(F.col("role"), F.lit(": "), F.col("text"))
    ).select("conv_id", block_id().alias("block_id"), F.array_join("items", "\n").alias("text"))
    models = F.array(*[
        F.struct(F.lit(m).alias("m"), F.lit(s.model_name).alias("model_name"))
        for m, s in enumerate(BASELINES)])
    conv = block.select("*", F.explode(models).alias("_m")).select("conv_id", "block_id", "text", "_m.*")
    i, m, n = F.col("conv_id"), F.col("m"), F.length("text")
    score, base = (n * 37 + m * 11) % 101, (n * 13 + m * 29) % 101
    real = F.when(i % 10 == 0, 1).when(score >= 85, 1).otherwise(0)
    realism = F.concat(
        F.lit('{"analysis":'), F.to_json(F.struct(F.col("text").alias("quote"))),
        F.lit(',"look_Real":'), real, F.lit(',"Score":'),
        F.when(i % 8 == 5, F.concat(F.lit('"'), score, F.lit('"'))).otherwise(score.cast("string")),
        F.lit("}"),
    )
    names = ["None", "Repetitive Looping", "Unrealistic Dialogue", "Both"]
    points = F.element_at(F.array(*[F.lit(x) for x in (0, 15, 20, 35)]), (i % 4 + 1).cast("int"))
    band = (
        F.when(base <= 25, "Escalation").when(base <= 50, "Containment")
        .when(base <= 75, "De-escalation").otherwise("Resolution")
    )
    final = F.when(i % 9 == 0, base).otherwise(F.greatest(base - points, F.lit(0)))
    deescalation = F.concat(
        F.lit('{"reasoning":"r","outcome_category":"'),
        F.when(i % 7 == 0, "Containment").otherwise(band),
        F.lit('","base_score":'), base, F.lit(',"penalty_applied":"'),
        F.element_at(F.array(*[F.lit(x) for x in names]), (i % 4 + 1).cast("int")),
        F.lit('","final_score":'), final, F.lit("}"),
    )
    wrapped = (
        F.when(i % 6 == 1, F.concat(F.lit("```json\n"), realism, F.lit("\n```")))
        .when(i % 6 == 2, F.concat(F.lit("Here you are: "), realism, F.lit(" Done.")))
        .otherwise(realism)
    )
    useless = F.when(i % 12 == 3, "no verdict").otherwise("{broken")
    answer = lambda case, raw: F.struct(case.alias("case_id"), raw.alias("realism_raw"))
    answers = F.array(
        answer(F.col("block_id"), wrapped),
        F.when(i % 6 == 3, answer(F.concat("block_id", F.lit("_broken")), useless)),
    )
    return conv.select(
        F.explode(F.array_compact(answers)).alias("_a"), "model_name", deescalation.alias("deescalation_raw")
    ).select("_a.case_id", "model_name", "_a.realism_raw", "deescalation_raw")


def chat_records(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as JSON chat records in two spellings; beside some, records of one message
    without a list, and records that are not valid, under ids of their own."""
    kind = F.col("conv_id") % 8
    other = F.when(F.col("role") == "user", "human").when(
        F.col("role") == "assistant", "gpt"
    ).otherwise("system")
    standard = F.struct(F.col("role").alias("role"), F.col("text").alias("content"))
    sharegpt = F.struct(other.alias("from"), F.col("text").alias("value"))
    item = F.when(F.col("conv_id") % 2 == 0, F.to_json(standard)).otherwise(F.to_json(sharegpt))
    key = F.when(F.col("conv_id") % 2 == 0, "messages").otherwise("conversations")
    listed = F.array_join("items", ",")
    made = lambda end, value: F.struct(
        F.concat(block_id(), F.lit(end)).alias("record_id"),
        F.concat(F.lit('{"'), key, F.lit('":'), value, F.lit("}")).alias("record"),
    )
    odd = (
        F.when(kind == 5, made("_one", F.element_at("items", 1)))
        .when(kind == 6, made("_stray", F.concat(F.lit("["), listed, F.lit(',"stray"]'))))
        .when(kind == 7, made("_text", F.lit('"text only"')))
    )
    records = F.array_compact(F.array(made("", F.concat(F.lit("["), listed, F.lit("]"))), odd))
    return blocks(spark, sf, item).select(F.explode(records).alias("_r")).select("_r.*")


def training_history(spark: SparkSession, sf: str) -> DataFrame:
    """All events as the history of runs: click and view as loss and eval_loss, others without."""
    kind = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"),
        F.col("event_id").alias("step"),
        F.when(kind == "click", F.col("value")).alias("loss"),
        F.when(kind == "view", F.col("value")).alias("eval_loss"),
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """One run per user with its sizes."""
    return (
        table(spark, sf, "events")
        .groupBy(F.col("user_id").alias("run_id"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))
        .select(
            "run_id",
            F.concat(F.lit("model_"), F.col("run_id") % 7).alias("model_key"),
            (F.col("n") * 9).alias("train_samples"),
            F.col("n").alias("eval_samples"),
            (F.col("first") * 3).cast("double").alias("duration_sec"),
            F.when(F.col("run_id") % 6 == 0, "failed").otherwise("success").alias("status"),
            F.concat(F.lit("org/model_"), F.col("run_id") % 7).alias("hf_model_id"),
            (F.col("run_id") % 5 + 1).cast("int").alias("epochs"),
            F.concat(F.lit("checkpoints/"), "run_id").alias("checkpoint_dir"),
        )
    )


def token_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as token vectors of pairs; all of some pairs are on one side."""
    v = F.col("vec_id")
    one_sided = F.expr("vec_id div 10") % 9 == 4
    return table(spark, sf, "embeddings").select(
        F.expr("vec_id div 10").alias("pair_id"),
        F.when(F.expr("vec_id div 10") % 2 == 0, "echo_base")
        .otherwise("echo_finetuned")
        .alias("model_name"),
        F.when((v % 2 == 0) | one_sided, "pred").otherwise("ref").alias("side"),
        F.expr("(vec_id % 10) div 2").cast("int").alias("pos"),
        F.col("embedding").alias("vec"),
    )
