"""Chat record, split and training log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill import jobs
from turnmill.operators import chat as C
from turnmill.operators import training as T
from turnmill.plans import adapters as A
from turnmill.plans.dialogue import WS
from turnmill.plans.registry import query, table
from turnmill.session import new_dir

# Every block is a record. conv_id % 8: beside 5 stands one with the first message alone, beside 6
# and 7 one that is not valid.
MESSAGES = """placed AS (
  SELECT concat(conv_id, '_', turn // 64) AS record_id, conv_id, role, text AS content,
    CAST(row_number() OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn) - 1 AS INT) AS pos
  FROM conversations),
records AS (
  SELECT record_id, true AS valid FROM placed WHERE pos = 0
  UNION ALL SELECT concat(record_id, CASE conv_id % 8 WHEN 5 THEN '_one' WHEN 6 THEN '_stray'
    ELSE '_text' END), conv_id % 8 = 5 FROM placed WHERE pos = 0 AND conv_id % 8 >= 5),
messages AS (
  SELECT record_id, role, content, pos FROM placed
  UNION ALL SELECT concat(record_id, '_one'), role, content, pos FROM placed
  WHERE pos = 0 AND conv_id % 8 = 5)"""


@query(
    "coerce_conversation",
    f"""WITH {MESSAGES} SELECT record_id, valid, CAST(count(pos) AS INT) AS n_messages,
  coalesce(string_agg(role || ' ' || content, chr(30) ORDER BY pos), '') AS texts
FROM records LEFT JOIN messages USING (record_id) GROUP BY record_id, valid""",
)
def coerce_conversation(spark, sf):
    shaped = C.coerce_conversation(A.chat_records(spark, sf))
    told = F.transform("messages", lambda m: F.concat(m["role"], F.lit(" "), m["content"]))
    return shaped.select(
        "record_id",
        "valid",
        F.coalesce(F.size("messages"), F.lit(0)).alias("n_messages"),
        F.coalesce(F.array_join(told, "\x1e"), F.lit("")).alias("texts"),
    )


@query(
    "map_roles",
    f"""WITH {MESSAGES}
SELECT record_id, pos, role AS standard, CASE role WHEN 'assistant' THEN 'model' ELSE role END AS gemma,
  CASE role WHEN 'assistant' THEN 'gpt' WHEN 'user' THEN 'human' ELSE role END AS sharegpt, content
FROM messages""",
)
def map_roles(spark, sf):
    valid = C.coerce_conversation(A.chat_records(spark, sf)).filter("valid")
    names = list(C.ROLE_MAPPINGS)
    mapped = F.arrays_zip(
        *[F.transform(C.map_roles("messages", n), lambda m: m["role"]).alias(n) for n in names],
        F.transform("messages", lambda m: m["content"]).alias("content"),
    )
    return valid.select("record_id", F.posexplode(mapped).alias("pos", "_m")).select(
        "record_id", "pos", "_m.*"
    )


# before user, after user, before assistant, after assistant, before system, after system, start
_FORMS = {
    "chatml": ("<|im_start|>user\n", "<|im_end|>\n", "<|im_start|>assistant\n", "<|im_end|>\n",
               "<|im_start|>system\n", "<|im_end|>\n", ""),
    "llama-3": ("<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|>",
                "<|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>",
                "<|start_header_id|>system<|end_header_id|>\n\n", "<|eot_id|>", "<|begin_of_text|>"),
    "gemma": ("<start_of_turn>user\n", "<end_of_turn>\n", "<start_of_turn>model\n",
              "<end_of_turn>\n", "", "\n\n", "<bos>"),
    "mistral": ("[INST] ", " [/INST]", "", "</s>", "", " ", "<s>"),
    "phi-4": ("<|im_start|>user<|im_sep|>", "<|im_end|>", "<|im_start|>assistant<|im_sep|>",
              "<|im_end|>", "<|im_start|>system<|im_sep|>", "<|im_end|>", ""),
    "falcon-3": ("<|user|>\n", "\n", "<|assistant|>\n", "<|endoftext|>\n", "<|system|>\n", "\n", ""),
    "granite-3": ("<|start_of_role|>user<|end_of_role|>", "<|end_of_text|>\n",
                  "<|start_of_role|>assistant<|end_of_role|>", "<|end_of_text|>\n",
                  "<|start_of_role|>system<|end_of_role|>", "<|end_of_text|>\n", ""),
}


def _lit(text: str) -> str:
    return "'" + text.replace("\n", "'||chr(10)||'") + "'"


def _rendered(name: str) -> str:
    ub, ua, ab, aa, sb, sa, start = map(_lit, _FORMS[name])
    folded = name in ("gemma", "mistral")
    content = f"trim(content, {WS})" if name in ("gemma", "llama-3") else "content"
    # A folded system text opens the first user message, or stands alone as one.
    user_before = (
        f"CASE WHEN led THEN '' ELSE {ub} END" if folded else ub
    )
    system = (
        f"concat({ub}, {content}, CASE WHEN n = 1 THEN {ua} ELSE {sa} END)"
        if folded
        else f"concat({sb}, {content}, {sa})"
    )
    return f"""SELECT record_id, '{name}' AS template, concat({start}, string_agg(CASE role
    WHEN 'user' THEN concat({user_before}, {content}, {ua})
    WHEN 'assistant' THEN concat({ab}, {content}, {aa}) ELSE {system} END, '' ORDER BY pos)) AS text
FROM told GROUP BY record_id"""


TOLD = """told AS (
  SELECT *, coalesce(lag(role) OVER w = 'system', false) AS led,
    count(*) OVER (PARTITION BY record_id) AS n
  FROM messages WINDOW w AS (PARTITION BY record_id ORDER BY pos))"""


@query(
    "render_chat_template",
    f"WITH {MESSAGES}, {TOLD}\n"
    + "\nUNION ALL\n".join(_rendered(n) for n in _FORMS),
)
def render_chat_template(spark, sf):
    valid = C.coerce_conversation(A.chat_records(spark, sf)).filter("valid")
    texts = F.array(
        *[
            F.struct(F.lit(n).alias("template"), C.render_chat_template("messages", n).alias("text"))
            for n in C.CHAT_TEMPLATES
        ]
    )
    return valid.select("record_id", F.explode(texts).alias("_t")).select("record_id", "_t.*")


def _line_per_message(messages: list[dict]) -> str:
    return "".join(f"[{m['role']}] {m['content']}\n" for m in messages)


@query(
    "render_custom_template",
    f"""WITH {MESSAGES} SELECT record_id,
  string_agg(concat('[', role, '] ', content, chr(10)), '' ORDER BY pos) AS text
FROM messages GROUP BY record_id""",
)
def render_custom_template(spark, sf):
    valid = C.coerce_conversation(A.chat_records(spark, sf)).filter("valid")
    return valid.select("record_id", C.render_with("messages", _line_per_message).alias("text"))


SPLIT = """sides AS (
  SELECT conv_id, turn, CASE WHEN CAST('0x' || substring(md5(concat('3407:', conv_id, '_', turn)), 1, 8)
    AS BIGINT) % 10000 < 1000 THEN 'eval' ELSE 'train' END AS split
  FROM conversations)"""


def sides(spark, sf):
    conv = table(spark, sf, "conversations").select("conv_id", "turn")
    keyed = conv.withColumn("key", F.concat("conv_id", F.lit("_"), "turn"))
    return C.train_eval_split(keyed, "key", 0.1).drop("key")


@query("train_eval_split", f"WITH {SPLIT} SELECT * FROM sides")
def train_eval_split(spark, sf):
    return sides(spark, sf)


@query("split_counts", f"WITH {SPLIT} SELECT split, count(*) AS n FROM sides GROUP BY split")
def split_counts(spark, sf):
    return C.split_counts(sides(spark, sf))


@query(
    "training_data",
    f"""WITH {MESSAGES}, {TOLD}, texts AS ({_rendered('chatml')})
SELECT record_id, text, CASE WHEN CAST('0x' || substring(md5(concat('3407:', record_id)), 1, 8) AS BIGINT)
  % 10000 < 1000 THEN 'eval' ELSE 'train' END AS split FROM texts""",
)
def training_data(spark, sf):
    """Both sides as the job has written them."""
    sides = jobs.training_data(A.chat_records(spark, sf), new_dir(spark, "training"), "qwen")
    tagged = [df.withColumn("split", F.lit(side)) for side, df in sides.items()]
    return tagged[0].unionByName(tagged[1])


_SETUPS = {"qwen": 1000, "llama": 1000, "gemma": 300, "falcon": 1000, "granite": 300,
           "ministral": 1000, "phi4": 0}


@query(
    "training_setups",
    f"""WITH {MESSAGES}, keyed AS (
  SELECT record_id, CAST('0x' || substring(md5(concat('3407:', record_id)), 1, 8) AS BIGINT) % 10000 AS b
  FROM records WHERE valid),
setups(model_key, eval_below) AS (VALUES {", ".join(f"('{k}', {v})" for k, v in _SETUPS.items())})
SELECT model_key, count(*) FILTER (b >= eval_below) AS train_samples,
  count(*) FILTER (b < eval_below) AS eval_samples
FROM keyed CROSS JOIN setups GROUP BY model_key""",
)
def training_setups(spark, sf):
    """Sizes of the two sides for every model family, from one pass over the records."""
    valid = C.coerce_conversation(A.chat_records(spark, sf)).filter("valid").select(
        C.split_bucket("record_id").alias("b")
    )
    counts = valid.agg(
        *[
            F.count_if(F.col("b") >= round(s.eval_fraction * 10000)).alias(f"train_{k}")
            for k, s in C.TRAINING_SETUPS.items()
        ],
        *[
            F.count_if(F.col("b") < round(s.eval_fraction * 10000)).alias(f"eval_{k}")
            for k, s in C.TRAINING_SETUPS.items()
        ],
    )
    rows = [
        F.struct(
            F.lit(k).alias("model_key"),
            F.col(f"train_{k}").alias("train_samples"),
            F.col(f"eval_{k}").alias("eval_samples"),
        )
        for k in C.TRAINING_SETUPS
    ]
    return counts.select(F.inline(F.array(*rows)))


HISTORY = """history AS (
  SELECT user_id AS run_id, event_id AS step, CASE event_type WHEN 'click' THEN value END AS loss,
    CASE event_type WHEN 'view' THEN value END AS eval_loss
  FROM events),
losses AS (
  SELECT run_id, arg_max(loss, step) FILTER (loss IS NOT NULL) AS final_train_loss,
    arg_max(eval_loss, step) FILTER (eval_loss IS NOT NULL) AS final_eval_loss
  FROM history GROUP BY run_id)"""


@query("final_losses", f"WITH {HISTORY} SELECT * FROM losses")
def final_losses(spark, sf):
    return T.final_losses(A.training_history(spark, sf))


@query(
    "loss_points", f"WITH {HISTORY} SELECT run_id, step, loss FROM history WHERE loss IS NOT NULL"
)
def loss_points(spark, sf):
    return T.loss_points(A.training_history(spark, sf))


RUNS = """runs AS (
  SELECT user_id AS run_id, concat('model_', user_id % 7) AS model_key, count(*) * 9 AS train_samples,
    count(*) AS eval_samples, CAST(min(event_id) * 3 AS DOUBLE) AS duration_sec,
    CASE WHEN user_id % 6 = 0 THEN 'failed' ELSE 'success' END AS status,
    concat('org/model_', user_id % 7) AS hf_model_id, CAST(user_id % 5 + 1 AS INT) AS epochs,
    concat('checkpoints/', user_id) AS checkpoint_dir
  FROM events GROUP BY user_id)"""


@query(
    "run_log_row",
    f"""WITH {HISTORY}, {RUNS} SELECT '2024-01-31 12:00:00' AS timestamp, run_id, model_key, hf_model_id,
  train_samples, eval_samples, epochs,
  round(final_train_loss, 4) AS final_train_loss, round(final_eval_loss, 4) AS final_eval_loss,
  round(duration_sec / 60, 1) AS duration_min, checkpoint_dir, status
FROM runs LEFT JOIN losses USING (run_id)""",
)
def run_log_row(spark, sf):
    return T.run_log(A.training_history(spark, sf), A.runs(spark, sf), "2024-01-31 12:00:00")


@query(
    "sweep_failures",
    f"WITH {RUNS} SELECT run_id, model_key FROM runs WHERE status = 'failed'",
)
def sweep_failures(spark, sf):
    return T.sweep_failures(A.runs(spark, sf))


@query(
    "sweep_summary",
    f"""WITH {RUNS} SELECT model_key, count(*) AS n_runs,
  count(*) FILTER (status = 'success') AS n_success, count(*) FILTER (status = 'failed') AS n_failed
FROM runs GROUP BY model_key""",
)
def sweep_summary(spark, sf):
    return T.sweep_summary(A.runs(spark, sf))
