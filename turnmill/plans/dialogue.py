"""Dialogue, scoring and summary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.text import PY_WHITESPACE
from turnmill.operators import dialogue as D
from turnmill.operators import histories as H
from turnmill.operators import scoring as S
from turnmill.operators import summaries as M
from turnmill.plans import adapters as A
from turnmill.plans.registry import query, table

WS = "concat(" + ", ".join(f"chr({ord(c)})" for c in PY_WHITESPACE) + ")"

TURNS = """turns AS (
  SELECT concat('conv_', conv_id, '.csv') AS source_file, CAST(turn AS INT) AS turn_index,
    CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, text AS content, conv_id
  FROM conversations),
near AS (
  SELECT *, lead(role) OVER w AS next_role, lead(content) OVER w AS next_text,
    lag(role) OVER w AS previous_role, lag(content) OVER w AS previous_text
  FROM turns WINDOW w AS (PARTITION BY source_file ORDER BY turn_index)),
points AS (SELECT * FROM near WHERE role = 'user' AND next_role = 'assistant')"""


@query(
    "speaker_role",
    """SELECT conv_id, turn,
  CASE (conv_id * 3 + turn) % 9 WHEN 4 THEN 'assistant' WHEN 5 THEN 'assistant'
    WHEN 6 THEN 'assistant' WHEN 8 THEN 'assistant' ELSE 'user' END AS role
FROM conversations""",
)
def speaker_role(spark, sf):
    return A.mixed_labels(spark, sf).select(
        "conv_id", "turn", D.speaker_role("speaker_label").alias("role")
    )


@query(
    "turn_pairs",
    f"""WITH {TURNS} SELECT source_file, turn_index, content AS officer_input,
  next_text AS reference_response FROM points""",
)
def turn_pairs(spark, sf):
    return D.turn_pairs(A.turns(spark, sf))


def _history(copies: str) -> str:
    return f"""WITH {TURNS}, counted AS (
  SELECT *, coalesce(role = 'user' AND next_role = 'assistant', false) AS is_point,
    {copies} AS copies,
    length(content) + CASE role WHEN 'user' THEN 9 ELSE 10 END + 1 AS chars
  FROM near)
SELECT source_file, turn_index, role, content, copies, is_point,
  CAST(sum(is_point::INT) OVER w - is_point::INT AS BIGINT) AS points_before,
  CAST(sum(chars * copies) OVER w - 1 AS BIGINT) AS prompt_chars
FROM counted WINDOW w AS (PARTITION BY source_file ORDER BY turn_index)"""


TWICE = "CASE WHEN role = 'assistant' AND previous_role = 'user' THEN 2 ELSE 1 END"


@query("history_index", _history("1"))
def history_index(spark, sf):
    return D.history_index(A.turns(spark, sf))


@query("history_index_compat", _history(TWICE))
def history_index_compat(spark, sf):
    return D.history_index(A.turns(spark, sf), compat=True)


def _messages(line: str) -> str:
    return f"""WITH {TURNS}, told AS (
  SELECT source_file, turn_index, role, next_role, list({line}) OVER (
    PARTITION BY source_file ORDER BY turn_index) AS lines FROM near)
SELECT source_file, turn_index, array_to_string(list_concat(['system: Stay in role.'], {{lines}}), chr(10)) AS history
FROM told WHERE role = 'user' AND next_role = 'assistant'"""


MESSAGE = "concat(role, ': ', content)"


def _messages_of(spark, sf, compat):
    histories = H.dialogue_history(A.turns(spark, sf), "Stay in role.", compat)
    lines = F.transform("history", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return histories.select("source_file", "turn_index", F.array_join(lines, "\n").alias("history"))


@query("dialogue_history", _messages(MESSAGE).format(lines="lines"))
def dialogue_history(spark, sf):
    """All messages of every history."""
    return _messages_of(spark, sf, False)


@query(
    "dialogue_history_compat",
    _messages(f"CASE WHEN role = 'assistant' AND previous_role = 'user' THEN [{MESSAGE}, {MESSAGE}] ELSE [{MESSAGE}] END")
    .format(lines="flatten(lines)"),
)
def dialogue_history_compat(spark, sf):
    return _messages_of(spark, sf, True)


FOLDS = {
    "messages": H.MessageCount(),
    "prompt_chars": H.PromptChars(),
    "last_reply": H.LastBy("assistant"),
    "recent": H.LastMessages(3),
}


@query(
    "folded_histories",
    f"""WITH {TURNS}, told AS (
  SELECT *, count(*) OVER w + 1 AS messages, list(concat(role, ': ', content)) OVER r AS recent,
    arg_max(content, turn_index) FILTER (role = 'assistant') OVER w AS last_reply,
    CAST(sum(length(content) + CASE role WHEN 'user' THEN 9 ELSE 10 END + 1) OVER w - 1 AS BIGINT) AS prompt_chars
  FROM near WINDOW w AS (PARTITION BY source_file ORDER BY turn_index),
    r AS (PARTITION BY source_file ORDER BY turn_index ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
SELECT source_file, turn_index, content AS officer_input, messages, prompt_chars, last_reply,
  array_to_string(recent, chr(10)) AS recent
FROM told WHERE role = 'user' AND next_role = 'assistant'""",
)
def folded_histories(spark, sf):
    """What a count, the last reply and a windowed prompt need of every history."""
    lines = F.transform("recent", lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return H.folded_histories(A.turns(spark, sf), FOLDS).withColumn("recent", F.array_join(lines, "\n"))


def _prompts(line: str) -> str:
    return f"""WITH {TURNS}, told AS (
  SELECT source_file, turn_index, role, next_role,
    string_agg({line}, chr(10)) OVER (PARTITION BY source_file ORDER BY turn_index) AS so_far,
    count(*) OVER (PARTITION BY source_file ORDER BY turn_index) AS n
  FROM near)
SELECT source_file, turn_index, length(prompt) AS prompt_chars, md5(prompt) AS prompt_md5
FROM (SELECT *, concat('System: Stay in role.', chr(10), so_far, chr(10), 'Civilian:') AS prompt
  FROM told) WHERE role = 'user' AND next_role = 'assistant'"""


LINE = "concat(CASE role WHEN 'user' THEN 'Officer: ' ELSE 'Civilian: ' END, content)"


def _prompted(spark, sf, compat):
    histories = H.dialogue_history(A.turns(spark, sf), "Stay in role.", compat)
    prompts = histories.withColumn("prompt", D.render_plain_prompt("history"))
    # The whole prompts are rendered; a digest keeps the comparison small.
    return prompts.select(
        "source_file",
        "turn_index",
        F.length("prompt").cast("bigint").alias("prompt_chars"),
        F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"),
    )


@query("render_plain_prompt", _prompts(LINE))
def render_plain_prompt(spark, sf):
    return _prompted(spark, sf, False)


@query(
    "render_plain_prompt_compat",
    _prompts(f"CASE WHEN role = 'assistant' AND previous_role = 'user' "
             f"THEN concat({LINE}, chr(10), {LINE}) ELSE {LINE} END"),
)
def render_plain_prompt_compat(spark, sf):
    return _prompted(spark, sf, True)


@query(
    "split_system_message",
    f"""WITH {TURNS}, told AS (
  SELECT source_file, turn_index, role, next_role, list({MESSAGE}) OVER (
    PARTITION BY source_file ORDER BY turn_index) AS messages FROM near)
SELECT source_file, turn_index, 'Stay in role.' AS system_text, CAST(len(messages) AS INT) AS n_messages,
  messages[1] AS first_message, md5(array_to_string(messages, chr(10))) AS messages_md5
FROM told WHERE role = 'user' AND next_role = 'assistant'""",
)
def split_system_message(spark, sf):
    system, rest = D.split_system_message("history")
    lines = F.transform(rest, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    histories = H.dialogue_history(A.turns(spark, sf), "Stay in role.")
    return histories.select("source_file", "turn_index", system.alias("system_text"), lines.alias("_m")).select(
        "source_file",
        "turn_index",
        "system_text",
        F.size("_m").alias("n_messages"),
        F.try_element_at("_m", F.lit(1)).alias("first_message"),
        F.md5(F.array_join("_m", "\n").cast("binary")).alias("messages_md5"),
    )


def _sql_list(values) -> str:
    return "[" + ", ".join(v if v == "NULL" else "'" + v.replace("\n", "'||chr(10)||'") + "'" for v in values) + "]"


def _clean_sql(profile: str) -> str:
    trim = lambda t: f"trim({t}, {WS})"
    text = trim("reply")
    if profile == "generation":
        text = trim(f"replace(regexp_replace({text}, '^```[^\\n]*\\n', ''), '```', '')")
    for marker in D.STOP_MARKERS[profile]:
        text = trim(f"split_part({text}, '{marker}', 1)")
    for prefix in D.SPEAKER_PREFIXES[profile]:
        text = trim(f"regexp_replace({text}, '^{prefix}', '', 'i')")
    return text


@query(
    "clean_reply",
    f"""WITH raw AS (
  SELECT conv_id, turn, concat({_sql_list([r[0] for r in A.RAW_REPLIES])}[(conv_id + turn) % 9 + 1],
    text, {_sql_list([r[1] for r in A.RAW_REPLIES])}[(conv_id + turn) % 9 + 1]) AS reply
  FROM conversations)
SELECT conv_id, turn, {_clean_sql('metric')} AS metric_reply,
  {_clean_sql('generation')} AS generation_reply FROM raw""",
)
def clean_reply(spark, sf):
    return A.raw_replies(spark, sf).select(
        "conv_id",
        "turn",
        D.clean_reply("reply", "metric").alias("metric_reply"),
        D.clean_reply("reply", "generation").alias("generation_reply"),
    )


@query(
    "clean_text",
    f"""SELECT conv_id, turn, trim(text, {WS}) AS text FROM conversations
UNION ALL SELECT conv_id, -1 - turn, ' ' FROM conversations WHERE turn % 4 = 0""",
)
def clean_text(spark, sf):
    """Every text with blanks around it; beside those of one turn in four, a blank or missing one."""
    turns = table(spark, sf, "conversations")
    blank = F.when(F.col("turn") % 8 == 0, F.lit(None).cast("string")).otherwise(" \n\t")
    padded = turns.select("conv_id", "turn", F.concat(F.lit(" "), "text", F.lit(" \n")).alias("text"))
    blanks = turns.filter("turn % 4 = 0").select("conv_id", -1 - F.col("turn"), blank)
    return padded.union(blanks).select("conv_id", "turn", D.clean_text(F.col("text")).alias("text"))


@query(
    "corpus_stats",
    """SELECT count(DISTINCT conv_id) AS n_files, count(*) AS n_turns,
  CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_words,
  CAST(round(sum(len(regexp_extract_all(text, '\\S+'))) * (4.7::DOUBLE / 3.6::DOUBLE)) AS BIGINT) AS n_tokens
FROM conversations""",
)
def corpus_stats(spark, sf):
    return M.corpus_stats(A.turns(spark, sf))


PREDICTIONS = f"""{TURNS},
models(model_name, model_family, model_type) AS (VALUES
  ('echo_base', 'echo', 'base'), ('echo_finetuned', 'echo', 'fine_tuned'),
  ('repeat_base', 'repeat', 'base')),
predictions AS MATERIALIZED (
  SELECT source_file, turn_index, model_name, model_family, model_type, content AS officer_input,
    next_text AS reference_response,
    CASE model_name WHEN 'echo_base' THEN content
      WHEN 'echo_finetuned' THEN array_to_string(
        string_split(next_text, ' ')[1:CAST(ceil(len(string_split(next_text, ' ')) / 2.0) AS BIGINT)], ' ')
      ELSE CASE WHEN previous_role = 'assistant' THEN previous_text ELSE '' END
    END AS predicted_response
  FROM points CROSS JOIN models)"""

# The longest common subsequence is the longest rising run of the places where words meet.
ROUGE = f"""
rouge_words AS (
  SELECT source_file, turn_index, model_name,
    regexp_extract_all(lower(predicted_response), '[a-z0-9]+') AS p,
    regexp_extract_all(lower(reference_response), '[a-z0-9]+') AS r
  FROM predictions),
meetings AS (
  SELECT *, flatten(list_transform(p, lambda w: list_reverse(
    list_filter(range(1, len(r) + 1), lambda k: r[k] = w)))) AS places
  FROM rouge_words),
rouge AS MATERIALIZED (
  SELECT source_file, turn_index, model_name,
    CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_reduce(places,
      lambda ends, k: list_concat(list_filter(ends, lambda e: e < k), [k],
        list_filter(ends, lambda e: e >= k)[2:]), []::BIGINT[])) / (len(p) + len(r)) END AS rouge_l
  FROM meetings)"""


def _spaced(expr: str, rules) -> str:
    for pattern, replacement in rules:
        sql = pattern.replace("'", "''")
        expr = f"regexp_replace({expr}, '{sql}', '{replacement}', 'g')"
    return expr


def _words(expr: str) -> str:
    return f"regexp_extract_all({expr}, '\\S+')"


def _bleu_words(c: str) -> str:
    text = f"replace(replace(replace({c}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for name, char in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{name}', '{char}')"
    rules = [
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    ]
    return _words(_spaced(f"concat(' ', {text}, ' ')", rules))


def _meteor_words(c: str) -> str:
    rules = [
        (r"([\[\](){}<>\"?!,;:@#$%&*]|\.\.\.)", r" \1 "),
        (r"([^.])\.(\s|$)", r"\1 . \2"),
        (r"(n't|'ll|'re|'ve|'s|'m|'d)(\s|$)", r" \1 \2"),
    ]
    return _words(_spaced(f"lower({c})", rules))


KEY = "source_file, turn_index, model_name"

BLEU = f"""
bleu_words AS (
  SELECT {KEY}, {_bleu_words('predicted_response')} AS p, {_bleu_words('reference_response')} AS r
  FROM predictions),
orders AS (SELECT unnest(range(1, 5)) AS n),
p_grams AS MATERIALIZED (
  SELECT {KEY}, n, gram, count(*) AS c FROM (
    SELECT {KEY}, n, unnest(list_transform(range(1, len(p) - n + 2),
      lambda i: array_to_string(p[i:i + n - 1], ' '))) AS gram
    FROM bleu_words CROSS JOIN orders) GROUP BY ALL),
r_grams AS MATERIALIZED (
  SELECT {KEY}, n, gram, count(*) AS c FROM (
    SELECT {KEY}, n, unnest(list_transform(range(1, len(r) - n + 2),
      lambda i: array_to_string(r[i:i + n - 1], ' '))) AS gram
    FROM bleu_words CROSS JOIN orders) GROUP BY ALL),
matched AS (
  SELECT {KEY}, n, sum(least(a.c, b.c)) AS m
  FROM p_grams a JOIN r_grams b USING ({KEY}, n, gram) GROUP BY ALL),
bleu AS MATERIALIZED (
  SELECT {KEY}, CASE WHEN any_value(len(p)) = 0 OR any_value(len(r)) = 0 THEN 0.0
    ELSE exp(avg(ln((coalesce(m, 0) + 1.0::DOUBLE) / (greatest(len(p) - n + 1, 0) + 1))))
      * any_value(CASE WHEN len(p) > len(r) THEN 1.0::DOUBLE
          ELSE exp(1.0::DOUBLE - len(r)::DOUBLE / greatest(len(p), 1)) END) END AS bleu_4
  FROM bleu_words CROSS JOIN orders LEFT JOIN matched USING ({KEY}, n) GROUP BY {KEY})"""

METEOR = f"""
meteor_words AS (
  SELECT {KEY}, {_meteor_words('predicted_response')} AS p,
    {_meteor_words('reference_response')} AS r
  FROM predictions),
p_words AS (
  SELECT {KEY}, w, i, row_number() OVER (PARTITION BY {KEY}, w ORDER BY i DESC) AS k
  FROM (SELECT {KEY}, unnest(p) AS w, unnest(range(1, len(p) + 1)) AS i FROM meteor_words)),
r_words AS (
  SELECT {KEY}, w, i AS j, row_number() OVER (PARTITION BY {KEY}, w ORDER BY i DESC) AS k
  FROM (SELECT {KEY}, unnest(r) AS w, unnest(range(1, len(r) + 1)) AS i FROM meteor_words)),
aligned AS (
  SELECT {KEY}, i, j, lag(i) OVER w AS pi, lag(j) OVER w AS pj
  FROM p_words JOIN r_words USING ({KEY}, w, k) WINDOW w AS (PARTITION BY {KEY} ORDER BY i)),
chunks AS (
  SELECT {KEY}, count(*)::DOUBLE AS m,
    count(*) FILTER (NOT coalesce(i = pi + 1 AND j = pj + 1, false)) AS c
  FROM aligned GROUP BY ALL),
meteor AS MATERIALIZED (
  SELECT {KEY}, coalesce((1 - 0.5::DOUBLE * power(c / m, 3)) * (m / len(p)) * (m / len(r))
    / (0.9::DOUBLE * (m / len(p)) + 0.1::DOUBLE * (m / len(r))), 0.0) AS meteor
  FROM meteor_words LEFT JOIN chunks USING ({KEY}))"""

# Words with the same first digit of their MD5 have the same unit vector: see HashEncoder.
ENCODED = f"""
sides AS (
  SELECT {KEY}, list_transform({_words('predicted_response')}, lambda w: md5(w)[1]) AS p,
    list_transform({_words('reference_response')}, lambda w: md5(w)[1]) AS r
  FROM predictions),
parts AS (
  SELECT {KEY}, CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0
      ELSE len(list_filter(p, lambda x: list_contains(r, x)))::DOUBLE / len(p) END AS p,
    CASE WHEN len(p) = 0 OR len(r) = 0 THEN 0.0
      ELSE len(list_filter(r, lambda x: list_contains(p, x)))::DOUBLE / len(r) END AS r
  FROM sides),
encoded AS MATERIALIZED (
  SELECT {KEY}, p AS precision, r AS recall,
    CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS embedding_f1 FROM parts)"""

SCORED = f"""{PREDICTIONS}, {ROUGE}, {BLEU}, {METEOR}, {ENCODED},
scored AS MATERIALIZED (
  SELECT * EXCLUDE (precision, recall) FROM predictions JOIN rouge USING ({KEY}) JOIN bleu USING ({KEY})
    JOIN meteor USING ({KEY}) JOIN encoded USING ({KEY}))"""


def _one_score(name: str, ctes: str) -> str:
    return f"WITH {PREDICTIONS}, {ctes} SELECT {KEY}, round({name}, 9) AS {name} FROM {name.split('_')[0]}"


def _keyed(spark, sf, name, score):
    return A.predictions(spark, sf).select(
        "source_file",
        "turn_index",
        "model_name",
        F.round(score("predicted_response", "reference_response"), 9).alias(name),
    )


@query(
    "predictions",
    f"""WITH {PREDICTIONS}, numbered AS (
  SELECT *, CAST(regexp_extract(source_file, '-?[0-9]+') AS BIGINT) AS conv_id FROM predictions)
SELECT * EXCLUDE (conv_id), CASE WHEN conv_id % 5 <> 0
    THEN CAST((conv_id * 7 + turn_index * 3 + length(model_name)) % 100 AS DOUBLE) / 100
  END AS embedding_f1
FROM numbered""",
)
def predictions(spark, sf):
    return A.with_given_f1(A.predictions(spark, sf))


@query("score_rouge_l", _one_score("rouge_l", ROUGE))
def score_rouge_l(spark, sf):
    return _keyed(spark, sf, "rouge_l", S.score_rouge_l)


@query("score_bleu4", _one_score("bleu_4", BLEU))
def score_bleu4(spark, sf):
    return _keyed(spark, sf, "bleu_4", S.score_bleu4)


@query("score_meteor", _one_score("meteor", METEOR))
def score_meteor(spark, sf):
    return _keyed(spark, sf, "meteor", S.score_meteor)


def _rounded(df, digits=6):
    return df.select(
        *[
            F.round(c, digits).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query(
    "score_predictions",
    f"""WITH {SCORED} SELECT {KEY}, round(rouge_l, 9) AS rouge_l, round(bleu_4, 9) AS bleu_4,
  round(meteor, 9) AS meteor, round(embedding_f1, 9) AS embedding_f1 FROM scored""",
)
def score_predictions(spark, sf):
    """All four metrics of every reply."""
    return _rounded(scored(spark, sf).select("source_file", "turn_index", "model_name", *_METRICS), 9)


@query(
    "score_embedding_f1",
    """WITH tokens AS (
  SELECT vec_id // 10 AS pair_id, CASE WHEN vec_id % 2 = 0 THEN 'pred' ELSE 'ref' END AS side,
    CAST(vec_id % 10 // 2 AS INT) AS pos, CAST(embedding AS DOUBLE[]) AS vec
  FROM embeddings WHERE NOT (vec_id // 10 % 9 = 4 AND vec_id % 2 = 1)),
cosines AS (
  SELECT p.pair_id, p.pos AS i, r.pos AS j, list_cosine_similarity(p.vec, r.vec) AS c
  FROM tokens p JOIN tokens r ON p.pair_id = r.pair_id AND p.side = 'pred' AND r.side = 'ref'),
parts AS (
  SELECT pair_id, coalesce((SELECT avg(b) FROM (SELECT max(c) AS b FROM cosines x
      WHERE x.pair_id = t.pair_id GROUP BY i)), 0.0) AS p,
    coalesce((SELECT avg(b) FROM (SELECT max(c) AS b FROM cosines x
      WHERE x.pair_id = t.pair_id GROUP BY j)), 0.0) AS r
  FROM (SELECT DISTINCT pair_id FROM tokens) t)
SELECT pair_id, CASE WHEN pair_id % 2 = 0 THEN 'echo_base' ELSE 'echo_finetuned' END AS model_name, round(p, 6) AS precision, round(r, 6) AS recall,
  round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM parts""",
)
def score_embedding_f1(spark, sf):
    return _rounded(S.embedding_f1(A.token_vectors(spark, sf)))


@query(
    "score_encoded_f1",
    f"""WITH {PREDICTIONS}, {ENCODED} SELECT {KEY}, round(precision, 9) AS precision, round(recall, 9) AS recall,
  round(embedding_f1, 9) AS f1 FROM encoded""",
)
def score_encoded_f1(spark, sf):
    scores = S.score_encoded_f1("predicted_response", "reference_response")
    scored = A.predictions(spark, sf).select("source_file", "turn_index", "model_name", scores.alias("_s"))
    return _rounded(scored.select("source_file", "turn_index", "model_name", "_s.*"), 9)


_METRICS = ["rouge_l", "bleu_4", "meteor", "embedding_f1"]
_AVG = ", ".join(f"round(avg({m}), 6) AS avg_{m}" for m in _METRICS)
_STD = ", ".join(f"round(stddev_samp({m}), 6) AS std_{m}" for m in _METRICS)


def scored(spark, sf):
    return S.score_predictions(A.predictions(spark, sf), S.HashEncoder)


@query(
    "metric_model_summary",
    f"""WITH {SCORED} SELECT model_name, model_family, model_type, count(turn_index) AS n_turns,
  {_AVG}, {_STD} FROM scored GROUP BY ALL""",
)
def metric_model_summary(spark, sf):
    return _rounded(M.metric_model_summary(scored(spark, sf)))


@query(
    "metric_file_summary",
    f"""WITH {SCORED} SELECT source_file, model_name, model_family, model_type,
  count(turn_index) AS n_turns, {_AVG} FROM scored GROUP BY ALL""",
)
def metric_file_summary(spark, sf):
    return _rounded(M.metric_file_summary(scored(spark, sf)))


_WIDE = " UNION ALL ".join(
    f"""SELECT model_family, '{m}' AS metric, round(avg({m}) FILTER (model_type = 'base'), 6) AS base,
  round(avg({m}) FILTER (model_type = 'fine_tuned'), 6) AS fine_tuned,
  round(avg({m}) FILTER (model_type = 'fine_tuned') - avg({m}) FILTER (model_type = 'base'), 6) AS delta
FROM scored GROUP BY model_family"""
    for m in _METRICS
)


@query("base_vs_finetuned", f"WITH {SCORED} {_WIDE}")
def base_vs_finetuned(spark, sf):
    return _rounded(M.base_vs_finetuned(scored(spark, sf)))
