"""Scenario, generation and judge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnmill.functions.json import variant_kind
from turnmill.operators import generation as G
from turnmill.operators import judging as J
from turnmill.operators import scenarios as C
from turnmill.operators import summaries as M
from turnmill.operators.models import case_model_grid, default_specs, select_models, skip_unconfigured
from turnmill.plans import adapters as A
from turnmill.plans.dialogue import SCORED, TURNS, WS, _rounded, scored
from turnmill.plans.registry import query

# conv_id decides the spelling of a case: see adapters.scenario_cases.
CASES = f"""users AS (
  SELECT conv_id, turn // 64 AS block, turn, text FROM conversations WHERE role = 'user'),
heads AS (
  SELECT DISTINCT conv_id, block, bad FROM users CROSS JOIN (VALUES (false), (true)) b(bad)
  WHERE NOT bad OR conv_id % 11 = 10),
cases AS (
  SELECT conv_id, block, bad,
    CASE WHEN bad THEN concat('bad_', conv_id, '_', block) ELSE
    CASE conv_id % 5 WHEN 0 THEN concat('c', conv_id, '_', block)
      WHEN 1 THEN CAST(conv_id AS VARCHAR)
      ELSE concat('case_', lpad(CAST(conv_id + 1 AS VARCHAR),
        CAST(greatest(4, length(CAST(conv_id + 1 AS VARCHAR))) AS INT), '0')) END END AS case_id,
    CASE conv_id % 5 WHEN 0 THEN 'a street' WHEN 1 THEN 'a shop' WHEN 2 THEN 'a park'
      ELSE '' END AS scenario_context,
    CASE conv_id % 5 WHEN 0 THEN '{{"age":30,"mood":"calm"}}' WHEN 1 THEN 'angry'
      WHEN 2 THEN 'tired' WHEN 3 THEN '["a","b"]' ELSE '' END AS character_profile,
    CASE WHEN bad THEN 'police_dialogue must be a list.' END AS error
  FROM heads),
said AS (
  SELECT conv_id, block, false AS bad, CAST(row_number() OVER w - 1 AS INT) AS turn_index,
    trim(text, {WS}) AS police
  FROM users WINDOW w AS (PARTITION BY conv_id, block ORDER BY turn))"""


def cases(spark, sf):
    return C.normalize_cases(A.scenario_cases(spark, sf))


@query(
    "coalesce_fields",
    f"WITH {CASES} SELECT case_id, scenario_context, character_profile, error FROM cases",
)
def coalesce_fields(spark, sf):
    return cases(spark, sf).drop("police_turns")


@query("case_id", f"WITH {CASES} SELECT conv_id AS pos, case_id FROM cases")
def case_id(spark, sf):
    raw = A.scenario_cases(spark, sf)
    return raw.select(
        F.col("pos").cast("bigint").alias("pos"),
        C.case_id(F.col("case"), F.col("pos")).alias("case_id"),
    )


@query(
    "police_turns",
    f"WITH {CASES} SELECT case_id, turn_index, police FROM cases JOIN said USING (conv_id, block, bad)",
)
def police_turns(spark, sf):
    return cases(spark, sf).select(
        "case_id", F.posexplode("police_turns").alias("turn_index", "police")
    )


@query(
    "render_system_prompt",
    f"""WITH {CASES} SELECT case_id, concat('Scene: ', scenario_context, ' Who: ', character_profile, '.')
  AS prompt FROM cases""",
)
def render_system_prompt(spark, sf):
    template = "Scene: {scenario_context} Who: {character_profile}."
    prompt = C.render_system_prompt("scenario_context", "character_profile", template)
    return cases(spark, sf).select("case_id", prompt.alias("prompt"))


MODELS = """models(model_name, model_family, model_type) AS (VALUES
  ('echo_base', 'echo', 'base'), ('echo_finetuned', 'echo', 'fine_tuned'),
  ('repeat_base', 'repeat', 'base'))"""


@query(
    "case_model_grid",
    f"""WITH {CASES}, {MODELS} SELECT case_id, model_name, model_family, model_type
FROM cases CROSS JOIN models""",
)
def case_model_grid_(spark, sf):
    return case_model_grid(cases(spark, sf).select("case_id"), A.BASELINES).drop(
        "backend", "model_path"
    )


@query(
    "select_models",
    f"""WITH {CASES}, chosen(model_name) AS (VALUES ('qwen_finetuned'), ('gemini_2_5_flash'))
SELECT case_id, model_name FROM cases CROSS JOIN chosen""",
)
def select_models_(spark, sf):
    specs = default_specs({"qwen_finetuned": "/models/qwen"})
    chosen = select_models(specs, ["gemini_2_5_flash", "qwen_finetuned", "llama_base"])
    return case_model_grid(cases(spark, sf).select("case_id"), skip_unconfigured(chosen)).select(
        "case_id", "model_name"
    )


GENERATED = f"""{CASES}, {MODELS},
generated AS (
  SELECT case_id, model_name, turn_index, police,
    CASE WHEN model_name = 'repeat_base' THEN ''
      ELSE concat(2 * turn_index + 2, ' ', police) END AS civilian_generated
  FROM cases JOIN said USING (conv_id, block, bad) CROSS JOIN models)"""


@query("generate_conversations", f"WITH {GENERATED} SELECT * FROM generated")
def generate_conversations(spark, sf):
    return G.generation_lines(G.generate_conversations(cases(spark, sf), A.BASELINES))


@query(
    "build_transcript",
    f"""WITH {GENERATED}, told AS (
  SELECT case_id, model_name, string_agg(concat('Officer: ', police, chr(10), 'Civilian: ',
    civilian_generated), chr(10) ORDER BY turn_index) AS conversation_transcript
  FROM generated GROUP BY ALL)
SELECT c.case_id, m.model_name, c.error, conversation_transcript
FROM cases c CROSS JOIN models m LEFT JOIN told t
  ON c.case_id = t.case_id AND m.model_name = t.model_name""",
)
def build_transcript(spark, sf):
    return G.generate_conversations(cases(spark, sf), A.BASELINES).select(
        "case_id", "model_name", "error", "conversation_transcript"
    )


REPLIES = f"""WITH {TURNS}, {MODELS}, told AS (
  SELECT *, count(*) OVER (PARTITION BY source_file ORDER BY turn_index) AS n,
    arg_max(content, turn_index) FILTER (role = 'assistant')
      OVER (PARTITION BY source_file ORDER BY turn_index) AS last_reply
  FROM near)
SELECT source_file, turn_index, model_name,
  CASE WHEN model_name = 'repeat_base' THEN coalesce(last_reply, '')
    ELSE concat(n + 1, ' ', content) END AS predicted_response, CAST(NULL AS VARCHAR) AS error
FROM told CROSS JOIN models WHERE role = 'user' AND next_role = 'assistant'"""
REPLY = ["source_file", "turn_index", "model_name", "predicted_response", "error"]


@query("predict_replies", REPLIES)
def predict_replies(spark, sf):
    """Replies to whole histories."""
    return G.predict_replies(A.turns(spark, sf), A.BASELINES).select(*REPLY)


@query("predict_folded", REPLIES)
def predict_folded(spark, sf):
    """The same replies from folds of the histories."""
    return G.predict_folded(A.turns(spark, sf), A.BASELINES, G.BASELINE_FOLDS).select(*REPLY)


BLOCKS = """blocks AS (
  SELECT conv_id, turn // 64 AS block,
    string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS text
  FROM conversations GROUP BY ALL)"""
JUDGED_CASES = f"""{BLOCKS},
outputs AS (
  SELECT concat(conv_id, '_', block) AS case_id, model_name, concat('Scene {{profile}} ', conv_id) AS scenario_context,
    concat('Profile ', conv_id % 4) AS profile, text AS ground_truth,
    concat(model_name, ' ', text) AS target_conversation,
    CASE WHEN conv_id % 3 = m THEN concat(model_name, ' ', text) ELSE concat('T ', text) END
      AS conversation_transcript, (conv_id + m) % 6 <> 0 AS present
  FROM blocks CROSS JOIN (VALUES (0, 'echo_base'), (1, 'echo_finetuned'), (2, 'repeat_base')) t(m, model_name))"""
SELECTED = ["echo_base", "repeat_base"]


@query(
    "case_model_pairs",
    f"""WITH {JUDGED_CASES} SELECT case_id, scenario_context, profile, ground_truth, model_name,
  target_conversation, conversation_transcript
FROM outputs WHERE present AND model_name IN ('echo_base', 'repeat_base')""",
)
def case_model_pairs(spark, sf):
    return J.case_model_pairs(A.judge_cases(spark, sf), SELECTED)


@query(
    "skipped_pairs",
    f"""WITH {JUDGED_CASES} SELECT case_id, model_name FROM outputs
WHERE NOT present AND model_name IN ('echo_base', 'repeat_base')""",
)
def skipped_pairs(spark, sf):
    return J.skipped_pairs(A.judge_cases(spark, sf), SELECTED)


@query(
    "render_judge_prompt",
    f"""WITH {JUDGED_CASES} SELECT case_id, model_name,
  concat('C ', replace(scenario_context, '{{profile}}', profile), ' P ', profile, ' T ',
    target_conversation) AS prompt
FROM outputs WHERE present""",
)
def render_judge_prompt(spark, sf):
    pairs = J.case_model_pairs(A.judge_cases(spark, sf), [m.model_name for m in A.BASELINES])
    names = ["scenario_context", "profile", "target_conversation"]
    template = "C {scenario_context} P {profile} T {target_conversation}"
    return pairs.select(
        "case_id",
        "model_name",
        J.render_prompt(template, {n: n for n in names}).alias("prompt"),
    )


VERDICTS = f"""{BLOCKS},
answers AS (
  SELECT concat(conv_id, '_', block, CASE WHEN ok THEN '' ELSE '_broken' END) AS case_id,
    conv_id AS i, m, model_name, ok, text, (length(text) * 37 + m * 11) % 101 AS score,
    (length(text) * 13 + m * 29) % 101 AS base,
    CASE conv_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 20 ELSE 35 END AS points,
    CASE conv_id % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Repetitive Looping'
      WHEN 2 THEN 'Unrealistic Dialogue' ELSE 'Both' END AS penalty
  FROM blocks CROSS JOIN
    (VALUES (0, 'echo_base'), (1, 'echo_finetuned'), (2, 'repeat_base')) t(m, model_name)
  CROSS JOIN (VALUES (true), (false)) u(ok)
  WHERE ok OR conv_id % 6 = 3),
flat AS (
  SELECT case_id, model_name,
    CASE WHEN ok THEN CAST(score AS DOUBLE) END AS realism_score,
    CASE WHEN ok THEN CASE WHEN i % 10 = 0 OR score >= 85 THEN 1.0::DOUBLE ELSE 0.0 END END AS look_real,
    CASE WHEN ok THEN CAST(CASE WHEN i % 9 = 0 THEN base ELSE greatest(base - points, 0) END AS DOUBLE) END
      AS deescalation_final_score,
    CASE WHEN ok THEN CAST(base AS DOUBLE) END AS deescalation_base_score,
    CASE WHEN ok THEN CASE WHEN i % 7 = 0 THEN 'Containment' ELSE band END END
      AS deescalation_outcome_category,
    CASE WHEN ok THEN penalty END AS deescalation_penalty_applied,
    CASE WHEN ok THEN NULL WHEN i % 12 = 3 THEN 'Could not find JSON object in response.'
      ELSE 'Broken JSON in response.' END AS error, band, points
  FROM (SELECT *, CASE WHEN base <= 25 THEN 'Escalation' WHEN base <= 50 THEN 'Containment'
        WHEN base <= 75 THEN 'De-escalation' ELSE 'Resolution' END AS band FROM answers))"""


def flat(spark, sf):
    return J.flatten_judge(A.verdicts(spark, sf)).drop("realism_result", "deescalation_result")


@query("flatten_judge", f"WITH {VERDICTS} SELECT * EXCLUDE (band, points) FROM flat")
def flatten_judge(spark, sf):
    return flat(spark, sf)


@query(
    "parse_judge_json",
    f"""WITH {VERDICTS} SELECT case_id, model_name, CASE WHEN ok THEN 'OBJECT' END AS kind,
  CASE WHEN ok THEN CAST(score AS VARCHAR) END AS score, CASE WHEN ok THEN text END AS quote
FROM answers""",
)
def parse_judge_json(spark, sf):
    parsed = A.verdicts(spark, sf).withColumn("v", J.parse_judge_json("realism_raw"))
    return parsed.select(
        "case_id",
        "model_name",
        variant_kind(F.col("v")).alias("kind"),
        F.try_variant_get("v", "$.Score", "string").alias("score"),
        F.try_variant_get("v", "$.analysis.quote", "string").alias("quote"),
    )


@query(
    "realism_tier",
    f"""WITH {VERDICTS} SELECT case_id, model_name, realism_score,
  CASE WHEN realism_score >= 85 THEN 'High Realism' WHEN realism_score > 50 THEN 'Marginal'
    WHEN realism_score IS NOT NULL THEN 'Artificial' END AS realism_tier,
  (realism_score >= 85) = (look_real = 1) AS look_real_ok
FROM flat""",
)
def realism_tier(spark, sf):
    return J.realism_check(flat(spark, sf)).select(
        "case_id", "model_name", "realism_score", "realism_tier", "look_real_ok"
    )


@query(
    "outcome_check",
    f"""WITH {VERDICTS} SELECT case_id, model_name,
  CASE WHEN error IS NULL THEN band END AS expected_outcome,
  CASE WHEN error IS NULL THEN greatest(deescalation_base_score - points, 0.0) END AS expected_final_score,
  deescalation_outcome_category = band AS outcome_ok,
  deescalation_final_score = greatest(deescalation_base_score - points, 0.0) AS final_score_ok
FROM flat""",
)
def outcome_check(spark, sf):
    return J.outcome_check(flat(spark, sf)).select(
        "case_id", "model_name", "expected_outcome", "expected_final_score", "outcome_ok",
        "final_score_ok",
    )


JUDGE_SUMMARY = """judge_summary AS (
  SELECT model_name, round(avg(realism_score), 6) AS avg_realism_score,
    round(avg(look_real), 6) AS avg_look_real,
    round(avg(deescalation_final_score), 6) AS avg_deescalation_score,
    count(case_id) AS n_cases, count(error) AS n_errors
  FROM flat GROUP BY model_name)"""


@query("judge_model_summary", f"WITH {VERDICTS}, {JUDGE_SUMMARY} SELECT * FROM judge_summary")
def judge_model_summary(spark, sf):
    return _rounded(M.judge_model_summary(flat(spark, sf)))


@query(
    "metric_vs_judge",
    f"""WITH {SCORED}, {VERDICTS}, {JUDGE_SUMMARY},
metric_summary AS (
  SELECT model_name, round(avg(rouge_l), 6) AS avg_rouge_l, round(avg(bleu_4), 6) AS avg_bleu_4,
    round(avg(meteor), 6) AS avg_meteor, round(avg(embedding_f1), 6) AS avg_embedding_f1
  FROM scored GROUP BY model_name)
SELECT model_name, avg_rouge_l, avg_bleu_4, avg_meteor, avg_embedding_f1, avg_realism_score,
  avg_look_real, avg_deescalation_score
FROM metric_summary FULL JOIN judge_summary USING (model_name)""",
)
def metric_vs_judge(spark, sf):
    metrics = M.metric_model_summary(scored(spark, sf))
    return _rounded(M.metric_vs_judge(metrics, M.judge_model_summary(flat(spark, sf))))


class LengthJudge:
    """Baseline judge: scores follow from the length of the prompt."""

    def judge(self, prompt: str) -> str:
        n = len(prompt)
        return (
            f'{{"Score": {n % 101}, "look_Real": {n % 2}, "final_score": {n % 97}, '
            f'"base_score": {n % 89}, "outcome_category": "Containment", "penalty_applied": "None"}}'
        )


def _filled_length(template: str, names: list[str]) -> str:
    plain = template
    for n in names:
        plain = plain.replace("{" + n + "}", "")
    return " + ".join([str(len(plain)), *[f"length({n})" for n in names]])


_REALISM = _filled_length(
    J.REALISM_PROMPT, ["scenario_context", "profile", "ground_truth", "target_conversation"]
)
_OUTCOME = _filled_length(J.DEESCALATION_PROMPT, ["conversation_transcript"])


@query(
    "run_judge",
    f"""WITH {JUDGED_CASES}, sized AS (
  SELECT case_id, model_name,
    {_REALISM} - length('{{profile}}') + length(profile) AS r, {_OUTCOME} AS d
  FROM outputs WHERE present)
SELECT case_id, model_name, CAST(r % 101 AS DOUBLE) AS realism_score,
  CAST(r % 2 AS DOUBLE) AS look_real, CAST(d % 97 AS DOUBLE) AS deescalation_final_score,
  CAST(d % 89 AS DOUBLE) AS deescalation_base_score,
  'Containment' AS deescalation_outcome_category, 'None' AS deescalation_penalty_applied,
  CAST(NULL AS VARCHAR) AS error
FROM sized""",
)
def run_judge(spark, sf):
    pairs = J.case_model_pairs(A.judge_cases(spark, sf), [m.model_name for m in A.BASELINES])
    return J.flatten_judge(J.run_judge(pairs, LengthJudge)).drop(
        "realism_result", "deescalation_result"
    )


@query(
    "replay_judge",
    f"""WITH {VERDICTS} SELECT c.case_id, t.model_name, f.realism_score,
  CASE WHEN f.case_id IS NULL THEN 'Empty judge response.' ELSE f.error END AS error
FROM (SELECT DISTINCT case_id FROM answers) c
CROSS JOIN (VALUES ('echo_base'), ('echo_finetuned'), ('repeat_base'), ('unseen_model')) t(model_name)
LEFT JOIN flat f ON f.case_id = c.case_id AND f.model_name = t.model_name""",
)
def replay_judge(spark, sf):
    recorded = A.verdicts(spark, sf)
    names = [*[m.model_name for m in A.BASELINES], "unseen_model"]
    wanted = recorded.select("case_id").distinct().select(
        "case_id", F.explode(F.array(*[F.lit(n) for n in names])).alias("model_name")
    )
    return J.flatten_judge(J.replay_judge(wanted, recorded)).select(
        "case_id", "model_name", "realism_score", "error"
    )
