import json

import numpy as np

from turnmill.operators import generation as G
from turnmill.operators import hooks as H
from turnmill.operators import judging as J
from turnmill.operators import scenarios as C
from turnmill.operators import scoring as S
from turnmill.operators import summaries as M
from turnmill.operators.models import (
    ModelSpec,
    case_model_grid,
    default_specs,
    select_models,
    skip_unconfigured,
)

CASES = [
    {"case_id": "x", "scenario_context": " s ", "character_profile": {"a": 1}, "police_dialogue": ["Hi ", "", "Go"]},
    {"id": 12, "context": "c", "scenario": "", "profile": "p",
     "police_dialog": [{"text": "", "transcript": "t"}, {"utterance": "u"}, 5, {}]},
    {"case_id": 0, "character_profile": None, "officer_turns": "no list"},
    {"character_profile": [], "suspect_profile": "sp", "police_dialogue": [], "officer_dialogue": [" "]},
]


def cases(spark):
    rows = [(i, json.dumps(c)) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "pos int, j string").selectExpr("pos", "parse_json(j) as case")
    return C.normalize_cases(df)


def test_cases(spark):
    got = {r.case_id: r for r in cases(spark).collect()}
    assert set(got) == {"x", "12", "case_0003", "case_0004"}
    assert (got["x"].scenario_context, got["x"].character_profile) == ("s", '{"a":1}')
    assert got["x"].police_turns == ["Hi", "Go"]
    assert (got["12"].scenario_context, got["12"].police_turns) == ("c", ["t", "u", "5"])
    assert got["case_0003"].error == "police_dialogue must be a list."
    assert got["case_0004"].error == "No police dialogue found for case_id=case_0004"
    assert got["case_0004"].character_profile == "sp"


def test_system_prompt_does_not_fill_twice(spark):
    df = spark.createDataFrame([("{character_profile}", "p")], "c string, p string")
    prompt = C.render_system_prompt("c", "p", "A {scenario_context} B {character_profile}.")
    assert df.select(prompt).first()[0] == "A {character_profile} B p."


def test_generation_feeds_replies_back(spark):
    class Fails:
        def generate(self, *a, **k):
            raise RuntimeError("down")

    def factory(spec):
        return Fails() if spec["model_name"] == "bad" else G.builtin_factory(spec)

    specs = [ModelSpec("echo", "e", "base"), ModelSpec("bad", "b", "api")]
    got = {(r.case_id, r.model_name): r for r in G.generate_conversations(cases(spark), specs, factory).collect()}
    assert len(got) == 8
    assert got["x", "echo"].conversation_transcript == (
        "Officer: Hi\nCivilian: 2 Hi\nOfficer: Go\nCivilian: 4 Go"
    )
    assert got["x", "bad"].error == "down" and got["x", "bad"].generated_conversation is None
    assert got["case_0003", "echo"].error == "police_dialogue must be a list."


def test_model_registry(spark):
    specs = default_specs({"qwen_base": "/m/q"})
    assert len(specs) == 15
    assert [s.model_name for s in skip_unconfigured(specs)] == ["qwen_base", "gemini_2_5_flash"]
    assert [s.model_name for s in select_models(specs, ["falcon_base", "qwen_base"])] == ["qwen_base", "falcon_base"]
    grid = case_model_grid(spark.range(3), specs)
    assert grid.count() == 45 and "Join" not in grid._jdf.queryExecution().toString()


def test_only_failed_items_are_asked_again():
    calls = []

    def one(item):
        calls.append(item)
        if item == "bad" or (item == "late" and calls.count("late") < 3):
            raise ValueError(item)
        return item.upper()

    found = H.ask_all(["a", "late", "bad"], one, tries=3)
    assert found[:2] == ["A", "LATE"] and str(found[2]) == "bad"
    assert calls == ["a", "late", "bad", "late", "bad", "late", "bad"]
    assert H.ask_all([], one) == []


def test_lists_go_to_hooks_that_take_them():
    sizes, singles = [], []

    def many(items):
        sizes.append(len(items))
        if "poison" in items:
            raise RuntimeError("whole call")
        return [ValueError("no") if i == "bad" and len(sizes) == 1 else i.upper() for i in items]

    def one(item):
        singles.append(item)
        if item == "poison":
            raise RuntimeError(item)
        return item.upper()

    assert H.ask_all(["a", "bad", "c"], one, many, tries=2) == ["A", "BAD", "C"]
    assert (sizes, singles) == ([3, 1], [])
    found = H.ask_all(["a", "poison"], one, many)
    assert found[0] == "A" and str(found[1]) == "poison" and singles == ["a", "poison"]
    # A call that gives too few answers is not trusted.
    assert H.ask_all(["a", "b"], one, lambda items: ["only one"]) == ["A", "B"]


def test_batches_give_what_single_calls_give(spark):
    class Lists(G.EchoGenerator):
        def generate_batch(self, histories, **sampling):
            assert len(histories) <= 2
            return [self.generate(h, **sampling) if len(h) < 4 else ValueError("long") for h in histories]

    class Single(G.EchoGenerator):
        def generate(self, history, **sampling):
            if len(history) >= 4:
                raise ValueError("long")
            return super().generate(history, **sampling)

    specs = [ModelSpec("m1", "f", "base"), ModelSpec("m2", "f", "base")]
    run = lambda hook, **kw: sorted(
        map(str, G.generate_conversations(cases(spark), specs, lambda spec: hook(), **kw).collect())
    )
    assert run(Lists, batch_size=2) == run(Single, batch_size=1) == run(Single)
    turns = spark.range(60).selectExpr(
        "concat('c', id % 7) as source_file", "cast(id div 7 as int) as turn_index",
        "if((id div 7) % 2 = 0, 'Officer', 'Civ') as speaker_label", "concat('t', id) as transcript",
    )
    ask = lambda hook, **kw: sorted(
        map(str, G.predict_replies(turns, specs, lambda spec: hook(), **kw).collect())
    )
    assert ask(Lists, batch_size=2) == ask(Single, batch_size=1) == ask(Single, segment_turns=2, segments=3)
    assert len(ask(Single)) == 2 * sum(i % 2 == 0 and 7 * (i + 1) + c < 60 for c in range(7) for i in range(9))


def test_judge_pairs(spark):
    df = spark.sql(
        "select 'c' as case_id, map('m1', named_struct('target_conversation', 't', 'conversation_transcript', 'u')) "
        "as model_outputs union all select 'd', map()"
    )
    assert [(r.case_id, r.model_name, r.target_conversation) for r in J.case_model_pairs(df, ["m1", "m2"]).collect()] == [
        ("c", "m1", "t")
    ]
    missing = sorted(tuple(r) for r in J.skipped_pairs(df, ["m1", "m2"]).collect())
    assert missing == [("c", "m2"), ("d", "m1"), ("d", "m2")]


def test_prompt_fills_in_order(spark):
    df = spark.createDataFrame([("see {b}", "B {a}", None)], "a string, b string, c string")
    got = df.select(J.render_prompt("{a}|{b}|{c}", {"a": "a", "b": "b", "c": "c"})).first()[0]
    assert got == "see B {a}|B {a}|"


def test_verdicts(spark):
    good = '{"outcome_category":"Containment","base_score":40,"penalty_applied":"Both","final_score":5}'
    raws = [
        ("plain", '{"Score": 85, "look_Real": 1}'),
        ("fenced", '```json\n{"Score": "50.5", "look_Real": 1}\n```'),
        ("fence", '```\n{"Score": 51, "look_Real": 0}```'),
        ("wrapped", 'So: {"Score": 50, "look_Real": 0} ok'),
        ("none", "nothing"),
        ("broken", "{broken}"),
        ("list", "[1]"),
        ("null", None),
        ("noscore", '{"Score": null}'),
    ]
    df = spark.createDataFrame([(c, "m", r, good) for c, r in raws],
                               "case_id string, model_name string, realism_raw string, deescalation_raw string")
    flat = J.outcome_check(J.realism_check(J.flatten_judge(df)))
    got = {r.case_id: r for r in flat.collect()}
    assert [got[c].realism_score for c, _ in raws] == [85.0, 50.5, 51.0, 50.0, None, None, None, None, None]
    assert [got[c].realism_tier for c, _ in raws[:4]] == ["High Realism", "Marginal", "Marginal", "Artificial"]
    assert [got[c].look_real_ok for c, _ in raws[:4]] == [True, False, True, True]
    assert got["none"].error.startswith("Could not find") and got["null"].error == "Empty judge response."
    assert got["broken"].error and got["list"].error and got["noscore"].error is None
    assert got["none"].deescalation_final_score is None
    assert (got["plain"].expected_outcome, got["plain"].expected_final_score) == ("Containment", 5.0)
    assert got["plain"].final_score_ok and got["plain"].outcome_ok
    summary = M.judge_model_summary(flat).first()
    assert (summary.n_cases, summary.n_errors) == (9, 4)


def test_run_judge_reports_failures(spark):
    class Flaky:
        def judge(self, prompt):
            if "bad" in prompt:
                raise ValueError("no")
            return '{"Score": 1}'

    df = spark.createDataFrame(
        [("a", "ok"), ("b", "bad")], "case_id string, target_conversation string"
    ).selectExpr(
        "case_id", "'m' as model_name", "'' as scenario_context", "'' as profile",
        "'' as ground_truth", "target_conversation", "target_conversation as conversation_transcript",
    )
    flat = {r.case_id: r for r in J.flatten_judge(J.run_judge(df, Flaky, tries=2, wait_seconds=0)).collect()}
    assert flat["a"].realism_score == 1.0
    assert flat["b"].error == "Judge failed after 2 attempts: no"


def vectors(spark, pairs, seed=3):
    draw, rows = np.random.default_rng(seed), []
    for pair, (n, m) in pairs.items():
        for side, k in (("pred", n), ("ref", m)):
            rows += [(pair, "m", side, i, draw.normal(size=4).tolist()) for i in range(k)]
    return rows


def test_embedding_f1_against_matrix(spark):
    rows = vectors(spark, {1: (7, 5), 2: (1, 9), 3: (4, 0), 4: (0, 2)})
    rows.append((1, "m", "pred", 7, [0.0] * 4))
    df = spark.createDataFrame(rows, "pair_id long, model_name string, side string, pos int, vec array<float>")
    for block in (2, 128):
        got = {r.pair_id: r for r in S.embedding_f1(df, block).collect()}
        assert set(got) == {1, 2, 3, 4}
        for pair in (1, 2):
            side = lambda s: np.array([r[4] for r in rows if r[0] == pair and r[2] == s], dtype="float32").astype(float)
            unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)
            cos = unit(side("pred")) @ unit(side("ref")).T
            p, r = cos.max(axis=1).mean(), cos.max(axis=0).mean()
            assert np.allclose([got[pair].precision, got[pair].recall, got[pair].f1], [p, r, 2 * p * r / (p + r)])
        assert (got[3].f1, got[4].f1) == (0.0, 0.0)
    same = spark.createDataFrame(
        [(1, "m", s, i, [1.0, float(i)]) for s in ("pred", "ref") for i in range(3)],
        "pair_id long, model_name string, side string, pos int, vec array<float>",
    )
    assert abs(S.embedding_f1(same).first().f1 - 1.0) < 1e-12


def test_pair_f1_does_not_depend_on_blocks():
    draw = np.random.default_rng(4)
    pred, ref = draw.normal(size=(23, 4)).tolist(), draw.normal(size=(17, 4)).tolist()
    assert np.allclose(S._pair_f1(pred, ref, 5), S._pair_f1(pred, ref))


def test_failed_predictions_are_not_scored(spark):
    df = spark.createDataFrame(
        [("a b", "a b", None), (None, "a b", "down"), ("", "x", None)],
        "predicted_response string, reference_response string, error string",
    )
    got = [(r.rouge_l, r.meteor) for r in S.score_predictions(df).collect()]
    assert got[0][0] == 1.0 and got[1] == (None, None) and got[2] == (0.0, 0.0)


def test_summaries(spark):
    rows = [
        ("f1", 0, "m1", "ministral", "base", 0.2), ("f1", 2, "m1", "ministral", "base", 0.4),
        ("f1", 0, "m2", "mistral", "fine_tuned", 0.8), ("f2", 0, "m3", None, "api", None),
    ]
    df = spark.createDataFrame(
        rows, "source_file string, turn_index int, model_name string, model_family string, "
        "model_type string, rouge_l double",
    ).selectExpr("*", "rouge_l as bleu_4", "rouge_l as meteor", "rouge_l as embedding_f1")
    got = M.metric_model_summary(df).collect()
    assert [r.model_name for r in got] == ["m2", "m1", "m3"]
    assert got[0].std_rouge_l is None and abs(got[1].std_rouge_l - 0.2 / 2**0.5) < 1e-12
    assert got[2].model_family is None and got[2].n_turns == 1
    delta = {(r.model_family, r.metric): r.delta for r in M.base_vs_finetuned(df).collect()}
    assert abs(delta["mistral", "rouge_l"] - 0.5) < 1e-12
    assert [r.n_turns for r in M.metric_file_summary(df).collect()] == [2, 1, 1]


def test_run_judge_makes_texts_of_one_call_at_a_time(spark):
    class Even:
        def judge(self, prompt):
            return str(len(prompt))

    rows = [(f"c{i}", "m", "s", "p", "g", "t" * i, None if i == 5 else "u") for i in range(70)]
    df = spark.createDataFrame(rows, "case_id string, model_name string, scenario_context string, profile string, "
                               "ground_truth string, target_conversation string, conversation_transcript string").coalesce(1)
    judged = J.run_judge(df, Even, batch_size=32)
    assert "MapInArrow" in judged._jdf.queryExecution().analyzed().toString()
    got = {r.case_id: int(r.realism_raw) for r in judged.collect()}
    assert len(got) == 70 and all(got[f"c{i}"] == got["c0"] + i for i in range(70))
