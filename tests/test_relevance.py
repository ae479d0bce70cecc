from turnmill.operators import relevance as R

SCHEMA = (
    "id int, no_police_presence string, advertisement_content_detected string, "
    "police_presence_signals_score int, interaction_type_signals_score int, "
    "deescalation_indicators_score int, escalation_indicators_score int"
)
ROWS = [
    (1, "0", "0", 2, 2, 1, 6),
    (2, "1", "0", 6, 6, 6, 0),
    (3, "1", "1", 0, 0, 0, 0),
    (4, "0", "0", 1, 2, 1, 0),
    (5, None, "x", 1, None, 0, 0),
    (6, "2", "1.0", 2, 2, 1, 5),
]


def verdicts(spark, **options):
    df = spark.createDataFrame(ROWS, SCHEMA)
    return {r.id: r for r in R.filter_verdicts(df, **options).collect()}


def test_stages_and_reasons(spark):
    v = verdicts(spark)
    assert {i: r.stage for i, r in v.items()} == {1: None, 2: 1, 3: 1, 4: 2, 5: 2, 6: None}
    assert v[1].rejection_reason == ""
    assert v[3].rejection_reason == (
        "[Stage 1 – context filter] flags triggered: "
        "no_police_presence, advertisement_content_detected"
    )
    assert v[5].rejection_reason == (
        "[Stage 2 – score filter] below threshold: police_presence_signals_score=1 (min 2); "
        "interaction_type_signals_score=0 (min 2); deescalation_indicators_score=0 (min 1)"
    )
    assert v[3].failures == ["no_police_presence", "advertisement_content_detected"]


def test_cap_is_inclusive(spark):
    v = verdicts(spark, escalation_cap=5)
    assert v[6].stage is None
    assert v[1].rejection_reason.endswith("escalation_indicators_score=6 (max 5)")


def test_absent_columns_are_skipped(spark):
    df = spark.createDataFrame([(1,), (2,)], "id int")
    assert R.accepted(R.filter_verdicts(df)).count() == 2


def test_split_is_whole_and_summary_counts(spark):
    v = R.filter_verdicts(spark.createDataFrame(ROWS, SCHEMA))
    assert R.accepted(v).count() + R.rejected(v).count() == len(ROWS)
    assert "rejection_reason" not in R.accepted(v).columns
    s = R.filter_summary(v).first()
    assert (s.total, s.accepted, s.rejected, s.stage_1_rejected, s.stage_2_rejected) == (6, 2, 4, 2, 2)
    assert (s.accepted_pct, s.rejected_pct) == (33.3, 66.7)
    empty = R.filter_summary(v.filter("id < 0")).first()
    assert (empty.total, empty.accepted_pct) == (0, 0.0)
    top = R.top_rejection_reasons(v, 2).collect()
    assert [r.n for r in top] == [1, 1] and top[0].rejection_reason < top[1].rejection_reason


def test_report_lines(spark):
    v = R.filter_verdicts(spark.createDataFrame(ROWS, SCHEMA))
    lines = R.summary_lines(R.filter_summary(v), R.top_rejection_reasons(v)).collect()
    assert [r.line_no for r in lines] == list(range(len(lines)))
    assert lines[1].line == "Accepted: 2 (33.3%)"


def test_taxonomy_and_group_scores(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(r.id for r in df.filter(R.taxonomy_rule()).collect()) == [1, 2, 6]
    bits = spark.createDataFrame([(1, "1", 0, None), (2, "0", 1, 1)], "id int, a string, b int, c int")
    got = R.group_scores(bits, {"g": ["a", "b", "c"]}).select("g_score", "g_of").collect()
    assert [tuple(r) for r in got] == [(1, "1/3"), (2, "2/3")]


def test_verdicts_need_no_shuffle(spark):
    plan = R.filter_verdicts(spark.createDataFrame(ROWS, SCHEMA))
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
