import random

import pytest

from turnmill.operators import dialogue as D
from turnmill.operators import generation as G
from turnmill.operators import histories as H
from turnmill.operators.models import ModelSpec
from turnmill.plans import adapters


def turns(spark, files):
    rows = [
        (f, i, label, text) for f, talk in files.items() for i, (label, text) in enumerate(talk)
    ]
    return spark.createDataFrame(
        rows, "source_file string, turn_index int, speaker_label string, transcript string"
    ).repartition(3)


FILES = {
    "a.csv": [("Officer", "o0"), ("Officer", "o1"), ("John", "c2"), ("John", "c3"), ("deputy", "o4"), (None, None)],
    "one.csv": [("Officer", "only")],
    "end.csv": [("[Voice 2]", "c0"), ("Travel agent", "o1")],
}


def random_files(n, longest):
    draw = random.Random(7)
    return {
        f"f{k}": [(draw.choice(["Officer", "Civ"]), f"t{k}.{i} é") for i in range(draw.randint(1, longest))]
        for k in range(n)
    }


def by_hand(files, compat=False):
    """Points and histories, turn by turn. With compat a reply that was asked for comes twice."""
    role = lambda x: "user" if x and any(k.lower() in x.lower() for k in D.AUTHORITY_KEYWORDS) else "assistant"
    points, histories = {}, {}
    for f, talk in files.items():
        history = []
        for i, (label, text) in enumerate(talk):
            text = text or ("nan" if compat else "")
            history.append((role(label), text))
            following = talk[i + 1] if i + 1 < len(talk) else None
            if role(label) == "user" and following and role(following[0]) == "assistant":
                reply = following[1] or ("nan" if compat else "")
                points[f, i] = (text, reply)
                histories[f, i] = list(history)
                if compat:
                    history.append(("assistant", reply))
    return points, histories


def test_roles(spark):
    labels = ["deputy smith", "LAW ENFORCEMENT 2", "[Officer]", "Travel agent", "[Voice 2]", "John", None]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    got = [r[0] for r in df.select(D.speaker_role("l")).collect()]
    assert got == ["user"] * 4 + ["assistant"] * 3


@pytest.mark.parametrize("files", [FILES, random_files(6, 30)])
@pytest.mark.parametrize("compat", [False, True])
def test_points_and_histories(spark, files, compat):
    points, histories = by_hand(files, compat)
    df = turns(spark, files)
    pairs = D.turn_pairs(df, compat, chunk_rows=4).collect()
    assert {(r.source_file, r.turn_index): (r.officer_input, r.reference_response) for r in pairs} == points

    whole = H.dialogue_history(df, "sys", compat, chunk_turns=4)
    got = {(r.source_file, r.turn_index): [(m.role, m.content) for m in r.history] for r in whole.collect()}
    assert got == {k: [("system", "sys"), *h] for k, h in histories.items()}

    prompts = whole.select("source_file", "turn_index", D.render_plain_prompt("history").alias("p"))
    lengths = {(r.source_file, r.turn_index): len(r.p) for r in prompts.collect()}
    frame = len("System: sys\n") + len("\nCivilian:")
    index = D.history_index(df, compat, chunk_rows=4).collect()
    assert len(index) == sum(map(len, files.values()))
    assert {
        (r.source_file, r.turn_index): r.prompt_chars + frame for r in index if r.is_point
    } == lengths
    for f in files:
        rows = sorted((r for r in index if r.source_file == f), key=lambda r: r.turn_index)
        seen = 0
        for r in rows:
            assert r.points_before == seen
            seen += r.is_point


def test_streamed_replies_see_the_same_history(spark):
    files = random_files(4, 25)
    _, histories = by_hand(files)

    class Show:
        def generate(self, history, max_new_tokens, temperature, top_p):
            if history[-1]["content"].startswith("t2."):
                raise ValueError("no answer")
            return "|".join(m["content"] for m in history)

    specs = [ModelSpec("m1", "f", "base"), ModelSpec("m2", "f", "base")]
    got = G.predict_replies(turns(spark, files), specs, lambda spec: Show(), system_prompt="sys", segment_turns=4)
    rows = {(r.model_name, r.source_file, r.turn_index): r for r in got.collect()}
    assert len(rows) == 2 * len(histories)
    for (m, f, i), r in rows.items():
        if f == "f2":
            assert (r.predicted_response, r.error) == (None, "no answer")
        else:
            assert r.predicted_response == "|".join(["sys", *[c for _, c in histories[f, i]]])


@pytest.mark.parametrize("files", [FILES, random_files(6, 30)])
def test_folds_of_histories(spark, files):
    _, histories = by_hand(files)
    folds = {"n": H.MessageCount(), "chars": H.PromptChars(), "reply": H.LastBy("assistant"), "last": H.LastMessages(4)}
    got = H.folded_histories(turns(spark, files), folds, chunk_rows=4).collect()
    assert len(got) == len(histories)
    for r in got:
        told = histories[r.source_file, r.turn_index]
        lines = [f"{D.ROLE_NAMES[role]}: {text}" for role, text in told]
        assert r.officer_input == told[-1][1] and r.n == len(told) + 1 and r.chars == len("\n".join(lines))
        assert r.reply == next((text for role, text in reversed(told) if role == "assistant"), None)
        assert [(m.role, m.content) for m in r["last"]] == told[-4:]
    with pytest.raises(ValueError, match="window of 5"):
        H.folded_histories(turns(spark, files), {"last": H.LastMessages(5)}, chunk_rows=4)


def test_folded_replies(spark):
    files = random_files(4, 25)
    _, histories = by_hand(files)
    calls = []

    class Show:
        def generate_batch(self, states, max_new_tokens, temperature, top_p):
            return [ValueError("no answer") if s["last"][-1]["content"].startswith("t2.") else f"{s['n']} {len(s['last'])}" for s in states]

        def generate(self, state, **kw):
            calls.append(state)

    specs = [ModelSpec("m1", "f", "base"), ModelSpec("m2", "f", "base")]
    folds = {"n": H.MessageCount(), "last": H.LastMessages(3)}
    got = G.predict_folded(turns(spark, files), specs, folds, lambda spec: Show(), batch_size=3, chunk_rows=8, tasks=2)
    rows = {(r.model_name, r.source_file, r.turn_index): r for r in got.collect()}
    assert len(rows) == 2 * len(histories)
    for (m, f, i), r in rows.items():
        n = len(histories[f, i])
        assert (r.predicted_response, r.error) == ((None, "no answer") if f == "f2" else (f"{n + 1} {min(n, 3)}", None))


def test_plain_prompt_and_system_split(spark):
    df = spark.sql(
        "select array(named_struct('role', 'system', 'content', 's'), named_struct('role', 'user', 'content', 'u'),"
        " named_struct('role', 'tool', 'content', 'x'), named_struct('role', 'assistant', 'content', 'a')) as h"
    )
    assert df.select(D.render_plain_prompt("h")).first()[0] == "System: s\nOfficer: u\nCivilian: a\nCivilian:"
    system, rest = D.split_system_message("h")
    got = df.select(system.alias("s"), rest.alias("r")).first()
    assert got.s == "s" and [m.role for m in got.r] == ["user", "tool", "assistant"]


def test_clean_reply(spark):
    cells = {
        "  Civilian: hi  Officer: stop": ("hi", "hi"),
        "ASSISTANT: Suspect: x": ("Suspect: x", "Suspect: x"),
        "Civilian: Assistant: x</s>y": ("x", "x"),
        "```json\nhi\n```": ("```json\nhi\n```", "hi"),
        "ok Police: no": ("ok Police: no", "ok"),
        "Response: fine": ("Response: fine", "fine"),
        "Officer: only": ("", ""),
        "User:<|im_end|>": ("", ""),
    }
    df = spark.createDataFrame([(c,) for c in [*cells, None]], "v string")
    got = df.select(D.clean_reply("v"), D.clean_reply("v", "generation")).collect()
    assert [tuple(r) for r in got] == [*cells.values(), ("", "")]
    blank = spark.createDataFrame([(" x ",), (" \n",), (None,)], "v string").select(D.clean_text("v"))
    assert [r[0] for r in blank.collect()] == ["x", " ", " "]


def test_predictions_keep_their_given_scores(spark):
    rows = [("conv_3.csv", 4, "echo_base"), ("conv_5.csv", 4, "echo_base"), ("conv_-3.csv", 4, "echo_base")]
    df = adapters.with_given_f1(spark.createDataFrame(rows, "source_file string, turn_index int, model_name string"))
    assert [r.embedding_f1 for r in df.collect()] == [(21 + 12 + 9) / 100, None, 0.0]
