import hashlib
import json

import pytest

from turnmill.operators import chat as C
from turnmill.operators import training as T

RECORDS = {
    "list": {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": " u "},
                          {"role": "assistant", "content": "a"}]},
    "share": {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]},
    "single": {"messages": {"role": "user", "content": "u"}},
    "mixed": {"messages": [{"role": "user", "content": "u"}, "stray"]},
    "text": {"messages": "u"},
    "empty": {"messages": []},
    "none": {"other": 1},
    "gaps": {"messages": [{"content": None}, {"role": "tool", "content": 5}]},
}


def records(spark):
    rows = [(k, json.dumps(v)) for k, v in RECORDS.items()] + [("broken", "{")]
    return spark.createDataFrame(rows, "record_id string, record string")


def test_shapes(spark):
    got = {r.record_id: r for r in C.coerce_conversation(records(spark)).collect()}
    valid = {k for k, r in got.items() if r.valid}
    assert valid == {"list", "share", "single", "empty", "gaps"}
    assert [tuple(m) for m in got["share"].messages] == [("user", "u"), ("assistant", "a")]
    assert [tuple(m) for m in got["single"].messages] == [("user", "u")]
    assert [tuple(m) for m in got["gaps"].messages] == [("", ""), ("tool", "5")]
    assert got["mixed"].messages is None and got["empty"].messages == []


def test_roles(spark):
    df = C.coerce_conversation(records(spark)).filter("record_id in ('list', 'gaps')").orderBy("record_id")
    got = df.select(*[C.map_roles("messages", m).alias(m) for m in C.ROLE_MAPPINGS]).collect()
    assert [m.role for m in got[1].sharegpt] == ["system", "human", "gpt"]
    assert [m.role for m in got[1].gemma] == ["system", "user", "model"]
    assert [m.role for m in got[0].sharegpt] == ["", "tool"]


EXPECTED = {
    "chatml": "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n u <|im_end|>\n<|im_start|>assistant\na<|im_end|>\n",
    "llama-3": "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\ns<|eot_id|>"
               "<|start_header_id|>user<|end_header_id|>\n\nu<|eot_id|>"
               "<|start_header_id|>assistant<|end_header_id|>\n\na<|eot_id|>",
    "gemma": "<bos><start_of_turn>user\ns\n\nu<end_of_turn>\n<start_of_turn>model\na<end_of_turn>\n",
    "mistral": "<s>[INST] s  u  [/INST]a</s>",
    "phi-4": "<|im_start|>system<|im_sep|>s<|im_end|><|im_start|>user<|im_sep|> u <|im_end|>"
             "<|im_start|>assistant<|im_sep|>a<|im_end|>",
}


@pytest.mark.parametrize("template", EXPECTED)
def test_templates(spark, template):
    df = C.coerce_conversation(records(spark)).filter("record_id = 'list'")
    assert df.select(C.render_chat_template("messages", template)).first()[0] == EXPECTED[template]


def test_training_text_drops_or_keeps_invalid(spark):
    setup = C.TRAINING_SETUPS["qwen"]
    assert C.training_text(records(spark), setup).count() == 5
    kept = {r.record_id: r.text for r in C.training_text(records(spark), setup, compat=True).collect()}
    assert len(kept) == 9 and kept["mixed"] == "" and kept["broken"] == ""


def test_split_is_stable(spark):
    keys = [str(i) for i in range(4000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    want = {k: int(hashlib.md5(f"3407:{k}".encode()).hexdigest()[:8], 16) % 10000 for k in keys}
    got = {r.k: r.split for r in C.train_eval_split(df, "k", 0.1).collect()}
    assert got == {k: "eval" if b < 1000 else "train" for k, b in want.items()}
    assert 300 < sum(s == "eval" for s in got.values()) < 500
    assert C.train_eval_split(df, "k", 0.0).filter("split = 'eval'").count() == 0
    some = {r.k: r.split for r in C.train_eval_split(df.limit(50), "k", 0.1).collect()}
    assert all(got[k] == s for k, s in some.items())


def test_losses(spark):
    rows = [(1, 1, 0.9, None), (1, 3, None, 0.7), (1, 2, 0.0, None), (1, 4, None, None), (2, 1, 0.5, None)]
    history = spark.createDataFrame(rows, "run_id int, step long, loss double, eval_loss double")
    got = {r.run_id: (r.final_train_loss, r.final_eval_loss) for r in T.final_losses(history).collect()}
    assert got == {1: (0.0, 0.7), 2: (0.5, None)}
    assert T.loss_points(history, "eval_loss").count() == 1
    runs = spark.createDataFrame(
        [(1, "a", 9, 1, 90.0, "success"), (3, "a", 9, 0, 0.0, "failed")],
        "run_id int, model_key string, train_samples long, eval_samples long, duration_sec double, status string",
    )
    log = {r.run_id: r for r in T.run_log(history, runs).collect()}
    assert (log[1].duration_min, log[1].final_eval_loss, log[3].final_train_loss) == (1.5, 0.7, None)
    assert tuple(T.sweep_summary(runs).first()) == ("a", 2, 1, 1)
