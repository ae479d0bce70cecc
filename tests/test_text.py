import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from turnmill.functions import text as T
from turnmill.functions import tokens as K
from turnmill.functions.stems import stem
from turnmill.operators import scoring as S


def values(spark, column, cells, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(c,) for c in cells], schema).select(column).collect()]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=T.PY_WHITESPACE + "ab.", max_size=12), min_size=1, max_size=30))
def test_strip_equals_python(spark, cells):
    assert values(spark, T.strip_ws("v"), cells) == [c.strip() for c in cells]


def test_flag_and_score_cells(spark):
    cells = ["1", "1.0", " 1 ", "2", "0", "x", None, "true", "-1", ""]
    assert values(spark, T.flag_set("v"), cells) == [
        True, False, True, False, False, False, False, False, False, False,
    ]
    assert values(spark, T.safe_int("v"), cells) == [1, 0, 1, 2, 0, 0, 0, 0, -1, 0]
    numbers = [1.9, 1.0, float("nan"), float("inf"), None, 2.0]
    assert values(spark, T.flag_set("v"), numbers, "v double") == [
        True, True, False, False, False, False,
    ]
    assert values(spark, T.safe_int("v"), numbers, "v double") == [1, 1, 0, 0, 0, 2]
    assert values(spark, T.flag_set("v"), [True, False, None], "v boolean") == [True, False, False]


def test_missing_cells(spark):
    assert values(spark, T.na_to_null("v"), ["N/A", "", "nan", "None", "x", "n/a", "0", None]) == [
        None, None, None, None, "x", None, "0", None,
    ]


def test_percent(spark):
    df = spark.createDataFrame([(1, 3), (0, 0), (3, 3)], "a bigint, b bigint")
    assert [r[0] for r in df.select(T.percent(F.col("a"), F.col("b"))).collect()] == [33.3, 0.0, 100.0]


PUBLIC_13A = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
    (r"([^0-9])([\.,])", r"\1 \2 "),
    (r"([\.,])([^0-9])", r" \1 \2"),
    (r"([0-9])(-)", r"\1 \2 "),
]


def public_words(text):
    text = text.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    for old, new in K.BLEU_ENTITIES.items():
        text = text.replace(old, new)
    text = f" {text} "
    for pattern, spaced in PUBLIC_13A:
        text = re.sub(pattern, spaced, text)
    return text.split()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="a5.,-& é\n" + string.punctuation, max_size=20), min_size=1, max_size=40))
def test_bleu_words_follow_the_public_rules(spark, cells):
    cells += ["a..5", "5..7", "5...7", "1,000.5-6", "x-y 5-y", "&quot;a&amp;b"]
    assert [w.split() for w in values(spark, K.bleu_words("v"), cells)] == [public_words(c) for c in cells]


def test_rouge_and_meteor_words(spark):
    assert values(spark, K.rouge_words("v"), ["Don't  STOP, né 5!"])[0].split() == [
        "don", "t", "stop", "n", "5",
    ]
    assert values(spark, K.meteor_words("v"), ["I don't. You're (ok)... yes."])[0].split() == [
        "i", "do", "n't", ".", "you", "'re", "(", "ok", ")", "...", "yes", ".",
    ]


words = st.lists(st.sampled_from("abcde"), max_size=12)


def longest_common(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def scored(score, pairs, *more):
    """The score of each pair of word lists, all in one batch."""
    sides = [pa.array([" ".join(side) if side is not None else None for side in column]) for column in zip(*pairs)]
    (pred, ref), _ = K.numbered(*sides)
    return score(pred, ref, *more)


def one(score, a, b):
    return scored(score, [(a, b)])[0]


@given(st.lists(st.tuples(words, words), min_size=1, max_size=5))
def test_rouge_l_against_table(pairs):
    want = [2 * longest_common(a, b) / (len(a) + len(b)) if a and b else 0.0 for a, b in pairs]
    assert np.allclose(scored(K.rouge_l, pairs), want)


def test_long_texts_of_many_lanes():
    draw = random.Random(3)
    some = lambda: [draw.choice("abcdefg") for _ in range(draw.choice([0, 1, 63, 64, 65, 128, 129, 300]))]
    pairs = [(some(), some()) for _ in range(40)]
    want = [2 * longest_common(a, b) / (len(a) + len(b)) if a and b else 0.0 for a, b in pairs]
    assert np.allclose(scored(K.rouge_l, pairs), want)


def bleu_by_hand(a, b):
    if not a or not b:
        return 0.0
    total = 0.0
    for n in range(1, 5):
        have, want = (Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (a, b))
        total += math.log((sum((have & want).values()) + 1) / (max(len(a) - n + 1, 0) + 1))
    return math.exp(total / 4) * (1.0 if len(a) > len(b) else math.exp(1 - len(b) / len(a)))


def meteor_by_hand(a, b, *alike):
    """Stage by stage, from the end of both texts, as long as words are left."""
    left = [dict(enumerate(a)), dict(enumerate(b))]
    pairs = []
    for key in alike:
        for i in sorted(left[0], reverse=True):
            j = max((j for j, w in left[1].items() if key(w) == key(left[0][i])), default=None)
            if j is not None:
                pairs.append((i, j))
                del left[0][i], left[1][j]
    if not pairs:
        return 0.0
    pairs.sort()
    m, chunks = len(pairs), 1 + sum(x[0] + 1 != y[0] or x[1] + 1 != y[1] for x, y in zip(pairs, pairs[1:]))
    p, r = m / len(a), m / len(b)
    return (1 - 0.5 * (chunks / m) ** 3) * p * r / (0.9 * p + 0.1 * r)


@given(st.lists(st.tuples(words, words), min_size=1, max_size=5))
def test_bleu_and_meteor_by_hand(pairs):
    assert np.allclose(scored(K.bleu_4, pairs), [bleu_by_hand(a, b) for a, b in pairs])
    assert np.allclose(scored(K.meteor, pairs), [meteor_by_hand(a, b, str) for a, b in pairs])


talk = st.lists(st.sampled_from("run runs running ran cat cats happy happily".split()), max_size=9)


@given(st.lists(st.tuples(talk, talk), min_size=1, max_size=5))
def test_meteor_with_stems_by_hand(pairs):
    sides = [pa.array([" ".join(x) for x in column]) for column in zip(*pairs)]
    (pred, ref), names = K.numbered(*sides)
    got = K.METRICS["meteor_stems"][1](pred, ref, names)
    assert np.allclose(got, [meteor_by_hand(a, b, str, stem) for a, b in pairs])


@given(words, words)
def test_scores_stay_in_range(a, b):
    for score in (K.rouge_l, K.bleu_4, K.meteor):
        assert 0.0 <= one(score, a, b) <= 1.0
    if a:
        assert one(K.rouge_l, a, a) == 1.0
        assert abs(one(K.bleu_4, a, a) - 1.0) < 1e-9


def test_score_goldens():
    the, a = "the cat sat on the mat".split(), "the cat is on the mat".split()
    assert abs(one(K.rouge_l, the, a) - 10 / 12) < 1e-12
    # clipped matches 5, 3, 1, 0 of 6, 5, 4, 3
    assert abs(one(K.bleu_4, the, a) - (6 / 7 * 4 / 6 * 2 / 5 * 1 / 4) ** 0.25) < 1e-12
    # five exact words in two chunks
    assert abs(one(K.meteor, the, a) - (5 / 6) * (1 - 0.5 * (2 / 5) ** 3)) < 1e-12
    assert one(K.bleu_4, ["x"], []) == one(K.meteor, [], ["x"]) == one(K.rouge_l, [], None) == 0.0
    # repeated words are clipped
    assert one(K.bleu_4, ["the"] * 4, ["the"]) < 1


def test_stems():
    # Examples of the published rules.
    goldens = """caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor
    sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing
    fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit
    conformabli conform radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication
    predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
    sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical
    electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop
    adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
    homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect bowdlerize
    bowdler probate probat rate rate cease ceas controll control roll roll as as by by""".split()
    for word, want in zip(goldens[::2], goldens[1::2]):
        assert stem(word) == want, word


def test_stems_are_an_option(spark):
    df = spark.createDataFrame([("he runs home", "he was running home"), (None, "x")], "p string, r string")
    exact, stems = df.select(S.score_meteor("p", "r"), S.score_meteor("p", "r", stems=True)).first()
    assert abs(exact - meteor_by_hand("he runs home".split(), "he was running home".split(), str)) < 1e-12
    assert abs(stems - meteor_by_hand("he runs home".split(), "he was running home".split(), str, stem)) < 1e-12
    assert stems > exact
    both = S.score_predictions(df.withColumnsRenamed({"p": "predicted_response", "r": "reference_response"}), stems=True)
    assert [r.meteor for r in both.collect()] == [stems, 0.0]


def test_long_texts_are_scored_in_small_steps():
    texts = pa.array(["x" * (1 << 19), None, "y" * (1 << 19), "z" * (3 << 20), "", "w"])
    found = K.steps(texts, pa.array(["", "", "", "", None, "v"]))
    assert found == [(0, 3), (3, 1), (4, 2)]
    assert K.steps(pa.array([""] * 5000)) == [(0, 4096), (4096, 904)] and K.steps(pa.array([], pa.string())) == []
