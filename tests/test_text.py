import random

import pytest
from pyspark.sql import functions as F

import plain
from answergauge.functions import text as T
from answergauge.rules import STOP_WORDS


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_white_space_is_what_python_strips(spark):
    assert set(T.WHITESPACE) == set(plain.SPACES) and len(T.WHITESPACE) == 29
    texts = plain.random_texts(1500, 1) + [s + "a" + s for s in plain.SPACES] + ["", " ", "　"]
    assert column(spark, texts, T.strip) == [t.strip() for t in texts]


def test_blank(spark):
    assert column(spark, [None, "", " 　\x1c", "a"], T.is_blank) == [True, True, True, False]


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(5)
    values = [2.675, 0.125, 0.375, 1.005, 33.335, 66.665, 0.0, 100.0, 2.5e-3]
    values += [rng.randint(0, 10**6) / rng.randint(1, 997) for _ in range(3000)]
    values += [k / 8 / 100 for k in range(3000)]
    assert column(spark, values, T.round2, "double") == [round(v, 2) for v in values]
    assert column(spark, values, T.fixed2, "double") == [f"{v:.2f}" for v in values]
    ratios = [v for v in values if v <= 1]
    assert column(spark, ratios, T.percent1, "double") == [f"{v:.1%}" for v in ratios]


@pytest.mark.parametrize(
    "text, words",
    [
        ("", []),
        ("a I x", []),
        ("2024 3.14 __ -- 12,5", []),
        ("²² a1 don't (word) word.", ["²²", "a1", "don't", "(word)", "word."]),
        ("one two　three\x1cfour five\x85six", ["one", "two", "three", "four", "five", "six"]),
        ("the the The", ["the", "The"]),
        ("--x ..é 1a 😀b", ["--x", "..é", "1a", "😀b"]),
    ],
)
def test_token_examples(spark, text, words):
    assert column(spark, [text], T.tokens) == [words]


@pytest.mark.parametrize("alphabet", [plain.ALPHABET, plain.LATIN])
def test_tokens_of_random_texts(spark, alphabet):
    texts = [t for t in plain.random_texts(3000, 2, alphabet) if not plain.has_han(t)]
    got = column(spark, texts, T.tokens)
    assert [set(g) for g in got] == [plain.spaced_token_set(t) for t in texts]
    assert all(len(set(g)) == len(g) for g in got)


def test_long_letterless_run_is_linear(spark):
    text = "-" * 300_000 + " word " + "7" * 300_000
    assert column(spark, [text], T.tokens) == [["word"]]


def test_null_text_has_no_tokens(spark):
    assert column(spark, [None], T.tokens) == [None]


def test_han_text_gives_character_pairs_and_other_words(spark):
    (got,) = column(spark, ["Python是一种解释型，面向 对象C++、v2"], T.tokens)
    assert sorted(got) == sorted(["是一", "种解", "解释", "释型", "面向", "对象", "Python", "C++", "v2"])
    assert not set(got) & set(STOP_WORDS)


def test_han_text_with_lexicon_takes_the_longest_word(spark):
    lexicon = ("编程", "编程语言", "解释型", "一种")
    (got,) = column(spark, ["一种解释型的编程语言和编程 Java"], lambda c: T.tokens(c, lexicon))
    assert got == ["解释型", "编程语言", "编程", "Java"]


def test_unknown_han_words_count_as_pairs_beside_a_lexicon(spark):
    (got,) = column(spark, ["天空很蓝编程大海"], lambda c: T.tokens(c, ("编程",)))
    assert sorted(got) == sorted(["编程", "天空", "空很", "很蓝", "大海"])


def test_placeholders(spark):
    env = {"A": "1", "B": "${A}", "名-x": "n"}
    texts = ["plain", "${A}${B}", "$${A}$", "${C} ${名-x}", "${A", "${}", "a${A}b\n${A}", None]
    want = ["plain", "1${A}", "$1$", "${C} n", "${A", "${}", "a1b\n1", None]
    assert column(spark, texts, lambda c: T.fill_placeholders(c, env)) == want
    assert column(spark, ["${A}"], lambda c: T.fill_placeholders(c, {})) == ["${A}"]
