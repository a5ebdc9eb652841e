import time

import pytest
from pyspark.sql import functions as F

import plain
from answergauge.functions import validity as V
from answergauge.operators.evaluate import add_validity
from answergauge.rules import Rules


def check(spark, texts, rules=Rules()):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return add_validity(df, rules, "t").orderBy("i").collect()


@pytest.mark.parametrize(
    "text, message",
    [
        (None, "回答内容为空"),
        ("", "回答内容为空"),
        ("　 \x1d", "回答内容为空"),
        (" abcd ", "回答长度不足，仅4字,低于阈值:5字"),
        ("aaaaaaaaab", "回答重复率过高：0.90，高于阈值：0.7"),
        ("aaaaaaabcd", "回答重复率过高：短语「aa」连续重复3次，超过阈值：2次"),
        ("axaaayaaza", "有效性校验通过"),
        ("我知道我知道我知道", "回答重复率过高：短语「我知道」连续重复3次，超过阈值：2次"),
        ("xABABAB", "有效性校验通过"),
        ("ABABABx", "回答重复率过高：短语「AB」连续重复3次，超过阈值：2次"),
        ("😀😁😀😁😀😁", "回答重复率过高：短语「😀😁」连续重复3次，超过阈值：2次"),
        ("ordinary text\n", "有效性校验通过"),
        ("abcdabcdabcdxyxyxyxy", "回答重复率过高：短语「xy」连续重复4次，超过阈值：2次"),
    ],
)
def test_verdicts(spark, text, message):
    (row,) = check(spark, [text])
    assert row.validity_msg == message
    assert row.is_valid == (message == "有效性校验通过")


@pytest.mark.parametrize("limit", [0.2, 0.5, 0.6, 0.66, 0.7, 0.75, 0.9, 0.99, 1.0])
def test_share_is_exact_wherever_it_exceeds_the_limit(spark, limit):
    texts = [t for t in plain.repetitive_texts(800, 3) + plain.random_texts(300, 4) if t]
    texts += ["aab" * n + "a" * k for n in range(0, 30, 3) for k in range(1, 40, 7)]
    texts += ["ab" * 500, "aab" * 500, "aaab" * 500, "x" * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    share = V.top_char_share_above(F.col("t"), limit)
    got = [r.s for r in df.select("i", share.alias("s")).orderBy("i").collect()]
    for text, found in zip(texts, got):
        true = plain.char_share(text)
        assert found == true if true > limit else (found is None or found <= limit)


def test_full_share(spark):
    texts = [t for t in plain.random_texts(500, 6) if t]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", V.top_char_share(F.col("t")).alias("s")).orderBy("i").collect()
    assert [r.s for r in got] == [plain.char_share(t) for t in texts]


@pytest.mark.parametrize("more_than", [0, 1, 2, 3])
def test_phrase_runs(spark, more_than):
    texts = plain.repetitive_texts(2500, 7) + plain.random_texts(500, 8)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    run = V.longest_phrase_run(F.col("t"), (2, 3, 4), more_than)
    rows = df.select("i", run.alias("r")).select("i", "r.times", "r.phrase").orderBy("i").collect()
    assert [(r.times, r.phrase) for r in rows] == [plain.phrase_run(t, more_than) for t in texts]


def test_huge_texts_do_not_overflow_the_stack(spark):
    texts = ["ab cd " * 200_000 + "xyxyxy", " ." * 400_000 + "x"]
    for text, row in zip(texts, check(spark, texts)):
        times, phrase = plain.phrase_run(text.strip(), 2)
        assert times > 2
        assert row.validity_msg == f"回答重复率过高：短语「{phrase}」连续重复{times}次，超过阈值：2次"


def test_many_distinct_characters_are_counted_in_one_sort(spark):
    text = "".join(chr(0x4E00 + i % 20_000) for i in range(60_000)) + "一" * 3 + "乙乙乙" * 5
    df = spark.createDataFrame([(text,), ("".join(chr(0x4E00 + i // 3) for i in range(30_000)),)], "t string")
    df.select(V.top_char_share("t")).collect()
    start = time.perf_counter()
    rows = df.select(V.top_char_share("t").alias("share"), V.top_char_share_above(F.col("t"), 0.5).alias("above")).collect()
    assert time.perf_counter() - start < 10  # it was over 20 s for one search a character
    assert [r.share for r in rows] == [plain.char_share(text), 3 / 30_000]
    assert all(r.above is None or r.above <= 0.5 for r in rows)


@pytest.mark.parametrize("distinct", [1, V.COUNTED_CHARS - 1, V.COUNTED_CHARS, V.COUNTED_CHARS + 1])
def test_shares_of_few_and_of_many_characters(spark, distinct):
    """Counted by searches or by runs; no character goes through a lambda any more, which took most of the time."""
    text = "".join(chr(0x1F600 - distinct + i) for i in range(distinct)) * 3 + "\n\n\n\n."
    df = spark.createDataFrame([(text,)], "t string").select(V.top_char_share(F.col("t")).alias("share"))
    assert df.first().share == plain.char_share(text)
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_long_word_lists_find_what_short_ones_find(spark):
    words = tuple(f"w{i}" for i in range(90)) + ("", "b", "w1", "ab", "bc")
    texts = ["w1 w12 abc", "nothing here", "", None, "w89w8"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(V.banned_words(F.col("t"), Rules(sensitive_words=words)).alias("w")).collect()
    assert [r.w for r in rows] == [[w for w in words if w in t] if t is not None else [] for t in texts]


def test_whole_verdict_on_random_texts(spark):
    texts = plain.repetitive_texts(1500, 9)
    for text, row in zip(texts, check(spark, texts)):
        s = text.strip()
        if not s:
            want = "回答内容为空"
        elif len(s) < 5:
            want = f"回答长度不足，仅{len(s)}字,低于阈值:5字"
        elif plain.char_share(s) > 0.7:
            want = f"回答重复率过高：{plain.char_share(s):.2f}，高于阈值：0.7"
        else:
            times, phrase = plain.phrase_run(s, 2)
            want = (
                f"回答重复率过高：短语「{phrase}」连续重复{times}次，超过阈值：2次" if times else "有效性校验通过"
            )
        assert row.validity_msg == want


def test_compliance(spark):
    rules = Rules(sensitive_words=("bad", "wor", "é"))
    rows = check(spark, ["a bad word, é", "good text", "BAD", " wor"], rules)
    assert [r.compliance_msg for r in rows] == [
        "检测到敏感词：bad,wor,é", "合规性校验通过", "合规性校验通过", "检测到敏感词：wor",
    ]
    assert [r.is_compliant for r in rows] == [False, True, True, False]
    (row,) = check(spark, ["bad"])
    assert (row.is_compliant, row.compliance_msg) == (True, "未配置敏感词库，跳过合规性校验")
