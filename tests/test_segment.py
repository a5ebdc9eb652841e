"""Segmentation of Han text by probability, against a plain dynamic program."""

import math
import random
import re

import pytest

from answergauge.operators import segment
from answergauge.operators.evaluate import evaluate
from answergauge.rules import Rules

HAN_RUN = re.compile("[一-鿿]+")


def lexicon(spark, words):
    return spark.createDataFrame(list(words), "word string, freq long")


def plain(text, words):
    """Words of highest probability of each run; ties go to the longer last word."""
    freq = {}
    for word, n in words:
        if n is not None and n > 0 and word and HAN_RUN.fullmatch(word):
            freq[word] = freq.get(word, 0) + n
    total = float(sum(freq.values()) or 1)
    weight = {w: math.floor(math.log(n / total) * 1_000_000) for w, n in freq.items()}
    unseen = math.floor(math.log(1 / total) * 1_000_000) if freq else 0
    out = []
    for run in HAN_RUN.findall(text or ""):
        best = [(0, 0, [])]
        for end in range(1, len(run) + 1):
            found = []
            for k in range(1, end + 1):
                word = run[end - k : end]
                if word in weight or k == 1:
                    found.append((best[end - k][0] + weight.get(word, unseen), k, [*best[end - k][2], word]))
            best.append(max(found, key=lambda f: f[:2]))
        out.append(" ".join(best[-1][2]))
    return out


def segmented(spark, texts, words):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    return {r["id"]: r["runs"] for r in segment.han_segments(df, lexicon(spark, words), ["id"]).collect()}


AMBIGUOUS = [("研究", 50), ("研究生", 20), ("生命", 40), ("命", 10), ("起源", 30), ("生", 5), ("的", 100)]


def test_probability_decides_and_not_length(spark):
    got = segmented(spark, ["研究生命起源", "研究生的研究"], AMBIGUOUS)
    assert got == {0: ["研究 生命 起源"], 1: ["研究生 的 研究"]}


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    rng = random.Random(seed)
    letters = "大因以为的可"
    make = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    words = [(make(5), rng.choice([1, 1, 3, 50])) for _ in range(40)] + [("大因", None), (None, 3), ("x大", 9), ("", 4), ("以", 0)]
    texts = ["，".join(make(30) for _ in range(rng.randint(0, 4))) for _ in range(30)] + [None, "", "abc", "a大b因c", make(30) * 20]
    texts += texts[:3]
    assert segmented(spark, texts, words) == {i: plain(t, words) for i, t in enumerate(texts)}


def test_ties_go_to_the_longer_last_word(spark):
    words = [("大因", 1), ("因以", 1), ("大", 1), ("以", 1)]
    assert plain("大因以", words) == ["大 因以"]
    assert segmented(spark, ["大因以"], words) == {0: ["大 因以"]}


def test_no_lexicon_at_all(spark):
    assert segmented(spark, ["大因以 x"], []) == {0: ["大 因 以"]}


def test_many_words_and_long_runs(spark):
    """100,000 words stay a table; a run of 20,000 characters is cut where no word spans a gap."""
    chars = [chr(0x4E00 + i) for i in range(400)]
    words = [(a + b, 1 + (i * j) % 7) for i, a in enumerate(chars) for j, b in enumerate(chars[:250])]
    assert len(words) == 100_000
    rng = random.Random(4)
    some = "".join(rng.choice(chars) for _ in range(50))
    long = "".join(rng.choice(chars[250:]) for _ in range(20_000))
    df = spark.createDataFrame([(0, some), (1, long)], "id long, text string")
    found = segment.han_segments(df, lexicon(spark, words), ["id"])
    assert {r["id"]: r["runs"] for r in found.collect()} == {0: plain(some, words), 1: [" ".join(long)]}


def test_large_lexicons_are_joined_without_a_nested_loop(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(0, "研究生命起源")], "id long, text string")
        found = segment.han_segments(df, lexicon(spark, AMBIGUOUS), ["id"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and not any(w in plan for w in ("NestedLoop", "Cartesian", "Broadcast", "InArrow"))
        assert found.first()["runs"] == ["研究 生命 起源"]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_token_sets(spark):
    texts = ["研究生命起源 of life，星系星", "plain words only words", None, "的 一个", ""]
    df = spark.createDataFrame([(None if i == 1 else i, t) for i, t in enumerate(texts)], "id long, text string")
    found = segment.segmented_tokens(df, lexicon(spark, AMBIGUOUS), ["id"])
    got = {r["id"]: r["tokens"] and sorted(r["tokens"]) for r in found.collect()}
    # The characters that no word covers count in pairs; stop words never count.
    assert got[0] == sorted(["研究", "生命", "起源", "of", "life", "星系", "系星"])
    assert got[None] == ["only", "plain", "words"] and got[2] is None and not got[3] and not got[4]


def test_grading_with_a_lexicon(spark):
    cases = spark.createDataFrame(
        [(1, "p", "研究生命起源", ["生命", "究生"]), (2, "p", "plain words", ["words"])],
        "case_pos long, prompt string, standard_answer string, expect_keywords array<string>",
    ).selectExpr("case_pos", "'c' as case_id", "'d' as case_desc", "*").drop("case_pos")
    cases = cases.selectExpr("row_number() over (order by standard_answer) as case_pos", "*")
    answers = cases.selectExpr("case_pos", "0 as code", "standard_answer as data", "'ok' as msg", "1.0D as cost_ms")
    rows = {r["standard_answer"]: r for r in evaluate(cases, answers, rules=Rules(), keep=["standard_answer"], lexicon=lexicon(spark, AMBIGUOUS)).collect()}
    pairs = {r["standard_answer"]: r for r in evaluate(cases, answers, rules=Rules(), keep=["standard_answer"]).collect()}
    # As pairs both keywords would count as found; as words only the first one is.
    assert pairs["研究生命起源"]["relevance_score"] == 100.0
    assert rows["研究生命起源"]["relevance_score"] == 50.0 and rows["研究生命起源"]["hallucination_level"] == "无"
    assert rows["plain words"].asDict() == pairs["plain words"].asDict() | {"execute_timestamp": rows["plain words"]["execute_timestamp"]}


def test_equal_runs_of_a_text_are_looked_up_once(spark):
    """One row a text and different run meets the lexicon, with all its places."""
    text = "，".join(["研究", "命", "研究", "生", "命", "研究"] * 50)
    df = spark.createDataFrame([(0, text), (1, None), (2, "no"), (3, "命")], "id long, text string")
    rows = df.selectExpr("id", "regexp_extract_all(text, '[一-鿿]+', 0) as runs")
    got = {r["id"]: r["g"] for r in rows.select("id", segment._with_places(segment.F.col("runs")).alias("g")).collect()}
    assert {r["run"]: len(r["_places"]) for r in got[0]} == {"研究": 150, "命": 100, "生": 50}
    assert sorted(p for r in got[0] for p in r["_places"]) == list(range(300))
    assert not got[1] and not got[2] and [tuple(r) for r in got[3]] == [("命", [0])]
    assert segmented(spark, [text], AMBIGUOUS) == {0: plain(text, AMBIGUOUS)}


def test_tokens_keep_the_order_in_which_they_come(spark):
    texts = ["研究生，命，研究，研究生", "起源，命，研究生，起源"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    found = segment.segmented_tokens(df, lexicon(spark, AMBIGUOUS), ["id"])
    got = {r["id"]: r["tokens"] for r in found.collect()}
    assert got == {0: ["研究生", "研究"], 1: ["起源", "研究生"]}


def tokens_of(spark, df, words, threshold):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        made = segment.segmented_tokens(df, lexicon(spark, words), ["id"])
        plan = made._jdf.queryExecution().executedPlan().toString()
        return plan, sorted(((str(r["id"]), r["tokens"]) for r in made.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_lexicon_that_tasks_can_hold_goes_to_the_texts(spark):
    """Runs and their paths were shuffled, several times as many bytes as the texts have, and filled the disk."""
    df = spark.range(50).selectExpr("id", "concat('研究生命起源 of life ', id, '，研究生的研究') as text")
    plan, rows = tokens_of(spark, df, AMBIGUOUS, "1")
    assert "Exchange" not in plan and "Join" not in plan
    assert len(rows) == 50 and rows[0] == ("0", ["研究", "生命", "起源", "研究生", "of", "life"])


@pytest.mark.parametrize("seed", range(2))
def test_held_and_joined_lexicons_give_the_same_tokens(spark, seed):
    rng = random.Random(seed)
    letters = "大因以为的可"
    make = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    words = [(make(6), rng.choice([1, 1, 3, 50])) for _ in range(40)] + [("大因", None), (None, 3), ("x大", 9), ("", 4), ("以", 0)]
    texts = ["，".join(make(30) + " word" * rng.randint(0, 1) for _ in range(rng.randint(0, 4))) for _ in range(30)]
    texts += [None, "", "abc（def", "a大b因c", make(30) * 20, "的"]
    # Ids 0 to 4 stand twice, with other texts or none; NULL is an id too.
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (1, make(9)), (2, "plain（words"), (3, None), (4, ""), (None, make(9)), (None, "x")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    plan, held = tokens_of(spark, df, words, "10m")
    joins, joined = tokens_of(spark, df, words, "-1")
    assert "ArrowEvalPython" in plan and "ArrowEvalPython" not in joins
    assert len(held) == len(rows) and held == joined
    assert tokens_of(spark, df, [], "10m")[1] == tokens_of(spark, df, [], "-1")[1]


def test_paths_of_long_words_and_runs_that_are_forgotten(monkeypatch):
    from answergauge.operators import held_words

    monkeypatch.setattr(held_words, "REMEMBERED", 3)
    rng = random.Random(1)
    make = lambda a, b: "".join(rng.choice("大因以为") for _ in range(rng.randint(a, b)))
    words = [(make(1, 12), rng.choice([1, 5, 90])) for _ in range(60)]
    freq = {}
    for word, n in words:
        freq[word] = freq.get(word, 0) + n
    total = float(sum(freq.values()))
    paths = held_words.HanPaths(list(freq), [math.floor(math.log(n / total) * 1_000_000) for n in freq.values()], math.floor(math.log(1 / total) * 1_000_000))
    for _ in range(2):
        for run in [make(1, 40) for _ in range(50)] + [make(3000, 3000)]:
            assert [" ".join(paths.path(run))] == plain(run, words)
