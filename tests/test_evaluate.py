import pytest
from pyspark.sql import functions as F

from answergauge import Rules, evaluate, schemas, summarise
from answergauge.operators.evaluate import add_scores, add_validity, judge_prompts
from answergauge.operators.summarise import batch_rows

CASES = [
    (0, "a", "first", "p0", "the cat sat on", ["the", "dog"]),
    (1, None, None, "p1", None, None),
    (2, "c", "no prompt", None, "std", []),
    (3, "d", "null answer", "p3", "std", []),
    (4, "e", "failed call", "p4", "std", []),
    (5, "f", "no outcome", "p5", "std", []),
    (6, "g", "blank answer", "p6", "std", ["k"]),
]
ANSWERS = [
    (0, 0, "the cat sat on the mat", "ok", 1.5),
    (1, 0, "anything at all", "ok", 2.0),
    (2, 0, "unused", "ok", 3.0),
    (3, 0, None, "ok", 4.0),
    (4, 2001, None, "请求超时", 5.0),
    (6, 0, "  ", "ok", 7.0),
]


@pytest.fixture(scope="module")
def inputs(spark):
    return spark.createDataFrame(CASES, schemas.CASES), spark.createDataFrame(ANSWERS, schemas.OUTCOMES)


def run(inputs, judgements=None, rules=Rules()):
    rows = evaluate(*inputs, judgements, rules, execute_timestamp="2024-01-01 00:00:00").collect()
    return {r.case_pos: r for r in rows}


def test_layout(inputs):
    df = evaluate(*inputs)
    assert df.columns == ["case_pos", *schemas.RESULT_COLUMNS]
    assert df.schema["total_score"].dataType.simpleString() == "double"
    assert all(len(r.execute_timestamp) == 19 for r in df.collect())


def test_every_kind_of_row(inputs):
    rows = run(inputs, rules=Rules(sensitive_words=("cat",)))
    assert len(rows) == len(CASES)
    good = rows[0]
    assert good.success_flag and good.is_valid and not good.is_compliant
    assert (good.relevance_score, good.completeness_score, good.hallucination_level) == (50.0, 100.0, "低")
    assert good.total_score == round(50 * 0.4 + 100 * 0.3 + 60 * 0.3, 2)
    defaults = rows[1]
    assert (defaults.case_id, defaults.case_desc) == ("unknown_id", "unknown_desc")
    assert (defaults.relevance_score, defaults.completeness_score) == (100.0, 80.0)
    assert defaults.hallucination_level == "未知"
    assert rows[2].error_msg == "执行异常：'prompt'" and rows[2].prompt == "" and rows[2].api_cost_ms == 0
    null = rows[3]
    assert null.success_flag and null.answer_content is None and null.hallucination_level == ""
    assert null.error_msg.startswith("执行异常：") and null.validity_msg == "" and not null.is_compliant
    failed = rows[4]
    assert (failed.success_flag, failed.error_msg, failed.api_cost_ms) == (False, "请求超时", 5.0)
    assert (failed.answer_content, failed.total_score, failed.is_valid) == ("", 0.0, False)
    assert not rows[5].success_flag and rows[5].error_msg
    blank = rows[6]
    assert (blank.total_score, blank.hallucination_level, blank.is_valid) == (30.0, "无", False)


def test_null_answer_without_banned_words_keeps_its_checks(inputs):
    null = run(inputs)[3]
    assert (null.is_valid, null.validity_msg, null.is_compliant) == (False, "回答内容为空", True)
    assert null.error_msg == "执行异常：'NoneType' object has no attribute 'strip'"


def test_judge_overrules_level_but_not_total(spark, inputs):
    replies = [(i, 0, '{"level":3,"reason":"made up"}') for i in range(7)]
    replies[6] = (6, 500, '{"level":3}')
    judgements = spark.createDataFrame(replies, schemas.JUDGEMENTS)
    plain, judged = run(inputs), run(inputs, judgements)
    assert (judged[0].hallucination_level, judged[0].hallucination_msg) == ("高", "made up")
    assert judged[0].total_score == plain[0].total_score
    # No standard answer, no gradable answer, failed judge: the rules' own result stays.
    for i in (1, 2, 3, 4, 5, 6):
        assert judged[i] == plain[i]


def test_judge_prompts_only_where_there_is_something_to_judge_by(inputs):
    rows = {r.case_pos: r.judge_prompt for r in judge_prompts(*inputs).collect()}
    assert sorted(rows) == [0, 3, 4, 5, 6]
    assert "【待检测回答】\nNone\n" in rows[4]


def test_summary(inputs):
    summary = summarise(evaluate(*inputs), total_time=3.5).first()
    assert (summary.total, summary.success, summary.failed, summary.success_rate) == (7, 4, 3, 57.14)
    # 68, 40+24+24, 0 and 30 over four successes.
    assert summary.avg_score.total == round((68 + 88 + 0 + 30) / 4, 2)
    dist = {k: v["count"] for k, v in summary.hallucination_dist.asDict(True).items()}
    assert dist == {"none": 1, "low": 1, "medium": 0, "high": 0, "unknown": 1}
    assert summary.hallucination_dist.low.ratio == "25.00%"
    assert summary.validate_pass_rate.valid == "50.00%"
    assert summary.validate_pass_rate.compliant == "100.00%"
    assert (summary.total_time, summary.avg_time_per_case) == (3.5, 0.5)


def test_summary_without_successes(spark, inputs):
    results = evaluate(*inputs)
    for rows, total in ((results.where("not success_flag"), 3), (results.where("false"), 0)):
        summary = summarise(rows).first()
        assert (summary.total, summary.success, summary.success_rate) == (total, 0, 0.0)
        assert summary.avg_score.total is None and summary.validate_pass_rate.valid is None
        assert summary.hallucination_dist.none.ratio is None and summary.hallucination_dist.none["count"] == 0
    row = batch_rows(summarise(results.where("false")).withColumn("batch_id", F.lit("b")), "m", "t").first()
    assert row.avg_total_score is None and row.total_cases == 0


def test_same_columns_work_on_a_stream(spark, tmp_path):
    """Grading is row-local, so a stream of answered cases is graded by the same functions."""
    folder = str(tmp_path / "answered")
    rows = [(i, f"word{i} answer text", "answer text", ["answer"]) for i in range(20)]
    answered = spark.createDataFrame(
        rows, "case_pos long, answer_content string, standard_answer string, expect_keywords array<string>"
    )
    answered.write.parquet(folder)

    def grade(df):
        return add_scores(add_validity(df, Rules()), Rules())

    stream = grade(spark.readStream.schema(answered.schema).parquet(folder))
    query = stream.writeStream.format("memory").queryName("graded").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("graded").collect()) == sorted(grade(answered).collect())
