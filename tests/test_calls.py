import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from answergauge import schemas
from answergauge.functions import calls
from answergauge.functions.judge import judge_prompt, judge_verdict, parse_reply
from answergauge.functions.text import fill_template
from answergauge.operators.attempts import call_outcomes, deciding_attempts, final_attempts, slow_calls


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def test_request_body(spark):
    body = json.loads(one(spark, 'say "hi"\n你好', lambda c: calls.request_body(c, "m1")))
    assert body == {
        "model": "m1", "messages": [{"role": "user", "content": 'say "hi"\n你好'}], "temperature": 0.7,
    }


@pytest.mark.parametrize(
    "body, code, data, msg",
    [
        ('{"choices":[{"message":{"content":"hi"}}]}', 0, "hi", "执行成功"),
        ('{"choices":[{"message":{"content":""}}]}', 0, "", "执行成功"),
        ('{"choices":[{"message":{"content":null}}]}', 0, None, "执行成功"),
        ('{"choices":[{"message":{"content":{"a":1}}}]}', 0, None, "执行成功"),
        ('{"choices":[]}', 4001, '{"choices":[]}', "模型回答提取失败：list index out of range"),
        ('{"choices":[{"message":{}}]}', 4001, '{"choices":[{"message":{}}]}', "模型回答提取失败：'content'"),
        ('{"choices":[{}]}', 4001, '{"choices":[{}]}', "模型回答提取失败：'message'"),
        ("{}", 4001, "{}", "模型回答提取失败：'choices'"),
        ("not json", 2004, "not json", "响应内容解析失败，预期为JSON格式"),
    ],
)
def test_reply_bodies(spark, body, code, data, msg):
    got = one(spark, body, calls.parse_body)
    assert (got.code, got.data, got.msg) == (code, data, msg)


def log(spark, rows):
    start = datetime(2024, 1, 1)
    data = [
        (req, no, kind, status, body, text, start + timedelta(seconds=at), start + timedelta(seconds=at + took))
        for req, no, kind, status, body, text, at, took in rows
    ]
    return spark.createDataFrame(data, schemas.ATTEMPTS)


OK_BODY = '{"choices":[{"message":{"content":"fine"}}]}'


def test_outcomes(spark):
    attempts = log(
        spark,
        [
            (1, 0, "timeout", None, None, None, 0, 1.0), (1, 1, None, 200, OK_BODY, None, 2, 0.2554),
            (2, 0, "timeout", None, None, None, 0, 1), (2, 1, "connect", None, None, None, 2, 1),
            (2, 2, None, 200, OK_BODY, None, 4, 1),
            (3, 0, None, 503, "busy", "503 Server Error", 0, 1), (3, 1, None, 200, OK_BODY, None, 2, 1),
            (4, 0, "other", None, None, "bad handshake", 0, 2),
            (5, 0, None, 200, "oops", None, 0, 1.6),
            (6, 0, None, 200, OK_BODY, None, 0, 1.5),
            (7, 0, "connect", None, None, None, 0, 1), (7, 1, "timeout", None, None, None, 2, 1),
        ],
    )
    rows = {r.case_pos: r for r in call_outcomes(attempts).collect()}
    assert {k: r.code for k, r in rows.items()} == {1: 0, 2: 2002, 3: 2003, 4: 2005, 5: 2004, 6: 0, 7: 2001}
    assert rows[1].data == "fine" and rows[1].cost_ms == 2255.4 and rows[1].is_slow
    assert rows[2].msg == "网络连接失败，无法访问接口地址" and rows[2].cost_ms == 3000 and not rows[2].is_slow
    assert (rows[3].data, rows[3].msg) == ("busy", "接口返回HTTP错误状态码：503 Server Error")
    assert (rows[4].msg, rows[4].is_slow) == ("未知网络异常：bad handshake", False)
    assert rows[5].is_slow  # a reply that is not JSON can still be slow
    assert not rows[6].is_slow  # exactly at the threshold
    assert rows[7].msg == "请求超时，超时限制30秒"
    assert {r.code for r in call_outcomes(attempts, max_retry=2).where("case_pos = 2").collect()} == {0}


def test_hot_request_is_combined_before_the_shuffle(spark):
    attempts = log(spark, [(1, 0, None, 200, OK_BODY, None, 0, 1)] * 500 + [(2, 0, None, 200, OK_BODY, None, 0, 1)])
    final = final_attempts(attempts)
    assert final.count() == 2
    plan = deciding_attempts(attempts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min(") == 2 and plan.count("Exchange") == 1
    assert "Window" not in plan and "SortAggregate" not in plan and "Sort " not in plan


def test_slow_calls_read_no_bodies(spark, tmp_path):
    path = str(tmp_path / "log")
    log(spark, [(1, 0, None, 200, OK_BODY, None, 0, 1)]).write.parquet(path)
    plan = slow_calls(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "body" not in schema and "error_text" not in schema
    plan = final_attempts(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize(
    "reply, want",
    [
        ('{"level":1,"reason":"x"}', ("低", "x")),
        ('{"level":true}', ("低", "LLM评判完成")),
        ('{"level":false,"reason":"y"}', ("无", "y")),
        ('{"level":1.0}', ("低", "LLM评判完成")),
        ('{"level":0}', ("无", "LLM评判完成")),
        ('{"level":2,"reason":null}', ("中", None)),
        (' \n{"reason":"z","level":3}\n', ("高", "z")),
        ('{"level":"1"}', None),
        ('{"level":1.5}', None),
        ('{"level":5}', None),
        ('{"level":-1}', None),
        ('{"level":null}', None),
        ("{}", None),
        ("[]", None),
        ('{"level":[1]}', None),
        ('{"level":2} tail', None),
        ('```json\n{"level":2}\n```', None),
        ("", None),
        (None, None),
    ],
)
def test_judge_replies(spark, reply, want):
    got = one(spark, reply, lambda c: judge_verdict(parse_reply(c)))
    assert (got and (got.level, got.reason)) == want


def test_judge_prompt_fills_each_slot_once(spark):
    prompt = one(spark, "say {standard_answer} {x}", lambda c: judge_prompt(F.lit("{answer_content}"), c))
    assert prompt == (
        "【参考原文】\n{answer_content}\n\n【待检测回答】\nsay {standard_answer} {x}\n\n请输出校验结果JSON。\n"
    )
    assert one(spark, "x", lambda c: fill_template("{{{a}}}{b}", {"a": c, "b": 0.7})) == "{x}0.7"
    assert "\nNone\n" in one(spark, None, lambda c: judge_prompt(F.lit("s"), c))
    with pytest.raises(ValueError):
        fill_template("{nobody}", {"a": F.lit("x")})
