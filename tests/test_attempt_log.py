"""Asking with retries over a stored log: who is asked how often, and what a broken run leaves."""

import os
import time

import pytest
from pyspark.sql import functions as F

from answergauge.operators.attempt_log import AttemptLog, ask_with_retries, open_cases, try_once

ANSWER = '{"choices":[{"message":{"content":"fine"}}]}'


def cases(spark, n=12):
    return spark.createDataFrame([(i, f"case {i}" if i != 5 else None) for i in range(n)], "case_pos long, prompt string")


def sender(folder, plan, broken=None):
    """Replies by case and try; each call leaves a file, so calls of all workers can be counted."""

    def send(body, attempt_no):
        import json
        import os
        import uuid

        case = int(json.loads(body)["messages"][0]["content"].split()[1])
        open(f"{folder}/{case}-{attempt_no}-{uuid.uuid4().hex}", "w").close()
        if broken is not None and case == broken and not os.path.exists(f"{folder}/mended"):
            os._exit(1)  # the worker dies in the middle of the call
        kinds = plan.get(case, [])
        kind = kinds[attempt_no] if attempt_no < len(kinds) else None
        if kind == "raise":
            raise RuntimeError("no line")
        if isinstance(kind, int):
            return {"status": kind, "body": "busy", "error_text": "503 Server Error"}
        return {"error_kind": kind} if kind else {"status": 200, "body": ANSWER}

    return send


def called(folder):
    out = {}
    for name in os.listdir(folder):
        if name != "mended":
            case, number, _ = name.split("-")
            out[int(case), int(number)] = out.get((int(case), int(number)), 0) + 1
    return out


PLAN = {1: ["timeout"], 2: ["timeout", "connect"], 3: ["timeout", "timeout", "timeout"], 4: [503], 6: ["other"], 7: ["raise"]}


def test_retries_follow_the_rule(spark, tmp_path):
    log = AttemptLog(spark)
    assert log.read().count() == 0
    rows = ask_with_retries(cases(spark), sender(str(tmp_path), PLAN), log, "m", 2, max_retry=2, wait_seconds=0.0).collect()
    codes = {r["case_pos"]: (r["code"], r["data"]) for r in rows}
    assert set(codes) == set(range(12)) - {5}  # nothing to ask about 5
    assert codes[0] == codes[1] == codes[2] == (0, "fine")
    assert (codes[3][0], codes[4][0], codes[6][0], codes[7][0]) == (2001, 2003, 2005, 2005)
    want = {(c, 0): 1 for c in codes} | {(1, 1): 1, (2, 1): 1, (2, 2): 1, (3, 1): 1, (3, 2): 1}
    assert called(tmp_path) == want
    # All is decided: another run asks nobody.
    ask_with_retries(cases(spark), sender(str(tmp_path), PLAN), log, "m", 2, max_retry=2).collect()
    assert called(tmp_path) == want


def test_a_larger_limit_goes_on_with_the_log(spark, tmp_path):
    log, send = AttemptLog(spark), sender(str(tmp_path), PLAN)
    first = ask_with_retries(cases(spark), send, log, max_retry=0, wait_seconds=0.0)
    assert {r["case_pos"]: r["code"] for r in first.collect()}[1] == 2001
    then = ask_with_retries(cases(spark), send, log, max_retry=1, wait_seconds=0.0)
    assert {r["case_pos"]: r["code"] for r in then.collect()}[1] == 0
    assert max(called(tmp_path).values()) == 1


@pytest.mark.parametrize("portions", [1, 4])
def test_a_killed_wave_goes_on_where_it_stopped(spark, tmp_path, portions):
    folder = str(tmp_path)
    log = AttemptLog(spark)
    send = sender(folder, PLAN, broken=9)
    with pytest.raises(Exception):
        ask_with_retries(cases(spark), send, log, "m", 11, max_retry=2, wait_seconds=0.0, portions=portions)
    stored = {(r["request_id"], r["attempt_no"]) for r in log.read().collect()}
    before = called(folder)
    assert stored and (9, 0) not in stored and stored <= set(before)
    open(f"{folder}/mended", "w").close()
    rows = ask_with_retries(cases(spark), send, log, "m", 2, max_retry=2, wait_seconds=0.0, portions=portions).collect()
    assert {r["case_pos"] for r in rows} == set(range(12)) - {5} and [r["code"] for r in rows if r["case_pos"] == 9] == [0]
    # No stored attempt was made again.
    assert all(n == 1 for key, n in called(folder).items() if key in stored)


def test_open_cases(spark):
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = [(0, 0, None), (1, 0, "timeout"), (2, 0, "timeout"), (2, 1, "timeout"), (3, 0, "timeout"), (3, 1, "other"), (3, 1, "other")]
    log = spark.createDataFrame(rows, "request_id long, attempt_no int, error_kind string").withColumn("ended_at", stamp)
    todo = open_cases(cases(spark, 5), log, max_retry=1).collect()
    assert {r["case_pos"]: (r["attempt_no"], r["last_end"] is None) for r in todo} == {1: (1, False), 4: (0, True)}


def test_a_retry_waits(spark, tmp_path):
    now = F.timestamp_micros(F.lit(int(time.time() * 1e6)))
    todo = cases(spark, 1).withColumns({"attempt_no": F.lit(1), "last_end": F.unix_micros(now)})
    row = try_once(todo, sender(str(tmp_path), {}), wait_seconds=1.5).first()
    waited = row["started_at"].timestamp() - todo.first()["last_end"] / 1e6
    assert 1.4 < waited < 30
