import csv
import glob
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from answergauge import HistoryStore, evaluate, schemas
from answergauge.operators.ask import ask_all, collect_answers
from answergauge.operators.layout import spread
from answergauge.operators.summarise import summarise
from answergauge.plans.batch import run_batch
from answergauge.rules import Rules, fill_placeholders
from answergauge.sources import history
from answergauge.sources.cases import read_cases, write_bucketed
from answergauge.sources.report import REPORT_COLUMNS, export_csv

CASES = [(i, f"id{i}", "desc", f"prompt {i}", f"prompt {i} again", ["prompt"]) for i in range(40)]


@pytest.fixture(scope="module")
def results(spark):
    cases = spark.createDataFrame(CASES, schemas.CASES)
    answers = spark.createDataFrame(
        [(i, 0 if i % 4 else 2001, f"prompt {i}\nanswer", "msg", 1.0) for i in range(40)], schemas.OUTCOMES
    )
    return evaluate(cases, answers, execute_timestamp="2024-01-01 00:00:00")


# ---- History ---------------------------------------------------------------------


def test_history_round_trip(spark, results):
    store = HistoryStore(spark, "round_trip")
    first = store.save_batch(results, "model-a", 4.0)
    second = store.save_batch(results.where("case_pos < 8"), "model-b", 1.0)
    third = store.save_batch(results.where("not success_flag"), "model-c")
    assert len({first, second, third}) == 3 and all(b.startswith("batch_") for b in (first, second, third))

    row = store.batch(first).first()
    assert (row.total_cases, row.success_count, row.success_rate, row.total_time) == (40, 30, 75.0, 4.0)
    assert store.batch(third).first().avg_total_score is None
    assert store.latest(2).count() == 2 and store.latest(50).count() == 3 and store.latest(-1).count() == 3
    ids = [(r.execute_time, r.batch_id) for r in store.latest(10).collect()]
    assert ids == sorted(ids, key=lambda p: p[1]) or len({t for t, _ in ids}) > 1
    assert store.batch("nothing").count() == 0

    saved = store.cases(second).drop("batch_id").collect()
    assert [r.case_pos for r in saved] == list(range(8))
    assert saved == results.where("case_pos < 8").orderBy("case_pos").collect()
    assert store.list_view().columns == history.LIST_COLUMNS
    lines = {r.key: r.value for r in store.detail_view(second).collect()}
    assert lines["total_cases"] == "8" and lines["model_name"] == "model-b" and len(lines) == 8
    overview = store.case_overview(second).collect()
    assert [r.status for r in overview][:3] == ["失败", "成功", "成功"]

    assert store.delete(first) is True
    assert store.batch(first).count() == 0 and store.cases(first).count() == 0
    assert store.delete(first) is False
    assert store.cases(second).count() == 8


def test_orphan_details_are_deleted_but_not_reported(spark, results):
    store = HistoryStore(spark, "orphans")
    batch = store.save_batch(results)
    store._hide(batch)
    assert store.delete(batch) is False
    assert store.cases(batch).count() == 0


def test_failed_save_leaves_nothing_behind(spark, results):
    store = HistoryStore(spark, "failures")
    broken = results.withColumn("total_score", F.raise_error(F.lit("boom")).cast("double"))
    assert store.save_batch(broken) == ""
    assert store.latest().count() == 0 and store.details.count() == 0


def test_reading_one_batch_prunes_partitions(spark, results):
    store = HistoryStore(spark, "pruned")
    batch = store.save_batch(results)
    plan = store.cases(batch)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(batch_id" in plan


def test_batches_of_the_same_second_are_ordered_by_id(spark):
    rows = [("b2", "2024-01-01 00:00:00"), ("b1", "2024-01-01 00:00:00"), ("b0", "2023-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "batch_id string, execute_time string")
    assert [r.batch_id for r in history.latest_batches(df).collect()] == ["b1", "b2", "b0"]


def test_another_process_opens_the_history(spark, results, tmp_path):
    store = HistoryStore(spark, location=str(tmp_path / "history"))
    batch = store.save_batch(results, "model-a", 4.0)
    gone = store.save_batch(results.where("case_pos < 8"), "model-a")
    assert store.delete(gone)
    script = f"""
import sys
sys.path.insert(0, {os.path.dirname(os.path.dirname(os.path.abspath(__file__)))!r})
from pyspark.sql import SparkSession
from answergauge import HistoryStore
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
store = HistoryStore(spark, location={str(tmp_path / "history")!r})
print("FOUND", [r.batch_id for r in store.latest().collect()], store.cases({batch!r}).count(), store.delete({batch!r}))
"""
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert f"FOUND ['{batch}'] 40 True" in run.stdout, run.stderr[-2000:]
    assert store.latest().count() == 0 and store.cases(batch).count() == 0


def test_a_save_that_fails_late_leaves_nothing_visible(spark, results, tmp_path, monkeypatch):
    store = HistoryStore(spark, location=str(tmp_path / "late"))
    monkeypatch.setattr(history.log, "exception", lambda *a: None)
    monkeypatch.setattr(history, "batch_rows", lambda *a: 1 / 0)
    assert store.save_batch(results) == ""
    assert store.latest().count() == 0 and store.details.count() == 0


def test_rows_without_batch_id_survive_a_delete(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "batch_id string")
    assert {r[0] for r in history.without_batch(rows, "a").collect()} == {"b", None}


def test_batches_compared_and_trends(spark, results):
    store = HistoryStore(spark, "compared")
    one = store.save_batch(results.where("case_pos < 30"), "m", 1.0)
    two = store.save_batch(results.where("case_pos >= 10").withColumn("total_score", F.lit(1.0)), "m", 1.0)
    rows = {r.case_pos: r for r in store.compare(one, two).collect()}
    assert len(rows) == 40
    assert [rows[i].side for i in (0, 15, 39)] == ["baseline", "both", "candidate"]
    assert rows[15].total_score_change == round(1.0 - rows[15].old_total_score, 2) and rows[0].total_score_change is None
    assert rows[15].level_changed is False
    trend = store.trend().orderBy("run").collect()
    assert [r.run for r in trend] == [1, 2] and trend[0].avg_total_score_change is None
    assert trend[1].avg_total_score_change == round(trend[1].avg_total_score - trend[0].avg_total_score, 2)


# ---- Report ----------------------------------------------------------------------


def test_rollup_reads_no_details(spark, results, tmp_path):
    store = HistoryStore(spark, location=str(tmp_path / "rollup"))
    first = store.save_batch(results, "model-a", 4.0)
    store.save_batch(results.where("case_pos < 8"), "model-a", 1.0)
    store.save_batch(results.limit(0), "model-b", 0.5)
    rolled = store.rollup()
    assert not [f for f in rolled.inputFiles() if "eval_case_detail" in f]
    rows = {(r.level, r.model_name, r.batch_id): r for r in rolled.collect()}
    one = rows["batch", "model-a", first]
    assert (one.total, one.success, one.total_time, one.n_batches, one.n_uncounted) == (40, 30, 4.0, 1, 0)
    assert one.avg_score == store.summary(first).first().avg_score
    a = next(r for r in rows.values() if r.level == "model" and r.model_name == "model-a")
    both = summarise(results.unionByName(results.where("case_pos < 8")), total_time=5.0).first()
    assert all(a[c] == both[c] for c in both.asDict())
    whole = next(r for r in rows.values() if r.level == "all")
    assert (whole.total, whole.n_batches, whole.total_time) == (48, 3, 5.5)
    empty = next(r for r in rows.values() if r.level == "model" and r.model_name == "model-b")
    assert (empty.total, empty.success, empty.avg_score.total) == (0, 0, None)
    store.delete(first)
    assert next(r for r in store.rollup().collect() if r.level == "all").total == 8
    assert HistoryStore(spark, location=str(tmp_path / "nothing")).rollup().count() == 0


def test_newest_batches_open_few_days(spark, tmp_path, monkeypatch):
    """400 days of one batch, then a day of several; two of the newest are deleted."""
    store = HistoryStore(spark, location=str(tmp_path / "days"))
    rows = spark.range(403).selectExpr(
        "concat('b', lpad(id, 3, '0')) batch_id",
        "concat(date_add(date'2024-01-01', cast(least(id, 399) as int)), ' 10:00:00') execute_time",
        "'m' model_name", "1L total_cases", "1L success_count", "1D total_time", "100D success_rate", "50D avg_total_score",
    ).selectExpr("*", "left(execute_time, 10) day")
    rows.coalesce(1).write.mode("append").partitionBy("day").parquet(store.batch_path)
    store.delete("b402"), store.delete("b398")
    opened = []
    of_days = store._of_days
    monkeypatch.setattr(store, "_of_days", lambda days: opened.extend(days) or of_days(days))
    got = [r.batch_id for r in store.latest(10).collect()]
    assert got == ["b399", "b400", "b401", *[f"b{i}" for i in range(397, 390, -1)]]
    assert len(set(opened)) <= 16
    assert got == [r.batch_id for r in history.latest_batches(store.batches, 10).collect()]
    assert store.latest(0).count() == 0 and store.latest(1000).count() == 401
    assert [r.batch_id for r in store.list_view(2).collect()] == ["b399", "b400"]
    uncounted = next(r for r in store.rollup().collect() if r.level == "all")
    assert (uncounted.n_batches, uncounted.n_uncounted, uncounted.total) == (401, 401, None)


def test_csv_keeps_every_value(spark, tmp_path):
    texts = ["plain", "a,b", 'say "x"', "two\nlines", "cr\r\nlf", "back\\slash", "\nlead", " pad ", "", None, "é中"]
    cases = spark.createDataFrame([(i, f"id{i}", None, "p", "s", []) for i in range(len(texts))], schemas.CASES)
    answers = spark.createDataFrame(
        [(i, 0, t, "m", 1.5) for i, t in enumerate(texts)][:-1] + [(10, 2001, None, "bad", 1.5)], schemas.OUTCOMES
    )
    path = export_csv(evaluate(cases, answers), str(tmp_path))
    assert os.path.basename(path).startswith("eval_report_") and path.endswith(".csv")
    (part,) = glob.glob(f"{path}/part-*")
    with open(part, encoding="utf-8", newline="") as f:
        assert f.read(1) == "\ufeff"
    with open(part, encoding="utf-8-sig", newline="") as f:
        rows = list(csv.DictReader(f))
    assert list(rows[0]) == REPORT_COLUMNS and len(rows) == len(texts)
    assert [r["answer_content"] for r in rows[:9]] == texts[:9]
    assert [r["case_id"] for r in rows] == [f"id{i}" for i in range(len(texts))]
    assert (rows[0]["success_flag"], rows[10]["success_flag"]) == ("True", "False")
    assert (rows[0]["relevance_score"], rows[10]["relevance_score"], rows[10]["total_score"]) == ("100.0", "0", "0")
    assert rows[0]["compute_cost_ms"] == "" and rows[9]["answer_content"] == ""


def test_large_report_is_written_in_ordered_parts(spark, tmp_path, results):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = export_csv(results, str(tmp_path), "r.csv")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    seen = []
    for part in sorted(glob.glob(f"{path}/part-*")):
        with open(part, encoding="utf-8-sig", newline="") as f:
            seen += [r["case_id"] for r in csv.DictReader(f)]
    assert len(glob.glob(f"{path}/part-*")) > 1
    assert seen == [f"id{i}" for i in range(40)]


# ---- Cases -----------------------------------------------------------------------


def test_cases_from_parquet_and_json(spark, tmp_path):
    cases = spark.createDataFrame(CASES, schemas.CASES)
    cases.write.parquet(str(tmp_path / "p"))
    cases.write.json(str(tmp_path / "j"))
    want = [tuple(r) for r in cases.orderBy("case_pos").collect()]
    for name, fmt in (("p", "parquet"), ("j", "json")):
        got = read_cases(spark, str(tmp_path / name), fmt)
        assert [tuple(r) for r in got.orderBy("case_pos").collect()] == want
    for fmt in ("parquet", "json", "yaml"):
        assert read_cases(spark, str(tmp_path / "missing"), fmt).count() == 0


def test_malformed_json_stops_the_read(spark, tmp_path):
    (tmp_path / "bad.json").write_text('{"case_pos": 1\n')
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        read_cases(spark, str(tmp_path / "bad.json"), "json").collect()


def test_odd_yaml_items_are_cases_of_their_own(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "odd.yaml"
    path.write_text("eval_case_list:\n- case_id: 7\n  prompt: 3.5\n  expect_keywords: [1, a, null]\n- just text\n- prompt: p\n  expect_keywords: one\n")
    rows = read_cases(spark, str(path), "yaml", env={}).orderBy("case_pos").collect()
    assert [r.case_pos for r in rows] == [0, 1, 2]
    assert (rows[0].case_id, rows[0].prompt, rows[0].expect_keywords) == ("7", "3.5", ["1", "a", None])
    assert rows[1].prompt is None and rows[2].expect_keywords == ["one"]
    folder = tmp_path / "two"
    folder.mkdir()
    for name in ("a.yaml", "b.yaml"):
        (folder / name).write_text(path.read_text())
    with pytest.raises(ValueError):
        read_cases(spark, str(folder), "yaml")


def test_placeholders_come_from_the_environment(spark, tmp_path, monkeypatch):
    pytest.importorskip("yaml")
    monkeypatch.setenv("CASE_WORD", "hello")
    path = tmp_path / "env.yaml"
    path.write_text("eval_case_list:\n- prompt: say ${CASE_WORD} ${NO_SUCH_NAME}\n")
    assert read_cases(spark, str(path), "yaml").first().prompt == "say hello ${NO_SUCH_NAME}"
    assert read_cases(spark, str(path), "yaml", env={}).first().prompt == "say ${CASE_WORD} ${NO_SUCH_NAME}"


def test_cases_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "cases.yaml"
    path.write_text(
        "eval_case_list:\n"
        "  - case_id: A\n    prompt: 'say ${WORD} ${OTHER}'\n    expect_keywords: ['${WORD}', x]\n"
        "  - case_desc: only\n",
        encoding="utf-8",
    )
    rows = read_cases(spark, str(path), "yaml", env={"WORD": "hi"}).orderBy("case_pos").collect()
    assert tuple(rows[0]) == (0, "A", None, "say hi ${OTHER}", None, ["hi", "x"])
    assert tuple(rows[1]) == (1, None, "only", None, None, None)
    assert read_cases(spark, str(path), "yaml", key_path="other.path").count() == 0
    path.write_text("a: [b", encoding="utf-8")
    assert read_cases(spark, str(path), "yaml").count() == 0


def test_bucketed_tables_join_without_exchange(spark):
    cases = spark.createDataFrame(CASES, schemas.CASES)
    answers = spark.createDataFrame([(i, 0, "some text", "ok", 1.0) for i in range(40)], schemas.OUTCOMES)
    spark.sql("CREATE DATABASE IF NOT EXISTS bucketed")
    write_bucketed(cases, "bucketed.cases", 4)
    write_bucketed(answers, "bucketed.answers", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = evaluate(spark.table("bucketed.cases"), spark.table("bucketed.answers"))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert df.count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_spread_follows_its_argument(spark):
    scan = spark.range(100).coalesce(1)
    assert spread(scan, 3, "id").rdd.getNumPartitions() == 3
    assert spread(scan, None, "id") is scan


# ---- Asking ----------------------------------------------------------------------


def stand_ins():
    """A model and a judge as local functions, which travel to the workers by value."""

    def echo(prompt):
        if prompt == "prompt 3":
            raise RuntimeError("no luck")
        if prompt == "prompt 4":
            return {"code": 2001, "data": None, "msg": "请求超时", "cost_ms": 9.0}
        return {"code": 0, "data": f"{prompt}!", "msg": "ok", "cost_ms": 1.0}

    def judge(prompt):
        reply = '{"level": 0, "reason": "seen %d"}' % len(prompt)
        return {"code": 0, "data": reply, "msg": "ok", "cost_ms": 1.0}

    return echo, judge


def test_asking(spark):
    cases = spark.createDataFrame(CASES + [(40, "n", None, None, "s", []), (41, "m", None, "q", " ", [])], schemas.CASES)
    echo, judge = stand_ins()
    asked = ask_all(cases, echo, concurrent_num=3, judge=judge)
    assert asked.rdd.getNumPartitions() == 3
    answers, judgements = collect_answers(cases, echo, 3, judge, waves=4)
    assert answers.columns == ["case_pos", "code", "data", "msg", "cost_ms"]
    assert answers.count() == 41  # no call without a prompt
    rows = {r.case_pos: r for r in evaluate(cases, answers, judgements).collect()}
    assert rows[0].answer_content == "prompt 0!" and rows[0].hallucination_msg.startswith("seen ")
    assert rows[3].error_msg == "执行异常：no luck" and not rows[3].success_flag
    assert rows[4].error_msg == "请求超时" and rows[4].api_cost_ms == 9.0
    assert rows[40].error_msg == "执行异常：'prompt'"
    assert rows[41].hallucination_level == "未知"
    # The replies are read back from the checkpoint folder.
    plan = answers._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "mapInPandas" not in plan


def test_bad_replies_stay_with_their_case(spark):
    cases = spark.createDataFrame([(i, "c", "d", f"p{i}", "s", []) for i in range(8)], schemas.CASES)

    def ask(prompt):
        ok = {"code": 0, "data": "fine", "msg": "ok", "cost_ms": 1}
        bad = {"p0": None, "p1": {"data": "x"}, "p2": ok | {"data": {"k": ["é"]}}, "p3": ok | {"cost_ms": "soon"}, "p6": ok | {"code": "zero"}}
        return bad.get(prompt, ok)

    def judge(prompt):
        return {"fine": None}.get(prompt) if "fine" in prompt else {"code": 0, "data": 7, "msg": None, "cost_ms": None}

    rows = {r.case_pos: r for r in ask_all(cases, ask, 2, judge).collect()}
    assert len(rows) == 8
    assert [rows[i].code for i in range(8)] == [-1, -1, 0, -1, 0, 0, -1, 0]
    assert rows[2].data == '{"k": ["é"]}' and rows[2].judge_data == "7" and rows[4].judge_code is None
    assert rows[0].msg.startswith("执行异常") and rows[5].data == "fine" and rows[5].cost_ms == 1.0


def test_whole_batch(spark, tmp_path):
    echo, judge = stand_ins()
    cases = spark.createDataFrame(CASES, schemas.CASES)
    store = HistoryStore(spark, "whole")
    run = run_batch(cases, echo, judge=judge, concurrent_num=2, store=store, model_name="m", report_folder=str(tmp_path))
    assert run.summary.first().total == 40 and run.summary.first().success == 38
    row = store.batch(run.batch_id).first()
    assert (row.total_cases, row.success_count, row.model_name) == (40, 38, "m") and row.total_time > 0
    assert store.cases(run.batch_id).count() == 40 and glob.glob(f"{run.report}/part-*")
    recorded = spark.createDataFrame([(i, 0, "some answer", "ok", 1.0) for i in range(40)], schemas.OUTCOMES)
    assert run_batch(cases, answers=recorded).summary.first().success == 40
    with pytest.raises(ValueError):
        run_batch(cases)


def test_details_of_a_hot_batch_spread_over_salts(spark):
    batches = spark.createDataFrame([("hot", "m"), ("cold", "n")], "batch_id string, model_name string")
    details = spark.range(3000).selectExpr("if(id % 3 < 2, 'hot', 'cold') AS batch_id", "id AS case_pos")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = history.with_details(batches, details)
        assert joined.columns == ["batch_id", "model_name", "case_pos"]
        assert joined.where("model_name = 'm'").count() == 2000 and joined.count() == 3000
        # Without adaptive execution, partitions are as the salted join deals them.
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = history.with_details(batches, details)
        parts = joined.where("model_name = 'm'").groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
        assert max(r["count"] for r in parts) < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


# ---- Rules -----------------------------------------------------------------------


def test_rules_defaults_and_sections():
    assert Rules.from_mapping({}) == Rules() == Rules.from_mapping(None)
    tree = {
        "sensitive_words": ["x", "${SECRET}", "${NONE}"],
        "validity": {"min_length": 9},
        "score_weight": {"compliance": 0.5},
        "hallucination": {"whitelist": ["w"], "high_risk_threshold": 8},
    }
    rules = Rules.from_mapping(tree, {"SECRET": "${x}"})
    assert rules.sensitive_words == ("x", "${x}", "${NONE}") and rules.min_length == 9
    assert rules.weight_compliance == 0.5 and rules.weight_relevance == 0.4
    assert rules.whitelist == ("w",) and rules.high_risk_threshold == 8 and rules.low_risk_threshold == 3


def test_rules_files(tmp_path):
    (tmp_path / "r.json").write_text('{"validity": {"max_repeat_rate": 0.5}}')
    assert Rules.from_file(str(tmp_path / "r.json")).max_repeat_rate == 0.5
    pytest.importorskip("yaml")
    (tmp_path / "r.yaml").write_text("validity:\n  max_continuous_repeat: 4\n")
    assert Rules.from_file(str(tmp_path / "r.yaml")).max_continuous_repeat == 4


def test_nested_placeholders():
    assert fill_placeholders({"a": ["${X}-${Y}", 3], "b": None}, {"X": "1"}) == {"a": ["1-${Y}", 3], "b": None}
