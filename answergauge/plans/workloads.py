"""Every operator as a query over the given tables: ``(spark, folder) -> DataFrame``."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge import texts
from answergauge.functions import calls, scoring, validity
from answergauge.functions.text import fill_placeholders, round2, strip, tokens
from answergauge.operators.ask import ask_all
from answergauge.operators.attempt_log import AttemptLog, ask_with_retries
from answergauge.operators.attempts import call_outcomes, final_attempts, slow_calls
from answergauge.operators.changes import model_changes
from answergauge.operators.evaluate import (
    add_scores, add_tokens, add_validity, evaluate, judge_prompts, with_case_defaults,
)
from answergauge.operators.layout import materialised, shared_path
from answergauge.operators.segment import han_segments, segmented_tokens
from answergauge.operators.summarise import COUNTERS, batch_rows, count_results, summarise, summary_records, summary_rollup
from answergauge.operators.word_list import listed_words, word_table
from answergauge.plans import derive
from answergauge.rules import Rules
from answergauge.sources import history
from answergauge.sources.cases import read_cases
from answergauge.sources.report import report_rows

Query = Callable[[SparkSession, str], DataFrame]

BATCH = "batch_7"
PLACEHOLDERS = {"view": "VIEW", "click": "${purchase}", "purchase": "bought", "region-1": "north"}


def _joined(words: Column) -> Column:
    return F.array_join(F.sort_array(words), " ")


# ---- Answers by themselves -------------------------------------------------------


def q_tokens(spark, sf):
    docs = derive.documents(spark, sf, "doc_id", "text")
    found = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    return found.select("doc_id", F.size("words").alias("n_tokens"), _joined(F.col("words")).alias("tokens"))


def q_han_tokens(spark, sf):
    docs = derive.han_texts(derive.documents(spark, sf, "doc_id", "text"))
    found = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    return found.select("doc_id", F.size("words").alias("n_tokens"), _joined(F.col("words")).alias("tokens"))


def q_lexicon_tokens(spark, sf):
    docs = derive.han_texts(derive.documents(spark, sf, "doc_id", "text"))
    found = docs.select("doc_id", tokens(F.col("text"), derive.LEXICON).alias("words"))
    return found.select("doc_id", F.size("words").alias("n_tokens"), _joined(F.col("words")).alias("tokens"))


def q_han_segments(spark, sf):
    docs = derive.han_texts(derive.documents(spark, sf, "doc_id", "text"))
    lexicon = derive.han_lexicon(derive.table(spark, sf, "benchmark"))
    return han_segments(docs, lexicon, ["doc_id"]).select(
        "doc_id", F.size("runs").alias("n_runs"), F.array_join("runs", "/").alias("segments")
    )


def q_segmented_tokens(spark, sf):
    docs = derive.han_texts(derive.documents(spark, sf, "doc_id", "text"))
    lexicon = derive.han_lexicon(derive.table(spark, sf, "benchmark"))
    found = segmented_tokens(docs, lexicon, ["doc_id"])
    return found.select("doc_id", F.size("tokens").alias("n_tokens"), _joined(F.col("tokens")).alias("tokens"))


def q_validity_blank_len(spark, sf):
    rules = Rules(min_length=50, max_repeat_rate=1.0, max_continuous_repeat=1_000_000)
    docs = derive.documents(spark, sf, "doc_id", "text").withColumn("_s", strip(F.col("text")))
    nothing = F.lit(None)
    run = F.lit(None).cast("struct<times: int, phrase: string>")
    msg = validity.validity_msg(F.col("_s"), nothing.cast("double"), run, rules)
    return docs.select("doc_id", F.length("_s").alias("stripped_chars"), msg.alias("validity_msg"))


def q_char_repeat(spark, sf):
    docs = derive.documents(spark, sf, "doc_id", "text").withColumn("_s", strip(F.col("text")))
    share = F.when(F.col("_s") != "", validity.top_char_share(F.col("_s")))
    fast = F.when(F.col("_s") != "", validity.top_char_share_above(F.col("_s"), 0.7))
    return docs.select(
        "doc_id", share.alias("top_share"), F.coalesce(fast > 0.7, F.lit(False)).alias("is_repetitive")
    )


def q_phrase_repeat(spark, sf):
    docs = derive.documents(spark, sf, "doc_id", "text").withColumn("_s", strip(F.col("text")))
    run = validity.longest_phrase_run(F.col("_s"), (2, 3, 4), 2)
    return docs.select("doc_id", run.alias("_run")).select(
        "doc_id", F.col("_run.times").alias("times"), F.col("_run.phrase").alias("phrase")
    )


def _checked(spark, sf):
    docs = derive.documents(spark, sf, "doc_id", "text")
    return add_validity(docs, derive.DOC_RULES, "text")


def q_validity(spark, sf):
    return _checked(spark, sf).select("doc_id", "is_valid", "validity_msg")


def q_compliance(spark, sf):
    return _checked(spark, sf).select("doc_id", "is_compliant", "compliance_msg")


def _listed(spark, sf, words):
    docs = derive.documents(spark, sf, "doc_id", "text")
    found = listed_words(docs, words, ["doc_id"])
    return found.select("doc_id", validity.compliance_msg(F.col("found"), Rules(), True).alias("compliance_msg"))


def q_compliance_long_list(spark, sf):
    return _listed(spark, sf, word_table(spark, derive.LONG_LIST))


def q_compliance_word_table(spark, sf):
    return _listed(spark, sf, derive.banned_list(derive.table(spark, sf, "benchmark")))


# ---- Answers against cases -------------------------------------------------------


def _docs(spark, sf):
    """By key: cases and answers, both derived from these rows, then share one exchange of the texts."""
    return derive.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").repartition("doc_id")


def _unjoined(spark, sf):
    """The same where nothing is joined, so nothing need be shuffled."""
    return derive.documents(spark, sf, "doc_id", "text", "lang", "source", "n_chars")


def _scored(spark, sf):
    """Cases graded next to their text; nothing to join."""
    cases = with_case_defaults(derive.doc_cases(_unjoined(spark, sf), "text"))
    return add_scores(cases, derive.DOC_RULES, "text")


def q_case_defaults(spark, sf):
    return with_case_defaults(derive.doc_cases(_unjoined(spark, sf))).select(
        "case_pos", "case_id", "case_desc", "prompt", F.length("standard_answer").alias("standard_chars"),
        F.array_join("expect_keywords", "|").alias("keywords"),
    )


def q_relevance(spark, sf):
    return _scored(spark, sf).select("case_pos", "relevance_score")


def q_completeness(spark, sf):
    return _scored(spark, sf).select("case_pos", "completeness_score")


def q_unsupported_terms(spark, sf):
    cases = with_case_defaults(derive.doc_cases(_unjoined(spark, sf), "text"))
    found = add_tokens(cases, derive.DOC_RULES, "text").select(
        "case_pos",
        F.size("_answer_tokens").alias("n_answer"),
        scoring.unsupported(F.col("_answer_only"), derive.DOC_RULES).alias("_extra"),
    )
    return found.select(
        "case_pos",
        F.size("_extra").alias("n_extra"),
        scoring.extra_ratio(F.size("_extra"), F.col("n_answer")).alias("extra_ratio"),
        _joined(F.col("_extra")).alias("extra_terms"),
    )


def q_risk_level(spark, sf):
    scored = _scored(spark, sf)
    worth = scoring.level_score(F.col("hallucination_level"))
    return scored.select("case_pos", "hallucination_level", worth.alias("level_score"))


def q_risk_message(spark, sf):
    return _scored(spark, sf).select("case_pos", "hallucination_msg")


def q_total_score(spark, sf):
    return _scored(spark, sf).select("case_pos", "total_score")


def results(spark: SparkSession, sf: str, judged: bool = False) -> DataFrame:
    """The full grading of the document cases, with the batch each belongs to."""
    docs = _docs(spark, sf)
    return evaluate(
        derive.doc_cases(docs),
        derive.doc_answers(docs),
        derive.doc_judgements(docs) if judged else None,
        derive.DOC_RULES,
        derive.STAMP,
        keep=["batch_id"],
    )


def q_results(spark, sf):
    return results(spark, sf)


def q_chat_results(spark, sf):
    turns = derive.table(spark, sf, "conversations")
    return evaluate(
        derive.chat_cases(turns), derive.chat_answers(turns), execute_timestamp=derive.STAMP
    )


def q_judge_prompt(spark, sf):
    docs = _docs(spark, sf)
    return judge_prompts(derive.doc_cases(docs), derive.doc_answers(docs))


def q_judge_override(spark, sf):
    return results(spark, sf, judged=True).select(
        "case_pos", "hallucination_level", "hallucination_msg", "total_score"
    )


# ---- Model calls -----------------------------------------------------------------


def q_request_body(spark, sf):
    turns = derive.table(spark, sf, "conversations")
    body = calls.request_body(F.col("text"), "some-model")
    return turns.select("conv_id", "turn", body.alias("request_body"))


def q_reply_body(spark, sf):
    bodies = derive.reply_bodies(derive.table(spark, sf, "conversations"))
    parsed = bodies.select("conv_id", "turn", calls.parse_body(F.col("body")).alias("_o"))
    return parsed.select("conv_id", "turn", "_o.code", "_o.data", "_o.msg")


def q_attempt_final(spark, sf):
    return final_attempts(derive.attempts(derive.table(spark, sf, "events"))).select(
        "request_id", "attempt_no", "error_kind", "http_status", "cost_ms"
    )


def q_outcome_code(spark, sf):
    outcomes = call_outcomes(derive.attempts(derive.table(spark, sf, "events")), max_retry=2)
    return outcomes.select("case_pos", "code", "data", "msg")


def q_slow_calls(spark, sf):
    return slow_calls(derive.attempts(derive.table(spark, sf, "events")), max_retry=2, slow_ms=1000)


def q_generate_answers(spark, sf):
    """Ask a stand-in for a model, whose replies can be checked, about every user turn."""

    def ask(prompt: str) -> dict:
        return {"code": 0, "data": f"You said: {prompt}", "msg": "ok", "cost_ms": float(len(prompt))}

    cases = derive.chat_cases(derive.table(spark, sf, "conversations"))
    return ask_all(cases, ask, concurrent_num=3).select("case_pos", "code", "data", "msg", "cost_ms")


def q_ask_with_retries(spark, sf):
    """Ask a stand-in about every user turn. Some requests time out once, some always, some are turned away or raise."""

    def send(body: str, attempt_no: int) -> dict:
        prompt = json.loads(body)["messages"][0]["content"]
        kind = len(prompt) % 7
        if kind < 3 and attempt_no < kind:
            return {"error_kind": "timeout" if attempt_no else "connect"}
        if kind == 3:
            return {"error_kind": "timeout"}
        if kind == 4:
            return {"status": 503, "body": f"busy with {prompt}", "error_text": "503 Server Error"}
        if kind == 5:
            return {"error_kind": "other", "error_text": "bad handshake"}
        return {"status": 200, "body": json.dumps({"choices": [{"message": {"content": f"{attempt_no} {prompt}"}}]})}

    cases = derive.chat_cases(derive.table(spark, sf, "conversations"))
    log = AttemptLog(spark)
    outcomes = ask_with_retries(cases, send, log, "some-model", concurrent_num=8, max_retry=2, wait_seconds=0.0)
    tries = log.read().groupBy("request_id").agg(F.count("*").alias("tries"))
    joined = outcomes.join(tries, F.col("case_pos") == F.col("request_id"))
    return joined.select("case_pos", "tries", "code", "data", "msg")


def q_numbered_cases(spark, sf):
    """Cases without numbers in several files, read back in the order of files and lines."""
    cases = derive.chat_cases(derive.table(spark, sf, "conversations"))
    folder = shared_path(spark)
    in_order = cases.repartitionByRange(5, "case_pos").sortWithinPartitions("case_pos")
    in_order.drop("case_pos").write.json(folder)
    read = read_cases(spark, folder, "json", env={}, numbered=True)
    return read.select("case_pos", "case_id", "prompt", F.array_join("expect_keywords", "|").alias("keywords"))


def q_placeholders(spark, sf):
    events = derive.table(spark, sf, "events")
    text = F.concat(
        F.lit("user "), "user_id", F.lit(" did ${"), "event_type", F.lit("} in ${region-1} for $"), "value",
        F.lit(" ${"), "props",
    )
    return events.select("event_id", fill_placeholders(text, PLACEHOLDERS).alias("filled"))


# ---- Statistics ------------------------------------------------------------------


def _by_batch(spark, sf):
    return summarise(results(spark, sf), by=["batch_id"], total_time=F.length("batch_id") * F.lit(1.37))


def q_summary_counts(spark, sf):
    return _by_batch(spark, sf).select(
        "batch_id", "total", "success", "failed", "success_rate", "total_time", "avg_time_per_case"
    )


def q_summary_scores(spark, sf):
    return _by_batch(spark, sf).select(
        "batch_id", *[F.col(f"avg_score.{n}").alias(f"avg_{n}") for n in ("total", "relevance", "completeness")]
    )


def _level_columns() -> list[Column]:
    return [
        F.col(f"hallucination_dist.{n}.{part}").alias(f"{n}_{part}")
        for n in texts.SUMMARY_LEVELS
        for part in ("count", "ratio")
    ]


def q_summary_levels(spark, sf):
    return _by_batch(spark, sf).select("batch_id", *_level_columns())


def q_summary_pass_rates(spark, sf):
    return _by_batch(spark, sf).select(
        "batch_id",
        F.col("validate_pass_rate.valid").alias("valid_rate"),
        F.col("validate_pass_rate.compliant").alias("compliant_rate"),
    )


def q_summary(spark, sf):
    """The one summary over all cases, its nested fields side by side."""
    return summarise(results(spark, sf), total_time=123.45).select(
        "total", "success", "failed", "success_rate",
        *[F.col(f"avg_score.{n}").alias(f"avg_{n}") for n in ("total", "relevance", "completeness")],
        *_level_columns(),
        F.col("validate_pass_rate.valid").alias("valid_rate"),
        F.col("validate_pass_rate.compliant").alias("compliant_rate"),
        "total_time", "avg_time_per_case",
    )


# ---- History and report ----------------------------------------------------------


def _details(spark, sf):
    return derive.history_details(derive.table(spark, sf, "events"))


def _batches(spark, sf):
    """The batch rows of the stored details. Each batch ran when its last case did."""
    # As a timestamp the maximum has a fixed-width buffer and the aggregate stays a hash aggregate.
    ran = F.max(F.col("execute_timestamp").cast("timestamp_ntz")).alias("ran")
    seconds = F.length("batch_id") * F.lit(2.5)
    summary = summarise(_details(spark, sf), by=["batch_id"], total_time=seconds, also=[ran])
    return batch_rows(summary, F.concat(F.lit("model of "), "batch_id"), F.col("ran").cast("string"))


def q_batch_latest(spark, sf):
    return history.latest_batches(_batches(spark, sf), 10)


def q_batch_by_id(spark, sf):
    return history.batch_by_id(_batches(spark, sf), BATCH)


def q_batch_cases(spark, sf):
    return history.batch_cases(_details(spark, sf), BATCH)


def q_batch_details(spark, sf):
    joined = history.with_details(_batches(spark, sf), _details(spark, sf))
    return joined.select("batch_id", "execute_time", "case_pos", "case_id", "total_score", "avg_total_score")


def q_batch_delete(spark, sf):
    return history.without_batch(_batches(spark, sf), BATCH)


def q_details_delete(spark, sf):
    """Some rows have no batch id; they stay."""
    details = _details(spark, sf).withColumn("batch_id", F.when(F.col("case_desc") != "view", F.col("batch_id")))
    return history.without_batch(details, BATCH).select("batch_id", "case_pos", "total_score")


def _two_runs(spark, sf):
    """Two runs of one suite. The later one lacks some cases, has others anew, and scores differently."""
    details = _details(spark, sf)
    old = details.where("case_desc <> 'signup'").withColumn("batch_id", F.lit("old"))
    raised = F.when(F.col("total_score") > 50, "低").otherwise(F.col("hallucination_level"))
    new = details.where("case_desc <> 'error'").withColumns(
        {
            "batch_id": F.lit("new"),
            "total_score": F.col("relevance_score"),
            "relevance_score": F.col("total_score"),
            "hallucination_level": raised,
        }
    )
    return old.unionByName(new)


def q_compare_batches(spark, sf):
    return history.compare_batches(_two_runs(spark, sf), "old", "new")


def q_regression_verdict(spark, sf):
    return history.regression_verdict(_two_runs(spark, sf), "old", "new")


def q_model_trend(spark, sf):
    """Batches of ten models, in order of execution."""
    models = F.concat(F.lit("model "), F.right("batch_id", F.lit(1)))
    return history.model_trend(_batches(spark, sf).withColumn("model_name", models))


LEVEL_SHIFT = "2024-01-30 16:30:00"


def q_model_changes(spark, sf):
    """Two models, of which the second scores half from one moment on."""
    odd = F.right("batch_id", F.lit(1)).cast("int") % 2
    score = F.col("avg_total_score")
    shifted = F.when((odd == 1) & (F.col("execute_time") >= LEVEL_SHIFT), round2(score / 2)).otherwise(score)
    batches = _batches(spark, sf).withColumns(
        {"model_name": F.concat(F.lit("model "), odd.cast("string")), "avg_total_score": shifted}
    )
    return model_changes(batches)


def q_summary_rollup(spark, sf):
    """Batch rows are stored with their counters, then rolled up from those alone."""
    ran = F.max(F.col("execute_timestamp").cast("timestamp_ntz")).alias("ran")
    counted = count_results(_details(spark, sf), ["batch_id"], [ran])
    keep = ["_also.ran", F.struct(*COUNTERS).alias("counters")]
    summary = summary_records(counted, ["batch_id"], F.length("batch_id") * F.lit(2.5), keep)
    model = F.concat(F.lit("model "), F.right("batch_id", F.lit(1)))
    rows = batch_rows(summary, model, F.col("ran").cast("string"))
    stored = materialised(rows.withColumn("day", F.left("execute_time", F.lit(10))))
    return summary_rollup(stored).select(
        "level", "model_name", "day", "batch_id", "n_batches", "n_uncounted", "total", "success", "failed", "success_rate",
        *[F.col(f"avg_score.{n}").alias(f"avg_{n}") for n in ("total", "relevance", "completeness")],
        *_level_columns(),
        F.col("validate_pass_rate.valid").alias("valid_rate"),
        F.col("validate_pass_rate.compliant").alias("compliant_rate"),
        "total_time", "avg_time_per_case",
    )


def q_batch_list_view(spark, sf):
    return history.list_view(_batches(spark, sf), 25)


def q_batch_detail_view(spark, sf):
    return history.detail_view(_batches(spark, sf), BATCH)


def q_case_overview(spark, sf):
    return history.case_overview(_details(spark, sf), BATCH)


def q_csv_rows(spark, sf):
    return report_rows(results(spark, sf))


def all_queries() -> dict[str, Query]:
    return {name[2:]: f for name, f in globals().items() if name.startswith("q_")}
