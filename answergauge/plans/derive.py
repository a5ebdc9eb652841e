"""Cases, answers, judgements, call logs and history that Spark derives from the given tables.

Every derivation is row-local and keeps whole tables and whole texts. Some sources get a defect (no
prompt, no standard answer, a failed call, ...) so that every branch of the grading has rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge import texts
from answergauge.functions.text import HAN, round2
from answergauge.operators.layout import spread
from answergauge.rules import Rules

DOC_RULES = Rules(
    sensitive_words=("worthless", "der die", " the ", "Von", "schst"),
    whitelist=("Than", "than", "para", "pour", "der", "die"),
)
# Banned words by rule, far more than fit into a plan as single searches.
LONG_LIST = tuple(a + b for a in ("th", "en", "qu", "sch", "ción", "é", "St", " a") for b in "abcdefghijklmnopqrstuvwxyzäéñ")
STAMP = "2024-02-01 08:00:00"
KEYWORDS = ("the", "der", "que", "of the", "und die", "la", "a", "; ")

# A conversation's id and turn in one ordered number; overflow stops the query.
TURNS_PER_CONVERSATION = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Session setting: into how many partitions the documents are dealt, for files that cannot be split.
PARTITIONS = "spark.answergauge.partitions"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of the documents. Unlike the other tables they are long, and costly per row."""
    given = spark.conf.get(PARTITIONS, None)
    return spread(table(spark, sf_dir, "documents").select(*columns), int(given) if given else None, "doc_id")


# Lower-case letters and the Han characters that stand in for them, chosen so that stop words occur.
LATIN_LETTERS = "abcdefghijklmnopqrst"
HAN_LETTERS = "大因以为的可能们这所由也系个一种过是在我"


# Words that occur in those texts, one the beginning of another.
LEXICON = ("可能", "这所", "可能为", "种过是", "个一", "大因", "们由")


def han_texts(docs: DataFrame) -> DataFrame:
    """The documents with most letters replaced by Han characters."""
    return docs.select("doc_id", F.translate("text", LATIN_LETTERS, HAN_LETTERS).alias("text"))


def han_lexicon(benchmark: DataFrame) -> DataFrame:
    """Words with frequencies: the runs of Han characters that the items have after the same replacement, the first two
    characters of each and its last three, so that words overlap."""
    items = benchmark.select(F.translate("text", LATIN_LETTERS, HAN_LETTERS).alias("text"))
    runs = items.select(F.explode(F.regexp_extract_all("text", F.lit(f"[{HAN}]+"), F.lit(0))).alias("run"))
    words = runs.select(F.explode(F.array("run", F.left("run", F.lit(2)), F.right("run", F.lit(3)))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("freq"))


def banned_list(benchmark: DataFrame) -> DataFrame:
    """Every word of the items and every two neighbours, numbered by where they come first."""
    words = benchmark.select("item_id", F.split("text", "[ \n]").alias("ws"))
    singles = F.transform("ws", lambda w, i: F.struct((i * 2).alias("at"), w.alias("word")))
    pairs = F.transform(
        F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0))),
        lambda w, i: F.struct((i * 2 + 1).alias("at"), F.concat(F.element_at("ws", i + 1), F.lit(" "), w).alias("word")),
    )
    listed = words.select("item_id", F.inline(F.concat(singles, pairs)))
    place = F.min(F.col("item_id") * F.lit(TURNS_PER_CONVERSATION) + F.col("at")).alias("pos")
    return listed.groupBy("word").agg(place).select("pos", "word")


def _without_words_with(text: Column, letters: str) -> Column:
    return F.regexp_replace(text, rf"(?<![^ \n])[^ \n{letters}]*+[{letters}][^ \n]*+", "")


def doc_cases(docs: DataFrame, *keep: str) -> DataFrame:
    """A case per document. Its standard answer is the document without the words that have a certain
    letter, so documents differ from it by nothing, by a little or by a lot."""
    text, source, lang = F.col("text"), F.col("source"), F.col("lang")
    standard = (
        F.when(source == "src3", None)
        .when(source == "src5", _without_words_with(text, "sSrRtT"))
        .when(lang == "en", _without_words_with(text, "mM"))
        .when(lang == "fr", _without_words_with(text, "aA"))
        .otherwise(_without_words_with(text, "cC"))
    )
    return docs.select(
        F.col("doc_id").alias("case_pos"),
        F.when(source != "src4", F.concat(F.lit("doc_"), "doc_id")).alias("case_id"),
        F.when(source != "src11", F.concat(lang, F.lit("/"), source)).alias("case_desc"),
        F.when(source != "src6", F.concat(F.lit("Write in "), lang, F.lit(" for "), source)).alias("prompt"),
        standard.alias("standard_answer"),
        F.when(source != "src7", F.array(*[F.lit(k) for k in KEYWORDS])).alias("expect_keywords"),
        F.concat(F.lit("batch_"), source).alias("batch_id"),
        *keep,
    )


def doc_answers(docs: DataFrame) -> DataFrame:
    """The outcome of asking for each document: mostly the document."""
    source = F.col("source")
    code = F.when(source == "src8", texts.TIMEOUT).when(source == "src9", texts.BODY_NOT_JSON).otherwise(0)
    return docs.select(
        F.col("doc_id").alias("case_pos"),
        code.alias("code"),
        F.when(~source.isin("src8", "src10"), F.col("text")).alias("data"),
        F.when(code == 0, "ok").otherwise(F.concat(F.lit("failed with "), code)).alias("msg"),
        # Some calls take long enough for a number that Spark writes with an exponent.
        (F.col("n_chars") * F.when(source == "src1", 20000.0).otherwise(0.5)).alias("cost_ms"),
    )


# Judge replies, picked by the length of the document: accepted ones, then rejected ones.
REPLIES = (
    '{"level": 1, "reason": "@"}',
    '{"level": true, "reason": "@"}',
    '{"level": 1.0}',
    '{"level": 0, "reason": "@"}',
    '{"level": 2, "reason": null}',
    ' {"reason": "@", "level": 3} ',
    '{"level": "1", "reason": "@"}',
    '{"level": 1.5}',
    '{"level": 5, "reason": "@"}',
    '{"level": null}',
    '{"level": 2, "reason": "@"} as asked',
    '{"level": 2, "reason": "@"} and {x}',
    '{"level": 0}{"level": 3}',
    '{"level": 2}, {"level": 1}',
    '{"level": 2}, "y": {"level": 1}',
    '[{"level": 2}]',
    "{}",
    "level 2",
)


def doc_judgements(docs: DataFrame) -> DataFrame:
    pick = F.element_at(F.array(*[F.lit(r) for r in REPLIES]), (F.col("n_chars") % len(REPLIES)).cast("int") + 1)
    return docs.select(
        F.col("doc_id").alias("case_pos"),
        F.when(F.col("source") == "src12", texts.HTTP_ERROR).otherwise(0).alias("code"),
        F.replace(pick, F.lit("@"), F.concat("lang", F.lit(" "), "source")).alias("data"),
    )


def _turn_key(turn: Column) -> Column:
    return F.col("conv_id") * F.lit(TURNS_PER_CONVERSATION) + turn


def chat_cases(turns: DataFrame) -> DataFrame:
    """A case per user turn: the answer should take up every word of the prompt."""
    return turns.where(F.col("role") == "user").select(
        _turn_key(F.col("turn")).alias("case_pos"),
        F.concat_ws("-", "conv_id", "turn").alias("case_id"),
        F.lit(None).cast("string").alias("case_desc"),
        F.col("text").alias("prompt"),
        F.lit(None).cast("string").alias("standard_answer"),
        F.split("text", " ").alias("expect_keywords"),
    )


def chat_answers(turns: DataFrame) -> DataFrame:
    """The assistant turn right after a user turn answers it. The key is unique per turn, so a long
    conversation spreads over all partitions."""
    return turns.where(F.col("role") == "assistant").select(
        _turn_key(F.col("turn") - 1).alias("case_pos"),
        F.lit(0).alias("code"),
        F.col("text").alias("data"),
        F.lit("ok").alias("msg"),
        F.length("text").cast("double").alias("cost_ms"),
    )


def reply_bodies(turns: DataFrame) -> DataFrame:
    """A raw reply body per turn: an answer, an answer of null, a body without one, or one with a tail."""
    text, turn = F.col("text"), F.col("turn")
    answer = F.to_json(
        F.struct(F.array(F.struct(F.struct(text.alias("content")).alias("message"))).alias("choices"))
    )
    body = (
        F.when(F.col("role") == "system", text)
        .when(F.col("role") == "assistant", answer)
        .when(turn == 0, F.to_json(F.struct(F.array().cast("array<string>").alias("choices"), text.alias("note"))))
        .when(turn == 2, '{"choices":[{"message":{"content":null}}]}')
        .when(turn == 4, '{"choices":[{"message":{}}]}')
        .when(turn == 6, F.concat(answer, F.lit(" oops")))
        .when(turn == 8, F.concat(answer, answer))
        .when(turn == 10, F.concat(answer, F.lit(" and {x}")))
        .otherwise('{"error":"busy"}')
    )
    return turns.select("conv_id", "turn", body.alias("body"))


def attempts(events: DataFrame) -> DataFrame:
    """A call log: three attempts per request, each an event that took ``value`` hundredths of a second."""
    kind = F.col("event_type")
    micros = F.round(F.col("value") * 10000).cast("bigint")
    started = F.col("ts").cast("timestamp")
    body = F.when(kind == "click", F.concat(
        F.lit('{"choices":[{"message":{"content":"user '), "user_id", F.lit('"}}]}')
    )).otherwise(F.col("props"))
    return events.select(
        F.expr("event_id div 3").alias("request_id"),
        (F.col("event_id") % 3).cast("int").alias("attempt_no"),
        F.when(kind == "error", "timeout").when(kind == "view", "connect").when(kind == "signup", "other")
        .alias("error_kind"),
        F.when(kind == "click", 200).when(kind == "purchase", F.when(F.col("value") > 50, 500).otherwise(200))
        .alias("http_status"),
        body.alias("body"),
        F.when(kind == "signup", "bad handshake").when(kind == "purchase", "500 Server Error").alias("error_text"),
        started.alias("started_at"),
        F.timestamp_micros(F.unix_micros(started) + micros).alias("ended_at"),
    )


def history_details(events: DataFrame) -> DataFrame:
    """Stored result rows: a batch per user, a case per event."""
    kind, value = F.col("event_type"), F.col("value")
    level = F.when(kind == "view", "无").when(kind == "click", "低").when(kind == "purchase", "中").otherwise("高")
    ok = kind != "error"
    nothing = F.lit(None).cast("string")
    return events.select(
        F.concat(F.lit("batch_"), "user_id").alias("batch_id"),
        F.col("event_id").alias("case_pos"),
        F.concat_ws("_", kind, "event_id").alias("case_id"),
        kind.alias("case_desc"),
        F.concat(F.lit("Explain "), kind).alias("prompt"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("execute_timestamp"),
        nothing.alias("thread_id"),
        value.alias("api_cost_ms"),
        nothing.cast("double").alias("compute_cost_ms"),
        nothing.cast("double").alias("request_cost_ms"),
        F.when(ok, F.col("props")).otherwise("").alias("answer_content"),
        ok.alias("success_flag"),
        F.when(ok, "").otherwise("请求超时").alias("error_msg"),
        (ok & (value > 5)).alias("is_valid"),
        (ok & (value < 150)).alias("is_compliant"),
        F.lit("").alias("validity_msg"),
        F.lit("").alias("compliance_msg"),
        F.when(ok, F.least(value, F.lit(100.0))).otherwise(0.0).alias("total_score"),
        F.when(ok, round2(F.least(value, F.lit(100.0)) / 2)).otherwise(0.0).alias("relevance_score"),
        F.when(ok, round2(F.least(value, F.lit(100.0)) / 3)).otherwise(0.0).alias("completeness_score"),
        F.when(ok, level).otherwise("").alias("hallucination_level"),
        F.lit("").alias("hallucination_msg"),
    )
