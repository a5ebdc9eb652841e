"""Cases and recorded answers in, one full result row per case out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge import schemas, texts
from answergauge.functions import scoring, validity
from answergauge.functions.judge import judge_prompt, judge_verdict, parse_reply
from answergauge.functions.text import is_blank, strip, tokens
from answergauge.operators.segment import add_segmented_tokens
from answergauge.operators.word_list import listed_words
from answergauge.rules import Rules

# Columns that each grading step adds, for callers who want only some of them.
VALIDITY_COLUMNS = ["is_valid", "is_compliant", "validity_msg", "compliance_msg"]
SCORE_COLUMNS = [
    "total_score", "relevance_score", "completeness_score", "hallucination_level", "hallucination_msg",
]


def with_case_defaults(cases: DataFrame) -> DataFrame:
    """Fill what a case may leave out. A missing prompt stays NULL; it makes the case fail."""
    return cases.withColumns(
        {
            "case_id": F.coalesce("case_id", F.lit(texts.UNKNOWN_CASE_ID)),
            "case_desc": F.coalesce("case_desc", F.lit(texts.UNKNOWN_CASE_DESC)),
            "standard_answer": F.coalesce("standard_answer", F.lit("")),
            "expect_keywords": F.coalesce("expect_keywords", F.array().cast("array<string>")),
        }
    )


def add_validity(
    df: DataFrame, rules: Rules, content: str = "answer_content", banned: DataFrame | None = None, key: str = "case_pos"
) -> DataFrame:
    """Add the two validity and the two compliance columns for a text column. ``banned``, a table of ``pos`` and ``word``,
    takes the place of the rules' list of banned words; the rows then need a unique ``key``."""
    work = df.withColumn("_stripped", strip(F.col(content)))
    parts = validity.validity_parts(F.col("_stripped"), rules)
    if banned is None:
        parts["_banned"] = validity.banned_words(F.col(content), rules)
    else:
        found = listed_words(df, banned, [key], content).select(F.col(key).alias("_of"), F.col("found").alias("_banned"))
        work = work.join(found, F.col(key).eqNullSafe(F.col("_of")), "left").drop("_of")
    work = work.withColumns(parts)
    msg = validity.validity_msg(F.col("_stripped"), F.col("_char_share"), F.col("_phrase_run"), rules)
    work = work.withColumns(
        {"validity_msg": msg, "compliance_msg": validity.compliance_msg(F.col("_banned"), rules, banned is not None or None)}
    )
    return work.withColumns(
        {
            "is_valid": validity.is_valid(F.col("validity_msg")),
            "is_compliant": validity.is_compliant(F.col("compliance_msg")),
        }
    ).drop("_stripped", "_char_share", "_phrase_run", "_banned")


def add_tokens(
    df: DataFrame, rules: Rules, content: str = "answer_content", lexicon: DataFrame | None = None
) -> DataFrame:
    """Project every token set once; all scores read these columns. With a ``lexicon``, a table of ``word`` and ``freq``,
    Han text is segmented by probability; the rows then need a unique ``case_pos``."""
    if lexicon is not None:
        return add_segmented_tokens(df, lexicon, content)
    return df.withColumns(
        {
            "_answer_tokens": F.coalesce(tokens(F.col(content), rules.lexicon), F.array().cast("array<string>")),
            "_standard_tokens": tokens(F.col("standard_answer"), rules.lexicon),
            "_keyword_tokens": scoring.keyword_tokens(F.col("expect_keywords"), rules.lexicon),
        }
    ).withColumn("_answer_only", F.array_except("_answer_tokens", "_standard_tokens"))


def add_scores(
    df: DataFrame, rules: Rules, content: str = "answer_content", lexicon: DataFrame | None = None
) -> DataFrame:
    """Add the five score columns. Invalid and non-compliant answers are scored like all others."""
    text, standard = F.col(content), F.col("standard_answer")
    work = add_tokens(df, rules, content, lexicon).withColumns(
        {
            "_n_answer": F.size("_answer_tokens"),
            "_n_standard": F.size("_standard_tokens"),
            "_n_common": F.size("_answer_tokens") - F.size("_answer_only"),
            "_extra": scoring.unsupported(F.col("_answer_only"), rules),
            "relevance_score": scoring.relevance(
                text, F.col("expect_keywords"), F.col("_keyword_tokens"), F.col("_answer_tokens")
            ),
        }
    )
    work = work.withColumns(
        {
            "_n_extra": F.size("_extra"),
            "_ratio": scoring.extra_ratio(F.size("_extra"), F.col("_n_answer")),
            "completeness_score": scoring.completeness(
                text, standard, F.col("_n_answer"), F.col("_n_standard"), F.col("_n_common")
            ),
        }
    )
    work = work.withColumn(
        "hallucination_level",
        scoring.risk_level(text, standard, F.col("_n_extra"), F.col("_ratio"), rules),
    )
    level = F.col("hallucination_level")
    work = work.withColumns(
        {
            "hallucination_msg": scoring.risk_msg(
                text, level, F.col("_extra"), F.col("_n_extra"), F.col("_ratio")
            ),
            "total_score": scoring.total_score(
                F.col("relevance_score"), F.col("completeness_score"), level, rules
            ),
        }
    )
    return work.drop(*[c for c in work.columns if c.startswith("_") and c not in df.columns])


def judge_prompts(cases: DataFrame, answers: DataFrame, template: str = texts.JUDGE_TEMPLATE) -> DataFrame:
    """The prompt for the judge, for every case that has a prompt and a standard answer to judge by."""
    joined = with_case_defaults(cases).join(answers.select("case_pos", "data"), "case_pos", "left")
    prompt = judge_prompt(F.col("standard_answer"), F.col("data"), template)
    asked = joined.where(F.col("prompt").isNotNull() & ~is_blank(F.col("standard_answer")))
    return asked.select("case_pos", prompt.alias("judge_prompt"))


def _override(df: DataFrame, gradable: Column) -> DataFrame:
    """Let an acceptable judgement replace level and message; the total stays as it is."""
    asked = gradable & (F.col("_judge_code") == 0) & ~is_blank(F.col("standard_answer"))
    df = df.withColumn("_reply", parse_reply(F.when(asked, F.col("_judge_data"))))
    df = df.withColumn("_verdict", judge_verdict(F.col("_reply")))
    verdict = F.col("_verdict")
    return df.withColumns(
        {
            "hallucination_level": F.when(verdict.isNotNull(), verdict["level"]).otherwise(
                F.col("hallucination_level")
            ),
            "hallucination_msg": F.when(verdict.isNotNull(), verdict["reason"]).otherwise(
                F.col("hallucination_msg")
            ),
        }
    )


def evaluate(
    cases: DataFrame,
    answers: DataFrame,
    judgements: DataFrame | None = None,
    rules: Rules = Rules(),
    execute_timestamp: str | Column | None = None,
    keep: Sequence[str] = (),
    lexicon: DataFrame | None = None,
    banned: DataFrame | None = None,
) -> DataFrame:
    """One result row per case: case columns, call outcome, validity, compliance and scores.

    ``cases`` has the layout ``schemas.CASES``, ``answers`` ``schemas.OUTCOMES``, ``judgements``
    ``schemas.JUDGEMENTS``; each has at most one row per ``case_pos``, the unique key of the case. The
    join on it is the only exchange, hash-spread over unique keys; everything after is one chain of
    projections. Tables bucketed by ``case_pos`` join without any exchange. The order of the input
    is the order of ``case_pos``; sort where the rows leave Spark. ``keep`` names further columns of ``cases`` to carry
    along, such as a batch id. A ``lexicon`` segments Han text by probability (see ``add_tokens``), and ``banned``
    is a long list of banned words (see ``add_validity``); both have joins of their own."""
    call = answers.select(
        "case_pos",
        F.col("code").alias("_code"),
        F.col("data").alias("_data"),
        F.col("msg").alias("_msg"),
        F.col("cost_ms").alias("_cost_ms"),
    )
    df = with_case_defaults(cases).join(call, "case_pos", "left")
    if judgements is not None:
        df = df.join(
            judgements.select(
                "case_pos", F.col("code").alias("_judge_code"), F.col("data").alias("_judge_data")
            ),
            "case_pos",
            "left",
        )
    asked = F.col("prompt").isNotNull()
    df = df.withColumn("_ok", asked & F.coalesce(F.col("_code") == texts.SUCCESS, F.lit(False)))
    # The text to grade; NULL for failed calls and for successful ones without an answer.
    df = df.withColumn("_text", F.when(F.col("_ok"), F.col("_data")))
    df = add_scores(add_validity(df, rules, "_text", banned), rules, "_text", lexicon)
    gradable = F.col("_text").isNotNull()
    if judgements is not None:
        df = _override(df, gradable)
    return df.select("case_pos", *keep, *_result_columns(rules, gradable, execute_timestamp, banned is not None))


def _result_columns(
    rules: Rules, gradable: Column, execute_timestamp: str | Column | None, listed: bool = False
) -> list[Column]:
    """Every column of a result row, with the default a failed case shows."""
    any_words = bool(rules.sensitive_words) or listed
    ok, asked = F.col("_ok"), F.col("prompt").isNotNull()
    when = (
        F.date_format(F.current_timestamp(), schemas.TIME_FORMAT)
        if execute_timestamp is None
        else execute_timestamp if isinstance(execute_timestamp, Column) else F.lit(execute_timestamp)
    )
    null_fault = texts.NULL_ANSWER_FAULT if any_words else texts.NULL_ANSWER_FAULT_NO_WORDS
    error = (
        F.when(~asked, texts.FAULT_TEXT.format(fault=texts.MISSING_PROMPT_FAULT))
        .when(ok & ~gradable, texts.FAULT_TEXT.format(fault=null_fault))
        .when(ok, "")
        .when(F.col("_code").isNull(), texts.NO_OUTCOME_TEXT)
        .otherwise(F.col("_msg"))
    )
    # Without banned words a NULL answer fails only after both checks have reported.
    checked = ok if not any_words else gradable
    made = {
        "case_id": F.col("case_id"),
        "case_desc": F.col("case_desc"),
        "prompt": F.coalesce("prompt", F.lit("")),
        "execute_timestamp": when,
        "thread_id": F.lit(None),
        "api_cost_ms": F.when(asked, F.coalesce("_cost_ms", F.lit(0.0))).otherwise(0.0),
        "compute_cost_ms": F.lit(None),
        "request_cost_ms": F.lit(None),
        "answer_content": F.when(ok, F.col("_text")).otherwise(""),
        "success_flag": ok,
        "error_msg": error,
    }
    for name in VALIDITY_COLUMNS:
        default = "" if name.endswith("_msg") else False
        made[name] = F.when(checked, F.col(name)).otherwise(default)
    for name in SCORE_COLUMNS:
        default = 0.0 if name.endswith("_score") else ""
        made[name] = F.when(gradable, F.col(name)).otherwise(default)
    return [made[name].cast(kind).alias(name) for name, kind in schemas.RESULT_FIELDS.items()]
