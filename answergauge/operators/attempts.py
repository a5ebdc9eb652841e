"""From a log of call attempts to one outcome per request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge.functions import calls
from answergauge.functions.text import round2

# Ranks of attempts worth a retry come after all others, the last attempt first.
_RETRIED = 1 << 40


def deciding_attempts(attempts: DataFrame, max_retry: int = calls.MAX_RETRY) -> DataFrame:
    """Per request the number of the attempt that decides it (the first one not worth a retry, else the last one
    allowed), whether the server replied to it, and ``cost_ms`` from the first attempt's start to its end, waits
    included.

    Rank and values have fixed widths, so this is a hash
    aggregate that neither reads nor sorts bodies: map tasks keep one row per request before the shuffle,
    so a request with a huge share of the log costs no more than any other."""
    no = F.col("attempt_no").cast("bigint")
    rank = F.when(calls.is_retryable(F.col("error_kind")), F.lit(_RETRIED) - no).otherwise(no)
    replied = calls.got_reply(F.col("error_kind"), F.col("http_status"))
    started, ended = (F.unix_micros(F.col(c).cast("timestamp")) for c in ("started_at", "ended_at"))
    ranked = attempts.where(no <= max_retry).select(
        "request_id", rank.alias("_rank"), replied.alias("_replied"), started.alias("_started"), ended.alias("_ended")
    )
    chosen = ranked.groupBy("request_id").agg(
        F.min("_rank").alias("_rank"),
        F.min_by("_replied", "_rank").alias("replied"),
        F.min_by("_ended", "_rank").alias("_ended"),
        F.min("_started").alias("_started"),
    )
    number = F.when(F.col("_rank") > _RETRIED // 2, F.lit(_RETRIED) - F.col("_rank")).otherwise(F.col("_rank"))
    return chosen.select(
        "request_id",
        number.cast("int").alias("attempt_no"),
        "replied",
        round2((F.col("_ended") - F.col("_started")) / 1000.0).alias("cost_ms"),
    )


def final_attempts(
    attempts: DataFrame, max_retry: int = calls.MAX_RETRY, columns: tuple[str, ...] = ("error_kind", "http_status")
) -> DataFrame:
    """The deciding attempts with those of their columns that are asked for, fetched by a join on the request
    and the number of the attempt. The narrow side is hashed, so bodies are streamed, not sorted; only those of
    the deciding attempts are carried on, once each, should the log hold an attempt twice."""
    chosen = deciding_attempts(attempts, max_retry)
    log = attempts.select(F.col("request_id").alias("_request"), F.col("attempt_no").alias("_no"), *columns)
    same = F.col("request_id").eqNullSafe(F.col("_request")) & (F.col("attempt_no") == F.col("_no"))
    joined = chosen.hint("shuffle_hash").join(log, same)
    once = joined.dropDuplicates(["request_id", "attempt_no"])
    return once.select("request_id", "attempt_no", *columns, "replied", "cost_ms")


def slow_calls(
    attempts: DataFrame, max_retry: int = calls.MAX_RETRY, slow_ms: float = calls.SLOW_CALL_MS
) -> DataFrame:
    """Per request its cost and whether it got a reply, but slowly."""
    chosen = deciding_attempts(attempts, max_retry)
    slow = F.col("replied") & (F.col("cost_ms") > F.lit(slow_ms))
    return chosen.select(F.col("request_id").alias("case_pos"), "cost_ms", slow.alias("is_slow"))


def call_outcomes(
    attempts: DataFrame,
    max_retry: int = calls.MAX_RETRY,
    timeout_seconds: int = calls.TIMEOUT_SECONDS,
    slow_ms: float = calls.SLOW_CALL_MS,
) -> DataFrame:
    """One ``schemas.OUTCOMES`` row per request (``case_pos`` is the request id) plus ``is_slow``."""
    final = final_attempts(attempts, max_retry, ("error_kind", "http_status", "body", "error_text"))
    outcome = calls.call_outcome(
        F.col("error_kind"), F.col("http_status"), F.col("body"), F.col("error_text"), timeout_seconds
    )
    slow = F.col("replied") & (F.col("cost_ms") > F.lit(slow_ms))
    return final.withColumns({"_o": outcome, "is_slow": slow}).select(
        F.col("request_id").alias("case_pos"), "_o.code", "_o.data", "_o.msg", "cost_ms", "is_slow"
    )
