"""Asking a model with retries, over a stored log of attempts: a run that breaks off goes on where it stopped.

Each wave asks the cases that the log does not decide yet, once each, and appends what came of it. Finished tasks count even
if their wave fails as a whole; a wave that is started again asks only the cases whose attempts were not stored."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge.functions import calls
from answergauge.operators.attempts import call_outcomes
from answergauge.operators.layout import shared_path

# (request body, number of the try from 0) -> what came back: "status" and "body", or "error_kind" ("timeout",
# "connect" or another word) and "error_text".
Send = Callable[[str, int], dict]

ATTEMPTS = (
    "request_id BIGINT, attempt_no INT, error_kind STRING, http_status INT, body STRING, error_text STRING, "
    "started_at TIMESTAMP, ended_at TIMESTAMP"
)
COLUMNS = [part.split()[0] for part in ATTEMPTS.split(", ")]
WAIT_SECONDS = 1.0


class AttemptLog:
    """A folder of attempts that only grows."""

    def __init__(self, spark: SparkSession, location: str | None = None):
        self.spark, self.location = spark, location or shared_path(spark)

    def read(self) -> DataFrame:
        """All stored attempts, as they are now."""
        try:
            return self.spark.read.schema(ATTEMPTS).parquet(self.location)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ATTEMPTS)

    def append(self, attempts: DataFrame) -> None:
        """Each task's rows stay once that task has ended, whatever becomes of the others."""
        attempts.write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(self.location)


def open_cases(cases: DataFrame, log: DataFrame, max_retry: int = calls.MAX_RETRY) -> DataFrame:
    """``case_pos``, ``prompt``, ``attempt_no`` and ``last_end`` of the cases that need another try: none is stored, or
    all stored ones are worth a retry and there are fewer than ``max_retry`` of those after the first. The log is
    reduced to fixed-width numbers before it is joined."""
    state = log.groupBy("request_id").agg(
        F.max("attempt_no").alias("_last"),
        F.min(calls.is_retryable(F.col("error_kind")).cast("int")).alias("_all_retryable"),
        F.max(F.unix_micros("ended_at")).alias("_ended"),
    )
    asked = cases.where(F.col("prompt").isNotNull()).select("case_pos", "prompt")
    joined = asked.join(state, F.col("case_pos") == F.col("request_id"), "left")
    undecided = F.col("_last").isNull() | ((F.col("_all_retryable") == 1) & (F.col("_last") < max_retry))
    return joined.where(undecided).select(
        "case_pos", "prompt", F.coalesce(F.col("_last") + 1, F.lit(0)).alias("attempt_no"), F.col("_ended").alias("last_end")
    )


def try_once(
    todo: DataFrame, send: Send, model: str | None = None, concurrent_num: int = 1, wait_seconds: float = WAIT_SECONDS
) -> DataFrame:
    """``ATTEMPTS`` rows of one try per row of ``open_cases``, with at most ``concurrent_num`` calls in flight. A retry
    waits until ``wait_seconds`` have gone by since the try before it. A call that raises is an attempt that failed."""
    # Plain values only: the closure travels to workers that need not have this package.
    columns = list(COLUMNS)

    def text_or_none(value) -> str | None:
        return None if value is None else str(value)

    def attempt(row) -> tuple:
        if not pd.isna(row.last_end):
            time.sleep(min(wait_seconds, max(0.0, row.last_end / 1e6 + wait_seconds - time.time())))
        started = datetime.now(timezone.utc)
        try:
            reply = send(row.request, int(row.attempt_no))
            status = reply.get("status")
            found = (
                text_or_none(reply.get("error_kind")),
                None if status is None else int(status),
                text_or_none(reply.get("body")),
                text_or_none(reply.get("error_text")),
            )
        except Exception as e:
            found = ("raised", None, None, f"{type(e).__name__}: {e}")
        return (row.case_pos, row.attempt_no, *found, started, datetime.now(timezone.utc))

    def tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [attempt(row) for row in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=columns).astype({"http_status": "Int32"})

    requests = todo.select("case_pos", "attempt_no", "last_end", calls.request_body(F.col("prompt"), model).alias("request"))
    return requests.repartition(concurrent_num).mapInPandas(tries, ATTEMPTS)


def ask_with_retries(
    cases: DataFrame,
    send: Send,
    log: AttemptLog,
    model: str | None = None,
    concurrent_num: int = 1,
    max_retry: int = calls.MAX_RETRY,
    wait_seconds: float = WAIT_SECONDS,
    portions: int = 1,
) -> DataFrame:
    """Ask until the log decides every case that has a prompt, and return ``call_outcomes`` of the log.

    Call it again with the same log after a crash: what is stored is not asked again. A task that breaks off loses its own
    calls, so with more ``portions`` each wave is dealt to that many jobs and less is lost. ``case_pos`` is unique. Run it with
    ``spark.speculation`` off, or slow calls are made twice."""
    part_of = F.pmod(F.xxhash64("case_pos"), F.lit(portions))
    # One wave per try; a wave that finds nothing to ask ends it early.
    for _ in range(max_retry + 1):
        asked = False
        for portion in range(portions):
            todo = open_cases(cases.where(part_of == portion) if portions > 1 else cases, log.read(), max_retry)
            if not todo.isEmpty():
                asked = True
                log.append(try_once(todo, send, model, concurrent_num, wait_seconds))
        if not asked:
            break
    return call_outcomes(log.read(), max_retry)
