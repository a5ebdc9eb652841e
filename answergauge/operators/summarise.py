"""Batch statistics over result rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge import texts
from answergauge.functions.text import fixed2, round2

SCORES = {"total": "total_score", "relevance": "relevance_score", "completeness": "completeness_score"}
PASSES = {"valid": "is_valid", "compliant": "is_compliant"}
COUNTERS = [
    "total", "success", *[f"_sum_{n}" for n in SCORES], *[f"_n_{n}" for n in (*texts.SUMMARY_LEVELS, *PASSES)],
]


def _share(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent; NULL when there is no whole."""
    return part / F.nullif(whole, F.lit(0)) * 100


def _percent(part: Column, whole: Column) -> Column:
    return F.concat(fixed2(_share(part, whole)), F.lit("%"))


def count_results(
    results: DataFrame, by: Sequence[str] = (), also: Sequence[Column] = ()
) -> DataFrame:
    """The counts and sums every statistic derives from, per group of ``by`` or over all rows.

    All buffers are fixed-width and combine map-side, so one group with most of the rows is no
    hot spot. Scores have two decimals, so decimal sums are exact in any order."""
    ok = F.col("success_flag")

    def ok_rows(test: Column) -> Column:
        return F.count_if(ok & test)

    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(ok).alias("success"),
        *[
            F.sum(F.when(ok, F.col(c)).cast("decimal(20,2)")).alias(f"_sum_{name}")
            for name, c in SCORES.items()
        ],
        *[
            ok_rows(F.col("hallucination_level") == level).alias(f"_n_{name}")
            for name, level in texts.SUMMARY_LEVELS.items()
        ],
        *[ok_rows(F.col(c)).alias(f"_n_{name}") for name, c in PASSES.items()],
        F.struct(*also).alias("_also") if also else F.lit(None).alias("_also"),
    )


def success_rate(success: Column, total: Column) -> Column:
    return F.coalesce(round2(_share(success, total)), F.lit(0.0))


def summarise(
    results: DataFrame,
    by: Sequence[str] = (),
    total_time: float | Column = 0.0,
    also: Sequence[Column] = (),
) -> DataFrame:
    """One nested summary record per group: counts, success rate, mean scores, risk distribution, pass
    rates, times. Means and ratios are over successful cases and NULL when there are none.

    ``total_time`` is the batch's wall time in seconds as the caller measured it; a Column may use the
    grouping columns. ``also`` are further named aggregates to add at the end."""
    seconds = total_time if isinstance(total_time, Column) else F.lit(float(total_time))
    return summary_records(count_results(results, by, also), by, seconds, ["_also.*"] if also else [])


def summary_records(
    counted: DataFrame, by: Sequence[str], seconds: Column, keep: Sequence[str | Column] = ()
) -> DataFrame:
    """The summary record of each row of counts, whether counted at once or merged from counters of parts."""
    n, ok = F.col("total"), F.col("success")
    means = [
        round2(F.col(f"_sum_{name}").cast("double") / F.nullif(ok, F.lit(0))).alias(name) for name in SCORES
    ]
    levels = [
        F.struct(
            F.col(f"_n_{name}").alias("count"), _percent(F.col(f"_n_{name}"), ok).alias("ratio")
        ).alias(name)
        for name in texts.SUMMARY_LEVELS
    ]
    passes = [_percent(F.col(f"_n_{name}"), ok).alias(name) for name in PASSES]
    return counted.select(
        *by,
        n,
        ok,
        (n - ok).alias("failed"),
        success_rate(ok, n).alias("success_rate"),
        F.struct(*means).alias("avg_score"),
        F.struct(*levels).alias("hallucination_dist"),
        F.struct(*passes).alias("validate_pass_rate"),
        seconds.alias("total_time"),
        F.coalesce(round2(seconds / F.nullif(n, F.lit(0))), F.lit(0.0)).alias("avg_time_per_case"),
        *keep,
    )


ROLLUP_KEYS = ["model_name", "day", "batch_id"]
ROLLUPS = {
    "batch": ROLLUP_KEYS, "model and day": ["model_name", "day"], "model": ["model_name"], "day": ["day"], "all": [],
}


def summary_rollup(batches: DataFrame) -> DataFrame:
    """Summary records of each batch, each model's days, models, days and all (``level``), from batch rows that carry their
    ``counters``: no result row is read again. Means and rates are those of the rows themselves, not means of means.

    Counters are sums, so they merge in any order; scores and times are added as decimals. ``n_uncounted`` batches of the
    ``n_batches`` have no counters and are in no other figure. Without batches there is no row."""
    flat = batches.select(*ROLLUP_KEYS, F.col("total_time").cast("decimal(20,6)").alias("_seconds"), "counters.*")
    merged = flat.groupingSets([[F.col(c) for c in keys] for keys in ROLLUPS.values()], *ROLLUP_KEYS).agg(
        F.grouping_id().alias("_set"),
        F.count(F.lit(1)).alias("n_batches"),
        F.count_if(F.col("total").isNull()).alias("n_uncounted"),
        F.sum(F.when(F.col("total").isNotNull(), F.col("_seconds"))).alias("_seconds"),
        *[F.sum(c).alias(c) for c in COUNTERS],
    )
    level = F.lit(None).cast("string")
    for name, keys in ROLLUPS.items():
        absent = sum(1 << i for i, c in enumerate(reversed(ROLLUP_KEYS)) if c not in keys)
        level = F.when(F.col("_set") == absent, name).otherwise(level)
    named = merged.withColumn("level", level)
    return summary_records(named, ["level", *ROLLUP_KEYS, "n_batches", "n_uncounted"], F.col("_seconds").cast("double"))


def batch_rows(summary: DataFrame, model_name: str | Column, execute_time: str | Column) -> DataFrame:
    """Summaries that carry a ``batch_id`` as rows of the batch table, with their ``counters`` where they carry them."""

    def given(x: str | Column) -> Column:
        return x if isinstance(x, Column) else F.lit(x)

    return summary.select(
        "batch_id",
        given(execute_time).alias("execute_time"),
        given(model_name).alias("model_name"),
        F.col("total").alias("total_cases"),
        F.col("success").alias("success_count"),
        "total_time",
        "success_rate",
        F.col("avg_score.total").alias("avg_total_score"),
        *[c for c in summary.columns if c == "counters"],
    )
