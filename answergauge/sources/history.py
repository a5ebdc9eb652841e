"""The history of batches: Parquet folders at one place, which any later session can open."""

from __future__ import annotations

import itertools
import logging
import math
import secrets
import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from answergauge import schemas, texts
from answergauge.functions.text import plain_number, round2
from answergauge.operators.changes import model_changes
from answergauge.operators.salting import salted_join
from answergauge.operators.summarise import (
    COUNTERS, batch_rows, count_results, summarise, summary_records, summary_rollup,
)

LIST_COLUMNS = ["batch_id", "execute_time", "model_name", "total_cases", "success_rate", "avg_total_score"]

_COUNTER_TYPES = ", ".join(f"{c}: {'decimal(30,2)' if c.startswith('_sum_') else 'bigint'}" for c in COUNTERS)
BATCH_FILES = schemas.BATCH_FIELDS | {"counters": f"struct<{_COUNTER_TYPES}>", "day": "STRING"}

log = logging.getLogger(__name__)


def new_batch_id() -> str:
    return f"batch_{int(time.time())}_{secrets.token_hex(3)}"


# ---- Questions about history, over any batch and detail tables -------------------


def latest_batches(batches: DataFrame, limit: int = 10) -> DataFrame:
    """The newest batches first; a negative limit means all. Batches of the same second are in order of
    their id."""
    ordered = batches.orderBy(F.desc("execute_time"), "batch_id")
    return ordered.limit(limit) if limit >= 0 else ordered


def batch_by_id(batches: DataFrame, batch_id: str) -> DataFrame:
    return batches.where(F.col("batch_id") == batch_id)


def batch_cases(details: DataFrame, batch_id: str) -> DataFrame:
    """The result rows of one batch in case order."""
    return details.where(F.col("batch_id") == batch_id).orderBy("case_pos")


def with_details(batches: DataFrame, details: DataFrame, pieces: int | None = None) -> DataFrame:
    """Every result row next to its batch.

    A batch may hold a large share of all details. The details of such a batch are dealt to as many parts as they fill
    of ``pieces``, and its row is repeated as often; other batches are joined as they are. Batch rows are one
    per batch; where Spark finds them small enough to broadcast, nothing is shuffled at all."""
    return salted_join(batches, details, ["batch_id"], ["case_pos"], pieces)


def without_batch(rows: DataFrame, batch_id: str) -> DataFrame:
    """Rows of either table that remain once a batch is deleted; rows without a batch id remain too."""
    return rows.where(~F.col("batch_id").eqNullSafe(F.lit(batch_id)))


def list_view(batches: DataFrame, limit: int = 10) -> DataFrame:
    return latest_batches(batches, limit).select(*LIST_COLUMNS)


def detail_view(batches: DataFrame, batch_id: str) -> DataFrame:
    """One batch as key/value lines, in column order (``line``)."""
    row = batch_by_id(batches, batch_id)

    def shown(name: str) -> Column:
        return plain_number(F.col(name)) if schemas.BATCH_FIELDS[name] == "DOUBLE" else F.col(name).cast("string")

    pairs = [
        F.struct(F.lit(i).alias("line"), F.lit(c).alias("key"), shown(c).alias("value"))
        for i, c in enumerate(schemas.BATCH_COLUMNS)
    ]
    return row.select(F.inline(F.array(*pairs)))


def case_overview(details: DataFrame, batch_id: str) -> DataFrame:
    """One short line per case of a batch, in case order."""
    status = F.when(F.col("success_flag"), texts.STATUS_OK).otherwise(texts.STATUS_FAILED)
    return batch_cases(details, batch_id).select(
        "case_id", status.alias("status"), "total_score", "hallucination_level", "case_desc"
    )


def compare_batches(details: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Two batches case by case: which of them has the case (``side``), both totals and levels, the differences
    of the scores, and whether the level changed. Cases meet by ``case_pos``, their unique place in the suite
    (``case_id`` is free text that many cases may share)."""
    measured = [c for c in schemas.RESULT_COLUMNS if c.endswith("_score")]

    def of(batch_id: str, prefix: str) -> DataFrame:
        rows = batch_by_id(details, batch_id)
        named = [F.col(c).alias(f"{prefix}_{c}") for c in (*measured, "hallucination_level", "success_flag", "case_id")]
        return rows.select(F.col("case_pos").alias(f"{prefix}_pos"), *named)

    both = of(baseline, "old").join(of(candidate, "new"), F.col("old_pos") == F.col("new_pos"), "full_outer")
    side = F.when(F.col("new_pos").isNull(), "baseline").when(F.col("old_pos").isNull(), "candidate").otherwise("both")
    return both.select(
        F.coalesce("new_pos", "old_pos").alias("case_pos"),
        F.coalesce("new_case_id", "old_case_id").alias("case_id"),
        side.alias("side"),
        "old_total_score",
        "new_total_score",
        *[round2(F.col(f"new_{c}") - F.col(f"old_{c}")).alias(f"{c}_change") for c in measured],
        "old_hallucination_level",
        "new_hallucination_level",
        (F.col("old_hallucination_level") != F.col("new_hallucination_level")).alias("level_changed"),
        "old_success_flag",
        "new_success_flag",
    )


REPLICATES = 200
_DRAWS_PER_DIGEST = 8  # 16 bits each


def poisson_bounds() -> list[int]:
    """The 16-bit numbers from which on a draw is at least 1, 2, ...: cumulative shares of a Poisson variable of mean 1."""
    bounds, share, total = [], math.exp(-1), 0.0
    for k in itertools.count(1):
        total += share
        if round(total * 65536) >= 65536:
            return bounds
        bounds.append(round(total * 65536))
        share /= k


def regression_verdict(
    details: DataFrame,
    baseline: str,
    candidate: str,
    replicates: int = REPLICATES,
    confidence: float = 0.95,
    margin: float = 0.0,
    seed: int = 1,
) -> DataFrame:
    """One row on whether the candidate scores lower than the baseline on the cases that both answered: their number, the mean
    change of the total score, its interval by a paired bootstrap, and a verdict. ``better`` or ``worse`` says that the
    whole interval lies beyond ``margin``.

    Every case has a weight in each replicate, a Poisson number that its ``case_pos`` and the seed decide: so cases need
    not meet for resampling, reruns agree, and each task sends one row a replicate. Sums are whole (ten-thousandths)."""

    def of(batch_id: str, name: str) -> DataFrame:
        rows = batch_by_id(details, batch_id).where("success_flag")
        return rows.select("case_pos", F.col("total_score").cast("decimal(20,4)").alias(name))

    paired = of(baseline, "old").join(of(candidate, "new"), "case_pos").where("old IS NOT NULL AND new IS NOT NULL")
    change = ((F.col("new") - F.col("old")) * 10000).cast("bigint")
    digests = F.transform(
        F.sequence(F.lit(0), F.lit((replicates - 1) // _DRAWS_PER_DIGEST)),
        lambda b: F.md5(F.concat_ws(":", F.lit(seed), "case_pos", b).cast("binary")),
    )
    draws = F.flatten(
        F.transform(
            digests,
            lambda d: F.array(*[F.conv(F.substring(d, 4 * i + 1, 4), 16, 10).cast("int") for i in range(_DRAWS_PER_DIGEST)]),
        )
    )
    weights = F.transform(
        F.slice(draws, 1, replicates), lambda u: sum((F.when(u >= b, 1).otherwise(0) for b in poisson_bounds()), F.lit(0))
    )
    # Replicate 0 is the sample itself.
    dealt = paired.select(change.alias("_change"), F.posexplode(F.concat(F.array(F.lit(1)), weights)).alias("replicate", "w"))
    sums = dealt.groupBy("replicate").agg(F.sum("w").alias("_n"), F.sum(F.col("w") * F.col("_change")).alias("_sum"))
    mean = F.try_divide(F.col("_sum").cast("double"), F.col("_n").cast("double")) / F.lit(10000.0)
    drawn = F.array_sort(F.collect_list(F.when((F.col("replicate") > 0) & (F.col("_n") > 0), F.col("_mean"))))
    whole = sums.withColumn("_mean", mean).agg(
        drawn.alias("_drawn"),
        F.max(F.when(F.col("replicate") == 0, F.col("_n"))).alias("n_cases"),
        F.max(F.when(F.col("replicate") == 0, F.col("_mean"))).alias("mean_change"),
    )

    def quantile(share: float) -> Column:
        at = F.floor((F.size("_drawn") - 1) * F.lit(share)).cast("int") + 1
        return F.when(F.size("_drawn") > 0, F.try_element_at("_drawn", at))

    tail = (1 - confidence) / 2
    bounded = whole.withColumns({"lower": quantile(tail), "upper": quantile(1 - tail)})
    verdict = (
        F.when(F.col("lower").isNull(), "no common cases")
        .when(F.col("lower") > margin, "better")
        .when(F.col("upper") < -margin, "worse")
        .otherwise("no clear change")
    )
    return bounded.select(
        F.coalesce("n_cases", F.lit(0)).alias("n_cases"), "mean_change", "lower", "upper", verdict.alias("verdict")
    )


def model_trend(batches: DataFrame) -> DataFrame:
    """The batches of each model in order of execution (``run`` from 1), with the change of the mean total and of
    the success rate against the model's batch before. Works on batch rows only, one a batch."""
    order = Window.partitionBy("model_name").orderBy("execute_time", "batch_id")

    def change(name: str) -> Column:
        return round2(F.col(name) - F.lag(name).over(order)).alias(f"{name}_change")

    return batches.select(
        "model_name",
        F.row_number().over(order).alias("run"),
        "batch_id",
        "execute_time",
        "success_rate",
        change("success_rate"),
        "avg_total_score",
        change("avg_total_score"),
    )


class HistoryStore:
    """Saved batches below one folder, on any file system that Spark knows; no catalog is needed.

    ``eval_batch`` is partitioned by day, so that a listing opens few folders; ``eval_case_detail`` by batch, so
    that a batch is read and deleted alone; ``eval_deleted`` names the batches that were deleted. Parquet has
    no transactions, so order stands in for them: a batch's details are written before its batch row, and
    the batch is named as deleted before its details go. A batch is visible exactly while its row is."""

    def __init__(self, spark: SparkSession, name: str = "default", location: str | None = None):
        self.spark = spark
        root = location or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}.history"
        self.batch_path, self.detail_path, self.deleted_path = (
            f"{root.rstrip('/')}/{part}" for part in ("eval_batch", "eval_case_detail", "eval_deleted")
        )
        for path in (self.batch_path, self.detail_path, self.deleted_path):
            self._file_system(path).mkdirs(self._path(path))

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _file_system(self, path: str):
        return self._path(path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, path: str, fields: dict[str, str]) -> DataFrame:
        columns = ", ".join(f"{name} {kind}" for name, kind in fields.items())
        return self.spark.read.schema(columns).parquet(path)

    def save_batch(
        self, results: DataFrame, model_name: str = "unknown", total_time: float | None = None
    ) -> str:
        """Append one batch and return its id, or ``""`` if that failed. The results are computed once:
        the batch row is summed up from the saved details. Without a ``total_time`` in seconds, the
        time that computing and saving the details takes counts as the batch's."""
        batch_id = new_batch_id()
        stamp = time.strftime("%Y-%m-%d %H:%M:%S")
        start = time.monotonic()
        try:
            rows = results.select("case_pos", *schemas.RESULT_COLUMNS, F.lit(batch_id).alias("batch_id"))
            rows.write.mode("append").partitionBy("batch_id").parquet(self.detail_path)
            if total_time is None:
                total_time = round(time.monotonic() - start, 2)
            # Grouped over nothing, so that an empty batch has a row too.
            counted = count_results(self.details.where(F.col("batch_id") == batch_id))
            keep = [F.lit(batch_id).alias("batch_id"), F.struct(*COUNTERS).alias("counters")]
            summary = summary_records(counted, [], F.lit(float(total_time)), keep)
            row = batch_rows(summary, model_name, stamp).select(*schemas.BATCH_COLUMNS, "counters")
            row.withColumn("day", F.lit(stamp[:10])).write.mode("append").partitionBy("day").parquet(self.batch_path)
        except Exception:
            log.exception("batch %s was not saved", batch_id)
            self._drop(batch_id)
            return ""
        return batch_id

    def _visible(self, saved: DataFrame) -> DataFrame:
        deleted = self._read(self.deleted_path, {"batch_id": "STRING"})
        return saved.join(deleted, "batch_id", "left_anti")

    @property
    def batches(self) -> DataFrame:
        return self._visible(self._read(self.batch_path, BATCH_FILES)).select(*schemas.BATCH_COLUMNS)

    def _of_days(self, days: list[str]) -> DataFrame:
        """The visible batches of these folders; no other folder is listed or opened."""
        columns = ", ".join(f"{name} {kind}" for name, kind in BATCH_FILES.items())
        reader = self.spark.read.schema(columns).option("basePath", self.batch_path)
        saved = reader.parquet(*[f"{self.batch_path}/{day}" for day in days])
        return self._visible(saved).select(*schemas.BATCH_COLUMNS)

    def _newest(self, limit: int) -> DataFrame:
        """Batches among which the ``limit`` newest are: those of the newest days, walked back in steps that double until
        enough visible ones are found. The folder of a day says when its batches ran, so older days hold none newer."""
        listed = self._file_system(self.batch_path).listStatus(self._path(self.batch_path))
        names = [s.getPath().getName() for s in listed]
        days = sorted((name for name in names if name.startswith("day=")), reverse=True)
        found = opened = 0
        while found < limit and opened < len(days):
            step = days[opened : opened + max(1, opened)]
            found += self._of_days(step).limit(limit).count()
            opened += len(step)
        return self._of_days(days[: max(1, opened)]) if days else self.batches

    @property
    def details(self) -> DataFrame:
        return self._read(self.detail_path, {"case_pos": "BIGINT", **schemas.RESULT_FIELDS, "batch_id": "STRING"})

    def latest(self, limit: int = 10) -> DataFrame:
        """The newest batches first; only as many days are opened as hold them."""
        return latest_batches(self._newest(limit) if limit >= 0 else self.batches, limit)

    def batch(self, batch_id: str) -> DataFrame:
        return batch_by_id(self.batches, batch_id)

    def cases(self, batch_id: str) -> DataFrame:
        return batch_cases(self.details, batch_id)

    def summary(self, batch_id: str, total_time: float = 0.0) -> DataFrame:
        """The summary record of a saved batch."""
        return summarise(self.details.where(F.col("batch_id") == batch_id), total_time=total_time)

    def list_view(self, limit: int = 10) -> DataFrame:
        return self.latest(limit).select(*LIST_COLUMNS)

    def detail_view(self, batch_id: str) -> DataFrame:
        return detail_view(self.batches, batch_id)

    def case_overview(self, batch_id: str) -> DataFrame:
        return case_overview(self.details, batch_id)

    def compare(self, baseline: str, candidate: str) -> DataFrame:
        return compare_batches(self.details, baseline, candidate)

    def verdict(self, baseline: str, candidate: str, **options) -> DataFrame:
        return regression_verdict(self.details, baseline, candidate, **options)

    def rollup(self) -> DataFrame:
        """Summaries by batch, model and day, from the counters in the batch rows; see ``summary_rollup``."""
        return summary_rollup(self._visible(self._read(self.batch_path, BATCH_FILES)))

    def trend(self) -> DataFrame:
        return model_trend(self.batches)

    def changes(self, **options) -> DataFrame:
        """The batches from which on a model scores otherwise; see ``model_changes``."""
        return model_changes(self.batches, **options)

    def delete(self, batch_id: str) -> bool:
        """Delete a batch with its details; true if there was a batch row. Details without one are
        deleted all the same. No file is rewritten."""
        existed = not self.batch(batch_id).isEmpty()
        self._drop(batch_id)
        return existed

    def _drop(self, batch_id: str) -> None:
        self._hide(batch_id)
        escaped = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
        folder = f"{self.detail_path}/batch_id={escaped.escapePathName(batch_id)}"
        self._file_system(folder).delete(self._path(folder), True)

    def _hide(self, batch_id: str) -> None:
        named = self.spark.range(1).select(F.lit(batch_id).alias("batch_id"))
        named.coalesce(1).write.mode("append").parquet(self.deleted_path)
