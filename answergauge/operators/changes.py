"""Where a series of batches changes its level: segmentation at the largest change of the mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from answergauge.operators.layout import discard, materialised, shared_path
from answergauge.operators.salting import salted_join

LEAST_RUNS = 3
LEAST_RATIO = 16.0  # of an F test with one degree of freedom; four standard errors


def ordered_runs(batches: DataFrame, score: str = "avg_total_score", kept_at: str | None = None) -> DataFrame:
    """The batches with a score, numbered by model in order of execution (``run`` from 1), with the score in hundredths and
    the sums of scores and of their squares over all earlier batches of the model and over all its batches.

    Rows are sorted by ranges into pieces, which split a model with many batches, are summed within each, and then
    get the sums of the pieces before theirs, of which there is one row per model and piece."""
    session = batches.sparkSession
    points = F.round(F.col(score) * 100).cast("bigint")
    model = F.coalesce(F.concat(F.lit("+"), "model_name"), F.lit("-"))  # a missing name is a model of its own
    order = ["execute_time", "batch_id", "_points"]
    rows = batches.select(model.alias("_model"), "model_name", "execute_time", "batch_id", points.alias("_points"))
    ranged = rows.where("_points IS NOT NULL").repartitionByRange("_model", *order)
    path = shared_path(session)
    pieces = materialised(ranged.withColumn("_piece", F.spark_partition_id()), path)
    square = F.col("_points") * F.col("_points")

    totals = pieces.groupBy("_model", "_piece").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("_points").alias("_s"), F.sum(square).alias("_q")
    )
    by_model = Window.partitionBy("_model")
    earlier = by_model.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = [(f"_{c}", name) for c, name in (("n", "runs"), ("s", "sum"), ("q", "squares"))]
    offsets = totals.select(
        "_model",
        "_piece",
        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_at_{name}") for c, name in sums],
        *[F.sum(c).over(by_model).alias(f"all_{name}") for c, name in sums],
    )
    within = Window.partitionBy("_model", "_piece").orderBy(*order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    numbered = pieces.select(
        "*",
        F.row_number().over(within).alias("_place"),
        F.coalesce(F.sum("_points").over(before), F.lit(0)).alias("_sum"),
        F.coalesce(F.sum(square).over(before), F.lit(0)).alias("_squares"),
    )
    whole = numbered.join(offsets, ["_model", "_piece"]).select(
        "_model",
        "model_name",
        "batch_id",
        "execute_time",
        (F.col("_at_runs") + F.col("_place")).alias("run"),
        (F.col("_at_sum") + F.col("_sum")).alias("sum"),
        (F.col("_at_squares") + F.col("_squares")).alias("squares"),
        *[f"all_{name}" for _, name in sums],
    )
    kept = materialised(whole, kept_at)
    discard(session, path)
    return kept


def model_changes(batches: DataFrame, least_runs: int = LEAST_RUNS, least_ratio: float = LEAST_RATIO) -> DataFrame:
    """The batches from which on a model's mean total is another: per change the first batch after it, the number of runs and
    the mean score on both sides, the change, and ``ratio``, by how much the split explains the scores.

    The runs of a model are split where the difference of the two means explains most of the scores (ties: the earliest),
    provided both sides have ``least_runs`` and the F ratio reaches ``least_ratio``; then both sides are split in
    turn until none is. The sides of a row are those at its split. All runs of all models are tried in each round, as
    row-local arithmetic on prefix sums and one maximum per segment, combined before the shuffle; runs of settled segments drop
    out. Batches without a score take no part."""
    session = batches.sparkSession
    path = shared_path(session)
    rows = ordered_runs(batches, kept_at=path).withColumns(
        {"_first": F.lit(1).cast("bigint"), "_runs": F.col("all_runs"), "_sum0": F.lit(0).cast("bigint"),
         "_sum1": F.col("all_sum"), "_squares0": F.lit(0).cast("bigint"), "_squares1": F.col("all_squares")}
    ).drop("all_runs", "all_sum", "all_squares")
    found = None
    while True:
        splits = materialised(_splits(rows, least_runs, least_ratio))
        found = splits if found is None else found.unionByName(splits)
        if splits.isEmpty():
            break
        later = F.col("run") >= F.col("_split")
        side = {
            "_first": F.when(later, F.col("_split")).otherwise(F.col("_first")),
            "_runs": F.when(later, F.col("_first") + F.col("_runs") - F.col("_split")).otherwise(F.col("_split") - F.col("_first")),
            "_sum0": F.when(later, F.col("_split_sum")).otherwise(F.col("_sum0")),
            "_sum1": F.when(later, F.col("_sum1")).otherwise(F.col("_split_sum")),
            "_squares0": F.when(later, F.col("_split_squares")).otherwise(F.col("_squares0")),
            "_squares1": F.when(later, F.col("_squares1")).otherwise(F.col("_split_squares")),
        }
        at = splits.select("_model", "_first", F.col("run").alias("_split"), "_split_sum", "_split_squares")
        names = rows.columns
        used, path = path, shared_path(session)
        halves = salted_join(at, rows, ["_model", "_first"], ["run"]).withColumns(side)
        rows = materialised(halves.where(F.col("_runs") >= 2 * least_runs).select(*names), path)
        discard(session, used)
    discard(session, path)
    return found.select(
        "model_name", "run", "batch_id", "execute_time", "runs_before", "runs_after",
        "mean_before", "mean_after", (F.col("mean_after") - F.col("mean_before")).alias("change"), "ratio",
    )


def _splits(rows: DataFrame, least_runs: int, least_ratio: float) -> DataFrame:
    """The best split of each segment, where it has one: the first run after it."""

    def real(name: str) -> Column:
        return F.col(name).cast("double")

    k, n = F.col("run") - F.col("_first"), F.col("_runs")
    tried = rows.where((k >= least_runs) & (n - k >= least_runs)).withColumns({"_k": k, "_rest": n - k})
    means = tried.withColumns(
        {
            "_m0": (real("sum") - real("_sum0")) / real("_k"),
            "_m1": (real("_sum1") - real("sum")) / real("_rest"),
        }
    )
    gap = F.col("_m0") - F.col("_m1")
    scored = means.withColumn("_gain", real("_k") * real("_rest") / real("_runs") * (gap * gap))
    carried = ["model_name", "batch_id", "execute_time", "run", "sum", "squares", "_k", "_rest", "_m0", "_m1", "_gain"]
    segment = ["_model", "_first", "_runs", "_sum0", "_sum1", "_squares0", "_squares1"]
    best = scored.groupBy(*segment).agg(
        F.max_by(F.struct(*carried), F.struct("_gain", (-F.col("run")).alias("_up"))).alias("b")
    )
    total = real("_sum1") - real("_sum0")
    spread = real("_squares1") - real("_squares0") - total * total / real("_runs")
    inside = F.greatest(spread - F.col("b._gain"), F.lit(0.0))
    explained = F.col("b._gain") * (real("_runs") - 2)
    holds = (F.col("b._gain") > 0) & (explained >= F.lit(float(least_ratio)) * inside)
    return best.where(holds).select(
        "_model",
        "_first",
        F.col("b.sum").alias("_split_sum"),
        F.col("b.squares").alias("_split_squares"),
        "b.model_name",
        "b.run",
        "b.batch_id",
        "b.execute_time",
        F.col("b._k").alias("runs_before"),
        F.col("b._rest").alias("runs_after"),
        (F.col("b._m0") / 100).alias("mean_before"),
        (F.col("b._m1") / 100).alias("mean_after"),
        F.when(inside > 0, explained / inside).alias("ratio"),
    )
