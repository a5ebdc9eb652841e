"""Joins whose hot keys spread over several tasks, each as far as its rows need."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def heavy_keys(rows: DataFrame, keys: list[str], pieces: int) -> list[tuple]:
    """The keys that hold more than one part in ``pieces`` of all rows, each with the number of such parts that it fills.

    Fewer than ``pieces`` keys can, so the list is short however many keys there are. Rows are counted
    exactly: one row per key and task is shuffled, and the counts of other keys stay in the cluster. Rows with a
    NULL key meet nothing in a join and are left out."""
    known = rows.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    seen = Observation()
    counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.sum("_n").alias("total"))
    top = counts.orderBy(F.desc("_n")).limit(pieces).collect()
    total = seen.get["total"] or 0
    return [(*row[:-1], -(-row["_n"] * pieces // total)) for row in top if row["_n"] * pieces > total]


def salted_join(few: DataFrame, many: DataFrame, keys: list[str], deal_by: list[str], pieces: int | None = None) -> DataFrame:
    """The inner join of ``few``, which has little per key, with ``many``, in which a key may hold a large share of all rows.

    A heavy key's rows of ``many`` are dealt by ``deal_by`` to as many parts as it fills, and its rows of ``few`` are
    repeated once per part; other keys are neither dealt nor repeated. ``pieces`` is the number of parts that all
    rows should fill, by default four for each of the session's shuffle partitions, so that parts which meet in a
    partition still balance. The list of heavy keys is shorter than that and is broadcast. Counting them runs one
    job over the keys of ``many``."""
    session = many.sparkSession
    pieces = pieces or 4 * int(session.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(many, keys, pieces)
    if not heavy:
        return few.join(many, keys)
    types = ", ".join(f"`{k}` {many.schema[k].dataType.simpleString()}" for k in keys)
    parts = F.broadcast(session.createDataFrame(heavy, f"{types}, _parts bigint"))
    salt = F.coalesce(F.pmod(F.xxhash64(*deal_by), F.col("_parts")), F.lit(0))
    dealt = many.join(parts, keys, "left").withColumn("_salt", salt).drop("_parts")
    last = F.coalesce(F.col("_parts"), F.lit(1)) - 1
    repeated = few.join(parts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    return repeated.drop("_parts").join(dealt, [*keys, "_salt"]).drop("_salt")
