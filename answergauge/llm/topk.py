"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, merging by a tree.

Vectors are packed into shards and queries into blocks, each a row with a matrix. Every block meets every shard
once (a stated query set against all rows, in blocks): both are dealt to groups, blocks are repeated once per
shard group and shards once per block group, and a join on the two groups brings them together. A tile is one matrix product, of which each query keeps its best candidates; lists
of the same query are then merged in groups of ``FAN`` until one is left, so no task holds more than
``FAN`` lists of a query. Products are exact: in double precision while no sum can reach 2**53, else in integers.

Cases: a vector that is NULL or empty, or holds NULL or a non-finite component takes no part, nor does a row without id;
vectors meet only vectors of their own length; a query's candidates are all rows with another id; a
repeated candidate row can take several ranks, a repeated query row is answered once per row; ties go to the
smaller id; fewer candidates than k give fewer rows; scores beyond 64 bits are held at the limits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge.llm.common import materialised, ship_package

SHARD_ROWS = 4096
BLOCK_ROWS = 512
GROUP_SHARDS = 16
GROUP_BLOCKS = 16
FAN = 16
LONG = np.iinfo(np.int64)

_TILE = "number long, dim int, n int, ids binary, parts binary"


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component as double; NULL where the vector takes no part."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    values = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(factor))).cast("double"))
    return F.when((F.size(vector) > 0) & ~odd, values)


def _matrices(vectors: DataFrame, rows: int) -> DataFrame:
    """Rows of up to ``rows`` vectors of one length: their ids and components, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, count = TaskContext.get().partitionId() << 33, 0
        waiting: dict[int, tuple[list, list]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            nonlocal count
            ids, parts = waiting.pop(dim)
            count += 1
            return pa.RecordBatch.from_pydict(
                {
                    "number": pa.array([base + count - 1], pa.int64()),
                    "dim": pa.array([dim], pa.int32()),
                    "n": pa.array([len(ids)], pa.int32()),
                    "ids": pa.array([np.asarray(ids, np.int64).tobytes()], pa.binary()),
                    "parts": pa.array([np.concatenate(parts).astype(np.float64).tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            lists = batch.column("vector")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
            for owner, end, dim in zip(batch.column("id").to_pylist(), ends, lists.value_lengths().to_pylist()):
                ids, parts = waiting.setdefault(dim, ([], []))
                ids.append(owner)
                parts.append(flat[end - dim : end])
                if len(ids) == rows:
                    yield packed(dim)
        for dim in list(waiting):
            yield packed(dim)

    return vectors.mapInArrow(run, _TILE)


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors as 64-bit integers, held at the limits of that type."""
    bound = np.abs(queries).max(initial=0) * np.abs(shard).max(initial=0) * queries.shape[1]
    if bound < 2.0**53:
        return (queries @ shard.T).astype(np.int64)
    exact = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return np.clip(exact(queries) @ exact(shard).T, LONG.min, LONG.max).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of a row of scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = scores >= least
        scores, ids = scores[kept], ids[kept]
    order = np.lexsort((ids, ~scores))[:k]  # ~ reverses the order without overflow
    return scores[order], ids[order]


def grid(shards: int, blocks: int, tasks: int) -> tuple[int, int]:
    """Into how many groups shards and blocks are dealt: of ``GROUP_SHARDS`` and
    ``GROUP_BLOCKS``, or smaller until there are as many pairs of groups as ``tasks``. Results don't depend on it."""
    by = [max(1, -(-shards // GROUP_SHARDS)), max(1, -(-blocks // GROUP_BLOCKS))]
    most = [max(1, shards), max(1, blocks)]
    while by[0] * by[1] < tasks and by != most:
        at = 0 if by[0] * most[1] <= by[1] * most[0] and by[0] < most[0] or by[1] == most[1] else 1
        by[at] = min(most[at], 2 * by[at])
    return by[0], by[1]


def search(
    queries: DataFrame, vectors: DataFrame, k: int = 5, factor: int = 256, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """One row per query and rank: query_id, rank, vec_id, score."""
    ship_package(vectors.sparkSession)

    def usable(df: DataFrame) -> DataFrame:
        chosen = df.select(F.col(id_col).cast("long").alias("id"), scaled(F.col(vector_col), factor).alias("vector"))
        return chosen.where(F.col("id").isNotNull() & F.col("vector").isNotNull())

    shards = materialised(_matrices(usable(vectors), SHARD_ROWS))
    blocks = materialised(_matrices(usable(queries), BLOCK_ROWS))
    n_shards = shards.count()
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard_groups, block_groups = grid(n_shards, blocks.count(), tasks)

    def dealt(matrices: DataFrame, own: str, groups: int, other: str, others: int) -> DataFrame:
        return matrices.withColumn(own, F.pmod(F.xxhash64("number"), F.lit(groups))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(others - 1).cast("bigint")))
        )

    names = {c: f"q_{c}" for c in ("number", "n", "ids", "parts")}
    left = dealt(blocks, "block_group", block_groups, "shard_group", shard_groups).withColumnsRenamed(names)
    right = dealt(shards, "shard_group", shard_groups, "block_group", block_groups)
    tiles = left.join(right, ["shard_group", "block_group", "dim"]).select(
        "q_number", "dim", "number", "q_ids", "q_parts", "ids", "parts"
    )

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tile = batch.slice(i, 1).to_pylist()[0]
                dim = tile["dim"]
                q_ids, ids = np.frombuffer(tile["q_ids"], np.int64), np.frombuffer(tile["ids"], np.int64)
                scores = products(
                    np.frombuffer(tile["q_parts"]).reshape(-1, dim), np.frombuffer(tile["parts"]).reshape(-1, dim)
                )
                rows, found_scores, found_ids = [], [], []
                for at, q in enumerate(q_ids):
                    own = ids != q
                    s, v = best(scores[at][own], ids[own], k)
                    rows.append(at)
                    found_scores.append(s.tolist())
                    found_ids.append(v.tolist())
                best_of = [
                    [{"score": s, "vec_id": v} for s, v in zip(ss, vv)] for ss, vv in zip(found_scores, found_ids)
                ]
                yield pa.RecordBatch.from_pydict(
                    {
                        "q_number": pa.array([tile["q_number"]] * len(rows), pa.int64()),
                        "q_at": pa.array(rows, pa.int32()),
                        "query_id": pa.array(q_ids),
                        "shard": pa.array([tile["number"]] * len(rows), pa.int64()),
                        "best": pa.array(best_of, pa.list_(pa.struct([("score", pa.int64()), ("vec_id", pa.int64())]))),
                    }
                )

    lists = tiles.mapInArrow(
        partial, "q_number long, q_at int, query_id long, shard long, best array<struct<score:long,vec_id:long>>"
    )
    merged = _merged(lists, n_shards, k)
    return merged.select("query_id", F.posexplode("best")).select(
        "query_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        F.col("col.vec_id").alias("vec_id"),
        F.col("col.score").alias("score"),
    )


def _merged(lists: DataFrame, width: int, k: int) -> DataFrame:
    """Merges the lists of each query in a tree: groups of about ``FAN`` lists, and so on until one is left."""

    # Highest score first, then smallest id; ~score reverses the order without overflow.
    def top(lists_of: Column) -> Column:
        keyed = F.transform(
            F.flatten(lists_of), lambda x: F.struct(F.bitwise_not(x["score"]).alias("down"), x["vec_id"].alias("vec_id"))
        )
        return F.transform(
            F.slice(F.sort_array(keyed), 1, k),
            lambda x: F.struct(F.bitwise_not(x["down"]).alias("score"), x["vec_id"].alias("vec_id")),
        )

    key = ["q_number", "q_at", "query_id"]
    while width > FAN:
        width = -(-width // FAN)
        lists = (
            lists.withColumn("node", F.pmod(F.xxhash64("shard"), F.lit(width)))
            .groupBy(*key, "node")
            .agg(top(F.collect_list("best")).alias("best"))
            .withColumnRenamed("node", "shard")
        )
    return lists.groupBy(*key).agg(top(F.collect_list("best")).alias("best"))
