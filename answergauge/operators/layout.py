"""Partitioning and durability helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import answergauge

# Spark's setting for shuffle files to go when the statement that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def spread(scan: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """``scan`` in as many partitions as the caller asks for, by ``keys`` where given; as it is without a number.

    For costly row-local work over files that cannot be split, such as one large row group. The plan
    depends on the argument alone, never on the size of the data or of the cluster."""
    return scan if partitions is None else scan.repartition(partitions, *keys)


def materialised(df: DataFrame, path: str | None = None) -> DataFrame:
    """Run ``df`` once and read its rows back from the shared checkpoint folder, so that later readers and
    tasks on replaced executors do not compute (or call a model) again. Kept as Parquet, of which each
    reader loads only the columns it needs. ``path`` is for owners who ``discard`` it later.

    Nobody reads what was shuffled for these rows again, so it goes at once, not when the driver happens to
    collect its garbage: of a job in several steps, only the shuffles of one lie on disk."""
    session = df.sparkSession
    path = path or shared_path(session)
    before = session.conf.get(_CLEANUP, None)
    session.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            session.conf.unset(_CLEANUP)
        else:
            session.conf.set(_CLEANUP, before)
    return session.read.schema(df.schema).parquet(path)


def once_and_again(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows whose keys no other row has, and all others, None if there are none. Equal NULLs are equal keys. Only the keys are
    read and shuffled for it."""
    names = {k: f"_again_{k}" for k in keys}
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = materialised(counts.select(*keys).withColumnsRenamed(names))
    if again.isEmpty():
        return rows, None
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")


def ship_package(spark: SparkSession) -> None:
    """Give the tasks of this application the package, so that executors need not have it installed. Spark serves
    the archive of a few modules to them, as any Python file that an application adds."""
    context = spark.sparkContext
    if getattr(context, "_answergauge_shipped", False):
        return
    root = Path(answergauge.__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="answergauge-")) / "answergauge_modules.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(root.rglob("*.py")):
            out.write(module, module.relative_to(root.parent))
    context.addPyFile(str(archive))
    context._answergauge_shipped = True


def discard(session: SparkSession, path: str) -> None:
    """Delete a folder below the shared one, on whatever file system it lies."""
    jvm = session.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shared_path(session: SparkSession) -> str:
    """A new path in the folder that all executors share."""
    return f"{_checkpoint_folder(session)}/answergauge-{uuid.uuid4().hex}"


def _checkpoint_folder(session: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one in local mode."""
    context = session.sparkContext
    folder = session.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="answergauge-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")
