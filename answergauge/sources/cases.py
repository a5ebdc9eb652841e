"""Reading test cases."""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge import schemas
from answergauge.functions.text import fill_placeholders

TEXT_COLUMNS = ["case_id", "case_desc", "prompt", "standard_answer"]
CASE_FIELDS = [part.split()[0] for part in schemas.CASES.split(", ")]


def fill_case_placeholders(cases: DataFrame, env: Mapping[str, str]) -> DataFrame:
    """Replace ``${NAME}`` in every text of the cases."""
    filled = {c: fill_placeholders(F.col(c), env) for c in TEXT_COLUMNS}
    filled["expect_keywords"] = F.transform("expect_keywords", lambda k: fill_placeholders(k, env))
    return cases.withColumns(filled)


def read_cases(
    spark: SparkSession,
    path: str,
    format: str = "parquet",
    key_path: str = "eval_case_list",
    env: Mapping[str, str] | None = None,
    numbered: bool = False,
) -> DataFrame:
    """Cases with the ``schemas.CASES`` layout from parquet, JSON lines or YAML files; no rows when
    there is nothing at ``path``.

    ``case_pos`` is part of parquet and JSON data. In YAML, a list under the dotted ``key_path``, it is the
    place in the list, so a YAML path names one file. With ``numbered``, JSON lines need none: cases are numbered in the
    order of their files' paths and of the lines in them. Malformed JSON lines stop the read. Placeholders are
    filled from the environment unless ``env`` is given; an empty one leaves them."""
    try:
        if format == "yaml":
            cases = _read_yaml(spark, path, key_path)
        elif numbered:
            if format != "json":
                raise ValueError(f"cases are numbered by the lines of JSON files, not of {format}")
            cases = _read_numbered(spark, path)
        else:
            options = {"mode": "FAILFAST"} if format == "json" else {}
            cases = spark.read.schema(schemas.CASES).options(**options).format(format).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        cases = spark.createDataFrame([], schemas.CASES)
    env = os.environ if env is None else env
    return fill_case_placeholders(cases, env) if env else cases


def _read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with their number, the same however files are split.

    Lines are counted per split first; a line's number is the sum over all splits before its own plus its place in the
    split. Only one row per split, which Spark itself lists to plan the scan, goes through the driver; no line is shuffled
    or sorted."""
    scan = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )
    # Within a split, which one task reads in order, these ids have no gaps.
    lines = scan.where(F.trim(F.col("value"), F.lit(" \t\r\n")) != "").withColumn("_at", F.monotonically_increasing_id())
    counts = lines.groupBy("_file", "_block").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()
    counts.sort(key=lambda r: (r["_file"].encode(), r["_block"]))
    before = itertools.accumulate((r["n"] for r in counts), initial=0)
    starts = spark.createDataFrame(
        [(r["_file"], r["_block"], b - r["first"]) for r, b in zip(counts, before)], "_file string, _block long, _shift long"
    )
    fields = ", ".join(schemas.CASES.split(", ")[1:])
    parsed = F.from_json("value", fields, {"mode": "FAILFAST"})
    placed = lines.join(starts, ["_file", "_block"])
    return placed.select((F.col("_at") + F.col("_shift")).alias("case_pos"), parsed.alias("_case")).select("case_pos", "_case.*")


def _read_yaml(spark: SparkSession, path: str, key_path: str) -> DataFrame:
    """Each file is parsed inside the task that reads it. A file that is not YAML, or has no list at
    ``key_path``, has no cases."""

    fields = CASE_FIELDS[1:-1]

    def as_text(value) -> str | None:
        return value if value is None or isinstance(value, str) else str(value)

    def row(pos: int, case) -> list:
        """A case of texts. An item that is no mapping is a case of nothing, and so fails when it is graded."""
        case = case if isinstance(case, dict) else {}
        words = case.get("expect_keywords")
        if words is not None:
            words = [as_text(w) for w in (words if isinstance(words, list) else [words])]
        return [pos, *(as_text(case.get(name)) for name in fields), words]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for batch in batches:
            for content in batch["content"]:
                try:
                    node = yaml.safe_load(content)
                    for key in key_path.split("."):
                        node = node[key]
                except (yaml.YAMLError, KeyError, TypeError):
                    node = []
                rows = [row(pos, case) for pos, case in enumerate(node if isinstance(node, list) else [])]
                yield pd.DataFrame(rows, columns=CASE_FIELDS, dtype=object)

    files = spark.read.format("binaryFile").load(path)
    if len(files.inputFiles()) > 1:
        raise ValueError(f"{path} holds more than one file; cases are numbered by their place in one list")
    return files.select("content").mapInPandas(parse, schemas.CASES)


def write_bucketed(df: DataFrame, table: str, buckets: int, key: str = "case_pos") -> None:
    """Save cases or outcomes bucketed by their key. Tables with the same number of buckets join on it
    without an exchange."""
    df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
