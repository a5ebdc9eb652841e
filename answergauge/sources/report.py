"""CSV report of result rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from answergauge import schemas
from answergauge.functions.text import plain_number

# The columns of the report, in order.
REPORT_COLUMNS = [
    "case_id", "case_desc", "execute_timestamp",
    "api_cost_ms", "compute_cost_ms", "request_cost_ms",
    "success_flag", "error_msg",
    "is_valid", "is_compliant", "validity_msg", "compliance_msg",
    "total_score", "relevance_score", "completeness_score",
    "hallucination_level", "hallucination_msg", "answer_content",
]
BYTE_ORDER_MARK = "\ufeff"


def _as_text(name: str) -> Column:
    kind = schemas.RESULT_FIELDS[name]
    text = plain_number(F.col(name)) if kind == "DOUBLE" else F.col(name).cast("string")
    if kind == "BOOLEAN":
        text = F.initcap(text)
    elif name.endswith("_score"):
        # A score that was never computed is a plain 0.
        scored = F.col("success_flag") & (F.col("error_msg") == "")
        text = F.when(scored, text).otherwise("0")
    elif name == "api_cost_ms":
        # A case that never called has a plain 0 too.
        text = F.when(F.col(name) == 0, "0").otherwise(text)
    return F.coalesce(text, F.lit("")).alias(name)


def report_rows(results: DataFrame) -> DataFrame:
    """The report's columns as text, plus ``case_pos`` to sort by."""
    return results.select("case_pos", *[_as_text(name) for name in REPORT_COLUMNS])


def export_csv(results: DataFrame, folder: str, name: str | None = None) -> str:
    """Write the report in case order and return its directory.

    The rows are range-partitioned by ``case_pos``: part files in name order are in case order, each with
    the header, and no task gets the whole report; a small report ends up in one file. Row ends are
    LF, since Spark would otherwise also rewrite line breaks inside answers."""
    name = name or f"eval_report_{datetime.now():%Y%m%d_%H%M%S}.csv"
    path = f"{folder.rstrip('/')}/{name}"
    rows = report_rows(results).orderBy("case_pos").drop("case_pos")
    (
        rows.withColumnRenamed("case_id", BYTE_ORDER_MARK + "case_id")
        .write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return path
