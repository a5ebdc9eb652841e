"""The second opinion: the judge's prompt and its JSON reply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from answergauge import texts
from answergauge.functions.text import fill_template, parse_json


def judge_prompt(standard: Column, answer: Column, template: str = texts.JUDGE_TEMPLATE) -> Column:
    answer = F.coalesce(answer, F.lit("None"))  # the model call failed without any data
    return fill_template(template, {"standard_answer": standard, "answer_content": answer})


def parse_reply(reply: Column) -> Column:
    """The judge's reply as a variant; NULL unless the whole of it is one JSON object. Project it before
    ``judge_verdict`` looks at its parts, so that it is parsed once."""
    parsed = parse_json(reply)
    return F.when(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), parsed)


def judge_verdict(parsed: Column) -> Column:
    """``struct<level, reason>`` of an acceptable reply, else NULL: its ``level`` must be the number 0, 1, 2
    or 3 (``true`` counts as 1, text does not)."""
    kind = F.schema_of_variant(F.try_variant_get(parsed, "$.level", "variant"))
    number = F.when(
        kind.rlike("^(BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(parsed, "$.level", "double")
    )
    levels = F.create_map(*[F.lit(x) for pair in texts.JUDGE_LEVELS.items() for x in (float(pair[0]), pair[1])])
    level = F.try_element_at(levels, number)
    reason = F.when(
        F.try_variant_get(parsed, "$.reason", "variant").isNull(), texts.JUDGE_DEFAULT_TEXT
    ).otherwise(F.try_variant_get(parsed, "$.reason", "string"))
    return F.when(level.isNotNull(), F.struct(level.alias("level"), reason.alias("reason")))
