"""Ask a model about every case, through a function the caller supplies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answergauge import texts
from answergauge.operators.evaluate import with_case_defaults
from answergauge.operators.layout import materialised

# prompt -> {"code": int, "data": str | None, "msg": str, "cost_ms": float}
Ask = Callable[[str], dict]

ASKED = {
    "case_pos": "BIGINT", "code": "INT", "data": "STRING", "msg": "STRING", "cost_ms": "DOUBLE",
    "judge_code": "INT", "judge_data": "STRING",
}

# Our own code for a call that raised instead of reporting.
FAULT_CODE = -1


def ask_all(
    cases: DataFrame,
    ask: Ask,
    concurrent_num: int = 1,
    judge: Ask | None = None,
    template: str = texts.JUDGE_TEMPLATE,
) -> DataFrame:
    """The call outcome of every case and, with a judge, its reply, as ``ASKED`` rows.

    At most ``concurrent_num`` calls are in flight: that many partitions, each asking one case after
    the other and the judge right after the model. A call that raises, or a reply that lacks a code or has
    fields of another type, becomes the failed outcome of its own case; data that is no text is kept as JSON. Lazy: Spark may run it more than once, so use ``collect_answers`` unless ``ask``
    is a pure function."""
    # Plain values only: the closure travels to workers that need not have this package.
    columns, fault_text = list(ASKED), texts.FAULT_TEXT

    def as_text(value) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)

    def unpacked(reply: dict) -> tuple:
        cost = reply.get("cost_ms")
        code = int(reply["code"])
        if not -(2**31) <= code < 2**31:
            raise ValueError(f"code {code}")
        return code, as_text(reply.get("data")), as_text(reply.get("msg")), None if cost is None else float(cost)

    def ask_case(case) -> tuple:
        if case.prompt is None:
            return case.case_pos, None, None, None, None, None, None
        try:
            reply, verdict = ask(case.prompt), None
            answer = unpacked(reply)
            if judge is not None and case.standard_answer.strip():
                verdict = judge(
                    template.format(
                        standard_answer=case.standard_answer, answer_content=reply.get("data", "")
                    )
                )
            opinion = unpacked(verdict)[:2] if verdict else (None, None)  # an empty reply is no opinion
        except Exception as e:
            return case.case_pos, FAULT_CODE, None, fault_text.format(fault=e), 0.0, None, None
        return case.case_pos, *answer, *opinion

    def ask_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [ask_case(case) for case in batch.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    needed = ["case_pos", "prompt"] + (["standard_answer"] if judge is not None else [])
    todo = with_case_defaults(cases).select(*needed)
    schema = ", ".join(f"{name} {kind}" for name, kind in ASKED.items())
    return todo.repartition(concurrent_num).mapInPandas(ask_batches, schema)


def split_asked(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ASKED`` rows as the answers and judgements that ``evaluate`` takes."""
    answers = asked.where(F.col("code").isNotNull()).select("case_pos", "code", "data", "msg", "cost_ms")
    judgements = asked.where(F.col("judge_code").isNotNull()).select(
        "case_pos", F.col("judge_code").alias("code"), F.col("judge_data").alias("data")
    )
    return answers, judgements


def collect_answers(
    cases: DataFrame,
    ask: Ask,
    concurrent_num: int = 1,
    judge: Ask | None = None,
    template: str = texts.JUDGE_TEMPLATE,
    waves: int = 1,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ask once, keep the replies in the checkpoint folder (or in ``folder``), return answers and judgements.

    A task that is lost asks its share of the cases again. With more ``waves`` the cases are asked and saved in
    that many portions, so that less is lost. Run it with ``spark.speculation`` off, or slow calls are
    made twice."""
    wave_of = F.pmod(F.xxhash64("case_pos"), F.lit(waves))
    saved = [
        materialised(
            ask_all(cases.where(wave_of == wave), ask, concurrent_num, judge, template),
            folder and f"{folder}/asked-{wave}",
        )
        for wave in range(waves)
    ]
    return split_asked(reduce(DataFrame.unionByName, saved))
