"""A whole batch from cases to saved history and report."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame

from answergauge.operators.ask import Ask, collect_answers
from answergauge.operators.evaluate import evaluate
from answergauge.operators.layout import discard, materialised, shared_path
from answergauge.operators.summarise import summarise
from answergauge.rules import Rules
from answergauge.sources.history import HistoryStore
from answergauge.sources.report import export_csv


@dataclass(frozen=True)
class BatchRun:
    batch_id: str
    results: DataFrame
    summary: DataFrame
    report: str | None
    folder: str

    def discard(self) -> None:
        """Delete the saved replies and graded rows. ``results`` and ``summary`` cannot be read after that."""
        discard(self.results.sparkSession, self.folder)


def run_batch(
    cases: DataFrame,
    ask: Ask | None = None,
    answers: DataFrame | None = None,
    judge: Ask | None = None,
    judgements: DataFrame | None = None,
    rules: Rules = Rules(),
    concurrent_num: int = 1,
    waves: int = 1,
    store: HistoryStore | None = None,
    model_name: str = "unknown",
    report_folder: str | None = None,
) -> BatchRun:
    """Collect the answers (or take recorded ones), grade, save, summarise, report.

    Grading runs once: its rows go to the checkpoint folder, and the history, the summary and the report
    read them there. ``batch_id`` is empty when there is no store or saving failed; the rest of
    the batch goes on regardless. ``concurrent_num`` bounds the calls in flight, and with it the tasks of a wave;
    ``waves`` is how many portions the cases are asked and saved in, so a lost task asks less again. What
    is saved stays until the run's ``discard``."""
    start = time.monotonic()
    folder = shared_path(cases.sparkSession)
    if (ask is None) == (answers is None):
        raise ValueError("give either a function to ask or recorded answers")
    if ask is not None:
        answers, asked_judge = collect_answers(
            cases, ask, concurrent_num, judge, waves=waves, folder=folder
        )
        judgements = asked_judge if judge is not None else judgements
    stamp = time.strftime("%Y-%m-%d %H:%M:%S")
    results = materialised(evaluate(cases, answers, judgements, rules, stamp), f"{folder}/results")
    total_time = round(time.monotonic() - start, 2)
    batch_id = store.save_batch(results, model_name, total_time) if store is not None else ""
    report = export_csv(results, report_folder) if report_folder is not None else None
    return BatchRun(batch_id, results, summarise(results, total_time=total_time), report, folder)
