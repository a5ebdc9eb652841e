"""Grades batches of language-model answers as Spark DataFrame work."""

from answergauge.operators.evaluate import evaluate
from answergauge.operators.summarise import summarise
from answergauge.rules import Rules
from answergauge.sources.history import HistoryStore

__all__ = ["HistoryStore", "Rules", "evaluate", "summarise"]
