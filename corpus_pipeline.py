"""From raw documents to packed training sequences, in five stages.

Language ID, near-duplicates, personal data, mixing of sources, packing. Each stage takes what the one before it kept,
written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from answergauge.llm import language_id, mixing, pii, weighted_minhash
from answergauge.llm.common import materialised, table
from answergauge.llm.queries import packed

LEAST_CONFIDENCE = 0.5


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents; those without letters, or of no language with a probability of
    ``LEAST_CONFIDENCE``, go. Without any labelled document nothing can be told, and all stay.

    NULL and empty texts have no letters; NULL labels and ids are not learnt from; repeated rows and ties get equal
    results; an empty table stays empty; other columns are kept, whatever their names."""
    model = language_id.train(docs)
    if not model.languages:
        return docs
    pred, score = _free(docs, "_pred"), _free(docs, "_score")
    judged = model.annotate(docs, pred_col=pred, score_col=score)
    known = (F.col(pred) != language_id.UNKNOWN) & (F.col(score) >= LEAST_CONFIDENCE)
    return judged.where(known).drop(pred, score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Texts without a word (NULL, empty) are groups of their own and stay; of repeated rows one stays; see
    ``weighted_minhash`` for short and long texts."""
    return weighted_minhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to the name of its kind; all documents stay, also repeated ones and those with NULL or empty
    texts, and all columns."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of its source takes it. A NULL source is a source; texts without words (NULL,
    empty) have the size 0; repeated rows have tickets of their own; ties of tickets are broken as in ``mixing``."""
    return mixing.mix(docs)[0].rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. NULL and empty texts have the end token only; repeated rows are documents each;
    long texts give many windows; other columns are not read."""
    return packed(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixture", mixture),
    ("packing", packing),
]

# Sampled, learnt and packed rows have no counterpart in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
