"""The pipeline: what each stage keeps, on its own input."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from answergauge.llm import language_id, pii, weighted_minhash
from answergauge.llm.common import materialised

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    junk = spark.createDataFrame([(10**9, "12 34 56 !!", "en", "src0", 11), (10**9 + 1, None, None, None, None)], docs.schema)
    docs = docs.unionByName(junk)
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialised(stage(spark, out[-1], FOLDER)))
    return out


def test_registered():
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_columns(stages):
    for made in stages[1:5]:
        assert made.dtypes == stages[0].dtypes


def test_language_keeps_clean_documents(stages):
    kept = {r[0] for r in stages[1].select("doc_id").collect()}
    gone = [r for r in stages[0].collect() if r["doc_id"] not in kept]
    assert {10**9, 10**9 + 1} <= {r["doc_id"] for r in gone}
    assert len(gone) <= 2 + 0.01 * len(kept)
    assert all(language_id.ngrams(r["text"]) is None or len(r["text"]) < 200 for r in gone)


def test_one_of_each_group(stages):
    kept = sorted(r[0] for r in stages[2].select("doc_id").collect())
    classes = weighted_minhash.classes(stages[1]).collect()
    assert kept == sorted({r["class_id"] for r in classes}) and len(kept) < len(classes)


def test_personal_data_is_gone(stages):
    before = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert set(before) == set(after)
    changed = 0
    for key, text in before.items():
        spans = pii.spans_of(text)
        assert after[key]["text"] == pii.redacted(text, spans)
        assert after[key]["n_chars"] == len(after[key]["text"])
        changed += bool(spans)
    assert changed


def test_mixture_repeats_rows(stages):
    before = {tuple(r) for r in stages[3].collect()}
    after = [tuple(r) for r in stages[4].collect()]
    assert set(after) <= before and max(after.count(r) for r in set(after)) == 2
    words = lambda rows: sum(len((r[1] or "").split()) for r in rows)
    assert abs(words(after) - 1.5 * words(before)) < 0.05 * words(before)


def test_all_tokens_are_packed(stages):
    pieces = stages[5].collect()
    total = {}
    for p in pieces:
        total[p["doc_id"]] = total.get(p["doc_id"], 0) + p["length"]
    times = {}
    for r in stages[4].select("doc_id").collect():
        times[r[0]] = times.get(r[0], 0) + 1
    tokens = {p["doc_id"]: p["doc_tokens"] for p in pieces}
    assert total == {k: tokens[k] * n for k, n in times.items()}


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.count() > 0 and "sequence_id" in rows.columns


def test_every_stage_takes_an_empty_table(spark):
    empty = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, FOLDER).count() == 0


def test_language_takes_any_column_name(spark, stages):
    given = stages[0].selectExpr("*", "source as _pred", "doc_id as _SCORE")
    kept = corpus_pipeline.language(spark, given, FOLDER)
    assert kept.columns == given.columns and kept.count() == stages[1].count()
    assert kept.where("_pred <=> source AND _SCORE <=> doc_id").count() == kept.count()


def test_language_keeps_an_unlabelled_table(spark, stages):
    given = stages[0].withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, given, FOLDER)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in given.collect())


def test_stages_take_repeated_rows_and_long_texts(spark, stages):
    some = stages[0].where("lang = 'en'").limit(20)
    long = some.limit(1).withColumn("text", F.repeat("text", F.lit(400))).withColumn("doc_id", F.lit(77_000_001).cast("long"))
    docs = materialised(some.unionByName(some).unionByName(long))
    for name, stage in corpus_pipeline.STAGES:
        made = materialised(stage(spark, docs, FOLDER))
        assert made.count() > 0
        if name == "near_duplicates":
            ids = [r["doc_id"] for r in made.collect()]
            assert len(ids) == len(set(ids))
        docs = made
