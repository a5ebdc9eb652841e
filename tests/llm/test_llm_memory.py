"""What a task has freed goes back to the system, since Spark uses its Python workers again."""

import pytest
from pyspark.sql import functions as F

from answergauge.llm import language_id, packing, pii, weighted_minhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stages(docs):
    yield pii, lambda: pii.redact(docs)
    yield pii, lambda: pii.find_pii(docs)
    yield language_id, lambda: language_id.train(docs).predict(docs)
    vectors = docs.select(F.encode("text", "utf-8").alias("node"), F.unhex(F.lit("00" * 8)).alias("hashes"))
    idf = docs.sparkSession.sparkContext.broadcast(language_id.np.ones(1 << weighted_minhash.BUCKET_BITS))
    yield weighted_minhash, lambda: weighted_minhash._shingle_weights(vectors, idf)


@pytest.mark.parametrize("which", range(4))
def test_tasks_give_memory_back(spark, monkeypatch, tmp_path, which):
    rows = [(i, f"mail a{i}@example.org or wait, word {i}", "ab"[i % 2], "s", 9) for i in range(20)]
    module, made = list(stages(spark.createDataFrame(rows, COLUMNS)))[which]
    said = str(tmp_path / "said")

    def give_back():
        with open(said, "a") as out:
            out.write("x")

    monkeypatch.setattr(module, "give_back", give_back, raising=False)
    assert made().count() >= 20
    assert (tmp_path / "said").exists()


def test_words_of_many_short_texts_are_not_all_kept():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    encoder = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"), entries=50)
    texts = [f"w{i}x{i}" for i in range(2000)]
    ids = encoder(texts)
    assert len(encoder.words) + len(encoder.words.old) <= 120
    assert ids == packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))(texts)
