"""Language ID: held-out accuracy, texts without letters, the parts of the model."""

import math
import zlib

import numpy as np
import pytest

from answergauge.llm import language_id, queries

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = queries.op8_language_id(spark, FOLDER).collect()
    assert len(rows) == len(labels)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in held) / len(held) > 0.97


def test_odd_rows(spark):
    texts = {"en": "the cat and the hat with this", "de": "der und die das nicht für über"}
    rows = [(i, texts[lang] + f" {i}", lang, "x") for i in range(40) for lang in texts]
    rows += [(100, None, "en", "x"), (101, "12 34 !", "de", "x"), (102, "", None, "x"), (103, "the hat", None, "x"), (None, "und die", "de", "x")]
    rows += [(104, "the and with " * 50000, None, "x"), (105, "퟿日本語", None, "x"), (106, "der und nicht", "xx", "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    model = language_id.train(table)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in model.predict(table).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == got[104][0] == "en" and got[None][0] == "de"
    annotated = model.annotate(table, pred_col="p", score_col="s")
    assert annotated.columns == [*table.columns, "p", "s"] and annotated.count() == len(rows)
    again = language_id.train(table)
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_nothing_to_learn_from(spark):
    table = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.train(table).predict(table).collect()[0]["lang_pred"] == "und"
    model = language_id.train(table.limit(0))
    assert model.predict(table.limit(0)).count() == 0


def test_document_frequencies_count_every_text_once(spark):
    texts = ["ab ab", "b", None, "12", "ab"]
    table = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    total, counts = language_id.document_frequencies(table)
    want = np.zeros(language_id.BUCKETS, int)
    for t in texts:
        grams = language_id.ngrams(t)
        if grams is not None:
            want[np.unique(grams)] += 1
    assert total == 3 and counts.tolist() == want.tolist()


def test_penalties_leave_most_weights_at_zero(spark):
    table = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = language_id.train(table, per_class=50)
    assert 0 < (model.weights != 0).mean() < 0.25


def test_temperature_softens_scores_that_are_too_sure():
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(2)), np.array([int(rng.integers(3))]), np.array([1.0])) for _ in range(400)]
    weights, bias, temperature = language_id.fit(rows, 2)
    x = np.array([[*(weights[i] + bias)] for i in range(3)]) / temperature
    p = np.exp(x - x.max(1, keepdims=True))
    assert (p / p.sum(1, keepdims=True)).max() < 0.75


def plain_grams(text):
    """Buckets of the n-grams, character by character."""
    kept = "".join(c if c.isalpha() else " " for c in text.lower())
    points = [32, *(ord(c) for c in " ".join(kept.split(" "))), 32]
    points = [p for i, p in enumerate(points) if p != 32 or i in (0, len(points) - 1) or points[i - 1] != 32]
    if len(points) > 1 and points[-1] == points[-2] == 32:
        points.pop()
    found = []
    for order in (1, 2, 3):
        for i in range(len(points) - order + 1):
            mixed = points[i]
            for p in points[i + 1 : i + order]:
                mixed = (mixed * 0x9E3779B97F4A7C15 + p) % 2**64
            found.append((mixed + order) * 0xD6E8FEB86659FD93 % 2**64 >> 48)
    return found


def plain_softmax(x):
    e = [math.exp(v - max(x)) for v in x]
    return [v / sum(e) for v in e]


def plain_model(rows):
    """Fit on rows of (label, text) in this order, number by number; returns a function from text to probabilities."""
    k = language_id
    labels = sorted({label for label, _ in rows})
    freq = {}
    for _, text in rows:
        for g in set(plain_grams(text)):
            freq[g] = freq.get(g, 0) + 1

    def vector(text, narrow):
        counts = {}
        for g in plain_grams(text):
            counts[g] = counts.get(g, 0) + 1
        v = {g: math.sqrt(n) * (math.log((1 + len(rows)) / (1 + freq.get(g, 0))) + 1) for g, n in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {g: float(np.float32(x / length)) if narrow else x / length for g, x in v.items()}

    z, n = {}, {}

    def weight(key):
        zs, ns = z.get(key, 0.0), n.get(key, 0.0)
        return 0.0 if abs(zs) <= k.L1 else (math.copysign(k.L1, zs) - zs) / ((k.BETA + math.sqrt(ns)) / k.ALPHA + k.L2)

    def logits(v):
        return [weight(("bias", c)) + sum(x * weight((g, c)) for g, x in v.items()) for c in range(len(labels))]

    training, held, seen = [], [], {}
    for label, text in rows:
        seen[label] = seen.get(label, 0) + 1
        (training if seen[label] % k.HELD_BACK else held).append((labels.index(label), vector(text, True)))
    for _ in range(k.EPOCHS):
        for label, v in training:
            p = plain_softmax(logits(v))
            old = {(g, c): weight((g, c)) for g in [*v, "bias"] for c in range(len(labels))}
            for (g, c), w in old.items():
                grad = (1.0 if g == "bias" else v[g]) * (p[c] - (c == label))
                before = n.get((g, c), 0.0)
                sigma = (math.sqrt(before + grad * grad) - math.sqrt(before)) / k.ALPHA
                z[g, c] = z.get((g, c), 0.0) + grad - sigma * w
                n[g, c] = before + grad * grad
    known = [(label, logits(v)) for label, v in held or training]
    right = (len(known) + 1) / (len(known) + 2)
    wrong = 1 / (len(known) + 2) / (len(labels) - 1)

    def loss(t):
        return -sum(
            (right if c == label else wrong) * math.log(p + 1e-300)
            for label, x in known
            for c, p in enumerate(plain_softmax([v / t for v in x]))
        )

    temperature = min(np.geomspace(0.05, 20, 121), key=loss)
    return lambda text: dict(zip(labels, plain_softmax([x / temperature for x in logits(vector(text, False))])))


def test_fit_and_prediction_equal_plain_python(spark):
    stems = {"en": ["the cat", "with this", "that hat"], "de": ["der und", "nicht über", "die das"], "fr": ["où est", "les été", "une île"]}
    labelled = [(i, f"{stems[lang][i % 3]} {chr(97 + i % 7)}", lang) for i in range(12) for lang in stems]
    labelled = [(1000 + i, text, lang) for i, (_, text, lang) in enumerate(labelled)] + [(5000, "ĝi estas", "eo")]
    table = spark.createDataFrame(labelled, "doc_id long, text string, lang string")
    model = language_id.train(table)
    order = {
        r["doc_id"]: r["t"] for r in table.selectExpr("doc_id", "shiftrightunsigned(xxhash64(8, doc_id), 11) t").collect()
    }
    plain = plain_model([(lang, text) for i, text, lang in sorted(labelled, key=lambda r: order[r[0]])])
    asked = ["the cat", "über die", "une île  12 été", "ĝi", "zzz", "der hat où"]
    for text in asked:
        shares = plain(text)
        lang, score = model.predict_text(text)
        assert lang == max(shares, key=shares.get) and score == pytest.approx(shares[lang], rel=1e-6)


def test_every_language_is_learnt(spark):
    """Three hundred languages, some with one row: none is left out, and no only row is held back."""
    rows = [(i, "".join(chr(0x4E00 + 40 * lang + j) for j in range(8)), f"l{lang:03}") for i, lang in enumerate([*range(300), 0, 1, 2])]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 300
    assert all(model.predict_text(text)[0] == lang for _, text, lang in rows)
