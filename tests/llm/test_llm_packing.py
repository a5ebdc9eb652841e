"""Packing: exact ids, every id once, full sequences, equal step groups."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from answergauge.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_parts_give_the_ids_of_the_whole_text():
    rng = random.Random(1)
    bits = [" ", "  ", "\n", " \n", "a", "The", "é", "1", "$", "\t", "\x85", "\x1c", "'s", " ", "日本", ".", "\0"]
    bits += ["<|endoftext|>", "\r\n", "\xa0", "́", "ǅ", "²", "Ⅷ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    got = packing.Encoder(PATH, entries=50)(texts)
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def checked(rows, texts):
    """Asserts that the pieces cover each document once and the sequences without gaps; returns the padding."""
    t = tokenizer()
    docs, sequences, steps = {}, {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        steps.setdefault(r["step_id"], {})[r["sequence_id"]] = r["tier"]
    assert set(docs) == set(texts)
    for key, pieces in docs.items():
        ids = b"".join(bytes(p["ids"]) for p in sorted(pieces, key=lambda p: p["start"]))
        want = t.encode(texts[key] or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert all(p["doc_tokens"] == len(want) for p in pieces)
    padding = 0
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += len(p["ids"]) // 4
        assert at <= 2048
        padding += 2048 - at if at & (at - 1) else 0
    full = [sum(s.values()) for s in steps.values()]
    assert max(full) <= packing.STEP_TOKENS
    return padding, len(sequences)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (4, "a"), (5, "b c d"), (None, "null id"), (7, "\n\n  x  ")]
    table = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").coalesce(1)
    padding, _ = checked(packing.pack(table, PATH).collect(), dict(rows))
    assert padding < 2048
    assert packing.pack(table.limit(0), PATH).count() == 0


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    padding, sequences = checked(packing.pack(table, PATH).collect(), texts)
    assert padding <= 2048 * table.rdd.getNumPartitions() and sequences > 10


def test_repeated_rows_are_documents_of_their_own(spark):
    table = spark.createDataFrame([(1, "same text")] * 3, "doc_id long, text string")
    rows = packing.pack(table, PATH).collect()
    assert sum(len(r["ids"]) // 4 for r in rows) == 3 * rows[0]["doc_tokens"]


def test_latin_texts_give_the_ids_of_the_whole_text():
    rng = random.Random(2)
    encoder = packing.Encoder(PATH, entries=50)
    plain = [c for c in map(chr, range(0x250)) if encoder.plain.fullmatch(c)]
    bits = [" ", " ", "\n", "'s", "'S", "'", "1", "²", "the", "Straße", "l'été", "!!", " |"]
    texts = ["".join(rng.choice(bits if rng.random() < 0.5 else plain) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    got = encoder(texts)
    want = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want


def test_the_words_of_a_large_vocabulary_are_made_once():
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(letters[i // 26**k % 26] for k in range(4)) for i in range(90_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    encoder = packing._encoder.__wrapped__(PATH)
    made, make = [], encoder.words.make
    encoder.words.make = lambda word: made.append(word) or make(word)
    first = encoder(texts)
    assert encoder(texts) == first
    assert len(made) < 1.05 * len(words)
