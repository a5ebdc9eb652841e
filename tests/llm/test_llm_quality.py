"""Line-first quality rules: the query against its SQL, odd texts against plain Python."""

import re

import pytest

import compare
from answergauge.llm import line_quality, queries

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + o for at in windows.values() if len(at) > 1 for i in at for o in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
        len(words) < 20 or 100 * len(covered) > 30 * len(words),
    )


def test_query_equals_sql(spark):
    con = compare.connect(FOLDER)
    assert compare.difference(queries.op7_line_quality(spark, FOLDER), con, queries.OP7_SQL) is None


def test_odd_texts(spark):
    texts = [None, "", " \n\t", "one", "a\x0bb\x0cc d\re f", "x y\nx y\n\nx y\n", "a b c d e f g h " * 5, "1 2 3 4 5 6 7 8 9 " * 2]
    texts += ["w " * 30000, "| a " * 20000, "!! " * 20000, "é#é " * 30, "." * 100000, "The end.\n" * 40, "ab" * 50000]
    texts += [" ".join(map(str, range(30))) + "\n" + " ".join(map(str, range(5, 20)))]
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "null", "x")], "doc_id long, text string, quality string")
    rows = line_quality.measures(table).collect()
    assert len(rows) == len(texts) + 1
    got = {r["doc_id"]: tuple(r)[1:6] + (r["base_failed"],) for r in rows if r["doc_id"] is not None}
    assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert all(not (r["kept"] and r["base_failed"]) for r in rows)
    assert line_quality.measures(table.limit(0)).count() == 0


@pytest.mark.parametrize(
    "line, fails",
    [
        ("This is a sentence that ends as it should.", False),
        ('He said "no more than this."', False),
        ("A long line without an end that goes on for a good many words", False),
        ("Home page", True),
        ("Home | News | Sport | Contact", True),
        ("home > shop > shoes > red shoes for men", True),
        ("All Rights Reserved.", True),
        ("Licensed under the Apache License, Version 2.0.", True),
        ("BUY NOW!! CHEAP!! TODAY!!", True),
        ("word$$$ other### third&&& fourth***.", True),
        ("Wow! That is a fine thing to say.", False),
        ("The blog in question has a dialog in every catalog in the shop.", False),
        ("To read the file, users must log in to the server with the key that they were given.", False),
        ("Log in or sign up now.", True),
        ("Alle Rechte vorbehalten.", True),
        ("Tous droits réservés © 2024, Société Exemple.", True),
        ("Lea nuestra política de privacidad y el aviso legal.", True),
        ("The court held that a privacy policy of the firm, " + "which its readers had never seen, " * 4 + "was void.", False),
        ("Terms of use, privacy policy, all rights reserved: " + "and so on with a few more " * 5 + "words.", True),
        ("यह एक वाक्य है।", False),
        ("هل هذا صحيح؟", False),
        ("这是一个句子。」", False),
        ("ก" * 100, False),
        ("Hauptseite Kontakt Impressum", True),
    ],
)
def test_rules(spark, line, fails):
    from pyspark.sql import functions as F

    assert spark.range(1).select(line_quality.fails(F.lit(line))).first()[0] is fails


def test_failing_lines_go_before_the_document_is_judged(spark):
    good = "Line {0} has word{0} and other{0} and more{0}, up to its end{0}."
    text = "\n".join([good.format(i) for i in range(9)] + ["Home", "Privacy policy"])
    junk = "\n".join(["Home{0} | News{0} | Sport{0} | Contact{0} | Shop{0}".format(i) for i in range(9)] + [good.format(0)])
    rows = line_quality.with_clean_text(spark.createDataFrame([(1, text), (2, junk)], "doc_id long, text string")).collect()
    assert rows[0]["quality"]["kept"] and rows[0]["quality"]["clean_text"] == text.split("\nHome")[0]
    assert not rows[1]["quality"]["kept"] and not rows[1]["quality"]["base_failed"]


def test_one_phrase_does_not_cost_a_single_line_article(spark):
    words = [f"word{i}" for i in range(245)]
    article = lambda said: " ".join(words[:120] + said.split() + words[120:]) + "."
    texts = [article(s) for s in ("catalog in", "store of", "log in", "newsletter", "privacy policy", "Alle Rechte vorbehalten")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert all(r["kept"] and r["n_failed_lines"] == 0 for r in line_quality.measures(docs).collect())


def test_rules_equal_those_of_the_sql(spark):
    import duckdb

    said = ["log in", "LOG IN", "login", "newsletter", "privacy policy", "conditions d'utilisation", "a | b | c | d", "x > y > z > w"]
    said += ["Wow!! Now!! Buy!!", "no\\back 2 0 x", "x x x x | | |", "2 0 9 x0D !! !! !!", "$ % &", "end.", "यह।", "tail\r", ""]
    lines = [a + m + b + e for a in said for b in said for m in (" ", " and then ", ",") for e in ("", ".", "」", " ;  ")]
    rows = [(i, "\n".join(lines[i : i + 9])) for i in range(0, len(lines), 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert compare.difference(line_quality.measures(docs), con, queries.OP7_SQL) is None


def test_no_python_and_no_shuffle(spark):
    plan = queries.op7_line_quality(spark, FOLDER)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
