"""Chat formatting: fingerprints select mappings, texts come back whole, the mask covers the assistant's texts."""

import hashlib
import json
import random
import re

import pytest

import __spark_entry__
import compare
from answergauge.llm import chat_format, queries
from answergauge.llm.chat_format import TEMPLATE, Layout, Mappings, fingerprint

FOLDER = "/root/testdata/sf0.001"

RECORDS = [
    ({"role": "tool", "text": "t"}, "turn", [("tool", "t")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 3}, "messages",
     [("user", "a"), ("assistant", "")]),
    ({"system": "s", "messages": []}, "messages", [("system", "s")]),
    ({"messages": []}, "messages", []),
    ({"messages": [{"role": "user"}, {"content": "b"}, "c"]}, None, None),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "conversations",
     [("user", "a"), ("assistant", "b")]),
    ({"prompt": "p", "completion": "c", "meta": {"prompt": 1}}, "prompt", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "c"}, "prompt and response", [("user", "p"), ("assistant", "c")]),
    ({"output": "o", "input": "i", "instruction": "n"}, "instruction", [("user", "n\n\ni"), ("assistant", "o")]),
    ({"instruction": "n", "input": "", "output": 5}, "instruction", [("user", "n"), ("assistant", "5")]),
    ({"question": "q", "answer": True}, "question", [("user", "q"), ("assistant", "true")]),
    ({"request": {"messages": [{"role": "user", "content": "a"}], "n": 1}, "reply": {"message": {"content": "b"}}},
     "call log", [("user", "a"), ("assistant", "b")]),
    ({"prompt": "p", "output": "o"}, None, []),  # half of one layout, half of another
    ({"prompt": {"deep": 1}}, None, []),
    ([1, 2], None, []),
    ({}, None, []),
]


@pytest.mark.parametrize("record, layout, turns", RECORDS)
def test_layouts(record, layout, turns):
    mark, name, found = Mappings(chat_format.LAYOUTS).of(json.dumps(record))
    if turns is None:  # an item that is no object has a path of its own, which no layout knows
        assert name == "messages" and found == [("user", ""), ("", "b"), ("", "")]
    else:
        assert (name, found) == (layout, turns) and -(2**63) <= mark < 2**63


def test_fingerprints_depend_on_paths_alone():
    paths = lambda text: chat_format.field_paths(json.loads(text))
    assert fingerprint(paths('{"a": 1, "b": {"c": [2]}}')) == fingerprint(paths('{"b": {"c": ["x", null]}, "a": {"d": 0}, "a": ""}'))
    assert len({fingerprint(paths(t)) for t in ('{"a.b": 1}', '{"a": {"b": 1}}', '{"a": [{"b": 1}]}', '{"a": [1]}', "{}")}) == 5


@pytest.mark.parametrize("text", [None, "", "{", "nothing", '"text"', "[" * 100_000, "null", "7"])
def test_no_object_is_no_turn(text):
    assert Mappings(chat_format.LAYOUTS).of(text)[1:] == (None, [])


def test_layouts_are_declared_by_the_caller(spark):
    own = (Layout("mail", (chat_format.Named(("head", "from"), ("body",)),), (("me", "assistant"),)),)
    rows = spark.createDataFrame([(1, 0, '{"head": {"from": "me"}, "body": "x"}')], "conv_id int, turn int, record string")
    (row,) = chat_format.turns_of(rows, layouts=own).collect()
    assert (row["layout"], row["role"], row["text"]) == ("mail", "assistant", "x")


def plain(rows):
    """The contract in plain Python: per conversation (turn, role, text) in order."""
    out = {}
    for key in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2], r[3]) for r in rows if r[0] == key), key=lambda t: (t[0] is not None, t))
        learnt = "".join(t for _, role, t in turns if role == "assistant")
        said = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        out[key] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def read(df):
    return {r[0]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in df.collect()}


def records_of(spark, rows):
    records = [(c, t, json.dumps({"role": role, "text": text}), "x") for c, t, role, text in rows]
    return spark.createDataFrame(records, "conv_id long, turn int, record string, formatted string")


def test_random_texts_come_back(spark):
    rng = random.Random(5)
    bits = ["### ", "\\", "</turn>", "\n", ":\n", "\n</turn>\n", "Assistant:", " ", "é", "\U0001f600", "#", "</", "turn>", "\0", "\r"]
    some = lambda n: "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))
    rows = [(rng.randint(-3, 40), n, rng.choice(["user", "assistant", some(3)]), some(12)) for n in range(600)]
    formatted = chat_format.format_turns(chat_format.turns_of(records_of(spark, rows)))
    assert read(chat_format.read_back(formatted)) == plain(rows)
    for row in formatted.collect():
        ((role, start, end),) = TEMPLATE.parse(row["formatted"])
        assert (role, TEMPLATE.unescape(row["formatted"][start:end])) == (row["role"], row["text"])
        assert [tuple(s) for s in row["loss"]] == ([(start, end)] if role == "assistant" else [])
        body = row["formatted"][start:end]  # no control string stands in it without a backslash before it
        assert all(body[at.start() - 1 : at.start()] == "\\" for c in TEMPLATE.controls for at in re.finditer(re.escape(c), body))


def test_edge_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, "user", "first"), (1, 0, "assistant", ""), (1, 1, "user", "x"),
            (1, 1, "user", "x"), (1, 1, "assistant", "tie"), (2, 0, "assistant", "long " * 300_000), (3, 0, "", "")]
    formatted = chat_format.format_turns(chat_format.turns_of(records_of(spark, rows)))
    assert read(chat_format.read_back(formatted)) == plain(rows)
    assert chat_format.read_back(formatted.limit(0)).count() == 0
    broken = spark.createDataFrame([(5, 0, None), (5, 1, "{"), (5, 2, '{"other": 1}')], "conv_id long, turn int, record string")
    turns = chat_format.turns_of(broken)
    assert [r["layout"] for r in turns.collect()] == [None] * 3
    assert chat_format.format_turns(turns).count() == 0


def test_query_equals_sql(spark):
    name = "op13_chat_format"
    df = __spark_entry__.queries()[name](spark, FOLDER)
    assert compare.difference(df, compare.connect(FOLDER), __spark_entry__.oracle_sql()[name]) is None


def test_query_uses_every_layout_it_makes(spark):
    turns = chat_format.turns_of(queries.chat_records(spark.read.parquet(f"{FOLDER}/conversations.parquet")))
    assert {r[0] for r in turns.select("layout").distinct().collect()} == {"turn", "messages", "conversations", "prompt", "instruction"}


def test_query_with_nulls_and_added_columns(spark, tmp_path):
    rows = [(-7, 0, "user", None, 1), (1, 0, None, "a", 1), (1, 1, "assistant", None, 1), (2, 0, "human", "b", 1), (None, 2, "user", "c", 1)]
    given = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, record int")
    given.write.parquet(f"{tmp_path}/conversations.parquet")
    hard = [(-7, 0, "user", queries.HARD_TEXT), (-7, 1, "assistant", queries.HARD_TEXT)]
    want = plain([(c, t, r or "", x or "") for c, t, r, x, _ in rows] + hard)
    assert read(queries.op13_chat_format(spark, str(tmp_path))) == want
