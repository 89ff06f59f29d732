import duckdb
import hypothesis
import hypothesis.strategies as st
import json
import pytest

from leafmark.llm import chat


@hypothesis.given(st.lists(st.tuples(st.text(), st.text()), max_size=5))
def test_template_round_trip(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@pytest.mark.parametrize(
    "record, turns",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]), ({"messages": []}, []),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "tool", "value": 3}]}, [("user", "a"), ("assistant", "b"), ("tool", "3")]),
        ({"prompt": "", "response": "b"}, [("user", ""), ("assistant", "b")]), ({"completion": "b", "prompt": "a"}, [("user", "a"), ("assistant", "b")]),
        ({"instruction": "do", "input": "", "output": "x"}, [("user", "do"), ("assistant", "x")]), ({"instruction": "do", "input": "this", "output": "x"}, [("user", "do\n\nthis"), ("assistant", "x")]),
        ({"system": "s", "prompt": "a", "response": "b"}, [("system", "s"), ("user", "a"), ("assistant", "b")]), ({"turns": [{"role": "user", "text": "a"}]}, [("user", "a")]),
        ({"prompt": "a"}, None), ({"messages": [{"role": "user", "content": "a", "extra": 1}]}, None), ([1], None), ("x", None), (7, None),
    ],
)
def test_layouts(record, turns):
    known = {chat.fingerprint(m.paths): m for m in chat.MAPPINGS}
    assert len(known) == len(chat.MAPPINGS)
    assert chat.canonical(json.dumps(record), known)[1] == turns


def test_fingerprints_ignore_order_and_values():
    f = lambda x: chat.fingerprint(chat.field_paths(x))
    assert f({"a": 1, "b": [{"c": 2}]}) == f({"b": [{"c": None}, {"c": "x"}], "a": "y"}) != f({"a": 1, "b": {"c": 2}})


def test_records_that_fit_nothing(spark):
    df = spark.createDataFrame([(1, None, "clash"), (2, "{broken", ""), (3, '{"odd": 1}', ""), (4, '{"prompt": "a", "response": "b"}', ""), (4, '{"prompt": "a", "response": "b"}', "")], "id long, record string, formatted string")
    got = sorted((r.id, r.n_turns, r.formatted is None) for r in chat.format_records(df).collect())
    assert got[:3] == [(1, None, True), (2, None, True), (3, None, True)] and [x[0] for x in got] == [1, 2, 3, 4, 4] and got[3][1:] == (2, False)
    assert chat.format_records(df.limit(0)).isEmpty()


def test_query_equals_sql(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <#\\"), (2, 1, "assistant", None), (2, 0, None, "q"), (3, 0, "system", ""), (3, 1, "user", "é" * 5000), (3, 2, "assistant", "a"), (3, 3, "assistant", "b"), (4, 0, "user", "x"), (4, 0, "user", "x"), (None, 0, "user", "no id"), (5, None, "a:b\n", "</turn>")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, record string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = chat.op3_schema_fingerprint(spark, str(tmp_path))
    want = con.execute(chat.OP3_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert [r.conv_id for r in chat.op3_schema_fingerprint(spark, f"{tmp_path}/none").collect()] == [-7]


def test_megabytes_in_one_text():
    turns = [("user", r"\<#" * 400_000), ("assistant", "some text </turn> " * 80_000)]
    text, spans = chat.render(turns)
    (a, b), = spans
    assert chat.parse(text) == turns and chat.unescape(text[a:b]) == turns[1][1]
