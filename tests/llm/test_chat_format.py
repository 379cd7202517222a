"""Chat formatting: layouts, escaping and masks."""

import hashlib
import json
import random

import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from vigilspark.llm import chat_format as cf
from vigilspark.llm.plans import ORACLES, QUERIES

from conftest import SF

SAY = {
    "messages": {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
    "conversations": {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
    "turns": {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
    "prompt_response": {"response": "a", "prompt": "q"},
    "prompt_completion": {"prompt": "q", "completion": "a"},
    "question_answer": {"question": "q", "answer": "a"},
    "instruction_output": {"instruction": "q", "output": "a"},
}


def test_query_equals_its_sql(spark):
    name = "op6_chat_format"
    assert compare(spark, connect(SF), SF, name, QUERIES[name], ORACLES[name]) is None


def test_every_layout_gives_the_same_turns(spark):
    rows = [(i, json.dumps(x)) for i, x in enumerate(SAY.values())]
    turns = cf.turns_from_json(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    got = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, (r.layout, []))[1].append((r.role, r.text))
    assert got == {i: (name, [("user", "q"), ("assistant", "a")]) for i, name in enumerate(SAY)}


def test_longer_layouts_and_unknown_records(spark):
    rows = [
        (1, json.dumps({"system": "s", "prompt": "q", "response": "a"})),
        (2, json.dumps({"instruction": "q", "input": "more", "output": 5})),
        (3, json.dumps({"other": 1})), (4, "{broken"), (5, None), (None, json.dumps({"messages": []})),
        (6, json.dumps({"messages": [{"role": "user", "content": None}]})),
    ]
    turns = cf.turns_from_json(spark.createDataFrame(rows, "conv_id long, record string"))
    got = {(r.conv_id, r.turn): (r.layout, r.role, r.text) for r in turns.collect()}
    assert got[1, 0] == ("system_prompt_response", "system", "s") and got[1, 2][1:] == ("assistant", "a")
    assert got[2, 1][1:] == ("user", "more") and got[2, 2][1:] == ("assistant", "5")
    assert [got[k, None] for k in (3, 4, 5, None)] == [(None, None, None)] * 4
    assert got[6, 0] == ("messages", "user", None)
    out = {r.conv_id: r for r in cf.digest(cf.format_turns(turns)).collect()}
    assert len(out) == 7 and [out[k].n_turns for k in (3, 4, 5, None, 6)] == [0, 0, 0, 0, 1]


def test_further_fields_lose_no_turn(spark):
    more = {"id": 7, "source": {"role": "x", "content": [1]}, "tags": ["a"]}
    rows = []
    for i, said in enumerate(SAY.values()):
        said = json.loads(json.dumps(said))
        for turn in next((v for v in said.values() if isinstance(v, list)), []):
            turn |= {"name": "n", "meta": {"k": [{"z": 1}]}}
        rows.append((i, json.dumps(more | said)))
    rows.append((50, json.dumps(SAY["messages"] | {"prompt": "other"})))
    rows.append((51, json.dumps(SAY["prompt_response"] | {"system": {"not": "plain"}})))
    rows.append((52, json.dumps({"messages": [{"role": "user", "content": [{"type": "text"}]}]})))
    turns = cf.turns_from_json(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    got = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.turn or 0)):
        got.setdefault(r.conv_id, (r.layout, []))[1].append((r.role, r.text))
    both = [("user", "q"), ("assistant", "a")]
    assert {i: got[i] for i in range(len(SAY))} == {i: (name, both) for i, name in enumerate(SAY)}
    assert got[50] == ("messages", both) and got[51] == ("prompt_response", both) and got[52] == (None, [(None, None)])


def test_table_layouts(spark):
    tables = {
        "turn_rows": ([(1, 0, "user", "q", 9), (1, 1, "assistant", "a", 9)], "conv_id long, turn long, role string, text string, more int"),
        "message_rows": ([("x", 1, 0, "user", "q"), ("x", 1, 1, "assistant", "a")], "source string, conversation_id long, message_index int, role string, content string"),
        "speaker_rows": ([(1, 0, "human", "q"), (1, 1, "gpt", "a")], "conversation_id long, turn int, `from` string, value string"),
        "prompt_response_rows": ([(1, "q", "a", "l")], "id long, prompt string, response string, lang string"),
        "instruction_output_rows": ([(1, "q", "a")], "id long, instruction string, output string"),
    }
    for name, (rows, layout) in tables.items():
        table = spark.createDataFrame(rows, layout)
        assert cf.table_layout(table) == name
        found = cf.turns_from_table(table).orderBy("turn").collect()
        assert [(r.conv_id, r.turn, r.role, r.text) for r in found] == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]


def test_hash_does_not_depend_on_order_or_values(spark):
    same = ['{"prompt": "x", "response": 1}', '{"response": null, "prompt": [1]}', '{"response": 2.5, "prompt": true}']
    df = spark.createDataFrame([(x,) for x in same], "r string").select(cf.json_fingerprint(F.col("r")).alias("f"))
    a, b, c = (r.f for r in df.collect())
    assert a == c == cf.fingerprint({"prompt": 0, "response": 0}) != b


def test_control_strings_come_back(spark):
    rng = random.Random(2)
    bits = ["<|start|>", "<|", "|>", "<", "&", "&lt;", "&amp;", "&#91;", "[INST]", "[/INST]", "</s>", "[", "é🙂", "\n", "", "lt;", "amp;", "<|end|>"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(600)]
    rows = [(i // 3, i % 3, rng.choice(["user", "assistant", "<|text|>", "a\nb"]), t, 0) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    formatted = cf.format_turns(cf.turns_from_table(table))
    for r in formatted.select("*", cf.read_turns(F.col("formatted")).alias("t")).collect():
        want = [(x[2], x[3]) for x in rows if x[0] == r.conv_id]
        assert [tuple(t) for t in r.t] == want
        for x in ("</s>", "[INST]"):
            assert x not in r.formatted
        undone = [r.formatted[s.begin : s.end].replace("&lt;", "<").replace("&#91;", "[").replace("&amp;", "&") for s in r.loss_spans]
        assert undone == [t for role, t in want if role == "assistant"]


def test_odd_rows(spark):
    rows = [(1, 0, None, "x"), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (1, None, "user", None),
            (None, 3, "user", "n"), (2, 1, "assistant", "y" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in cf.digest(cf.format_turns(cf.turns_from_table(table))).collect()}
    said = "user\n\n" + "\nx\n" + "assistant\nx\n" * 2
    assert (out[1].n_turns, out[1].turns_sha256) == (4, hashlib.sha256(said.encode()).hexdigest())
    assert (out[1].loss_chars, out[2].loss_chars, out[None].loss_chars) == (2, 200_000, 0)
    assert cf.format_turns(cf.turns_from_table(table.limit(0))).count() == 0
    with pytest.raises(ValueError):
        cf.turns_from_table(table.drop("role"))


def test_no_python_in_the_plan(spark):
    for name in ("op6_chat_format", "op8_license_scan"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
