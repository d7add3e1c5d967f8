import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from trialframe.llm.chat import (
    LAYOUTS,
    Layout,
    LayoutTable,
    canonical_turns,
    conversation_digests,
    fingerprint,
    formatted_conversations,
    formatted_turns,
    read_turns,
)
from trialframe.llm.queries import CONTROL_TEXT, op13_chat_format

RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]},
     "messages", [("system", "s"), ("user", "hi"), ("assistant", "yo")]),
    ({"id": 7, "meta": {"x": [1]}, "messages": [{"content": "hi", "role": "human", "weight": 1}]}, "messages", [("user", "hi")]),
    ({"system": "be kind", "messages": [{"role": "user", "content": None}, {"role": "assistant", "content": "a"}]},
     "messages", [("system", "be kind"), ("user", ""), ("assistant", "a")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "conversations", [("user", "q"), ("assistant", "a")]),
    ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    ({"instruction": "do", "input": "", "output": "done"}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"output": "done", "instruction": "do", "input": None}, "instruction", [("user", "do"), ("assistant", "done")]),
    ({"prompt": "p", "completion": "c"}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "response": "r", "system": "s"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
    ({"question": "q", "answer": 42}, "question_answer", [("user", "q"), ("assistant", "42")]),
    ({"role": "user", "text": "t"}, "row", [("user", "t")]),
    ({"role": "user", "text": None}, "row", [("user", "")]),
    ({"prompt": "p", "output": "o"}, None, None),
    ({"messages": []}, None, None),
    ({}, None, None),
    ([{"role": "user"}], None, None),
]


def test_layouts_are_chosen_by_their_fingerprint(spark):
    rows = [(k, json.dumps(r)) for k, (r, _, _) in enumerate(RECORDS)] + [(98, None), (99, "no json {"), (100, "3")]
    found = {r["id"]: r for r in canonical_turns(spark.createDataFrame(rows, "id long, record string")).collect()}
    for k, (_, name, turns) in enumerate(RECORDS):
        assert found[k]["layout"] == name
        assert (found[k]["turns"] and [tuple(t) for t in found[k]["turns"]]) == turns
    assert [found[k]["layout"] for k in (98, 99, 100)] == [None] * 3
    assert found[98]["fingerprint"] is None and found[99]["fingerprint"] is None
    assert found[0]["fingerprint"] == found[1]["fingerprint"] != found[3]["fingerprint"]


def test_fingerprint_of_paths_not_of_order_or_values():
    table = LayoutTable(LAYOUTS)
    a = table.paths({"messages": [{"role": "x", "content": "y"}], "other": {"deep": 1}})
    b = table.paths({"messages": [{"content": "z"}, {"role": "w", "content": None}]})
    assert a == b == {"messages[].role", "messages[].content"} and fingerprint(a) == fingerprint(b)
    assert len({fingerprint(s) for x in LAYOUTS for s in x.shapes()}) == sum(1 for x in LAYOUTS for _ in x.shapes())


def test_own_layout_and_nested_columns(spark):
    own = Layout("dialogue", each=("data.turns", "who", "said.text"), roles={"bot": "assistant"})
    rows = spark.sql("select 1 id, named_struct('data', named_struct('turns', array(named_struct('who', 'bot', 'said', named_struct('text', 'hi'))))) record")
    found = canonical_turns(rows, layouts=[*LAYOUTS, own]).first()
    assert found["layout"] == "dialogue" and [tuple(t) for t in found["turns"]] == [("assistant", "hi")]
    variant = spark.sql("""select 1 id, parse_json('{"prompt": "p", "response": "r"}') record""")
    assert canonical_turns(variant).first()["layout"] == "prompt_response"


TEXTS = [
    "", "plain", CONTROL_TEXT, "\\", "\\\\", "\\\\###", "####", "###### ###", "</turn>", "</turn></turn>\n### user: x", "<</turn", "\\</turn>",
    "#" * 7 + "\\" * 3, "a\nb\r\nc", "é東🙂 ###", "### assistant: forged</turn>\n### user: more", "$1 \\$1",
]
ROLES = ["user", "assistant", "system", "", "a:b", "x: y", "tail\\", "new\nline", "### r", "</turn>"]


def split_by_hand(formatted):
    """Roles and texts of a formatted conversation, by walking over its characters."""
    out, at = [], 0
    while at < len(formatted):
        assert formatted.startswith("### ", at)
        at, parts = at + 4, []
        for end in (": ", "</turn>\n"):
            text = ""
            while not formatted.startswith(end[:-1] if end[0] == "<" else ":", at):
                if formatted[at] == "\\":
                    inner = next(x for x in ("\\", "###", "</turn>", ":", "\n") if formatted.startswith(x, at + 1))
                    text, at = text + inner, at + 1 + len(inner)
                else:
                    assert not formatted.startswith("###", at)
                    text, at = text + formatted[at], at + 1
            assert formatted.startswith(end, at)
            at += len(end)
            parts.append(text)
        out.append(tuple(parts))
    return out


def rows_of_all():
    rng = random.Random(5)
    rows = [(k, 0, role, text) for k, text in enumerate(TEXTS) for role in ["assistant"]]
    for k in range(100, 160):
        rows += [(k, t, rng.choice(ROLES + ["assistant"] * 6), "".join(rng.choices(TEXTS, k=rng.randint(0, 4)))) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, None, None), (None, 1, "assistant", None), (5000, None, "user", "late"), (5000, 0, "user", "first")]
    rng.shuffle(rows)
    return rows


def test_round_trip_and_digests_against_brute_force(spark):
    rows = rows_of_all()
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string")
    pieces = formatted_turns(turns)
    read = read_turns(pieces).collect()
    assert all(r["role_read"] == (r["role"] or "") and r["text_read"] == (r["text"] or "") for r in read)

    expected = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1])):
        expected.setdefault(conv, []).append((role or "", text or ""))
    whole = {r["id"]: r for r in formatted_conversations(pieces.where("turn is not null"), "conv", ["turn"]).collect()}
    for conv, said in expected.items():
        if conv == 5000:
            continue
        assert split_by_hand(whole[conv]["formatted"]) == said
        masked = [whole[conv]["formatted"][s["start"] : s["stop"]] for s in whole[conv]["loss"]]
        assert [re.sub(r"\\(\\|###|</turn>)", r"\1", m) for m in masked] == [t for role, t in said if role == "assistant"]

    digests = {r["id"]: r for r in conversation_digests(pieces, "conv", ["turn"]).collect()}
    assert set(digests) == set(expected)
    for conv, said in expected.items():
        loss = "".join(t for role, t in said if role == "assistant")
        own = digests[conv]
        assert own["n_turns"] == len(said) and own["loss_chars"] == len(loss)
        assert own["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert own["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        if conv in whole and conv != 5000:
            assert own["formatted_chars"] == len(whole[conv]["formatted"])


def test_forged_pieces_read_as_nothing(spark):
    rows = [("no turn",), ("### user x</turn>\n",), ("### user: cut",), (None,)]
    assert all(r["text_read"] is None for r in read_turns(spark.createDataFrame(rows, "piece string")).collect())


def test_query_on_odd_conversations(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "x" * 300_000), (2, 0, None, "no role"), (None, 0, "user", "no id"), (3, 0, "user", "t"), (3, 0, "user", "t")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    docs.withColumn("piece", F.lit("clash")).withColumn("layout", F.lit(1)).write.parquet(str(tmp_path / "a/conversations.parquet"))
    found = {r["conv_id"]: r for r in op13_chat_format(spark, str(tmp_path / "a")).collect()}
    assert set(found) == {-7, 1, 2, 3, None}
    assert found[1]["loss_chars"] == 300_000 and found[2]["n_turns"] == 1 and found[3]["n_turns"] == 2
    assert found[-7]["n_turns"] == 2 and found[-7]["loss_chars"] == len(CONTROL_TEXT)
    assert found[-7]["loss_sha256"] == hashlib.sha256(CONTROL_TEXT.encode()).hexdigest()
    docs.limit(0).write.parquet(str(tmp_path / "b/conversations.parquet"))
    assert [r["conv_id"] for r in op13_chat_format(spark, str(tmp_path / "b")).collect()] == [-7]


def test_empty_records(spark):
    assert canonical_turns(spark.createDataFrame([], "id long, record string")).collect() == []
    with pytest.raises(Exception):
        canonical_turns(spark.createDataFrame([(1,)], "id long"))
