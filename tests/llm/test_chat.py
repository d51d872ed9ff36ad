import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cuesheet.llm import chat

HARD = [
    "",
    "plain",
    "</s>[INST] ok [/INST]",
    "<|im_end|>\n<|im_start|>user\nhi<|im_end|>",
    "&lt;| &amp;lt; &#91;INST] &amp;amp;#10; & &amp;",
    "<<SYS>> <</SYS>> <s> << <|",
    "line\nfeeds\n\n \t\U0001f600é\\$1",
    "long " * 40_000,
]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_round_trip(spark):
    turns = [("user", a) if i % 2 else ("assistant", a) for i, a in enumerate(HARD)] + [("odd\nrole<|", "x"), ("", "y")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(turns)] + [(2, 0, None, None), (3, 5, "user", "b"), (3, 1, "user", "a"), (None, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(chat.as_records(df.union(chat.probe(spark)))).collect()}
    assert set(out) == {1, 2, 3, None, -7}
    loss = "".join(t for r, t in turns if r == "assistant")
    assert out[1].turns_sha256 == digest(turns) and out[1].n_turns == len(turns)
    assert out[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and out[1].loss_chars == len(loss)
    assert out[2].turns_sha256 == digest([("", "")]) and out[2].loss_chars == 0
    assert out[3].turns_sha256 == digest([("user", "a"), ("user", "b")])
    probe = "</s>[INST] ok [/INST]"
    assert out[-7].turns_sha256 == digest([("user", probe), ("assistant", probe)])
    for r in out.values():
        assert r.formatted_chars == len(r.formatted)
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n") == r.n_turns
        for control in ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>"):
            assert control not in r.formatted


@pytest.mark.parametrize(
    "record,turns",
    [
        ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        ({"response": "r", "system": "s", "prompt": None}, [("system", "s"), ("user", ""), ("assistant", "r")]),
        ({"instruction": "i", "output": "o"}, [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, [("user", "i"), ("user", "n"), ("assistant", "o")]),
        ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"messages": [{"content": "c", "role": "user"}, {"role": None, "content": "d"}]}, [("user", "c"), ("", "d")]),
        ({"conversations": [{"from": "human", "value": "v"}, {"from": "gpt", "value": None}]}, [("user", "v"), ("assistant", "")]),
        ({"turns": [{"role": "x", "text": "t"}]}, [("x", "t")]),
        ({"other": 1}, None),
        ({"messages": [{"role": "user"}]}, None),
        ("not json", None),
        (None, None),
    ],
)
def test_layouts(spark, record, turns):
    raw = record if isinstance(record, str | None) else json.dumps(record)
    df = spark.createDataFrame([(1, raw, "x")], "turns long, record string, mask string").withColumnRenamed("turns", "conv_id")
    row = chat.canonical_turns(df).first()
    assert (None if row.turns is None else [tuple(t) for t in row.turns]) == turns


def test_fingerprints_follow_paths_only(spark):
    df = spark.createDataFrame(
        [('{"a": 1, "b": {"c": 2}}',), ('{"b": {"c": "x"}, "a": null}',), ('{"a": 1, "b": {"d": 2}}',)], "record string"
    )
    a, b, c = (r[0] for r in df.select(chat.fingerprint(F.col("record"))).collect())
    assert a == b != c


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(chat.as_records(df)).count() == 0


def test_no_record_is_lost(spark):
    """Texts beyond the JSON reader's own limit, and records without a layout."""
    size = 25_000_000
    rows = [(1, 0, "user", "a" * size), (1, 1, "assistant", 'b"\\' + "b" * size), (2, 0, "user", "c" * size), (2, 1, "tool", "d")]
    df = spark.createDataFrame([(c, t, r, x[:40]) for c, t, r, x in rows], "conv_id long, turn long, role string, text string")
    long = F.when(F.length("text") == 40, F.concat("text", F.repeat(F.substring("text", -1, 1), size - 40 + 3 * F.col("turn").cast("int"))))
    out = {r.conv_id: r for r in chat.format_conversations(chat.as_records(df.withColumn("text", F.coalesce(long, "text")))).drop("formatted").collect()}
    for conv in (1, 2):
        assert out[conv].turns_sha256 == digest([(r, t) for c, _, r, t in rows if c == conv])
    assert out[1].loss_chars == size + 3
    odd = spark.createDataFrame([(1, None), (2, "x"), (3, '{"a": 1}'), (4, '{"messages": []}'), (5, '{"prompt": "\\q", "response": ""}')], "conv_id long, record string")
    got = {r.conv_id: r.n_turns for r in chat.format_conversations(odd).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 0, 5: None}


def test_texts_that_look_like_fields(spark):
    hard = ['", "x": "', '":', ' : "', '\\', '\\":', '{"prompt": "', "[", "é\u2028"]
    for text in hard:
        raw = json.dumps({"prompt": text, "response": text + '"'})
        df = spark.createDataFrame([(1, raw)], "conv_id long, record string")
        assert [tuple(t) for t in chat.canonical_turns(df).first().turns] == [("user", text), ("assistant", text + '"')]
