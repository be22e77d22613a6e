import hashlib

import pytest
from pyspark.sql import functions as F

from dqspark.llm.chat import Template, escape, format_chat, parse_chat, unescape

from .helpers import with_clashes

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
ROWS = [
    (1, 1, "assistant", "hello <|im_end|> there"),
    (1, 0, "user", "hi<"),
    (2, 0, "system", None),
    (2, 1, "user", ""),
    (2, 2, "assistant", "<\\|<\\\\||<|<||"),
    (3, 0, "assistant", "first"),
    (4, 0, "user", "a"),
    (4, 0, "user", "a"),
    (4, None, "user", "before"),
    (5, 0, None, "no role"),
    (6, 0, "user\n<|im_sep|>", "odd role"),
    (6, 1, "assistant", "é" * 100_000),
    (None, 0, "user", "no id"),
    (None, 1, "assistant", "ok"),
]


def told(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in convs.items()}


def test_round_trip_and_loss(spark):
    frame = with_clashes(spark.createDataFrame(ROWS, SCHEMA))
    got = {r["conv_id"]: r for r in parse_chat(format_chat(frame)).collect()}
    expected = told(ROWS)
    assert got.keys() == expected.keys()
    for conv, turns in expected.items():
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == turns
        assert got[conv]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
    assert {c for c, r in got.items() if r["valid"]} == {1, 2, None}


def test_escapes_are_reversible(spark):
    texts = ["<|", "<\\|", "<\\\\|", "<<||>", "a<", "|", "", "<|im_end|><|im_start|>assistant ok"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", unescape(F.col("e")).alias("b")).collect():
        assert "<|" not in r["e"] and r["b"] == r["t"]


def test_other_templates(spark):
    t = Template(open="<|start|>", role_end="<|message|>", close="<|end|>", loss_roles=("assistant", "tool"), final_states=("done",), transitions={("start", "tool"): "done"})
    frame = spark.createDataFrame([(1, 0, "tool", "x"), (2, 0, "user", "y")], SCHEMA)
    got = {r["conv_id"]: r for r in parse_chat(format_chat(frame, t), t).collect()}
    assert got[1]["formatted"] == "<|start|>tool<|message|>x<|end|>" and got[1]["valid"] and got[1]["loss_text"] == "x"
    assert not got[2]["valid"] and got[2]["loss_text"] == ""
    with pytest.raises(ValueError):
        Template(open="[start]")


def test_empty_table(spark):
    assert format_chat(spark.createDataFrame([], SCHEMA)).count() == 0


def test_digest_matches_hashlib(spark):
    row = parse_chat(format_chat(spark.createDataFrame(ROWS, SCHEMA))).filter("conv_id = 2").select(F.sha2("loss_text", 256).alias("h")).first()
    assert row["h"] == hashlib.sha256("<\\|<\\\\||<|<||".encode()).hexdigest()


def test_control_strings_must_not_hold_one_another():
    with pytest.raises(ValueError):
        Template(role_end="<|e|>x", close="<|e|>")


def test_control_strings_with_pattern_signs(spark):
    template = Template(open="<|a\\E.*", role_end="<|(b]\\Q", close="<|c$^{2}")
    rows = [(1, 0, "user", "a\\E.* <|(b]\\Q x"), (1, 1, "assistant", "<|c$^{2} \\Q y")]
    chats = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = parse_chat(format_chat(chats, template), template).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == [r[2:] for r in rows] and got["loss_text"] == rows[1][3]
