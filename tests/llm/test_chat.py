import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from attest.llm import chat
from attest.llm.template import Const, Output, TemplateError, Text, _operators, compile_template, fold, parse, rendered

from .helpers import collected

PIECE = st.lists(st.sampled_from(["\\", "###", "#", "</turn>", "<", "/turn>", "a", ":", " ", "\n", "### Assistant: ", "é", ""]), max_size=8).map("".join)
TURN = st.tuples(st.one_of(st.just("assistant"), PIECE), PIECE)


@settings(max_examples=300, deadline=None)
@given(st.lists(TURN, max_size=5))
def test_round_trip_and_mask(turns):
    render = compile_template(chat.TEMPLATE, chat.FILTERS)
    text, spans = rendered(render({"messages": iter([{"role": r, "text": t} for r, t in turns])}))
    assert [(r, t) for r, t, _, _ in chat.read_turns(text)] == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant" and t]


def test_broken_output_is_an_error():
    with pytest.raises(ValueError):
        list(chat.read_turns("### user: hi </turn>"))


def _digest(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())


@pytest.mark.parametrize("part", [1, 1 << 20])
def test_conversations_with_awkward_rows(spark, part):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, None, None), (None, 3, "assistant", "\\### x: </turn>"),
            (3, None, "user", "first"), (3, 0, "assistant", "é" * 1000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part string, formatted string")
    got = {r["conv_id"]: r for r in collected(chat.read_back(chat.format_conversations(df, part=part)))}
    expected = {1: [("user", "a"), ("assistant", "b"), ("assistant", "b")], 2: [("", "")], None: [("assistant", "\\### x: </turn>")],
                3: [("user", "first"), ("assistant", "é" * 1000)]}
    assert set(got) == set(expected)
    for k, turns in expected.items():
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == _digest(turns)
        assert r["formatted_chars"] == sum(len(f"### {chat.escape_role(a)}: {chat.escape(t)}</turn>\n") for a, t in turns)
    assert collected(chat.read_back(chat.format_conversations(df.limit(0)))) == []


@pytest.mark.parametrize("part", [1, 30])
def test_parts_end_with_a_turn_whatever_is_said(spark, part):
    turns = [("user", "a</turn>\n"), ("assistant", "</turn>\n"), ("</turn>\n", "x\\</turn>\n"), ("assistant", ""), ("assistant", "b" * 40 + "</turn>\n"), ("user", "")]
    df = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    parts = sorted(collected(chat.format_conversations(df, part=part)), key=lambda r: r["part"])
    assert [r["part"] for r in parts] == list(range(len(parts))) and len(parts) > 1
    assert [(r, t) for p in parts for r, t, _, _ in chat.read_turns(p["formatted"])] == turns
    r, = collected(chat.read_back(chat.format_conversations(df, part=part)))
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == _digest(turns)


def test_query_has_the_marks_conversation(spark):
    rows = {r["conv_id"]: r for r in collected(chat.op4_chat(spark, "/root/testdata/sf0.001"))}
    said = "\\### Assistant: </turn> ok"
    r = rows[-7]
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == _digest([("user", said), ("assistant", said)])
    by = {}
    for t in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(t["conv_id"], []).append((t["role"], t["text"]))
    assert set(rows) == {*by, -7}
    for k, turns in by.items():
        assert (rows[k]["n_turns"], rows[k]["turns_sha256"], rows[k]["loss_chars"], rows[k]["loss_sha256"]) == _digest(turns)


def _render(source, filters=None, **variables):
    return rendered(compile_template(source, filters or {"upper": str.upper})(variables))[0]


def test_language():
    assert _render("{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=iter("abc")) == "1,2,3"
    assert _render("{% set a = 'x' ~ 1 %}{{ a | upper }}{# no #}") == "X1"
    assert _render("{% if a == 1 and b %}1{% elif a < 3 or c %}2{% else %}3{% endif %}", a=2) == "2"
    assert _render("{{ m.k }}{{ m['k'] }}{{ m.none }}", m={"k": "v"}) == "vv"
    assert _render("{{ 'a' in 'cat' }}{{ (1 + 2) == 3 }}{{ none }}") == "truetrue"


def test_constants_are_folded():
    operators = _operators({"upper": str.upper})
    assert fold(parse("a{{ 'b' | upper ~ 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}"), operators) == (Text("aB1c"),)
    assert fold(parse("{{ false and x }}"), operators) == (Text("false"),)
    assert fold(Output(Const(1)), operators) == Output(Const(1))


@pytest.mark.parametrize("source", ["{{ f() }}", "{{ a.b | nothing }}", "{% for x %}{% endfor %}", "{% if a %}", "{% import x %}", "{{ a + }}", "{{ 'a }}", "{% set 1 = 2 %}"])
def test_what_the_sandbox_refuses(source):
    with pytest.raises(TemplateError):
        list(compile_template(source, {})({}))


def test_no_attributes_of_objects():
    with pytest.raises(TemplateError):
        _render("{{ a.__class__ }}", a="text")
