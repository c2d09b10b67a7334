import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracewell.llm import chat, queries


@given(st.text(alphabet="\\#<>/hl: @turn\né", max_size=30))
def test_escape(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "#" not in chat.escape(text) and "<" not in chat.escape(text)


def test_language():
    run = lambda t, **v: chat.compile_template(t)(**v)[0]
    assert run("{{ 'a' + 'b' ~ 3 }}{{ x }}", x=None) == "ab3"
    assert run("{% for x in xs %}{{ loop.index }}{{ x.a[0] }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": ["p"]}, {"a": ["q"]}, {}]) == "1p,2q,3"
    assert run("{% set y = 2 + 3 %}{% if y == 5 and 'z' in 'xyz' %}yes{% elif true %}no{% else %}never{% endif %}") == "yes"
    assert run("{{ ' A ' | trim | lower }}|{{ xs | length }}", xs=[1, 2]) == "a|2"
    assert run("{{ 'a\\'b\\n' }}") == "a'b\n"
    assert chat.compile_template("é{% generation %}{{ x }}{% endgeneration %}!")(x="ab") == ("éab!", [(1, 3)])


def test_folding():
    assert chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 2 %}x{% elif not false %}c{% endif %}d")) == ("block", [("out", ("const", "ab1cd"))])
    assert chat.fold(chat.parse("{% if x %}{{ 1 + 1 }}{% endif %}")) == ("block", [("if", [(("name", "x"), ("block", [("out", ("const", 2))]))], ("block", []))])


@pytest.mark.parametrize("bad", ["{{ }}", "{% for %}", "{% if x %}", "{{ x() }}", "{{ 'a' | eval }}", "{% endfor %}", "{{ a b }}", "{% import os %}", "{{ x. }}", "{{ 'a }}"])
def test_refused(bad):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(bad)


def test_sandbox():
    assert chat.compile_template("{{ x.__class__ }}{{ 'a'.upper }}{{ xs.append }}")(x=object(), xs=[1])[0] == ""
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{% for c in 'abc' %}x{% endfor %}")()


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_query(spark):
    got = {r.conv_id: r for r in queries.op5_chat(spark, "/root/testdata/sf0.001").collect()}
    by = {-7: [("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")]}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert got.keys() == by.keys()
    for k, turns in by.items():
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == expected(turns)


def test_edge_cases(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "assistant", None), (2, 0, "tool: x<y", "### User: </turn>\n### Assistant: z</turn>\n"), (2, 1, None, "n"), (2, 1, None, "n"), (None, 1, "system", "s"), (3, 5, "assistant", "long " * 50_000)]
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn int, role string, text string, turns string")
    got = {r.conv_id: r for r in chat.read_back(chat.formatted(turns)).collect()}
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars, got[1].loss_sha256) == expected([("user", "a"), ("assistant", "b"), ("assistant", "")])
    assert got[2].turns_sha256 == expected([("tool: x<y", rows[3][3]), ("", "n"), ("", "n")])[1] and got[2].loss_chars == 0
    assert got[None].n_turns == 1 and got[3].loss_chars == 250_000
    lone = spark.createDataFrame([(None, 1, "user", "a")] * 3, "conv_id long, turn int, role string, text string")
    assert [r.n_turns for r in chat.read_back(chat.formatted(lone)).collect()] == [1, 1, 1]
    assert chat.read_back(chat.formatted(turns.limit(0))).count() == 0
