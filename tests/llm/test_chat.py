"""Template compiler and chat formatting."""

from hashlib import sha256

import pytest
from hypothesis import given
from hypothesis import strategies as st

from seriesloom.llm import chat
from seriesloom.llm.template import Const, For, If, Out, TemplateError, compile_template, fold, parse

PIECES = st.lists(st.sampled_from(["<turn>", "</turn>", "### ", "\\", "\n", "<", "turn>", "#", "## ", " ", "/", "é", "😀", "a", "</turn>\n", "user"]), max_size=12).map("".join) | st.text(max_size=30)
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]) | PIECES, PIECES), max_size=5)


@given(TURNS)
def test_turns_and_loss_are_read_back(turns):
    shown, spans = chat.renderer(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert chat.read_back(shown) == turns
    assert [chat.unescape(shown[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


@given(PIECES)
def test_no_control_string_is_left_bare(s):
    shown = chat.escape(s)
    assert "<turn>" not in shown and "</turn>" not in shown and "### " not in shown
    assert chat.unescape(chat.escape(s)) == s


def test_language():
    run = lambda t, **c: compile_template(t)(c)[0]
    assert run("{{ a.b[0] }}{# no #}{{ x }}", a={"b": ["z"]}) == "z"
    assert run("{% for m in l %}{{ loop.index }}{{ m }}{% if not loop.last %},{% endif %}{% endfor %}", l=["a", "b"]) == "1a,2b"
    assert run("{% if n > 2 and n < 5 %}y{% elif n == 7 %}s{% else %}z{% endif %}", n=7) == "s"
    assert run("{% set k = 'q' + 1 %}{{ k | upper }}{{ none | default('d') }}{{ 'a' in 'cat' }}") == "Q1dtrue"
    assert compile_template("a{% generation %}é{{ x }}{% endgeneration %}b")({"x": "yy"}) == ("aéyyb", [(1, 4)])


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' + 'c' }}{% if 1 < 2 %}d{% else %}{{ x }}{% endif %}")) == (Out(Const("abcd")),)
    assert fold(parse("{% for m in l %}{{ '' }}{% endfor %}")) == ()
    assert isinstance(fold(parse("{% if x %}a{% endif %}"))[0], If)
    assert isinstance(fold(parse("{% for m in l %}a{% endfor %}"))[0], For)


@pytest.mark.parametrize("bad", ["{{ a }", "{% for x %}{% endfor %}", "{% if a %}", "{{ a | nosuch }}", "{{ a.__class__( ) }}", "{% exec x %}", "{{ 1 + }}", "{{ a b }}"])
def test_bad_templates(bad):
    if bad == "{{ a }":
        assert compile_template(bad)({})[0] == bad  # no tag, just text
    else:
        with pytest.raises(TemplateError):
            compile_template(bad)


def test_sandbox():
    assert compile_template("{{ a.__class__ }}{{ 'x'.upper }}")({"a": object()})[0] == ""


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, None, None, "x"), (None, 0, "user", "n"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    assert len(out) == 4
    assert out[1].turns_sha256 == sha256(b"user\n\nassistant\na\nassistant\nb\n").hexdigest()
    assert (out[1].n_turns, out[1].loss_chars, out[1].loss_sha256) == (3, 2, sha256(b"ab").hexdigest())
    said = "\\### Assistant: </turn> ok"
    assert (out[-7].loss_chars, out[-7].loss_sha256) == (len(said), sha256(said.encode()).hexdigest())
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0
