import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stackmeter.llm import chat

PARTS = st.lists(st.sampled_from(["<|turn|>", "<|end|>", "<|text|>", "\\", "<", "|", "turn|>", "[INST]", "</s>", "é", "\n", "a"]), max_size=12).map("".join)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), PARTS), PARTS), max_size=5))
def test_round_trip(turns):
    t = chat.Template()
    r = chat.Reader(t.escaper)
    pieces = list(t.render({"role": chat.role_out(a), "text": b} for a, b in turns))
    for text, masked in pieces:
        r.feed(text, masked)
    loss = "".join(b for a, b in turns if a == "assistant")
    assert (r.turns, r.all.hexdigest(), r.loss, r.under.hexdigest()) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
    assert r.chars == sum(len(p) for p, _ in pieces)


@given(PARTS)
def test_escape_is_reversible(text):
    e = chat.Escaper()
    assert e.unescape(e.escape(text)) == text
    assert not any(c in e.escape(text) for c in chat.CONTROL)


def test_language():
    say = lambda src, *turns: "".join(p for p, _ in chat.Template(src).render({"role": a, "text": b} for a, b in turns))
    two = ("user", " hi "), ("assistant", "ok")
    assert say("{% for m in messages %}{{ loop.index }}{{ m.role == 'user' }}{% if loop.last %}.{% elif loop.first %}>{% else %}-{% endif %}{% endfor %}", *two) == "1true>2false."
    assert say("{{ 'a' + 'b' }}{% if 1 == 2 or not true %}x{% else %}y{% endif %}") == "aby"
    assert say("{% for m in messages %}{{ m.text | trim }}{% endfor %}", *two) == "hiok"
    assert len(chat.Template("a{{ 'b' }}{% if true %}c{% endif %}").tree) == 1
    masked = [p for p in chat.Template("{% for m in messages %}[{% generation %}{{ m.text }}{% endgeneration %}]{% endfor %}").render([{"role": "a", "text": "t"}])]
    assert masked == [("[", False), ("t", True), ("]", False)]


@pytest.mark.parametrize("bad", ["{{ x }}", "{{ m.text }}", "{% for m in other %}{% endfor %}", "{% if true %}", "{% endfor %}", "{{ 'a' | eval }}", "{% for m in messages %}{{ m.__class__ }}{% endfor %}", "{{ 'a'() }}", "{% include 'x' %}", "{% for m in messages %}{% for n in messages %}{% endfor %}{% endfor %}"])
def test_sandbox(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_frame(spark):
    rows = [(1, 1, "assistant", "b" * 50_000), (1, 0, "user", None), (2, 0, None, "x"), (2, 0, None, "x"), (2, 0, "assistant", "<|end|>"), (None, 0, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as n_turns")
    got = {r.conv_id: r for r in chat.digests(df).collect()}
    assert got[1].turns_sha256 == sha("user\n\nassistant\n" + "b" * 50_000 + "\n") and got[1].loss_chars == 50_000
    assert got[2].n_turns == 3 and got[2].loss_sha256 == sha("<|end|>") and got[2].turns_sha256 == sha("\nx\n\nx\nassistant\n<|end|>\n")
    assert got[None].n_turns == 1
    whole = {r.conv_id: r for r in chat.formatted(df).collect()}
    assert [whole[1].text[a:b] for a, b in zip(whole[1]["mask"][::2], whole[1]["mask"][1::2], strict=True)] == ["b" * 50_000]
    assert all(len(whole[k].text) == got[k].formatted_chars for k in got)
    assert chat.digests(df.where("false")).count() == 0


def test_ids_of_any_type_and_empty_tables(spark):
    named = spark.createDataFrame([("a", 0, "user", "x"), ("b", 0, "assistant", "y"), ("b", 1, "user", ""), (None, 0, "user", "z")], "conv_id string, turn long, role string, text string")
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chat.digests(named).collect()} == {("a", 1, 0), ("b", 2, 1), (None, 1, 0)}
    assert {r.conv_id for r in chat.formatted(named).collect()} == {"a", "b", None}
    assert chat.digests(named.where("false")).count() == chat.formatted(named.where("false")).count() == 0
