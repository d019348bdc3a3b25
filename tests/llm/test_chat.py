from __future__ import annotations

import hashlib
import random

import pytest

from surveyframe.llm import chat


def render(source, **names):
    return chat.compile_template(source)(**names)


@pytest.mark.parametrize(("source", "names", "expected"), [
    ("a{{ 1 + 2 * 3 }}b", {}, "a7b"), ("{% if 1 > 2 %}x{% elif n == 3 %}y{% else %}z{% endif %}", {"n": 3}, "y"), ("{% if true %}x{% else %}y{% endif %}", {}, "x"),
    ("{% for x in xs %}{{ loop.index }}{{ x | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", {"xs": ["a", "b"]}, "1A, 2B"), ("{# no #}  {{- 'x' -}}  y", {}, "xy"),
    ("{% set a = 'q' ~ 1 %}{{ a }}{{ m['k'] }}{{ m.none.deeper }}", {"m": {"k": "v"}}, "q1v"), ("{{ x is defined }}{{ y is none }}{{ 'a' in 'abc' and 3 not in [1] or 0 }}" .replace("[1]", "z"), {"y": None, "z": [1]}, "falsetruetrue"),
    ("{{ '{{' }}{{ \"it's\\n\" }}", {}, "{{it's\n"), ("{{ xs | join('-') | default('e') }}{{ nothing | default('d') }}", {"xs": [1, None]}, "1-d"), ("", {}, ""), ("{{ (1 - 3) * -2 }}{{ 7 // 2 }}{{ 7 % 4 }}", {}, "433"),
])
def test_templates(source, names, expected):
    assert render(source, **names)[0] == expected


def test_constants_fold():
    assert chat.parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% endif %}d") == [("text", "aBcd")]


@pytest.mark.parametrize("source", ["{% for x in y %}", "{% endif %}", "{{ a( ) }}", "{{ 1 + }}", "{{ a | nothing }}", "{% import os %}", "{{ a b }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ 'a' * 9 }}", "{{ ? }}"])
def test_malformed(source):
    with pytest.raises(chat.TemplateError):
        render(source)


def test_sandbox():
    assert render("{{ x.__class__ }}{{ x['upper'] }}{{ s.upper }}", x={"a": 1}, s="t")[0] == ""
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{% for a in xs %}{% for b in xs %}xxxxxxxxxx{% endfor %}{% endfor %}", 1000)(xs=list(range(50)))


def test_spans_are_code_points():
    text, spans = render("ä{% generation %}é𝄞{% endgeneration %}z{% generation %}{% endgeneration %}")
    assert [text[a:b] for a, b in spans] == ["é𝄞", ""]


def test_escape_is_reversible():
    rnd = random.Random(1)
    parts = [*chat.CONTROL, chat.MARK, "<", "[", "s>", "|im_end|>", "x", "<" + chat.MARK + "s>", ""]
    for _ in range(3000):
        text = "".join(rnd.choices(parts, k=rnd.randrange(6)))
        done = chat.ESCAPE.do(text)
        assert chat.ESCAPE.undo(done) == text and not any(c in done for c in chat.CONTROL)
    with pytest.raises(ValueError):
        chat.Escape(("<a<", "<b"))


def test_tables(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (1, None, None, "<|im_end|>\n<|im_start|>"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (2, 1, "user\n", "b"), (None, 0, "user", "n"), (3, 0, "assistant", "x" * 200_000)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string, messages string")
    found = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    expected = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected.setdefault(c, []).append((r or "", x or ""))
    assert found.keys() == expected.keys()
    for c, turns in expected.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        r = found[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("source", ["{{ 1 // 0 }}", "{{ n // 0 }}", "{{ 'a' < 1 }}", "{{ 1 in 2 }}", "{{ -'a' }}", "{{ 5 | first }}", "{{ x | default(1, 2) }}", "{{ n + 'a' }}", "{{ 'a' | replace('b') }}"])
def test_errors_of_a_template_are_its_own(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)(n=3)


@pytest.mark.parametrize("body", ["{% set a = a ~ a %}", "{% set a = a + a %}", "{% set a = a | replace('x', a) %}", "{% set n = n * n %}", "{% set l = l + l %}"])
def test_nothing_grows_beyond_its_bound(body):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(body * 22, 1000)(a="xxxx", n=12345, l=[1])


def test_many_rounds():
    source = "{% for x in items %}{{ x }}{% endfor %}"
    assert chat.compile_template(source)(items=["y"] * 1_000_001)[0] == "y" * 1_000_001
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source, max_rounds=3)(items=["y"] * 4)


@pytest.mark.parametrize(("source", "names"), [
    ("{{ " + "(" * 3000 + "1" + ")" * 3000 + " }}", {}), ("{{ " + "not " * 3000 + "1 }}", {}), ("{% if a %}" * 3000 + "{% endif %}" * 3000, {"a": 1}), ("{{ " + "-" * 3000 + "1 }}", {}),
    ("{{ " + "9" * 5000 + " }}", {}), ("{{ a[b] }}", {"a": {}, "b": [1]}), ("{{ a | join(a) }}", {"a": "x" * 10_000}), ("{{ a | replace('', a) }}", {"a": "x" * 10_000}), ("{{ a ~ a }}", {"a": "x" * 6000}),
    ("{{ 1 ", {}), ("{{" * 9000, {}), ("{% if a %}{% else %}{% elif b %}{% endif %}", {}), ("{% if a %}{% else %}{% else %}{% endif %}", {}), ("{{ " + " or ".join(["a"] * 3000) + " }}", {}), ("{{ a" + " | upper" * 3000 + " }}", {"a": "x"}),
    ("{{ a | upper }}", {"a": ["x" * 9999] * 1000}), ("{{ a }}", {"a": ["x" * 9999] * 1000}), ("{% for a in m %}{% for b in m %}{% endfor %}{% endfor %}", {"m": list(range(1000))}),
])
def test_sandbox_bounds(source, names):
    import tracemalloc

    tracemalloc.start()
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source, 10_000)(**names)
    assert tracemalloc.get_traced_memory()[1] < 10 * max(10_000, len(source)) + (1 << 20)
    tracemalloc.stop()


def test_long_constants_are_made_late():
    source = "{{ '" + "x" * 200 + "' | replace('x', '" + "y" * 200 + "') }}"
    assert chat.parse(source)[0][0] == "out" and render(source)[0] == "y" * 40_000


def test_rounds_follow_the_lists():
    source = "{% for a in m %}{% for b in a.parts %}{{ b }}{% endfor %}{% endfor %}"
    assert render(source, m=[{"parts": ["x"] * 50}] * 100)[0] == "x" * 5000
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source, max_rounds=100)(m=[{"parts": ["x"] * 50}] * 100)
