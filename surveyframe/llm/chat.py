"""Chat formatting: a compiler for a small sandboxed template language.

``compile_template`` parses a template into a syntax tree, folds what is constant, and generates a Python closure for
each node. The language has text, ``{{ expression }}``, ``{% for x in list %}``, ``{% if %}``/``{% elif %}``/``{% else %}``,
``{% set name = expression %}``, ``{% generation %}`` ... ``{% endgeneration %}`` and ``{# comments #}``; a minus inside a
tag strips white space on that side. Expressions have strings, integers, true, false, none, names, ``a.b`` and ``a[b]`` on
dictionaries, lists and strings alone, ``+ - * // %``, ``~``, comparisons, ``in``, and/or/not, the tests ``is defined``
and ``is none``, and the filters in ``FILTERS``. There are no calls and no attributes of Python objects, so a template
reaches nothing but what it is given. The output and every text or list that an expression makes are bounded by
``max_chars`` before they are made, numbers by 64 bits, nesting by ``NESTED`` and ``DEEP``, and loop rounds by ``max_rounds``, which is
``ROUNDS`` and one for each loop of the template and entry of a given list unless it is set. Whatever a template does wrong
raises a TemplateError.

Rendering gives the text and the spans, in code points, that generation blocks wrote.
"""

from __future__ import annotations

import hashlib
import operator
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_slices

#: The mark that the escape sets behind the first character of a control string inside a text.
MARK = "\u2060"
# Control strings of common chat formats.
CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
TEMPLATE = (
    "{% for message in messages %}<|im_start|>{{ message.role | escape }}<|im_sep|>"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content | escape }}{% endgeneration %}"
    "{% else %}{{ message.content | escape }}{% endif %}<|im_end|>\n{% endfor %}"
)
#: Characters that a folded constant may have; a longer one is made when the template is rendered.
FOLD_CHARS = 1 << 12
#: Parentheses, signs and blocks inside each other, and operators and filters of one expression on top of each other.
NESTED = 40
DEEP = 100
#: Rounds of loops that any template may make, however short the lists that it is given.
ROUNDS = 1000


class TemplateError(ValueError):
    """The template is malformed, or asks for what the sandbox doesn't give."""


class TooLong(TemplateError):
    """A text or list would pass the bound."""

    def __init__(self, what: str = "a text or list"):
        super().__init__(f"{what} is too long")


class Escape:
    """Reversible: where a control string, with any number of marks behind its first character, stands in a text, one
    more mark is set; ``undo`` takes one away. No control string is left, and other texts stay as they are."""

    def __init__(self, control: tuple[str, ...] = CONTROL):
        firsts = {c[0] for c in control}
        if any(len(c) < 2 or MARK in c for c in control):
            raise ValueError("a control string has two characters or more and no mark")
        # A character that starts one may recur inside another (<<SYS>>), but never so that two can overlap partly.
        for a in control:
            for b in control:
                if any(a[i:] == b[: len(a) - i] for i in range(1, len(a))):
                    raise ValueError(f"{a} and {b} can overlap")
        rest = "|".join(f"{re.escape(c[0])}{MARK}*{re.escape(c[1:])}" for c in sorted(control, key=len, reverse=True))
        self._plain = re.compile(rest)
        self._first = tuple(firsts)

    def do(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0][0] + MARK + m[0][1:], text) if any(c in text for c in self._first) else text

    def undo(self, text: str) -> str:
        return self._plain.sub(lambda m: m[0][0] + m[0][2:] if m[0][1] == MARK else m[0], text) if MARK in text else text


ESCAPE = Escape()


class Undefined:
    """What a missing name or key gives: empty text, false, and nothing below it."""

    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False

    def __eq__(self, other) -> bool:
        return isinstance(other, Undefined)

    __hash__ = object.__hash__


UNDEFINED = Undefined()
FILTERS: dict[str, Callable] = {
    "escape": lambda x: ESCAPE.do(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x) if isinstance(x, str | list | dict) else 0, "default": lambda x, y="": y if x is None or isinstance(x, Undefined) else x,
    "replace": lambda x, a, b: _text(x).replace(_text(a), _text(b)), "join": lambda x, sep="": _text(sep).join(map(_text, x)), "first": lambda x: x[0] if x else UNDEFINED, "last": lambda x: x[-1] if x else UNDEFINED,
}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "in": lambda a, b: a in b}
_TIMES = {"*": operator.mul, "//": operator.floordiv, "%": operator.mod}
_OPEN = re.compile(r"\{[{%#]")
_CLOSE = {"{{": "}}", "{%": "%}", "{#": "#}"}
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|//|[-+*%~<>.,|()\[\]:=]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tied(a, b) -> str:
    return _text(a) + _text(b)


def _shown(x, limit: int, depth: int = 0) -> int:
    """At least the characters of a value's text, at most ten times less; more than ``limit`` as soon as that is sure."""
    if isinstance(x, str):
        return len(x)
    if not isinstance(x, list | dict):
        return 20
    if depth > NESTED:
        raise TemplateError("a value is nested too deeply")
    n = 2
    for y in x if isinstance(x, list) else (y for pair in x.items() for y in pair):
        n += 2 + _shown(y, limit, depth + 1)
        if n > limit:
            break
    return n


def _joined_size(limit: int, x, sep="") -> int:
    if not isinstance(x, str | list | dict):
        return 0
    n = len(_text(sep)) * max(0, len(x) - 1)
    return n + len(x) if isinstance(x, str) else n + _shown(list(x), limit)


def _replaced_size(limit: int, x, a, b) -> int:
    if (n := _shown(x, limit)) > limit:
        return n
    text, a, b = _text(x), _text(a), _text(b)
    return len(text) + text.count(a) * max(0, len(b) - len(a))


#: What bounds a result's characters from the arguments, before it is made.
_SIZES: dict[Callable, Callable[..., int]] = {
    FILTERS["join"]: _joined_size, FILTERS["replace"]: _replaced_size, _tied: lambda limit, a, b: _shown(a, limit) + _shown(b, limit),
    operator.add: lambda limit, a, b: sum(len(x) for x in (a, b) if isinstance(x, str | list)),
    **{FILTERS[f]: lambda limit, x: _shown(x, limit) for f in ("escape", "trim", "upper", "lower")},
}


def _call(fn: Callable, args: tuple, limit: int):
    """What an operator or filter gives, held to the sandbox's bounds."""
    try:
        if (size := _SIZES.get(fn)) and size(limit, *args) > limit:
            raise TooLong()
        value = fn(*args)
    except TemplateError:
        raise
    except (TypeError, ValueError, ArithmeticError, LookupError, AttributeError, RecursionError) as e:
        raise TemplateError(str(e)) from e
    if isinstance(value, str | list) and len(value) > limit:
        raise TooLong()
    if isinstance(value, int) and value.bit_length() > 64:
        raise TemplateError("a number is too large")
    return value


def _text(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


# --- Syntax tree: tuples (kind, ...). ("const", value) is what folding makes of an expression without names.


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:].strip()[:10]!r}")
            number, string, name, sign = m.groups()
            if string:
                string = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), string[1:-1], flags=re.S)
            if number and (len(number) > 20 or int(number).bit_length() > 64):
                raise TemplateError("a number is too large")
            self.tokens.append(("number", int(number)) if number else ("string", string) if string is not None else ("name", name) if name else ("sign", sign))
            at = m.end()
        self.at = self.depth = 0

    def deeper(self, part: Callable[[], tuple]) -> tuple:
        """What ``part`` reads, one level further in."""
        self.depth += 1
        if self.depth > NESTED:
            raise TemplateError("an expression is nested too deeply")
        found = part()
        self.depth -= 1
        return found

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, *values: str) -> str:
        if (got := self.take(*values)) is None:
            raise TemplateError(f"expected {' or '.join(values)}")
        return got

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        out = self.either()
        self.end()
        return out

    def either(self):
        left = self.both()
        while self.take("or"):
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.deeper(self.negated)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while True:
            if sign := self.take(*_COMPARE):
                left = ("call", _COMPARE[sign], (left, self.joined()))
            elif self.take("not"):
                self.need("in")
                left = ("not", ("call", _COMPARE["in"], (left, self.joined())))
            elif self.take("is"):
                no = self.take("not")
                test = ("is", self.need("defined", "none"), left)
                left = ("not", test) if no else test
            else:
                return left

    def joined(self):
        left = self.product()
        while sign := self.take("+", "-", "~"):
            fn = {"+": operator.add, "-": operator.sub, "~": _tied}[sign]
            left = ("call", fn, (left, self.product()))
        return left

    def product(self):
        left = self.filtered()
        while sign := self.take(*_TIMES):
            left = ("call", _bounded(_TIMES[sign]), (left, self.filtered()))
        return left

    def filtered(self):
        left = self.reached()
        while self.take("|"):
            name, args = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.deeper(self.either))
                    if not self.take(","):
                        self.need(")")
                        break
            left = ("call", FILTERS[name], (left, *args))
        return left

    def reached(self):
        left = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                left = ("get", left, ("const", self.name()))
            else:
                left = ("get", left, self.deeper(self.either))
                self.need("]")
        return left

    def atom(self):
        if self.take("("):
            inner = self.deeper(self.either)
            self.need(")")
            return inner
        if self.take("-"):
            return ("call", operator.neg, (self.deeper(self.atom),))
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("number", "string"):
            return ("const", value)
        if kind == "name":
            constants = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return ("const", constants[value]) if value in constants else ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def _bounded(fn: Callable) -> Callable:
    """No repetition of texts or lists by a factor."""

    def run(a, b):
        if not (isinstance(a, int) and isinstance(b, int)):
            raise TemplateError("only integers can be multiplied or divided")
        return fn(a, b)

    return run


def _get(value, key):
    if isinstance(key, list | dict):
        raise TemplateError("a list or dictionary is no key")
    if isinstance(value, dict):
        return value.get(key, UNDEFINED)
    if isinstance(value, list | str) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return UNDEFINED


def fold(node: tuple, depth: int = 0) -> tuple:
    """Replaces expressions whose parts are constant by their values, if these aren't long."""
    kind, below = node[0], depth + 1
    if depth > DEEP:
        raise TemplateError("an expression is too long")
    if kind == "call":
        args = tuple([fold(a, below) for a in node[2]])
        if all(a[0] == "const" for a in args):
            try:
                return ("const", _call(node[1], tuple(a[1] for a in args), FOLD_CHARS))
            except TooLong:
                pass
        return ("call", node[1], args)
    if kind in ("or", "and"):
        left, right = fold(node[1], below), fold(node[2], below)
        if left[0] == "const":
            return left if bool(left[1]) == (kind == "or") else right
        return (kind, left, right)
    if kind == "not":
        inner = fold(node[1], below)
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    if kind == "get":
        value, key = fold(node[1], below), fold(node[2], below)
        return ("const", _get(value[1], key[1])) if value[0] == key[0] == "const" else ("get", value, key)
    if kind == "is":
        inner = fold(node[2], below)
        return ("const", (inner[1] is None) if node[1] == "none" else inner[1] is not UNDEFINED) if inner[0] == "const" else ("is", node[1], inner)
    return node


def parse(source: str) -> list[tuple]:
    """The folded tree: nodes ("text", s), ("out", e), ("for", name, e, body), ("if", [(e, body)]), ("set", name, e), ("gen", body)."""
    stack: list[tuple[str, list]] = [("", [])]
    heads: list = []
    at, strip = 0, False

    def add(node: tuple) -> None:
        body = stack[-1][1]
        if node[0] == "text" and body and body[-1][0] == "text":
            body[-1] = ("text", body[-1][1] + node[1])
        elif node != ("text", ""):
            body.append(node)

    def open_block(kind: str) -> None:
        if len(stack) > NESTED:
            raise TemplateError("blocks are nested too deeply")
        stack.append((kind, []))

    def close(*kinds: str) -> list:
        if stack[-1][0] not in kinds:
            raise TemplateError(f"end of {kinds[0]} without its start")
        return stack.pop()[1]

    while m := _OPEN.search(source, at):
        end = source.find(_CLOSE[m[0]], m.end())
        if end < 0:
            raise TemplateError(f"{m[0]} without {_CLOSE[m[0]]}")
        inner = source[m.end() : end]
        before, inner = inner[:1] == "-", inner.removeprefix("-")
        after, inner = inner[-1:] == "-", inner.removesuffix("-")
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        add(("text", text.rstrip() if before else text))
        at, strip = end + 2, after
        if m[0] == "{{":
            value = fold(_Expression(inner).whole())
            add(("text", _text(value[1])) if value[0] == "const" else ("out", value))
        elif m[0] == "{%":
            tag = _Expression(inner)
            word = tag.name()
            if word == "for":
                name = tag.name()
                tag.need("in")
                heads.append((name, fold(tag.whole())))
                open_block("for")
            elif word == "endfor":
                body = close("for")
                add(("for", *heads.pop(), body))
            elif word == "if":
                heads.append([(fold(tag.whole()), None)])
                open_block("if")
            elif word in ("elif", "else"):
                body = close("if")
                heads[-1][-1] = (heads[-1][-1][0], body)
                heads[-1].append((fold(tag.whole()) if word == "elif" else ("const", True), None))
                open_block("if" if word == "elif" else "else")
            elif word == "endif":
                body = close("if", "else")
                branches = heads.pop()
                branches[-1] = (branches[-1][0], body)
                live = [b for b in branches if b[0][0] != "const" or b[0][1]]
                if live and live[0][0][0] == "const":
                    for node in live[0][1]:
                        add(node)
                elif live:
                    add(("if", live))
            elif word == "set":
                name = tag.name()
                tag.need("=")
                add(("set", name, fold(tag.whole())))
            elif word == "generation":
                if any(kind == "generation" for kind, _ in stack):
                    raise TemplateError("generation blocks don't nest")
                open_block("generation")
            elif word == "endgeneration":
                add(("gen", close("generation")))
            else:
                raise TemplateError(f"no tag {word}")
    rest = source[at:]
    add(("text", rest.lstrip() if strip else rest))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} has no end")
    return stack[0][1]


# --- Closures.


class _Output:
    def __init__(self, limit: int, max_rounds: int):
        self.max_rounds = max_rounds
        self.parts: list[str] = []
        self.length = self.rounds = 0
        self.spans: list[tuple[int, int]] = []
        self.limit = limit

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)
        if self.length > self.limit:
            raise TooLong("the output")


def _value(node: tuple, limit: int) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda names, v=node[1]: v
    if kind == "name":
        return lambda names, n=node[1]: names.get(n, UNDEFINED)
    if kind == "get":
        value, key = _value(node[1], limit), _value(node[2], limit)
        return lambda names: _get(value(names), key(names))
    if kind == "call":
        fn, args = node[1], [_value(a, limit) for a in node[2]]
        return lambda names: _call(fn, tuple(a(names) for a in args), limit)
    if kind == "not":
        return lambda names, a=_value(node[1], limit): not a(names)
    if kind == "is":
        inner = _value(node[2], limit)
        return (lambda names: inner(names) is None) if node[1] == "none" else (lambda names: inner(names) is not UNDEFINED)
    left, right = _value(node[1], limit), _value(node[2], limit)
    return (lambda names: left(names) or right(names)) if kind == "or" else (lambda names: left(names) and right(names))


def _printed(value, limit: int) -> str:
    if isinstance(value, list | dict) and _shown(value, limit) > limit:
        raise TooLong()
    return _text(value)


def _writer(body: list[tuple], limit: int) -> Callable[[dict, _Output], None]:
    steps = [_step(node, limit) for node in body]
    if len(steps) == 1:
        return steps[0]

    def run(names: dict, out: _Output) -> None:
        for step in steps:
            step(names, out)

    return run


def _step(node: tuple, limit: int) -> Callable[[dict, _Output], None]:
    kind = node[0]
    if kind == "text":
        return lambda names, out, t=node[1]: out.write(t)
    if kind == "out":
        return lambda names, out, v=_value(node[1], limit): out.write(_printed(v(names), limit))
    if kind == "set":
        return lambda names, out, n=node[1], v=_value(node[2], limit): names.__setitem__(n, v(names))
    if kind == "gen":
        inner = _writer(node[1], limit)

        def gen(names: dict, out: _Output) -> None:
            start = out.length
            inner(names, out)
            out.spans.append((start, out.length))

        return gen
    if kind == "if":
        branches = [(_value(test, limit), _writer(body, limit)) for test, body in node[1]]

        def choose(names: dict, out: _Output) -> None:
            for test, body in branches:
                if test(names):
                    return body(names, out)

        return choose
    name, items, body = node[1], _value(node[2], limit), _writer(node[3], limit)

    def loop(names: dict, out: _Output) -> None:
        found = items(names)
        found = found if isinstance(found, list) else []
        out.rounds += len(found)
        if out.rounds > out.max_rounds:
            raise TemplateError("too many rounds")
        for i, item in enumerate(found):
            body(names | {name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(found) - 1, "length": len(found)}}, out)

    return loop


def _loops(body: list[tuple]) -> int:
    """How many loops a tree has."""
    inner = {"for": lambda n: 1 + _loops(n[3]), "gen": lambda n: _loops(n[1]), "if": lambda n: sum(_loops(b) for _, b in n[1])}
    return sum(inner[n[0]](n) for n in body if n[0] in inner)


def _entries(names: dict) -> int:
    """How many entries the given lists have, lists inside of them included."""
    left, n = list(names.values()), 0
    while left:
        x = left.pop()
        if isinstance(x, list):
            n += len(x)
            left += [y for y in x if isinstance(y, list | dict)]
        elif isinstance(x, dict):
            left += [y for y in x.values() if isinstance(y, list | dict)]
    return n


@lru_cache(maxsize=32)
def compile_template(source: str, max_chars: int = 1 << 30, max_rounds: int | None = None) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's names that returns (text, generation spans)."""
    tree = parse(source)
    write, loops = _writer(tree, max_chars), _loops(tree)

    def render(**names) -> tuple[str, list[tuple[int, int]]]:
        out = _Output(max_chars, ROUNDS + loops * _entries(names) if max_rounds is None else max_rounds)
        write(names, out)
        return "".join(out.parts), out.spans

    return render


# --- Over tables.

_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.S)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def format_conversations(rows: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, spans (start, end in code points of generated text).

    A conversation's rows are ordered by turn; rows of equal turn by role, then text; a null turn comes first. Null roles
    and texts are empty. Rows with a null id make one conversation. A conversation becomes one string, so it has to fit
    into a row, as its output does. No rows give no rows.
    """
    compile_template(template)  # a malformed template fails here
    src = rows.select(F.col(id_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("content")).alias("m"))
    grouped = src.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    grouped = grouped.select("conv_id", F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))
    kind = grouped.schema["conv_id"].dataType.simpleString()

    def run(batches):
        render = compile_template(template)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                messages = batch.column("messages").to_pylist()
                out = [render(messages=m) for m in messages]
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in out], _SPANS)
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(map(len, messages), pa.int64()), pa.array([t for t, _ in out], pa.string()), spans], ["conv_id", "n_turns", "formatted", "spans"])

    return grouped.mapInArrow(run, f"conv_id {kind}, n_turns long, formatted string, spans array<struct<start:long,end:long>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn of a text that ``TEMPLATE`` wrote."""
    return [(ESCAPE.undo(m[1]), ESCAPE.undo(m[2])) for m in _TURN.finditer(formatted)]


def digests(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold, read back from them: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            turns = read_back(text)
            loss = "".join(ESCAPE.undo(text[s["start"] : s["end"]]) for s in spans)
            out.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        columns = zip(*out, strict=True) if out else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return map_slices(formatted.select("conv_id", "formatted", "spans"), run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", "formatted")
