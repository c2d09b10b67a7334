r"""Operator 5, chat formatting by a compiled template language.

The language: text, ``{{ expression }}``, ``{% for x in list %}..{% endfor %}`` with ``loop.index``, ``loop.index0``,
``loop.first`` and ``loop.last``, ``{% if %}..{% elif %}..{% else %}..{% endif %}``, ``{% set x = expression %}`` and
``{% generation %}..{% endgeneration %}`` around what a model learns to write. Expressions have strings, whole numbers,
true, false, none, names, ``a.b`` and ``a[b]`` (entries of mappings and lists only, never Python attributes), ``+ ~ ==
!= < > <= >= in``, ``not``, ``and``, ``or`` and filters ``x | name``. Nothing else can be named, called or looped over,
so a template can reach only its inputs and ends after as many steps as they have entries.

A template is parsed once into a tree, constant subtrees are folded, neighbouring constant texts are joined, and the
tree becomes Python closures that append to a list. Rendering a conversation also yields the spans of generations.

Spark groups the turns of a conversation and sorts them by turn (ties: by role, then text); conversations, not sources,
are groups, and rendering one needs its turns together. The filter ``escape`` is reversible: the backslash, ``#`` and
``<`` of a text become ``\\``, ``\h`` and ``\l``, so no control string can occur inside an escaped text.

Edge cases. Null text: empty. Null role: ''. A conversation without an assistant turn has no generation. Repeated rows
are repeated turns. Null turns come first; rows without conversation id are each one of their own. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPE = str.maketrans({"\\": "\\\\", "#": "\\h", "<": "\\l"})
_UNESCAPE = {"\\": "\\", "h": "#", "l": "<"}
TEMPLATE = (
    "{% for turn in turns %}### {% if turn.role == 'user' %}User{% elif turn.role == 'assistant' %}Assistant{% elif turn.role == 'system' %}System{% else %}@{{ turn.role | escape }}<{% endif %}: "
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
ROLES = {"User": "user", "Assistant": "assistant", "System": "system"}


def escape(text: str) -> str:
    return text.translate(_ESCAPE)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNESCAPE[m[1]], text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": lambda x: escape(_text(x)), "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": len, "first": lambda x: x[0] if x else None, "last": lambda x: x[-1] if x else None}


class TemplateError(ValueError):
    """A template that isn't well formed, or uses what isn't allowed."""


def _text(x: Any) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


# --- parsing: a tree of tuples whose first entry says what they are

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>.\[\]()|=]))""")
_COMPARE = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b}
_CONSTANTS = {"true": True, "false": False, "none": None}
_WORDS = {"in", "not", "and", "or", *_CONSTANTS}


class _Expression:
    """A recursive-descent reader of one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if not values or self.peek(*values):
            if self.at >= len(self.tokens):
                raise TemplateError("expression ends too early")
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.take("or"):
            node = ("or", node, self.both())
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.take("and"):
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while op := self.take(*_COMPARE):
            node = ("compare", op, node, self.added())
        return node

    def added(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "-", "~"):
            node = (op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.reached()
        while self.take("|"):
            name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = ("filter", name, node)
        return node

    def reached(self) -> tuple:
        node = self.atom()
        while True:
            if self.take("."):
                node = ("entry", node, ("const", self.take()))
            elif self.take("["):
                node = ("entry", node, self.either())
                if not self.take("]"):
                    raise TemplateError("no ]")
            else:
                return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError("no )")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "int":
            return ("const", int(value))
        if kind == "name" and value in _CONSTANTS:
            return ("const", _CONSTANTS[value])
        if kind == "name" and value not in _WORDS:
            return ("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The tree of a template."""
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    parts.reverse()

    def block(*ends: str) -> tuple[list[tuple], str]:
        body: list[tuple] = []
        while parts:
            kind, value = parts.pop()
            if kind == "text":
                body.append(("out", ("const", value)))
            elif kind == "out":
                body.append(("out", _Expression(value).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return body, value
                if word == "for" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)):
                    body.append(("for", m[1], _Expression(m[2]).whole(), ("block", block("endfor")[0])))
                elif word == "if":
                    arms, last = [], rest
                    while last is not None:
                        inner, end = block("elif", "else", "endif")
                        arms.append((_Expression(last).whole(), ("block", inner)))
                        last = end[4:] if end.startswith("elif") else None
                    other = block("endif")[0] if end == "else" else []
                    body.append(("if", arms, ("block", other)))
                elif word == "set" and (m := re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)\s*(.+)", rest.strip(), re.S)):
                    body.append(("set", m[1], _Expression(m[2]).whole()))
                elif word == "generation":
                    body.append(("generation", ("block", block("endgeneration")[0])))
                else:
                    raise TemplateError(f"unexpected {value!r}")
        if ends:
            raise TemplateError(f"no {ends[-1]}")
        return body, ""

    return ("block", block()[0])


# --- folding


def _constant(node: tuple) -> bool:
    return node[0] == "const"


def fold(node: tuple) -> tuple:
    """The tree with constant parts computed, branches decided where they can be, and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for x in map(fold, node[1]):
            inner = x[1] if x[0] == "block" else [x]
            for y in inner:
                if y[0] == "out" and _constant(y[1]) and out and out[-1][0] == "out" and _constant(out[-1][1]):
                    out[-1] = ("out", ("const", _text(out[-1][1][1]) + _text(y[1][1])))
                else:
                    out.append(y)
        return ("block", out)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "if":
        arms: list[tuple] = []
        other = fold(node[2])
        for test, body in node[1]:
            test, body = fold(test), fold(body)
            if _constant(test):
                if test[1]:
                    other = body
                    break
                continue
            arms.append((test, body))
        return ("if", arms, other) if arms else other
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind in ("and", "or"):
        a, b = fold(node[1]), fold(node[2])
        if _constant(a):
            return (b if a[1] else a) if kind == "and" else (a if a[1] else b)
        return (kind, a, b)
    made = (kind, *(fold(x) if isinstance(x, tuple) else x for x in node[1:]))
    if all(_constant(x) for x in made[1:] if isinstance(x, tuple)):
        return made if kind == "out" else ("const", _value(made)({}))
    return made


# --- closures


def _entry(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, list) and isinstance(key, int):
        return of[key] if -len(of) <= key < len(of) else None
    return None


def _value(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda v, c=node[1]: c
    if kind == "name":
        return lambda v, n=node[1]: v.get(n)
    if kind == "entry":
        of, key = _value(node[1]), _value(node[2])
        return lambda v: _entry(of(v), key(v))
    if kind == "filter":
        f, x = FILTERS[node[1]], _value(node[2])
        return lambda v: f(x(v))
    if kind == "not":
        x = _value(node[1])
        return lambda v: not x(v)
    if kind == "compare":
        f, a, b = _COMPARE[node[1]], _value(node[2]), _value(node[3])
        return lambda v: f(a(v), b(v))
    a, b = _value(node[1]), _value(node[2])
    if kind == "and":
        return lambda v: a(v) and b(v)
    if kind == "or":
        return lambda v: a(v) or b(v)
    if kind == "~":
        return lambda v: _text(a(v)) + _text(b(v))
    if kind == "+":
        return lambda v: a(v) + b(v)
    return lambda v: a(v) - b(v)


class _Out:
    def __init__(self) -> None:
        self.parts, self.size, self.spans = [], 0, []


def _writer(node: tuple) -> Callable[[dict, _Out], None]:
    kind = node[0]
    if kind == "out":
        if _constant(node[1]):
            text = _text(node[1][1])

            def put(v: dict, out: _Out, text=text, n=len(text)) -> None:
                out.parts.append(text)
                out.size += n

            return put
        value = _value(node[1])

        def write(v: dict, out: _Out) -> None:
            text = _text(value(v))
            out.parts.append(text)
            out.size += len(text)

        return write
    if kind == "block":
        steps = [_writer(x) for x in node[1]]

        def every(v: dict, out: _Out) -> None:
            for step in steps:
                step(v, out)

        return every
    if kind == "set":
        name, value = node[1], _value(node[2])

        def assign(v: dict, out: _Out) -> None:
            v[name] = value(v)

        return assign
    if kind == "generation":
        body = _writer(node[1])

        def generate(v: dict, out: _Out) -> None:
            start = out.size
            body(v, out)
            out.spans.append((start, out.size))

        return generate
    if kind == "if":
        arms, other = [(_value(t), _writer(b)) for t, b in node[1]], _writer(node[2])

        def choose(v: dict, out: _Out) -> None:
            for test, body in arms:
                if test(v):
                    return body(v, out)
            return other(v, out)

        return choose
    name, items, body = node[1], _value(node[2]), _writer(node[3])

    def loop(v: dict, out: _Out) -> None:
        found = items(v)
        if not isinstance(found, list):
            raise TemplateError("only lists can be looped over")
        inner = dict(v)
        for i, x in enumerate(found):
            inner[name] = x
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(found) - 1}
            body(inner, out)

    return loop


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of the template's inputs, given by name, that returns the text and the spans of generations."""
    run = _writer(fold(parse(source)))

    def render(**inputs: Any) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run(dict(inputs), out)
        return "".join(out.parts), out.spans

    return render


# --- Spark


def formatted(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, text, spans) of each conversation; spans: start and end of each generation, in code points.

    A conversation is rendered as one text and so meets in one task; rows without conv_id, which may be many, are each a
    conversation of their own.
    """
    one = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), one.alias("t"), F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("alone"))
    grouped = rows.groupBy("conv_id", "alone").agg(F.array_sort(F.collect_list("t")).alias("turns")).drop("alone")
    compile_template(template)  # a bad template fails here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for b in batches:
            made = [render(turns=x) for x in b.column(1).to_pylist()]
            spans = pa.array([[{"start": s, "end": e} for s, e in x[1]] for x in made], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in made], pa.string()), spans], names=["conv_id", "text", "spans"])

    return grouped.mapInArrow(run, "conv_id long, text string, spans array<struct<start:long,end:long>>")


_TURN = re.compile(r"### (User|Assistant|System|@[^<]*<): ([^<]*)</turn>\n")


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a conversation formatted by TEMPLATE."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((ROLES.get(m[1]) or unescape(m[1][1:-1]), unescape(m[2])))
        at = m.end()
    return turns


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parsed(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                both = ("".join(f"{r}\n{t}\n" for r, t in turns), loss)
                digests = [hashlib.sha256(x.encode()).hexdigest() for x in both]
                rows.append((len(turns), digests[0], len(loss), digests[1], len(text)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return conversations.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
