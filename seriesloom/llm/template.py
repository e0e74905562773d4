"""A small sandboxed template language for conversations, compiled to Python closures.

    {{ expression }}                      output
    {% for x in expression %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}   text that a model is to learn
    {# comment #}

Expressions: names, 'strings', numbers, true, false, none, a.b, a[b], + - ==
!= < <= > >= in not and or, and filters a | f or a | f(b). In a for loop,
loop.index, loop.index0, loop.first, loop.last and loop.length are known.

A template is parsed into a syntax tree, constant parts are folded (constant
expressions are evaluated, branches that cannot run are dropped, neighbouring
text is joined), and each node becomes a closure. There is no attribute access
to Python objects, no call other than to the listed filters, and no loop other
than over a list from the context, so a template cannot reach anything else.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass


class TemplateError(ValueError):
    """A template that does not parse, or that uses what does not exist."""


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """An operator or filter on some arguments."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


OPERATORS: dict[str, Callable] = {
    "+": lambda a, b: a + b if isinstance(a, str) == isinstance(b, str) else text(a) + text(b),
    "-": operator.sub, "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "not": operator.not_,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda s: text(s).strip(),
    "upper": lambda s: text(s).upper(),
    "lower": lambda s: text(s).lower(),
    "length": len,
    "default": lambda a, b: b if a is None else a,
    "string": lambda a: text(a),
}


def text(value: object) -> str:
    """What an output shows: nothing for none."""
    return value if isinstance(value, str) else "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


# -------------------------------------------------------------------- parsing

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<op>==|!=|<=|>=|[-+<>()\[\].,|]))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tokens, self.filters, at = [], filters, 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *want: str) -> bool:
        if self.peek() in want:
            self.at += 1
            return True
        return False

    def need(self, want: str) -> None:
        if not self.take(want):
            raise TemplateError(f"expected {want!r}")

    def whole(self) -> object:
        found = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return found

    def either(self) -> object:
        a = self.both()
        while self.take("or"):
            a = Apply("or", (a, self.both()))
        return a

    def both(self) -> object:
        a = self.negated()
        while self.take("and"):
            a = Apply("and", (a, self.negated()))
        return a

    def negated(self) -> object:
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> object:
        a = self.summed()
        while (op := self.peek()) in ("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            self.at += 1
            if op == "not":
                self.need("in")
                op = "not in"
            a = Apply(op, (a, self.summed()))
        return a

    def summed(self) -> object:
        a = self.filtered()
        while (op := self.peek()) in ("+", "-"):
            self.at += 1
            a = Apply(op, (a, self.filtered()))
        return a

    def filtered(self) -> object:
        a = self.reached()
        while self.take("|"):
            name = self.peek()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            args = [a]
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    if self.peek() != ")":
                        self.need(",")
            a = Apply("|" + name, tuple(args))
        return a

    def reached(self) -> object:
        a = self.atom()
        while True:
            if self.take("."):
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
                if kind != "name":
                    raise TemplateError("expected a name after '.'")
                self.at += 1
                a = Item(a, Const(name))
            elif self.take("["):
                a = Item(a, self.either())
                self.need("]")
            else:
                return a

    def atom(self) -> object:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "num":
            return Const(float(value) if "." in value else int(value))
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "name":
            words = {"true": True, "false": False, "none": None}
            return Const(words[value]) if value in words else Name(value)
        if value == "(":
            a = self.either()
            self.need(")")
            return a
        if value == "-":
            return Apply("-", (Const(0), self.reached()))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: dict[str, Callable] | None = None) -> tuple:
    """The syntax tree of a template: a tuple of nodes."""
    filters = FILTERS if filters is None else filters
    parts, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        if m[1] is not None:
            parts.append(("out", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    place = 0

    def body(ends: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal place
        out = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                out.append(Out(Const(value)))
            elif kind == "out":
                out.append(Out(_Expression(value, filters).whole()))
            else:
                word, _, rest = value.partition(" ")
                if word in ends:
                    return tuple(out), value
                out.append(statement(word, rest.strip()))
        if ends:
            raise TemplateError(f"expected {{% {ends[-1]} %}}")
        return tuple(out), ""

    def statement(word: str, rest: str) -> object:
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"for what? {rest!r}")
            return For(m[1], _Expression(m[2], filters).whole(), body(("endfor",))[0])
        if word == "if":
            test = _Expression(rest, filters).whole()
            then, end = body(("elif", "else", "endif"))
            if end.startswith("elif"):
                return If(test, then, (statement("if", end[4:].strip()),))
            return If(test, then, body(("endif",))[0] if end == "else" else ())
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=\s*(.+)", rest, re.DOTALL)
            if not m:
                raise TemplateError(f"set what? {rest!r}")
            return Set(m[1], _Expression(m[2], filters).whole())
        if word == "generation":
            return Generation(body(("endgeneration",))[0])
        raise TemplateError(f"unknown tag {word!r}")

    return body(())[0]


# ------------------------------------------------------------ constant folding


def fold(node: object, filters: dict[str, Callable] | None = None) -> object:
    """The same tree with everything computed that does not depend on the context."""
    filters = FILTERS if filters is None else filters
    if isinstance(node, tuple):
        out: list = []
        for x in (fold(n, filters) for n in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Out) and isinstance(y.value, Const):
                    shown = text(y.value.value)
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        shown = text(out.pop().value.value) + shown
                    if shown:
                        out.append(Out(Const(shown)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Apply):
        args = tuple(fold(a, filters) for a in node.args)
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        folded = Apply(node.op, args)
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(_expression(folded, filters)({}))
            except Exception:  # noqa: BLE001  it fails where it is reached, as it would unfolded
                return folded
        return folded
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Out):
        return Out(fold(node.value, filters))
    if isinstance(node, If):
        test = fold(node.test, filters)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other, filters)
        return If(test, fold(node.then, filters), fold(node.other, filters))
    if isinstance(node, For):
        body = fold(node.body, filters)
        return For(node.name, fold(node.over, filters), body) if body else ()
    if isinstance(node, Set):
        return Set(node.name, fold(node.value, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    return node


# ------------------------------------------------------------------- closures


def _item(of: object, key: object) -> object:
    """An entry of a dict or a list; none if there is no such entry. Nothing else has entries."""
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def _expression(node: object, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda context: value
    if isinstance(node, Name):
        name = node.name
        return lambda context: context.get(name)
    if isinstance(node, Item):
        of, key = _expression(node.of, filters), _expression(node.key, filters)
        if isinstance(node.key, Const):
            fixed = node.key.value
            return lambda context: _item(of(context), fixed)
        return lambda context: _item(of(context), key(context))
    args = [_expression(a, filters) for a in node.args]
    if node.op == "and":
        return lambda context: args[0](context) and args[1](context)
    if node.op == "or":
        return lambda context: args[0](context) or args[1](context)
    run = filters[node.op[1:]] if node.op.startswith("|") else OPERATORS[node.op]
    if len(args) == 1:
        one = args[0]
        return lambda context: run(one(context))
    return lambda context: run(*(a(context) for a in args))


class _Sink:
    """Rendered pieces, and where generations lie in code points."""

    def __init__(self) -> None:
        self.pieces: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, s: str) -> None:
        self.pieces.append(s)
        self.size += len(s)


def _statement(node: object, filters: dict[str, Callable]) -> Callable[[dict, _Sink], None]:
    if isinstance(node, tuple):
        steps = [_statement(n, filters) for n in node]
        if len(steps) == 1:
            return steps[0]

        def run(context: dict, sink: _Sink) -> None:
            for step in steps:
                step(context, sink)

        return run
    if isinstance(node, Out):
        if isinstance(node.value, Const):
            shown = text(node.value.value)
            return lambda context, sink: sink.write(shown)
        value = _expression(node.value, filters)
        return lambda context, sink: sink.write(text(value(context)))
    if isinstance(node, If):
        test, then, other = _expression(node.test, filters), _statement(node.then, filters), _statement(node.other, filters)
        return lambda context, sink: then(context, sink) if test(context) else other(context, sink)
    if isinstance(node, For):
        over, body, name = _expression(node.over, filters), _statement(node.body, filters), node.name

        def loop(context: dict, sink: _Sink) -> None:
            items = over(context)
            if not isinstance(items, list):
                raise TemplateError("a loop needs a list")
            inner = dict(context)
            for i, x in enumerate(items):
                inner[name] = x
                inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(items) - 1, "length": len(items)}
                body(inner, sink)

        return loop
    if isinstance(node, Set):
        name, value = node.name, _expression(node.value, filters)

        def assign(context: dict, sink: _Sink) -> None:
            context[name] = value(context)

        return assign
    if isinstance(node, Generation):
        body = _statement(node.body, filters)

        def mark(context: dict, sink: _Sink) -> None:
            start = sink.size
            body(context, sink)
            sink.spans.append((start, sink.size))

        return mark
    raise TypeError(node)


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from a context to (text, spans of code points inside generation blocks)."""
    known = FILTERS | (filters or {})
    run = _statement(fold(parse(source, known), known), known)

    def render(context: dict) -> tuple[str, list[tuple[int, int]]]:
        sink = _Sink()
        run(dict(context), sink)
        return "".join(sink.pieces), sink.spans

    return render
