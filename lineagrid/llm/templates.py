"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}            writes a value
    {% for m in messages %} … {% endfor %}
    {% if e %} … {% elif e %} … {% else %} … {% endif %}
    {% set name = expression %}
    {% generation %} … {% endgeneration %}    marks what the model must learn

Expressions: strings, integers, true/false/none, names, ``a.b``, ``a['b']``,
``+``, ``==``, ``!=``, ``<``, ``<=``, ``>``, ``>=``, ``in``, ``not``, ``and``,
``or`` and ``value | filter``. Only mappings are looked into and only the
filters given to the compiler are called, so a template reaches nothing else.
Source is parsed to a syntax tree, constants are folded, and each node becomes
a closure that yields ``(piece, marked)``; loops take any iterator, so a
conversation of any length is rendered in bounded memory.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """A template that cannot be parsed, or a value it may not use."""


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Item:
    of: Any
    key: Any


@dataclass
class Op:
    name: str
    args: list


@dataclass
class Filter:
    name: str
    arg: Any


@dataclass
class Text:
    text: str


@dataclass
class Write:
    expr: Any


@dataclass
class Set:
    name: str
    expr: Any


@dataclass
class If:
    branches: list  # of (condition, body)


@dataclass
class For:
    name: str
    source: Any
    body: list = field(default_factory=list)


@dataclass
class Generation:
    body: list = field(default_factory=list)


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+|.<>\[\]()]))", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_OPS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "not": operator.not_,
}
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over one expression, weakest binding first."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        while source[at:].strip():
            found = _TOKEN.match(source, at)
            if not found:
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            text, number, name, mark = found.groups()
            if text is not None:
                value = re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
                self.tokens.append(("const", value))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            else:
                self.tokens.append(("name", name) if name else ("mark", mark))
            at = found.end()
        self.at = 0

    def peek(self) -> tuple[str, Any]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)

    def take(self, kind: str, value: Any = None) -> bool:
        if self.peek()[0] == kind and value in (None, self.peek()[1]):
            self.at += 1
            return True
        return False

    def need(self, kind: str, value: Any = None) -> Any:
        found = self.peek()
        if not self.take(kind, value):
            raise TemplateError(f"expected {value or kind}, found {found[1]!r}")
        return found[1]

    def whole(self) -> Any:
        out = self.either()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return out

    def either(self) -> Any:
        out = self.both()
        while self.take("name", "or"):
            out = Op("or", [out, self.both()])
        return out

    def both(self) -> Any:
        out = self.negated()
        while self.take("name", "and"):
            out = Op("and", [out, self.negated()])
        return out

    def negated(self) -> Any:
        return Op("not", [self.negated()]) if self.take("name", "not") else self.compared()

    def compared(self) -> Any:
        out = self.added()
        while True:
            kind, value = self.peek()
            if kind == "mark" and value in _OPS and value != "+":
                self.at += 1
                out = Op(value, [out, self.added()])
            elif self.take("name", "in"):
                out = Op("in", [out, self.added()])
            elif kind == "name" and value == "not" and self.tokens[self.at + 1 : self.at + 2] == [("name", "in")]:
                self.at += 2
                out = Op("not in", [out, self.added()])
            else:
                return out

    def added(self) -> Any:
        out = self.filtered()
        while self.take("mark", "+"):
            out = Op("+", [out, self.filtered()])
        return out

    def filtered(self) -> Any:
        out = self.primary()
        while self.take("mark", "|"):
            out = Filter(self.need("name"), out)
        return out

    def primary(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind == "const":
            out: Any = Const(value)
        elif kind == "name":
            out = Const(_WORDS[value]) if value in _WORDS else Name(value)
        elif (kind, value) == ("mark", "("):
            out = self.either()
            self.need("mark", ")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while True:
            if self.take("mark", "."):
                out = Item(out, Const(self.need("name")))
            elif self.take("mark", "["):
                out = Item(out, self.either())
                self.need("mark", "]")
            else:
                return out


def parse(source: str) -> list:
    """The syntax tree of a template, unfolded."""
    root: list = []
    stack: list[tuple[str, Any, list]] = [("", None, root)]
    at = 0
    for tag in _TAG.finditer(source):
        if tag.start() > at:
            stack[-1][2].append(Text(source[at : tag.start()]))
        at = tag.end()
        if tag[1] is not None:
            stack[-1][2].append(Write(_Expression(tag[1]).whole()))
            continue
        word, _, rest = tag[2].strip().partition(" ")
        kind, node, body = stack[-1]
        if word == "for":
            found = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
            if not found:
                raise TemplateError("expected: for name in expression")
            loop = For(found[1], _Expression(found[2]).whole())
            body.append(loop)
            stack.append(("for", loop, loop.body))
        elif word == "if":
            test = If([(_Expression(rest).whole(), [])])
            body.append(test)
            stack.append(("if", test, test.branches[0][1]))
        elif word in ("elif", "else") and kind == "if":
            node.branches.append((Const(True) if word == "else" else _Expression(rest).whole(), []))
            stack[-1] = ("if", node, node.branches[-1][1])
        elif word == "generation":
            made = Generation()
            body.append(made)
            stack.append(("generation", made, made.body))
        elif word == "set":
            name, equals, expr = rest.partition("=")
            if not equals or not name.strip().isidentifier():
                raise TemplateError("expected: set name = expression")
            body.append(Set(name.strip(), _Expression(expr).whole()))
        elif word == f"end{kind}" and kind:
            stack.pop()
        else:
            raise TemplateError(f"unexpected tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    if at < len(source):
        root.append(Text(source[at:]))
    return root


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """Evaluate what is constant: operators, filters, branches; join adjacent texts."""
    if isinstance(node, list):
        out: list = []
        for x in node:
            for y in fold(x, filters) if isinstance(x, If) else [fold(x, filters)]:
                if isinstance(y, Write) and isinstance(y.expr, Const):
                    y = Text(_shown(y.expr.value))
                if isinstance(y, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + y.text)
                elif not isinstance(y, Text) or y.text:
                    out.append(y)
        return out
    if isinstance(node, Op):
        args = [fold(a, filters) for a in node.args]
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if node.name in _OPS and all(isinstance(a, Const) for a in args):
            return Const(_OPS[node.name](*[a.value for a in args]))
        return Op(node.name, args)
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        arg = fold(node.arg, filters)
        return Const(filters[node.name](arg.value)) if isinstance(arg, Const) else Filter(node.name, arg)
    if isinstance(node, Item):
        return Item(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Write):
        return Write(fold(node.expr, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr, filters))
    if isinstance(node, For):
        return For(node.name, fold(node.source, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold(node.body, filters))
    if isinstance(node, If):  # a list: the chosen body, or the test that is left
        left = []
        for test, body in node.branches:
            test = fold(test, filters)
            if isinstance(test, Const) and not test.value:
                continue
            left.append((test, fold(body, filters)))
            if isinstance(test, Const):
                break
        if left and isinstance(left[0][0], Const):
            return left[0][1]
        return [If(left)] if left else []
    return node


def _shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _value(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda scope: node.value
    if isinstance(node, Name):
        return lambda scope: scope.get(node.name)
    if isinstance(node, Item):
        of, key = _value(node.of, filters), _value(node.key, filters)

        def item(scope: dict) -> Any:
            held = of(scope)
            if held is None:
                return None
            if not isinstance(held, Mapping):
                raise TemplateError("only mappings can be looked into")
            return held.get(key(scope))

        return item
    if isinstance(node, Filter):
        call, arg = filters[node.name], _value(node.arg, filters)
        return lambda scope: call(arg(scope))
    args = [_value(a, filters) for a in node.args]
    if node.name == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if node.name == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    call = _OPS[node.name]
    return (lambda scope: call(args[0](scope))) if len(args) == 1 else (lambda scope: call(args[0](scope), args[1](scope)))


Pieces = Iterator[tuple[str, bool]]


def _writer(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict, bool], Pieces]:
    if isinstance(node, list):
        parts = [_writer(x, filters) for x in node]

        def body(scope: dict, marked: bool) -> Pieces:
            for part in parts:
                yield from part(scope, marked)

        return body
    if isinstance(node, Text):
        return lambda scope, marked: iter(((node.text, marked),))
    if isinstance(node, Write):
        value = _value(node.expr, filters)
        return lambda scope, marked: iter(((_shown(value(scope)), marked),))
    if isinstance(node, Set):
        new = _value(node.expr, filters)

        def put(scope: dict, marked: bool) -> Pieces:
            scope[node.name] = new(scope)
            return iter(())

        return put
    if isinstance(node, Generation):
        inner = _writer(node.body, filters)
        return lambda scope, marked: inner(scope, True)
    if isinstance(node, If):
        branches = [(_value(t, filters), _writer(b, filters)) for t, b in node.branches]

        def choose(scope: dict, marked: bool) -> Pieces:
            for test, inner in branches:
                if test(scope):
                    return inner(scope, marked)
            return iter(())

        return choose
    source, inner = _value(node.source, filters), _writer(node.body, filters)

    def loop(scope: dict, marked: bool) -> Pieces:
        for index, held in enumerate(source(scope) or ()):
            yield from inner(scope | {node.name: held, "loop": {"index": index + 1, "index0": index, "first": index == 0}}, marked)

    return loop


class Template:
    """A compiled template. ``control`` strings are what ``escape`` guards in texts."""

    def __init__(self, source: str, control: tuple[str, ...] = ()):
        self.control = control
        self._guard = re.compile("|".join(["\\\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in control)]))
        filters = {"escape": self.escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "string": _shown}
        self.tree = fold(parse(source), filters)
        self._write = _writer(self.tree, filters)

    def escape(self, text: Any) -> str:
        """Put a backslash after the first character of control strings; double backslashes."""
        return self._guard.sub(lambda m: m[0] + "\\", _shown(text))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def pieces(self, **scope: Any) -> Pieces:
        return self._write(scope, False)

    def render(self, **scope: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans that generation marks cover."""
        out, spans, at = [], [], 0
        for piece, marked in self.pieces(**scope):
            out.append(piece)
            if marked and piece:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(piece))
                else:
                    spans.append((at, at + len(piece)))
            at += len(piece)
        return "".join(out), spans

    def is_turn_local(self, messages: str = "messages") -> bool:
        """One loop over ``messages`` that uses no loop state: turns can be rendered apart."""
        if len(self.tree) != 1 or not isinstance(self.tree[0], For) or self.tree[0].source != Name(messages):
            return False

        def names(x: Any) -> set[str]:
            if isinstance(x, Name):
                return {x.name}
            if isinstance(x, (list, tuple)):
                return set().union(*map(names, x), set())
            return set().union(*map(names, vars(x).values()), set()) if hasattr(x, "__dict__") else set()

        def sets(x: Any) -> bool:
            return isinstance(x, Set) or isinstance(x, (list, tuple)) and any(map(sets, x)) or (
                hasattr(x, "__dict__") and any(map(sets, vars(x).values()))
            )

        return names(self.tree[0].body) <= {self.tree[0].name} and not sets(self.tree)
