"""Compiler for a small sandboxed chat template language.

A template is parsed into a syntax tree, constants are folded, and the tree is turned into nested Python closures.
Nothing is evaluated as Python source. A template reads only the mapping it is given: names, string keys of mappings
and the filters below; there are no calls, no attributes of Python objects and no assignments outside the template.

    {{ expr }}   {% for x in expr %} ... {% endfor %}   {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expr %}   {% generation %} ... {% endgeneration %}

Expressions: strings, integers, true, false, none, names, a.b, a['b'], not, and, or, ==, !=, <, <=, >, >=, in, +, ~
(concatenate as text) and filters (a | trim). `loop` has index, index0, first and last. Values iterate lazily, so that a
conversation need not be held whole. Text between generation markers comes with its mark set.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any

MAX_DEPTH = 50
Render = Callable[[dict, bool], "Iterable[tuple[str, bool]]"]


class TemplateError(ValueError):
    """The template can't be parsed or uses something that the sandbox doesn't have."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    op: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Print:
    expr: Any


@dataclass(frozen=True)
class Set:
    name: str
    expr: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    of: Any
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()\[\]=-]))", re.S)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def text_of(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else str(value)


def is_in(a: Any, b: Any) -> bool:
    return text_of(a) in b if isinstance(b, str) else a in b if isinstance(b, (Mapping, list, tuple)) else False


BASE_FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: text_of(x).strip(),
    "upper": lambda x: text_of(x).upper(),
    "lower": lambda x: text_of(x).lower(),
    "length": lambda x: len(x) if isinstance(x, (str, list, tuple, Mapping)) else 0,
    "string": text_of,
}


class Words:
    """The tokens of one expression or tag."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected character at {source[at : at + 10]!r}")
            kind = m.lastgroup
            self.items.append((kind, m[kind]))
            at = m.end()
        self.at, self.depth = 0, 0

    def peek(self) -> tuple[str, str]:
        return self.items[self.at] if self.at < len(self.items) else ("end", "")

    def take(self, *values: str) -> str:
        kind, value = self.peek()
        if kind in ("end", "str") or value not in values:
            return ""
        self.at += 1
        return value

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected, found {self.peek()[1]!r}")

    def ident(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"a name expected, found {value!r}")
        self.at += 1
        return value

    def expr(self) -> Any:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        left = self.both()
        while self.take("or"):
            left = Op("or", (left, self.both()))
        self.depth -= 1
        return left

    def both(self) -> Any:
        left = self.negated()
        while self.take("and"):
            left = Op("and", (left, self.negated()))
        return left

    def negated(self) -> Any:
        count = 0
        while self.take("not"):
            count += 1
        inner = self.compared()
        for _ in range(count):
            inner = Op("not", (inner,))
        return inner

    def compared(self) -> Any:
        left = self.summed()
        while op := self.take(*COMPARE, "in"):
            left = Op(op, (left, self.summed()))
        return left

    def summed(self) -> Any:
        left = self.filtered()
        while op := self.take("+", "~"):
            left = Op(op, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        value = self.atom()
        while self.take("|"):
            value = Filter(self.ident(), value)
        return value

    def atom(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            node: Any = Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            node = Const(int(value))
        elif kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            node = Const(fixed[value]) if value in fixed else Name(value)
        elif value == "(":
            node = self.expr()
            self.need(")")
        else:
            raise TemplateError(f"an expression expected, found {value!r}")
        while op := self.take(".", "["):
            node = Get(node, Const(self.ident()) if op == "." else self.expr())
            if op == "[":
                self.need("]")
        return node

    def end(self) -> None:
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.peek()[1]!r}")


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    parts = re.split(r"(\{\{.*?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", source, flags=re.S)
    place = 0

    def block(ends: tuple[str, ...], depth: int) -> tuple[tuple, str, Words | None]:
        nonlocal place
        if depth > MAX_DEPTH:
            raise TemplateError("nested too deeply")
        out: list = []
        while place < len(parts):
            part = parts[place]
            place += 1
            if part.startswith("{{") and part.endswith("}}"):
                w = Words(part[2:-2])
                out.append(Print(w.expr()))
                w.end()
            elif part.startswith("{%") and part.endswith("%}"):
                w = Words(part[2:-2].strip("-"))
                tag = w.ident()
                if tag in ends:
                    return tuple(out), tag, w
                out.append(tagged(tag, w, depth))
            elif not part.startswith("{#") and part:
                out.append(Print(Const(part)))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} missing")
        return tuple(out), "", None

    def tagged(tag: str, w: Words, depth: int) -> Any:
        if tag == "for":
            name = w.ident()
            w.need("in")
            of = w.expr()
            w.end()
            return For(name, of, block(("endfor",), depth + 1)[0])
        if tag == "if":
            test = w.expr()
            w.end()
            then, ended, rest = block(("elif", "else", "endif"), depth + 1)
            other: tuple = ()
            if ended == "elif":
                other = (tagged("if", rest, depth + 1),)
            elif ended == "else":
                other = block(("endif",), depth + 1)[0]
            return If(test, then, other)
        if tag == "set":
            name = w.ident()
            w.need("=")
            value = w.expr()
            w.end()
            return Set(name, value)
        if tag == "generation":
            w.end()
            return Generation(block(("endgeneration",), depth + 1)[0])
        raise TemplateError(f"unknown tag {tag!r}")

    return block((), 0)[0]


def fold(node: Any, filters: Mapping[str, Callable]) -> Any:
    """The same tree with constant expressions evaluated, decided branches chosen and neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            y = fold(x, filters)
            for z in y if isinstance(y, tuple) else (y,):
                if isinstance(z, Print) and isinstance(z.expr, Const):
                    z = Print(Const(text_of(z.expr.value)))
                    if out and isinstance(out[-1], Print) and isinstance(out[-1].expr, Const):
                        z = Print(Const(out.pop().expr.value + z.expr.value))
                    if not z.expr.value:
                        continue
                out.append(z)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(fold(a, filters) for a in node.args)
        if all(isinstance(a, Const) for a in args):
            return Const(evaluated(Op(node.op, args), filters)({}))
        if node.op in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Op(node.op, args)
    if isinstance(node, Filter):
        of = fold(node.of, filters)
        if node.name not in filters:
            raise TemplateError(f"unknown filter {node.name!r}")
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Get):
        return Get(fold(node.of, filters), fold(node.key, filters))
    if isinstance(node, Print):
        return Print(fold(node.expr, filters))
    if isinstance(node, Set):
        return Set(node.name, fold(node.expr, filters))
    if isinstance(node, If):
        test, then, other = (fold(x, filters) for x in (node.test, node.then, node.other))
        return (then if test.value else other) if isinstance(test, Const) else If(test, then, other)
    if isinstance(node, For):
        return For(node.name, fold(node.of, filters), fold(node.body, filters))
    if isinstance(node, Generation):
        body = fold(node.body, filters)
        return Generation(body) if body else ()
    return node


def evaluated(node: Any, filters: Mapping[str, Callable]) -> Callable[[dict], Any]:
    """A closure that gives the value of an expression."""
    if isinstance(node, Const):
        return lambda ctx, v=node.value: v
    if isinstance(node, Name):
        return lambda ctx, n=node.name: ctx.get(n)
    if isinstance(node, Get):
        of, key = evaluated(node.of, filters), evaluated(node.key, filters)

        def get(ctx):
            x = of(ctx)
            return x.get(key(ctx)) if isinstance(x, Mapping) else None

        return get
    if isinstance(node, Filter):
        of, f = evaluated(node.of, filters), filters[node.name]
        return lambda ctx: f(of(ctx))
    args = [evaluated(a, filters) for a in node.args]
    a, b = args[0], args[-1]
    if node.op == "and":
        return lambda ctx: a(ctx) and b(ctx)
    if node.op == "or":
        return lambda ctx: a(ctx) or b(ctx)
    if node.op == "not":
        return lambda ctx: not a(ctx)
    if node.op == "in":
        return lambda ctx: is_in(a(ctx), b(ctx))
    if node.op == "~":
        return lambda ctx: text_of(a(ctx)) + text_of(b(ctx))
    if node.op == "+":

        def plus(ctx):
            x, y = a(ctx), b(ctx)
            return x + y if isinstance(x, int) and isinstance(y, int) else text_of(x) + text_of(y)

        return plus
    compare = COMPARE[node.op]

    def compared(ctx):
        try:
            return compare(a(ctx), b(ctx))
        except TypeError:
            return False

    return compared


def generated(node: Any, filters: Mapping[str, Callable]) -> Render:
    """A closure that renders a statement, yielding texts and their marks."""
    if isinstance(node, tuple):
        steps = [generated(x, filters) for x in node]

        def run(ctx, mark):
            for step in steps:
                yield from step(ctx, mark)

        return run
    if isinstance(node, Print):
        if isinstance(node.expr, Const):
            return lambda ctx, mark, v=node.expr.value: ((v, mark),)
        value = evaluated(node.expr, filters)
        return lambda ctx, mark: ((text_of(value(ctx)), mark),)
    if isinstance(node, Set):
        value = evaluated(node.expr, filters)

        def put(ctx, mark, n=node.name):
            ctx[n] = value(ctx)
            return ()

        return put
    if isinstance(node, If):
        test, then, other = evaluated(node.test, filters), generated(node.then, filters), generated(node.other, filters)
        return lambda ctx, mark: (then if test(ctx) else other)(ctx, mark)
    if isinstance(node, Generation):
        body = generated(node.body, filters)
        return lambda ctx, mark: body(ctx, True)
    of, body = evaluated(node.of, filters), generated(node.body, filters)

    def loop(ctx, mark, n=node.name):
        values = of(ctx)
        if isinstance(values, (str, Mapping)) or not isinstance(values, Iterable):
            return
        inner, items, i, none = dict(ctx), iter(values), 0, object()
        item = next(items, none)
        while item is not none:
            after = next(items, none)
            inner[n] = item
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": after is none}
            yield from body(inner, mark)
            item, i = after, i + 1

    return loop


def compile_template(source: str, filters: Mapping[str, Callable[[Any], Any]] | None = None) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function that renders the template for a context: it yields texts, each with whether it is under a generation marker."""
    known = BASE_FILTERS | dict(filters or {})
    run = generated(fold(parse(source), known), known)
    return lambda context: iter(run(dict(context), False))
