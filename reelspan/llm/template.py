"""A compiler for a small, sandboxed chat template language.

``{{ expr }}`` writes a value; ``{% for x in expr %}..{% endfor %}``,
``{% if expr %}..{% elif expr %}..{% else %}..{% endif %}``,
``{% set name = expr %}`` and ``{% generation %}..{% endgeneration %}`` are the
statements; ``-`` next to a tag's percent sign or brace trims white space on
that side. Expressions have strings, integers, true, false, none, names,
``a.b`` and ``a['b']`` over mappings, ``loop.index``, ``loop.first`` and
``loop.last``, ``+ == != and or not in``, parentheses and the filters
``escape``, ``one_line``, ``trim``, ``upper``, ``lower`` and ``length``. There are no calls,
no attributes of Python objects and no imports.

Source is parsed into a tree, constant expressions, constant branches and
neighbouring literals are folded, and each node becomes a Python closure that
sends pieces to a sink. Text inside ``generation`` is reported as spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    r"""Reversible: backslashes double, and `<|` becomes `<\|`, so that no control string is left."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def one_line(text: str) -> str:
    r"""Line feeds of escaped text as `\n`, which no escaped text holds."""
    return text.replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def _text(value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(_text(v)),
    "one_line": lambda v: one_line(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if v is not None else 0,
}


# the tree
@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Output:
    expr: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # of (condition, body)
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    expr: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+.|()\[\]]))")
TAGS = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


class _Expression:
    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.strip()
        while at < len(source):
            m = TOKEN.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"bad expression: {source!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at, self.source = 0, source

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, kind: str) -> str:
        if self.at >= len(self.tokens) or (self.tokens[self.at][0] != kind and self.tokens[self.at][1] != kind):
            raise TemplateError(f"expected {kind} in {self.source!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        e = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r} in {self.source!r}")
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = Op("or", (e, self.both()))
        return e

    def both(self):
        e = self.negated()
        while self.take("and"):
            e = Op("and", (e, self.negated()))
        return e

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        e = self.added()
        while (kind := self.peek()) in ("==", "!=", "in"):
            self.at += 1
            e = Op(kind, (e, self.added()))
        return e

    def added(self):
        e = self.filtered()
        while self.take("+"):
            e = Op("+", (e, self.filtered()))
        return e

    def filtered(self):
        e = self.primary()
        while self.take("|"):
            if (name := self.need("name")) not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            e = Filter(name, e)
        return e

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError(f"expression ends early: {self.source!r}")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            e = Const(re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S))
        elif kind == "int":
            e = Const(int(value))
        elif kind == "name":
            if value in ("and", "or", "not", "in"):
                raise TemplateError(f"unexpected {value!r} in {self.source!r}")
            e = Const(WORDS[value]) if value in WORDS else Name(value)
        elif value == "(":
            e = self.either()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r} in {self.source!r}")
        while True:
            if self.take("."):
                e = Item(e, Const(self.need("name")))
            elif self.take("["):
                e = Item(e, self.either())
                self.need("]")
            else:
                return e


def parse(source: str) -> tuple:
    parts = TAGS.split(source)
    trim = False
    stack: list[tuple[str, Any, list]] = [("root", None, [])]
    for k, part in enumerate(parts):
        body = stack[-1][2]
        if k % 2 == 0:
            if trim:
                part = part.lstrip()
            if k + 1 < len(parts) and parts[k + 1][2:3] == "-":
                part = part.rstrip()
            if part:
                body.append(Output(Const(part)))
            continue
        trim = part[-3:-2] == "-"
        inner = part[2:-2].strip("-").strip()
        if part.startswith("{#"):
            continue
        if part.startswith("{{"):
            body.append(Output(_Expression(inner).whole()))
            continue
        word, _, rest = inner.partition(" ")
        if word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError(f"bad set: {inner!r}")
            body.append(Set(name.strip(), _Expression(value).whole()))
        elif word == "for":
            m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"bad for: {inner!r}")
            stack.append(("for", (m[1], _Expression(m[2]).whole()), []))
        elif word == "if":
            stack.append(("if", ([], _Expression(rest).whole()), []))
        elif word in ("elif", "else"):
            kind, (arms, condition), done = stack.pop() if stack[-1][0] == "if" else ("", ([], None), [])
            if kind != "if" or condition is None:
                raise TemplateError(f"{word} without if")
            arms = [*arms, (condition, tuple(done))]
            stack.append(("if", (arms, _Expression(rest).whole() if word == "elif" else None), []))
        elif word == "generation":
            if any(s[0] == "generation" for s in stack):
                raise TemplateError("generation inside generation")
            stack.append(("generation", None, []))
        elif word in ("endfor", "endif", "endgeneration"):
            kind, head, done = stack.pop()
            if kind != word[3:]:
                raise TemplateError(f"{word} closes {kind}")
            body = stack[-1][2]
            if kind == "for":
                body.append(For(head[0], head[1], tuple(done)))
            elif kind == "generation":
                body.append(Generation(tuple(done)))
            else:
                arms, condition = head
                body.append(If((*arms, (condition, tuple(done))), ()) if condition is not None else If(tuple(arms), tuple(done)))
        else:
            raise TemplateError(f"unknown statement {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return tuple(stack[0][2])


def _apply(kind: str, a: Any, b: Any = None) -> Any:
    if kind == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    if kind == "in":
        return b is not None and a in b
    return {"==": lambda: a == b, "!=": lambda: a != b, "not": lambda: not a}[kind]()


def _fold_expr(e):
    if isinstance(e, Item):
        return Item(_fold_expr(e.of), _fold_expr(e.key))
    if isinstance(e, Filter):
        of = _fold_expr(e.of)
        return Const(FILTERS[e.name](of.value)) if isinstance(of, Const) else Filter(e.name, of)
    if isinstance(e, Op):
        args = tuple(map(_fold_expr, e.args))
        if e.kind in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (e.kind == "and") else args[0]
        elif all(isinstance(a, Const) for a in args):
            return Const(_apply(e.kind, *(a.value for a in args)))
        return Op(e.kind, args)
    return e


def fold(body: Iterable) -> tuple:
    out: list = []
    for node in body:
        if isinstance(node, Output):
            e = _fold_expr(node.expr)
            if isinstance(e, Const):
                text = _text(e.value)
                if out and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const):
                    text = out.pop().expr.value + text
                if text:
                    out.append(Output(Const(text)))
            else:
                out.append(Output(e))
        elif isinstance(node, For):
            out.append(For(node.name, _fold_expr(node.over), fold(node.body)))
        elif isinstance(node, Set):
            out.append(Set(node.name, _fold_expr(node.expr)))
        elif isinstance(node, Generation):
            out.append(Generation(fold(node.body)))
        elif isinstance(node, If):
            arms, other = [], fold(node.other)
            for condition, arm in node.arms:
                condition = _fold_expr(condition)
                if isinstance(condition, Const):
                    if condition.value:
                        other = fold(arm)
                        break
                else:
                    arms.append((condition, fold(arm)))
            if arms:
                out.append(If(tuple(arms), other))
            else:
                for x in other:
                    merge = out and isinstance(x, Output) and isinstance(x.expr, Const) and isinstance(out[-1], Output) and isinstance(out[-1].expr, Const)
                    out.append(Output(Const(out.pop().expr.value + x.expr.value)) if merge else x)
    return tuple(out)


@dataclass
class Sink:
    """The pieces written so far, their length in code points, and the spans inside generation blocks."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)


def _expr(e) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        return lambda env, n=e.name: env.get(n)
    if isinstance(e, Item):
        of, key = _expr(e.of), _expr(e.key)

        def item(env):
            value, k = of(env), key(env)
            if isinstance(value, dict):
                return value.get(k)
            return value[k] if isinstance(value, list) and isinstance(k, int) and -len(value) <= k < len(value) else None

        return item
    if isinstance(e, Filter):
        return lambda env, f=FILTERS[e.name], of=_expr(e.of): f(of(env))
    args = tuple(map(_expr, e.args))
    if e.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env, k=e.kind: _apply(k, *(a(env) for a in args))


def _body(nodes: tuple) -> Callable[[dict, Sink], None]:
    steps = tuple(map(_node, nodes))

    def run(env, sink):
        for step in steps:
            step(env, sink)

    return steps[0] if len(steps) == 1 else run


def _node(node) -> Callable[[dict, Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.expr, Const):
            return lambda env, sink, t=node.expr.value: sink.write(t)
        return lambda env, sink, e=_expr(node.expr): sink.write(_text(e(env)))
    if isinstance(node, Set):

        def assign(env, sink, n=node.name, e=_expr(node.expr)):
            env[n] = e(env)

        return assign
    if isinstance(node, Generation):

        def generation(env, sink, body=_body(node.body)):
            start = sink.length
            body(env, sink)
            sink.spans.append((start, sink.length))

        return generation
    if isinstance(node, If):
        arms, other = [(_expr(c), _body(b)) for c, b in node.arms], _body(node.other)

        def choose(env, sink):
            for condition, body in arms:
                if condition(env):
                    return body(env, sink)
            return other(env, sink)

        return choose
    over, body = _expr(node.over), _body(node.body)

    def loop(env, sink, n=node.name):
        items = over(env) or []
        last = len(items) - 1
        inner = dict(env)
        for k, item in enumerate(items):
            inner[n] = item
            inner["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == last}
            body(inner, sink)

    return loop


class Template:
    """``render(**values)`` gives the text and the spans of code points inside generation blocks."""

    def __init__(self, source: str):
        self.source = source
        self.tree = fold(parse(source))
        self._run = _body(self.tree)

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        sink = Sink()
        self._run(values, sink)
        return "".join(sink.pieces), sink.spans

    def __reduce__(self):
        return Template, (self.source,)
