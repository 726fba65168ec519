"""A small template language for conversations, compiled to Python closures.

Texts hold ``{{ value }}``, ``{# comment #}`` and the statements ``{% for x in list %}``, ``{% if %} {% elif %} {% else %}``,
``{% set x = value %}`` and ``{% generation %}`` (what a model is trained to write), each but ``set`` closed by ``{% end... %}``.
A dash inside a tag's edge strips the white space beside it. Values know and, or, not, comparisons, ``in``, ``+ - ~``,
``name.key``, ``name[key]`` and filters after ``|``. Templates are data of strangers: they see the names they are given and
items of mappings and lists, never attributes of objects; nothing can be called but the filters, and loops run over given lists.

A template is parsed into a tree, constants are folded, and each node becomes a closure that yields pieces of the output
with whether they lie in a generation block, so that a long conversation is never held whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

Piece = tuple[str, bool]


class TemplateError(ValueError):
    """A template that cannot be parsed, or a value it asks for in vain."""


# --- the tree --------------------------------------------------------------------------------------------


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
class Unary:
    op: str
    a: Any


@dataclass(frozen=True)
class Binary:
    op: str
    a: Any
    b: Any


@dataclass(frozen=True)
class Filter:
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- what values can do ----------------------------------------------------------------------------------


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple, str)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if -len(of) <= key < len(of) else None
    raise TemplateError(f"no item {key!r} in {type(of).__name__}")


def _text(v: Any) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def _number(v: Any) -> Any:
    if not isinstance(v, (int, float)):
        raise TemplateError(f"not a number: {type(v).__name__}")
    return v


BINARY: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: b is not None and a in b,
    "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _number(a) + _number(b),
    "-": lambda a, b: _number(a) - _number(b),
    "~": lambda a, b: _text(a) + _text(b),
}


class Escape:
    """Puts a backslash before each backslash and control string of a text, and takes it away again."""

    def __init__(self, controls: Iterable[str]):
        self.pattern = re.compile("|".join(re.escape(c) for c in ["\\", *sorted(controls, key=len, reverse=True)]))

    def __call__(self, text: str) -> str:
        return self.pattern.sub(r"\\\g<0>", text)

    @staticmethod
    def undo(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def _filters(escape: Escape) -> dict[str, Callable[..., Any]]:
    return {
        "escape": lambda v: escape(_text(v)),
        "trim": lambda v: _text(v).strip(),
        "lower": lambda v: _text(v).lower(),
        "upper": lambda v: _text(v).upper(),
        "title": lambda v: _text(v).title(),
        "length": lambda v: len(v),
        "default": lambda v, other: other if v is None else v,
    }


# --- parsing ---------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{([{%#])(-?)(.*?)(-?)([}%#])\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(\d+)|([A-Za-z_]\w*)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|<=|>=|[-+~<>|.()\[\],=]))", re.DOTALL)
_CLOSES = {"{": "}", "%": "%", "#": "#"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
#: Nesting of values and blocks.
DEPTH = 50


class _Values:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, filters: dict):
        self.tokens, self.at, self.filters, self.depth = [], 0, filters, 0
        pos, source = 0, source.rstrip()
        while pos < len(source):
            if not (m := _TOKEN.match(source, pos)):
                raise TemplateError(f"cannot read {source[pos:pos + 20]!r}")
            kind = ("number", "name", "text", "sign")[m.lastindex - 1]
            self.tokens.append((kind, m[m.lastindex]))
            pos = m.end()

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *values: str) -> str | None:
        kind, v = self.peek()
        if kind in ("name", "sign") and v in values:
            self.at += 1
            return v
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, v = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {v!r}")
        self.at += 1
        return v

    def end(self) -> None:
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")

    def value(self) -> Any:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("values are nested too deeply")
        out = self._binary(("or",), lambda: self._binary(("and",), self._not))
        self.depth -= 1
        return out

    def _binary(self, ops: tuple, below: Callable[[], Any]) -> Any:
        out = below()
        while op := self.take(*ops):
            out = Binary(op, out, below())
        return out

    def _not(self) -> Any:
        negations = 0
        while self.take("not"):
            negations += 1
        out = self._compared()
        for _ in range(negations):
            out = Unary("not", out)
        return out

    def _compared(self) -> Any:
        below = lambda: self._binary(("+", "-", "~"), self._filtered)
        out = below()
        if op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            return Binary(op, out, below())
        if self.take("not"):
            self.need("in")
            return Unary("not", Binary("in", out, below()))
        return out

    def _filtered(self) -> Any:
        out = self._primary()
        while self.take("|"):
            name, args = self.name(), []
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.value())
                    if not self.take(","):
                        self.need(")")
                        break
            out = Filter(name, (out, *args))
        return out

    def _primary(self) -> Any:
        if self.take("("):
            out = self.value()
            self.need(")")
        elif self.take("-"):
            out = Unary("-", self._primary())
        else:
            kind, v = self.peek()
            if kind not in ("number", "name", "text"):
                raise TemplateError(f"expected a value, found {v!r}")
            self.at += 1
            if kind == "number":
                out = Const(int(v))
            elif kind == "text":
                out = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), v[1:-1], flags=re.DOTALL))
            else:
                out = Const(_WORDS[v]) if v in _WORDS else Name(v)
        while True:
            if self.take("."):
                out = Item(out, Const(self.name()))
            elif self.take("["):
                out = Item(out, self.value())
                self.need("]")
            else:
                return out


def _pieces(source: str) -> Iterator[tuple[str, str]]:
    """(kind, content) of texts, values and statements, white space stripped where a dash asks for it."""
    pos, strip = 0, False
    for m in _TAG.finditer(source):
        if m[5] != _CLOSES[m[1]]:
            raise TemplateError(f"tag not closed: {m[0][:20]!r}")
        text = source[pos : m.start()]
        text = text.lstrip() if strip else text
        yield "text", text.rstrip() if m[2] else text
        if m[1] != "#":
            yield ("value" if m[1] == "{" else "statement"), m[3]
        pos, strip = m.end(), bool(m[4])
    yield "text", source[pos:].lstrip() if strip else source[pos:]


def parse(source: str, filters: dict) -> tuple:
    """The tree of a template."""
    pieces = list(_pieces(source))
    at = 0

    def body(ends: tuple[str, ...], depth: int) -> tuple[tuple, str, _Values | None]:
        nonlocal at
        if depth > DEPTH:
            raise TemplateError("blocks are nested too deeply")
        out: list[Any] = []
        while at < len(pieces):
            kind, content = pieces[at]
            at += 1
            if kind == "text":
                out.append(Text(content))
                continue
            v = _Values(content, filters)
            if kind == "value":
                out.append(Emit(v.value()))
                v.end()
                continue
            word = v.name()
            if word in ends:
                return tuple(out), word, v
            if word == "for":
                name = v.name()
                v.need("in")
                over = v.value()
                v.end()
                out.append(For(name, over, body(("endfor",), depth + 1)[0]))
            elif word == "if":
                branches, condition = [], v.value()
                v.end()
                while True:
                    inner, end, w = body(("elif", "else", "endif") if condition is not True else ("endif",), depth + 1)
                    branches.append((Const(True) if condition is True else condition, inner))
                    if end == "endif":
                        break
                    condition = w.value() if end == "elif" else True
                    w.end()
                out.append(If(tuple(branches)))
            elif word == "set":
                name = v.name()
                v.need("=")
                out.append(Set(name, v.value()))
                v.end()
            elif word == "generation":
                v.end()
                out.append(Generation(body(("endgeneration",), depth + 1)[0]))
            else:
                raise TemplateError(f"no statement {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), "", None

    return body((), 0)[0]


# --- folding ---------------------------------------------------------------------------------------------


def fold(node: Any, filters: dict) -> Any:
    """The tree with constant values computed, constant branches decided and neighbouring texts joined."""
    f = lambda x: fold(x, filters)
    if isinstance(node, tuple):
        out: list[Any] = []
        for n in map(f, node):
            for x in n if isinstance(n, tuple) else (n,):
                if isinstance(x, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + x.text)
                elif not (isinstance(x, Text) and not x.text):
                    out.append(x)
        return tuple(out)
    if isinstance(node, Unary):
        a = f(node.a)
        return Const(_unary(node.op, a.value)) if isinstance(a, Const) else Unary(node.op, a)
    if isinstance(node, Binary):
        a, b = f(node.a), f(node.b)
        if node.op in ("and", "or"):
            if isinstance(a, Const):
                return b if bool(a.value) == (node.op == "and") else a
        elif isinstance(a, Const) and isinstance(b, Const):
            return Const(BINARY[node.op](a.value, b.value))
        return Binary(node.op, a, b)
    if isinstance(node, Item):
        of, key = f(node.of), f(node.key)
        return Const(_item(of.value, key.value)) if isinstance(of, Const) and isinstance(key, Const) else Item(of, key)
    if isinstance(node, Filter):
        args = tuple(map(f, node.args))
        return Const(filters[node.name](*(a.value for a in args))) if all(isinstance(a, Const) for a in args) else Filter(node.name, args)
    if isinstance(node, Emit):
        v = f(node.value)
        return Text(_text(v.value)) if isinstance(v, Const) else Emit(v)
    if isinstance(node, For):
        return For(node.name, f(node.over), f(node.body))
    if isinstance(node, Set):
        return Set(node.name, f(node.value))
    if isinstance(node, Generation):
        return Generation(f(node.body))
    if isinstance(node, If):
        kept: list[tuple[Any, tuple]] = []
        for condition, inner in node.branches:
            c = f(condition)
            if isinstance(c, Const) and not c.value:
                continue
            kept.append((c, f(inner)))
            if isinstance(c, Const):
                break
        return kept[0][1] if kept and isinstance(kept[0][0], Const) else If(tuple(kept)) if kept else ()
    return node


def _unary(op: str, a: Any) -> Any:
    return not a if op == "not" else -_number(a)


# --- closures --------------------------------------------------------------------------------------------


def _value(node: Any, filters: dict) -> Callable[[dict], Any]:
    v = lambda x: _value(x, filters)
    if isinstance(node, Const):
        return lambda env, value=node.value: value
    if isinstance(node, Name):
        return lambda env, name=node.name: env.get(name)
    if isinstance(node, Item):
        of, key = v(node.of), v(node.key)
        return lambda env: _item(of(env), key(env))
    if isinstance(node, Unary):
        a, op = v(node.a), node.op
        return lambda env: _unary(op, a(env))
    if isinstance(node, Binary):
        a, b = v(node.a), v(node.b)
        if node.op == "and":
            return lambda env: a(env) and b(env)
        if node.op == "or":
            return lambda env: a(env) or b(env)
        run = BINARY[node.op]
        return lambda env: run(a(env), b(env))
    run, args = filters[node.name], [v(a) for a in node.args]
    return lambda env: run(*[a(env) for a in args])


def _body(nodes: tuple, filters: dict) -> Callable[[dict, bool], Iterator[Piece]]:
    parts = [_closure(n, filters) for n in nodes]

    def run(env: dict, marked: bool) -> Iterator[Piece]:
        for p in parts:
            yield from p(env, marked)

    return run


def _closure(node: Any, filters: dict) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, Text):
        return lambda env, marked, text=node.text: iter(((text, marked),))
    if isinstance(node, Emit):
        value = _value(node.value, filters)
        return lambda env, marked: iter(((_text(value(env)), marked),))
    if isinstance(node, Generation):
        inner = _body(node.body, filters)
        return lambda env, marked: inner(env, True)
    if isinstance(node, Set):
        value, name = _value(node.value, filters), node.name

        def put(env: dict, marked: bool) -> Iterator[Piece]:
            env[name] = value(env)
            return iter(())

        return put
    if isinstance(node, If):
        branches = [(_value(c, filters), _body(inner, filters)) for c, inner in node.branches]

        def choose(env: dict, marked: bool) -> Iterator[Piece]:
            for condition, inner in branches:
                if condition(env):
                    return inner(env, marked)
            return iter(())

        return choose
    over, inner, name = _value(node.over, filters), _body(node.body, filters), node.name

    def loop(env: dict, marked: bool) -> Iterator[Piece]:
        items = over(env)
        if items is None or isinstance(items, (str, dict)):
            raise TemplateError("loops run over lists")
        items, index = iter(items), 0
        end = object()
        item = next(items, end)
        while item is not end:
            following = next(items, end)
            yield from inner(env | {name: item, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": following is end}}, marked)
            item, index = following, index + 1

    return loop


def _uses(node: Any, name: str) -> int:
    if isinstance(node, Name):
        return int(node.name == name)
    if isinstance(node, tuple):
        return sum(_uses(n, name) for n in node)
    return sum(_uses(getattr(node, f.name), name) for f in fields(node)) if is_dataclass(node) else 0


@dataclass
class Template:
    """A compiled template. controls: strings that the filter ``escape`` keeps out of texts.

    render yields (piece, marked) in order. Where streams holds, messages may be an iterator: the template only loops over
    them once.
    """

    source: str
    controls: tuple[str, ...] = ()
    streams: bool = field(init=False)

    def __post_init__(self) -> None:
        filters = _filters(Escape(self.controls))
        self.tree = fold(parse(self.source, filters), filters)
        self._run = _body(self.tree, filters)
        self.streams = _uses(self.tree, "messages") == sum(isinstance(n, For) and n.over == Name("messages") for n in self.tree) <= 1

    def __getstate__(self) -> dict:
        return {"source": self.source, "controls": self.controls}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def render(self, messages: Iterable[dict], **names: Any) -> Iterator[Piece]:
        return self._run({"messages": messages if self.streams else list(messages)} | names, False)
