"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}   {% for x in e %} {% endfor %}
    {% set x = e %}    {% generation %} ... {% endgeneration %}         {# comment #}

Expressions: strings, whole numbers, true, false, none, names, `a.key` and `a["key"]` (keys of mappings only), filters
`a | f`, `~` (join as text), `+`, `==`, `!=`, `<`, `>`, `in`, `not`, `and`, `or`. There are no calls and no access to
attributes of Python objects; the filters are those given to `compile_template`. Constant parts are folded when the
template is compiled. Text inside a generation block is marked, which gives the loss mask.

A template renders as a stream of (text, marked), and a loop reads its rows one by one, so that a conversation of any
length needs the memory of one turn.
"""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    """A template that does not parse, or an expression that the sandbox does not allow."""


# --- syntax tree -------------------------------------------------------------------------------


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
class Apply:
    """A filter, operator or connective over its operands."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Marked:
    body: tuple


# --- parsing -----------------------------------------------------------------------------------

_PARTS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<number>\d+)|(?P<word>[A-Za-z_]\w*)|(?P<sign>==|!=|[|.~+<>()\[\]]))""", re.S)
_CONSTANTS = {"true": True, "false": False, "none": None}
_WORDS = {"and", "or", "not", "in"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def whole(self) -> Any:
        tree = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("sign", "word") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def next(self, *kinds: str) -> tuple[str, str]:
        if self.at >= len(self.tokens) or kinds and self.tokens[self.at][0] not in kinds:
            raise TemplateError("an expression ends too early or holds the wrong part")
        self.at += 1
        return self.tokens[self.at - 1]

    def either(self) -> Any:
        tree = self.both()
        while self.take("or"):
            tree = Apply("or", (tree, self.both()))
        return tree

    def both(self) -> Any:
        tree = self.negated()
        while self.take("and"):
            tree = Apply("and", (tree, self.negated()))
        return tree

    def negated(self) -> Any:
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        tree = self.joined()
        while op := self.take("==", "!=", "<", ">", "in"):
            tree = Apply(op, (tree, self.joined()))
        return tree

    def joined(self) -> Any:
        tree = self.filtered()
        while op := self.take("~", "+"):
            tree = Apply(op, (tree, self.filtered()))
        return tree

    def filtered(self) -> Any:
        tree = self.single()
        while self.take("|"):
            tree = Apply("|" + self.next("word")[1], (tree,))
        return tree

    def single(self) -> Any:
        if self.take("("):
            tree = self.either()
            if not self.take(")"):
                raise TemplateError("a bracket is not closed")
        else:
            kind, value = self.next("text", "number", "word")
            if kind == "text":
                tree = Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
            elif kind == "number":
                tree = Const(int(value))
            elif value in _CONSTANTS:
                tree = Const(_CONSTANTS[value])
            elif value in _WORDS:
                raise TemplateError(f"unexpected {value!r}")
            else:
                tree = Name(value)
        while op := self.take(".", "["):
            tree = Item(tree, Const(self.next("word")[1]) if op == "." else self.either())
            if op == "[" and not self.take("]"):
                raise TemplateError("a bracket is not closed")
        return tree


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    parts = [p for p in _PARTS.split(source) if p and not p.startswith("{#")]
    body, at, end = _body(parts, 0, ())
    return body


def _body(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str]:
    """The nodes up to a tag in `ends`; where it stands, and the tag."""
    nodes: list[Any] = []
    while at < len(parts):
        part = parts[at]
        at += 1
        if part.startswith("{{"):
            nodes.append(Output(_Expression(part[2:-2]).whole()))
        elif not part.startswith("{%"):
            nodes.append(Text(part))
        else:
            tag = part[2:-2].strip()
            word, _, rest = tag.partition(" ")
            if word in ends:
                return tuple(nodes), at, tag
            if word == "if":
                node, at = _if(parts, at, rest)
                nodes.append(node)
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest.strip(), re.S)
                if not m:
                    raise TemplateError(f"cannot read {tag!r}")
                body, at, _ = _body(parts, at, ("endfor",))
                nodes.append(For(m[1], _Expression(m[2]).whole(), body))
            elif word == "set":
                name, sign, value = rest.partition("=")
                if not sign or not name.strip().isidentifier():
                    raise TemplateError(f"cannot read {tag!r}")
                nodes.append(Assign(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                body, at, _ = _body(parts, at, ("endgeneration",))
                nodes.append(Marked(body))
            else:
                raise TemplateError(f"unknown tag {tag!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return tuple(nodes), at, ""


def _if(parts: list[str], at: int, test: str) -> tuple[If, int]:
    then, at, tag = _body(parts, at, ("elif", "else", "endif"))
    other: tuple = ()
    if tag.startswith("elif"):
        nested, at = _if(parts, at, tag[4:])
        other = (nested,)
    elif tag == "else":
        other, at, _ = _body(parts, at, ("endif",))
    return If(_Expression(test).whole(), then, other), at


# --- folding and closures ----------------------------------------------------------------------

Filters = Mapping[str, Callable[[Any], Any]]


def _text(value: Any) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


def _item(of: Any, key: Any) -> Any:
    if isinstance(of, Mapping):
        return of.get(key)
    raise TemplateError("only keys of mappings can be read")


def _operators(filters: Filters) -> dict[str, Callable]:
    return {
        "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: a + b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
        "<": lambda a, b: a < b, ">": lambda a, b: a > b, "in": lambda a, b: a in b, "not": lambda a: not a,
    } | {"|" + name: f for name, f in filters.items()}


def fold(tree: Any, operators: dict[str, Callable]) -> Any:
    """The same tree with all constant expressions, tests and neighbouring texts worked out."""
    if isinstance(tree, tuple):
        nodes: list[Any] = []
        for node in tree:
            node = fold(node, operators)
            if isinstance(node, If) and isinstance(node.test, Const):
                kept: tuple = node.then if node.test.value else node.other
            elif isinstance(node, Output) and isinstance(node.value, Const):
                kept = (Text(_text(node.value.value)),)
            else:
                kept = (node,)
            for x in kept:
                if isinstance(x, Text) and nodes and isinstance(nodes[-1], Text):
                    nodes[-1] = Text(nodes[-1].value + x.value)
                else:
                    nodes.append(x)
        return tuple(nodes)
    if isinstance(tree, Apply):
        args = tuple(fold(a, operators) for a in tree.args)
        if tree.op in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (tree.op == "and") else args[0]
        elif tree.op not in operators:
            raise TemplateError(f"unknown filter {tree.op[1:]!r}")
        elif all(isinstance(a, Const) for a in args):
            return Const(operators[tree.op](*(a.value for a in args)))
        return Apply(tree.op, args)
    if isinstance(tree, Item):
        return Item(fold(tree.of, operators), fold(tree.key, operators))
    if isinstance(tree, Output):
        return Output(fold(tree.value, operators))
    if isinstance(tree, If):
        return If(fold(tree.test, operators), fold(tree.then, operators), fold(tree.other, operators))
    if isinstance(tree, For):
        return For(tree.name, fold(tree.over, operators), fold(tree.body, operators))
    if isinstance(tree, Assign):
        return Assign(tree.name, fold(tree.value, operators))
    if isinstance(tree, Marked):
        return Marked(fold(tree.body, operators))
    return tree


Scope = dict[str, Any]
Value = Callable[[Scope], Any]
Part = tuple[str, bool]
Render = Callable[[Scope, bool], Iterator[Part]]


def _value(tree: Any, operators: dict[str, Callable]) -> Value:
    if isinstance(tree, Const):
        constant = tree.value
        return lambda scope: constant
    if isinstance(tree, Name):
        name = tree.name
        return lambda scope: scope.get(name)
    if isinstance(tree, Item):
        of, key = _value(tree.of, operators), _value(tree.key, operators)
        return lambda scope: _item(of(scope), key(scope))
    args = [_value(a, operators) for a in tree.args]
    if tree.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if tree.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    f = operators[tree.op]
    if len(args) == 1:
        return lambda scope: f(args[0](scope))
    return lambda scope: f(args[0](scope), args[1](scope))


def _renderer(body: tuple, operators: dict[str, Callable]) -> Render:
    parts = [_node(node, operators) for node in body]

    def render(scope: Scope, marked: bool) -> Iterator[Part]:
        for part in parts:
            yield from part(scope, marked)

    return render


def _node(node: Any, operators: dict[str, Callable]) -> Render:
    if isinstance(node, Text):
        constant = node.value

        def text(scope: Scope, marked: bool) -> Iterator[Part]:
            yield constant, marked
        return text
    if isinstance(node, Output):
        value = _value(node.value, operators)

        def output(scope: Scope, marked: bool) -> Iterator[Part]:
            yield _text(value(scope)), marked
        return output
    if isinstance(node, Marked):
        inner = _renderer(node.body, operators)
        return lambda scope, marked: inner(scope, True)
    if isinstance(node, Assign):
        name, value = node.name, _value(node.value, operators)

        def assign(scope: Scope, marked: bool) -> Iterator[Part]:
            scope[name] = value(scope)
            return iter(())
        return assign
    if isinstance(node, If):
        test, then, other = _value(node.test, operators), _renderer(node.then, operators), _renderer(node.other, operators)
        return lambda scope, marked: (then if test(scope) else other)(scope, marked)
    over, body, name = _value(node.over, operators), _renderer(node.body, operators), node.name

    def loop(scope: Scope, marked: bool) -> Iterator[Part]:
        rows, n = iter(over(scope) or ()), 0
        inner = dict(scope)
        row = next(rows, loop)
        while row is not loop:
            after = next(rows, loop)  # one row ahead, to know the last one
            inner[name] = row
            inner["loop"] = {"index": n + 1, "index0": n, "first": n == 0, "last": after is loop}
            yield from body(inner, marked)
            row, n = after, n + 1
    return loop


def compile_template(source: str, filters: Filters) -> Callable[[Mapping[str, Any]], Iterator[Part]]:
    """A function from the variables of a template to its parts: (text, marked)."""
    operators = _operators(filters)
    render = _renderer(fold(parse(source), operators), operators)
    return lambda variables: render(dict(variables), False)


def rendered(parts: Iterable[Part]) -> tuple[str, list[tuple[int, int]]]:
    """The whole text and the spans of marked text in it; marked parts that touch are one span."""
    out, spans, at = [], [], 0
    for text, marked in parts:
        if marked and text:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            else:
                spans.append((at, at + len(text)))
        out.append(text)
        at += len(text)
    return "".join(out), spans
