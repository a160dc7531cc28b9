"""A sandboxed template language: syntax tree, constant folding, Python closures.

    {% for m in messages %}...{% endfor %}
    {% if m.role == 'user' and not loop.first %}...{% elif ... %}...{% else %}...{% endif %}
    {% generation %}...{% endgeneration %}
    {{ '<|im_start|>' + m.role | line }}

Expressions know strings, whole numbers, names, fields of mappings, filters,
`+ == != and or not` and parentheses. There are no calls, no Python attributes and
no names beyond the given ones and `loop`, so a template can reach nothing else.

A compiled template yields its output piece by piece, with a flag for what stands
between generation marks, and reads messages from an iterator: a conversation of
any length takes the memory of one message.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

Writer = Callable[[dict, bool], Iterator[tuple[str, bool]]]


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Filtered:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    sign: str
    args: tuple


@dataclass
class Text:
    parts: list = field(default_factory=list)  # expressions


@dataclass
class For:
    name: str
    over: object
    body: list


@dataclass
class If:
    cases: list  # (condition, body); a None condition is else


@dataclass
class Generation:
    body: list


_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z][A-Za-z0-9_]*)|(==|!=|[()+.|\[\]]))")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        number, string, name, sign = m.groups()
        if number is not None:
            out.append(("const", int(number)))
        elif string is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPED.get(e[1], e[1]), string[1:-1])))
        elif name is not None:
            out.append(("name", name))
        else:
            out.append(("sign", sign))
        at = m.end()
    return out


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filters and fields."""

    def __init__(self, source: str, filters: dict):
        self.tokens, self.filters = _tokens(source), filters

    def take(self, kind: str, value: object) -> bool:
        if self.tokens and self.tokens[0] == (kind, value):
            self.tokens.pop(0)
            return True
        return False

    def whole(self):
        tree = self.either()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.take("name", "or"):
            tree = Op("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.negated()
        while self.take("name", "and"):
            tree = Op("and", (tree, self.negated()))
        return tree

    def negated(self):
        return Op("not", (self.negated(),)) if self.take("name", "not") else self.compared()

    def compared(self):
        tree = self.added()
        for sign in ("==", "!="):
            if self.take("sign", sign):
                return Op(sign, (tree, self.added()))
        return tree

    def added(self):
        tree = self.filtered()
        while self.take("sign", "+"):
            tree = Op("+", (tree, self.filtered()))
        return tree

    def name(self) -> str:
        if not self.tokens or self.tokens[0][0] != "name":
            raise TemplateError("a name is missing")
        return self.tokens.pop(0)[1]

    def filtered(self):
        tree = self.single()
        while True:
            if self.take("sign", "."):
                tree = Field(tree, self.name())
            elif self.take("sign", "["):
                kind, value = self.tokens.pop(0) if self.tokens else ("", "")
                if kind != "const" or not isinstance(value, str) or not self.take("sign", "]"):
                    raise TemplateError("fields are constant strings")
                tree = Field(tree, value)
            elif self.take("sign", "|"):
                tree = Filtered(tree, self.name())
                if tree.name not in self.filters:
                    raise TemplateError(f"no filter {tree.name!r}")
            else:
                return tree

    def single(self):
        if self.take("sign", "("):
            tree = self.either()
            if not self.take("sign", ")"):
                raise TemplateError("a parenthesis is missing")
            return tree
        if not self.tokens:
            raise TemplateError("an expression is missing")
        kind, value = self.tokens.pop(0)
        if kind == "const":
            return Const(value)
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str, filters: dict) -> list:
    """Template source to a list of nodes."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)

    def body(ends: tuple[str, ...]) -> tuple[list, str]:
        nodes: list = []
        while parts:
            part = parts.pop(0)
            if part.startswith("{{"):
                nodes.append(Text([_Expression(part[2:-2], filters).whole()]))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return nodes, word + " " + rest
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z][A-Za-z0-9_]*)\s+in\s+(.*)", rest.strip(), re.S)
                    if not m:
                        raise TemplateError("for name in expression")
                    inner, _ = body(("endfor",))
                    nodes.append(For(m[1], _Expression(m[2], filters).whole(), inner))
                elif word == "if":
                    cases, condition = [], _Expression(rest, filters).whole()
                    while True:
                        inner, end = body(("elif", "else", "endif"))
                        cases.append((condition, inner))
                        word, _, rest = end.partition(" ")
                        if word == "endif":
                            break
                        condition = _Expression(rest, filters).whole() if word == "elif" else None
                    nodes.append(If(cases))
                elif word == "generation":
                    inner, _ = body(("endgeneration",))
                    nodes.append(Generation(inner))
                else:
                    raise TemplateError(f"unknown statement {word!r}")
            elif part:
                nodes.append(Text([Const(part)]))
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return nodes, ""

    return body(())[0]


def _apply(sign: str, values: list):
    if sign == "+":
        a, b = values
        return a + b if isinstance(a, int) and isinstance(b, int) else f"{a}{b}"
    return {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "not": lambda a: not a}[sign](*values)


def fold_expression(tree, filters: dict):
    """Evaluates what holds constants only."""
    if isinstance(tree, Field):
        return Field(fold_expression(tree.of, filters), tree.name)
    if isinstance(tree, Filtered):
        of = fold_expression(tree.of, filters)
        return Const(filters[tree.name](str(of.value))) if isinstance(of, Const) else Filtered(of, tree.name)
    if isinstance(tree, Op):
        args = tuple(fold_expression(a, filters) for a in tree.args)
        if tree.sign in ("and", "or"):
            first = args[0]
            if isinstance(first, Const):
                return args[1] if bool(first.value) == (tree.sign == "and") else first
            return Op(tree.sign, args)
        if all(isinstance(a, Const) for a in args):
            return Const(_apply(tree.sign, [a.value for a in args]))
        return Op(tree.sign, args)
    return tree


def fold(nodes: list, filters: dict) -> list:
    """Folds expressions, drops branches that are never taken, joins neighbouring texts."""
    out: list = []
    for node in nodes:
        if isinstance(node, Text):
            parts = [fold_expression(p, filters) for p in node.parts]
        elif isinstance(node, If):
            cases, whole = [], None
            for condition, inner in node.cases:
                condition = Const(True) if condition is None else fold_expression(condition, filters)
                if isinstance(condition, Const) and not condition.value:
                    continue
                cases.append((condition, fold(inner, filters)))
                if isinstance(condition, Const):
                    break
            if cases and isinstance(cases[0][0], Const):
                whole = cases[0][1]
            for n in whole if whole is not None else [If(cases)] if cases else []:
                if isinstance(n, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(_joined(out[-1].parts + n.parts))
                else:
                    out.append(n)
            continue
        elif isinstance(node, For):
            out.append(For(node.name, fold_expression(node.over, filters), fold(node.body, filters)))
            continue
        else:
            out.append(Generation(fold(node.body, filters)))
            continue
        if out and isinstance(out[-1], Text):
            out[-1] = Text(_joined(out[-1].parts + parts))
        else:
            out.append(Text(_joined(parts)))
    return out


def _joined(parts: list) -> list:
    out: list = []
    for part in parts:
        if out and isinstance(part, Const) and isinstance(out[-1], Const):
            out[-1] = Const(f"{out[-1].value}{part.value}")
        else:
            out.append(part)
    return out


def _value(tree, filters: dict) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        value = tree.value
        return lambda scope: value
    if isinstance(tree, Name):
        name = tree.name

        def named(scope):
            if name not in scope:
                raise TemplateError(f"no name {name!r}")
            return scope[name]

        return named
    if isinstance(tree, Field):
        of, name = _value(tree.of, filters), tree.name

        def got(scope):
            holder = of(scope)
            if not isinstance(holder, dict):
                raise TemplateError(f"{name!r} of something that has no fields")
            return holder.get(name, "")

        return got
    if isinstance(tree, Filtered):
        of, apply = _value(tree.of, filters), filters[tree.name]
        return lambda scope: apply(str(of(scope)))
    args = [_value(a, filters) for a in tree.args]
    if tree.sign == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if tree.sign == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    sign = tree.sign
    return lambda scope: _apply(sign, [a(scope) for a in args])


def _writer(node, filters: dict) -> Writer:
    if isinstance(node, Text):
        parts = [_value(p, filters) for p in node.parts]

        def text(scope, marked):
            yield "".join(str(p(scope)) for p in parts), marked

        return text
    if isinstance(node, Generation):
        inner = _writers(node.body, filters)
        return lambda scope, marked: inner(scope, True)
    if isinstance(node, If):
        cases = [(_value(c, filters), _writers(b, filters)) for c, b in node.cases]

        def choose(scope, marked):
            for condition, inner in cases:
                if condition(scope):
                    yield from inner(scope, marked)
                    return

        return choose
    name, over, inner = node.name, _value(node.over, filters), _writers(node.body, filters)

    def loop(scope, marked):
        items = over(scope)
        if isinstance(items, (str, int, dict)) or not isinstance(items, Iterable):
            raise TemplateError("for needs a sequence")
        for k, item in enumerate(items):
            yield from inner({**scope, name: item, "loop": {"index0": k, "first": k == 0}}, marked)

    return loop


def _writers(nodes: list, filters: dict) -> Writer:
    all_of = [_writer(n, filters) for n in nodes]

    def run(scope, marked):
        for write in all_of:
            yield from write(scope, marked)

    return run


def compiled(source: str, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], Iterator[tuple[str, bool]]]:
    """A function that renders the names it is given, piece by piece."""
    run = _writers(fold(parse(source, filters), filters), filters)
    return lambda names: run(names, False)
