"""A small template language for conversations, compiled to Python closures.

``{{ expression }}``, ``{% for x in messages %}``, ``{% if %}/{% elif %}/{% else %}``, ``{% set x = ... %}``,
``{% generation %}`` around text that a model is to learn, and ``{# comments #}``. Expressions have strings,
integers, true, false, none, names, fields (x.role or x['role']), ``+ ~ == != < <= > >= in and or not``,
``a if c else b`` and filters (``x | trim``). Nothing can be called and only mappings have fields, so a template
reaches nothing but its input. Compiled templates yield (text, is_generation) pieces one by one, and read the
messages one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import partial

TAG = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<int>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.()\[\]]))""", re.S)
WORDS = {"true": True, "false": False, "none": None}
RESERVED = {"and", "or", "not", "in", "if", "else", *WORDS}
BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b,
    "~": lambda a, b: shown(a) + shown(b),
}
FILTERS: dict[str, Callable] = {"trim": lambda x: shown(x).strip(), "upper": lambda x: shown(x).upper(), "lower": lambda x: shown(x).lower(), "title": lambda x: shown(x).title(), "length": len}
LITERAL_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class TemplateError(ValueError):
    """The template isn't in the language, or asks for what isn't there."""


def shown(x) -> str:
    return "" if x is None else x if isinstance(x, str) else str(x)


class Expression:
    """Recursive descent over one expression; nodes are tuples whose first entry names them."""

    def __init__(self, source: str, names: set[str], filters: Mapping[str, Callable]):
        self.tokens, self.names, self.filters, at = [], names, filters, 0
        while source[at:].strip():
            m = TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "str" else text

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def parse(self) -> tuple:
        node = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.either()
        if self.take("if"):
            when = self.either()
            self.need("else")
            return ("choice", when, node, self.choice())
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
        node = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            node = ("binary", op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while op := self.take("+", "~"):
            node = ("binary", op, node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.field()
        while self.take("|"):
            name = self.tokens[self.at][1] if self.at < len(self.tokens) else ""
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", self.filters[name], node)
        return node

    def field(self) -> tuple:
        node = self.atom()
        while op := self.take(".", "["):
            if self.at >= len(self.tokens):
                raise TemplateError("a field's name is missing")
            kind, text = self.tokens[self.at]
            if kind != ("name" if op == "." else "str"):
                raise TemplateError(f"{text!r} can't name a field")
            self.at += 1
            if op == "[":
                self.need("]")
            node = ("field", node, text if op == "." else literal(text))
        return node

    def atom(self) -> tuple:
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return ("constant", int(text))
        if kind == "str":
            return ("constant", literal(text))
        if kind == "name" and text in WORDS:
            return ("constant", WORDS[text])
        if kind == "name" and text not in RESERVED and text in self.names:
            return ("name", text)
        raise TemplateError(f"no name {text!r}")


def literal(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: LITERAL_ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)


def fold(node: tuple) -> tuple:
    """The expression with everything worked out that doesn't depend on the input."""
    if node[0] in ("constant", "name"):
        return node
    node = tuple(fold(x) if isinstance(x, tuple) else x for x in node)
    parts = [x for x in node if isinstance(x, tuple)]
    if node[0] != "field" and all(x[0] == "constant" for x in parts):
        return ("constant", evaluator(node)({}))
    if node[0] == "choice" and node[1][0] == "constant":
        return node[2] if node[1][1] else node[3]
    if node[0] in ("and", "or") and node[1][0] == "constant":
        return node[2] if bool(node[1][1]) == (node[0] == "and") else node[1]
    return node


def read_field(value, key: str):
    if not isinstance(value, Mapping) or key not in value:
        raise TemplateError(f"no field {key!r}")
    return value[key]


def evaluator(node: tuple) -> Callable[[dict], object]:
    """A closure that works the expression out for given variables."""
    kind, *parts = node
    if kind == "constant":
        return lambda env, v=parts[0]: v
    if kind == "name":
        return lambda env, n=parts[0]: env[n]
    if kind == "field":
        return lambda env, of=evaluator(parts[0]), key=parts[1]: read_field(of(env), key)
    if kind == "binary":
        return lambda env, f=BINARY[parts[0]], a=evaluator(parts[1]), b=evaluator(parts[2]): f(a(env), b(env))
    if kind == "filter":
        return lambda env, f=parts[0], a=evaluator(parts[1]): f(a(env))
    if kind == "not":
        return lambda env, a=evaluator(parts[0]): not a(env)
    a, b = evaluator(parts[0]), evaluator(parts[1])
    if kind == "choice":
        return lambda env, c=evaluator(parts[2]): b(env) if a(env) else c(env)
    return (lambda env: a(env) and b(env)) if kind == "and" else (lambda env: a(env) or b(env))


class Parser:
    """Statements of a template; a list of tuples like the expressions'."""

    def __init__(self, source: str, names: Iterable[str], filters: Mapping[str, Callable]):
        self.filters, self.names = filters, set(names)
        self.parts: list[tuple[str, str]] = []
        at = 0
        for m in TAG.finditer(source):
            self.parts += [("text", source[at : m.start()])] + [(k, t.strip()) for k, t in (("out", m[1]), ("tag", m[2])) if t is not None]
            at = m.end()
        self.parts.append(("text", source[at:]))
        self.at = 0

    def expression(self, source: str) -> tuple:
        return fold(Expression(source, self.names, self.filters).parse())

    def block(self, *ends: str) -> tuple[list, str]:
        """Statements up to a tag that begins with one of ``ends``, and that tag."""
        out: list[tuple] = []
        while self.at < len(self.parts):
            kind, text = self.parts[self.at]
            self.at += 1
            word, _, rest = text.partition(" ") if kind == "tag" else ("", "", "")
            if kind == "tag" and word in ends:
                return merge(out), text
            if kind == "text":
                out.append(("text", text))
            elif kind == "out":
                node = self.expression(text)
                out.append(("text", shown(node[1])) if node[0] == "constant" else ("out", node))
            elif word == "for":
                m = re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip(), re.S)
                if not m or m[1] in RESERVED or m[1] == "loop":
                    raise TemplateError(f"can't read {text!r}")
                source, before = self.expression(m[2]), set(self.names)
                self.names |= {m[1], "loop"}
                body, _ = self.block("endfor")
                self.names = before
                out.append(("for", m[1], source, body))
            elif word == "if":
                cases, tag = [], text
                while not tag.startswith("endif"):
                    head, _, when = tag.partition(" ")
                    node = ("constant", True) if head == "else" else self.expression(when)
                    body, tag = self.block("endif") if head == "else" else self.block("elif", "else", "endif")
                    cases.append((node, body))
                out += decided(cases)
            elif word == "generation":
                out.append(("generation", self.block("endgeneration")[0]))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not name.strip().isidentifier() or name.strip() in RESERVED | {"loop"}:
                    raise TemplateError(f"can't read {text!r}")
                out.append(("set", name.strip(), self.expression(value)))
                self.names.add(name.strip())
            else:
                raise TemplateError(f"no statement {text!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return merge(out), ""


def merge(statements: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for s in statements:
        if s[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s[1])
        elif s != ("text", ""):
            out.append(s)
    return out


def decided(cases: list[tuple]) -> list[tuple]:
    """Cases without those that can't be; the statements themselves if the first that can be must be."""
    left = []
    for node, body in cases:
        if node[0] != "constant":
            left.append((node, body))
        elif node[1]:
            left.append((node, body))
            break
    return left[0][1] if left and left[0][0][0] == "constant" else [("if", left)] if left else []


Run = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def runner(statements: list[tuple]) -> Run:
    """A closure that yields the pieces of a block."""
    steps = [step(s) for s in statements]

    def run(env: dict, learn: bool) -> Iterator[tuple[str, bool]]:
        for s in steps:
            yield from s(env, learn)

    return steps[0] if len(steps) == 1 else run


def step(statement: tuple) -> Run:
    kind, *parts = statement
    if kind == "text":
        return lambda env, learn, t=parts[0]: iter(((t, learn),))
    if kind == "out":
        return lambda env, learn, f=evaluator(parts[0]): iter(((shown(f(env)), learn),))
    if kind == "generation":
        return lambda env, learn, body=runner(parts[0]): body(env, True)
    if kind == "set":
        name, value = parts[0], evaluator(parts[1])

        def assign(env: dict, learn: bool) -> Iterator:
            env[name] = value(env)
            return iter(())

        return assign
    if kind == "if":
        cases = [(evaluator(node), runner(body)) for node, body in parts[0]]

        def branch(env: dict, learn: bool) -> Iterator:
            return next((body(env, learn) for when, body in cases if when(env)), iter(()))

        return branch
    name, source, body = parts[0], evaluator(parts[1]), runner(parts[2])

    def repeat(env: dict, learn: bool) -> Iterator:
        values, index, missing = iter(source(env)), 0, object()
        ahead = next(values, missing)
        while ahead is not missing:
            value, ahead = ahead, next(values, missing)
            inner = env | {name: value, "loop": {"index": index + 1, "index0": index, "first": index == 0, "last": ahead is missing}}
            yield from body(inner, learn)
            index += 1

    return repeat


def escape(controls: tuple[str, ...], text) -> str:
    """The text with a backslash before each control string and each backslash."""
    return re.sub("|".join(map(re.escape, ("\\", *controls))), lambda m: "\\" + m[0], shown(text))


def unescape(controls: tuple[str, ...], text: str) -> str:
    return re.sub(r"\\(" + "|".join(map(re.escape, ("\\", *controls))) + ")", lambda m: m[1], text, flags=re.S)


def compile_template(source: str, controls: tuple[str, ...], names: Iterable[str] = ("messages",)) -> Callable[..., Iterator[tuple[str, bool]]]:
    """A function of the named inputs that yields (text, is_generation) pieces; ``escape`` is a filter for ``controls``."""
    statements, _ = Parser(source, names, FILTERS | {"escape": partial(escape, controls)}).block()
    run = runner(statements) if statements else (lambda env, learn: iter(()))
    return lambda **env: run(dict(env), False)
