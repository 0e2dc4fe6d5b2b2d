"""A small sandboxed template language for conversations, compiled to Python closures.

    template   = (text | "{{" expr "}}" | block)*
    block      = "{% for NAME in NAME %}" ... "{% endfor %}"
               | "{% if expr %}" ... ("{% elif expr %}" ...)* ("{% else %}" ...)? "{% endif %}"
               | "{% generation %}" ... "{% endgeneration %}"
    expr       = and/or/not, == and !=, "+" joins texts, "|" applies a filter; names, .fields, "texts", integers

Nothing else can be reached: values are texts, integers, truth values and
messages; a field is looked up in a message or in `loop` only, a filter in the
given table only. Constants are folded before closures are made. Rendering is
lazy: a template yields pieces while it draws messages from an iterator, so a
conversation of any length passes through.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

# A piece of output: its text, and whether the model is to learn it.
Piece = tuple[str, bool]
Render = Callable[[dict, bool], Iterator[Piece]]

_TOKEN = re.compile(r"""\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>\d+)|(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<op>==|!=|[|.+()]))""")
_ESCAPES = {"n": "\n", "t": "\t"}
LOOP_FIELDS = ("first", "last", "index", "index0")


class TemplateError(ValueError):
    """The template is not in the language, or reaches for something it may not."""


def _tokens(code: str) -> list[tuple[str, str]]:
    out, at, code = [], 0, code.rstrip()
    while at < len(code):
        found = _TOKEN.match(code, at)
        if not found:
            raise TemplateError(f"unexpected {code[at:at + 20]!r}")
        out.append((found.lastgroup, found.group(found.lastgroup)))
        at = found.end()
    return out


class _Expr:
    """Recursive descent over the tokens of one expression; gives nested tuples."""

    def __init__(self, code: str):
        self.tokens, self.at = _tokens(code), 0
        self.tree = self.any_of()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def any_of(self):
        left = self.all_of()
        while self.take("or"):
            left = ("or", left, self.all_of())
        return left

    def all_of(self):
        left = self.negated()
        while self.take("and"):
            left = ("and", left, self.negated())
        return left

    def negated(self):
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        op = self.take("==", "!=")
        return (op, left, self.joined()) if op else left

    def joined(self):
        left = self.filtered()
        while self.take("+"):
            left = ("+", left, self.filtered())
        return left

    def filtered(self):
        left = self.single()
        while self.take("|"):
            left = ("filter", self.name(), left)
        return left

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def single(self):
        if self.take("("):
            inner = self.any_of()
            if not self.take(")"):
                raise TemplateError("')' is missing")
            return inner
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        if kind == "text":
            self.at += 1
            return ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            self.at += 1
            return ("const", int(value))
        name = self.name()
        if name in ("true", "false"):
            return ("const", name == "true")
        return ("field", name, self.name()) if self.take(".") else ("name", name)


def parse(template: str) -> list:
    """The syntax tree: a list of nodes; blocks hold lists of nodes."""
    body, stack = [], []
    for k, part in enumerate(re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.DOTALL)):
        if k % 2 == 0:
            if part:
                body.append(("text", part))
            continue
        code = part[2:-2].strip()
        if part.startswith("{{"):
            body.append(("print", _Expr(code).tree))
            continue
        word, _, rest = code.partition(" ")
        loop = re.fullmatch(r"(\w+)\s+in\s+(\w+)", rest.strip()) if word == "for" else None
        if loop:
            stack.append(("for", body, (loop[1], loop[2])))
        elif word == "if":
            stack.append(("if", body, [(_Expr(rest).tree, [])]))
            body = stack[-1][2][0][1]
            continue
        elif word == "generation" and not rest:
            stack.append(("generation", body, None))
        elif word in ("elif", "else") and stack and stack[-1][0] == "if" and stack[-1][2][-1][0] != ("const", True):
            body = []
            stack[-1][2].append((_Expr(rest).tree if word == "elif" else ("const", True), body))
            continue
        elif word in ("endfor", "endif", "endgeneration") and stack and stack[-1][0] == word[3:]:
            kind, outer, more = stack.pop()
            outer.append(("if", more) if kind == "if" else (kind, more, body))
            body = outer
            continue
        else:
            raise TemplateError(f"unexpected {code!r}")
        body = []
    if stack:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return body


def _plain(value: object) -> str:
    """A value as output; nothing but texts and numbers prints."""
    if value is None:
        return ""
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError("only texts and numbers can be printed")


def _fold(tree: tuple, filters: dict) -> tuple:
    """The expression with every constant part worked out."""
    kind = tree[0]
    if kind in ("const", "name", "field"):
        return tree
    if kind == "filter":
        if tree[1] not in filters:
            raise TemplateError(f"no filter {tree[1]!r}")
        tree = ("filter", tree[1], _fold(tree[2], filters))
        constant = tree[2][0] == "const"
    else:
        tree = (kind, *(_fold(t, filters) for t in tree[1:]))
        constant = all(t[0] == "const" for t in tree[1:])
        if kind in ("and", "or") and tree[1][0] == "const":
            return tree[2] if bool(tree[1][1]) == (kind == "and") else tree[1]
    return ("const", _value(tree, filters)({})) if constant else tree


def fold(body: list, filters: dict) -> list:
    """The tree with constants worked out, dead branches gone and neighbouring texts joined."""
    out: list = []
    for node in body:
        if node[0] == "print":
            tree = _fold(node[1], filters)
            node = ("text", _plain(tree[1])) if tree[0] == "const" else ("print", tree)
        elif node[0] in ("for", "generation"):
            node = (node[0], node[1], fold(node[2], filters))
        elif node[0] == "if":
            branches = []
            for test, inner in node[1]:
                test = _fold(test, filters)
                if test[0] == "const" and not test[1]:
                    continue
                branches.append((test, fold(inner, filters)))
                if test[0] == "const":
                    break
            if not branches:
                continue
            if branches[0][0][0] == "const":
                for inner in branches[0][1]:
                    _append(out, inner)
                continue
            node = ("if", branches)
        _append(out, node)
    return out


def _append(out: list, node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _value(tree: tuple, filters: dict) -> Callable[[dict], object]:
    """A closure that gives the expression's value in a scope."""
    kind = tree[0]
    if kind == "const":
        constant = tree[1]
        return lambda scope: constant
    if kind == "name":
        name = tree[1]
        return lambda scope: scope.get(name)
    if kind == "field":
        _, name, field = tree

        def look_up(scope: dict) -> object:
            held = scope.get(name)
            if not isinstance(held, dict):
                raise TemplateError(f"{name} has no fields")
            return held.get(field)

        return look_up
    if kind == "filter":
        apply, inner = filters[tree[1]], _value(tree[2], filters)
        return lambda scope: apply(_plain(inner(scope)))
    if kind == "not":
        inner = _value(tree[1], filters)
        return lambda scope: not inner(scope)
    left, right = _value(tree[1], filters), _value(tree[2], filters)
    return {
        "and": lambda scope: left(scope) and right(scope),
        "or": lambda scope: left(scope) or right(scope),
        "==": lambda scope: left(scope) == right(scope),
        "!=": lambda scope: left(scope) != right(scope),
        "+": lambda scope: _plain(left(scope)) + _plain(right(scope)),
    }[kind]


def _closure(body: list, filters: dict) -> Render:
    """A generator of pieces for a list of nodes."""
    steps = [_node(node, filters) for node in body]
    if len(steps) == 1:
        return steps[0]

    def render(scope: dict, learn: bool) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope, learn)

    return render


def _node(node: tuple, filters: dict) -> Render:
    kind = node[0]
    if kind == "text":
        text = node[1]

        def render(scope: dict, learn: bool) -> Iterator[Piece]:
            yield text, learn
    elif kind == "print":
        value = _value(node[1], filters)

        def render(scope: dict, learn: bool) -> Iterator[Piece]:
            yield _plain(value(scope)), learn
    elif kind == "generation":
        inner = _closure(node[2], filters)

        def render(scope: dict, learn: bool) -> Iterator[Piece]:
            return inner(scope, True)
    elif kind == "if":
        branches = [(_value(test, filters), _closure(inner, filters)) for test, inner in node[1]]

        def render(scope: dict, learn: bool) -> Iterator[Piece]:
            for test, inner in branches:
                if test(scope):
                    yield from inner(scope, learn)
                    return
    else:
        (name, over), inner = node[1], _closure(node[2], filters)

        def render(scope: dict, learn: bool) -> Iterator[Piece]:
            items = iter(scope.get(over) or ())
            item, count = next(items, None), 0
            while item is not None:
                following = next(items, None)
                loop = {"first": count == 0, "last": following is None, "index": count + 1, "index0": count}
                yield from inner(scope | {name: item, "loop": loop}, learn)
                item, count = following, count + 1
    return render


def compile_template(template: str, filters: dict[str, Callable[[str], str]]) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages to pieces of output."""
    render = _closure(fold(parse(template), filters), filters)
    return lambda messages: (piece for piece in render({"messages": messages}, False) if piece[0])
