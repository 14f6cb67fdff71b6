"""A compiler of chat templates: source to syntax tree, constants folded, Python closures that render turns.

The language has text, {{ expression }}, {% if %}/{% elif %}/{% else %}/{% endif %}, {% generation %}/{% endgeneration %},
one {% for NAME in messages %}/{% endfor %}, and {# remarks #}; "-" beside a tag's percent sign strips white space there.
Expressions: strings, whole numbers, true, false, none, names, a.b, a['b'], a ~ b, comparisons, in, not, and, or,
a if b else c, and the filters of FILTERS. It is closed: names are the loop's variable, loop and the given constants; fields are
looked up in dictionaries only; there are no calls, no assignments and no loops but the one, so a turn's output is at most
the template's length and its fields, once for each mention."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace


class TemplateError(ValueError):
    """The template breaks the language's rules."""


def escape(text: str) -> str:
    """text without control strings: one more backslash between each '<' and '|' that have nothing but backslashes between."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """escape(), for a text that must also stay on its line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.DOTALL)


FILTERS: dict[str, Callable] = {"escape": escape, "line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len, "string": str}
_BINARY = {"~": lambda a, b: f"{a}{b}", "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Get:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """op: a filter, a binary operator, not, and, or, or if (condition, then, else)."""

    op: str
    args: tuple


@dataclass(frozen=True)
class Out:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # of (condition, nodes); the last may have Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


_TAG = re.compile(r"\{#.*?#\}|\{\{-?(.*?)-?\}\}|\{%-?\s*(.*?)\s*-?%\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[~<>().|\[\]]))", re.DOTALL)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at, end = [], 0, len(source.rstrip())
        while at < end:
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:at + 10]!r} in {source!r}")
            number, string, name, mark = m.groups()
            value = int(number) if number else re.sub(r"\\(.)", lambda x: _ESCAPED.get(x[1], x[1]), string[1:-1], flags=re.DOTALL) if string else name or mark
            self.tokens.append(("const" if number or string else "name" if name else "mark", value))
            at = m.end()
        self.source = source

    def take(self, *wanted: str) -> str | None:
        """The next token, taken, if it is one of these names or marks."""
        if self.tokens and self.tokens[0][0] != "const" and self.tokens[0][1] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing in {self.source!r}")

    def whole(self):
        got = self.choice()
        if self.tokens:
            raise TemplateError(f"unexpected {self.tokens[0][1]!r} in {self.source!r}")
        return got

    def choice(self):
        value = self.any()
        if self.take("if"):
            condition = self.any()
            self.need("else")
            return Apply("if", (condition, value, self.choice()))
        return value

    def any(self):
        got = self.all()
        while self.take("or"):
            got = Apply("or", (got, self.all()))
        return got

    def all(self):
        got = self.denied()
        while self.take("and"):
            got = Apply("and", (got, self.denied()))
        return got

    def denied(self):
        return Apply("not", (self.denied(),)) if self.take("not") else self.compared()

    def compared(self):
        got = self.joined()
        while op := self.take("==", "!=", "<=", ">=", "<", ">", "in", "not"):
            if op == "not":
                self.need("in")
                op = "not in"
            got = Apply(op, (got, self.joined()))
        return got

    def joined(self):
        got = self.filtered()
        while self.take("~"):
            got = Apply("~", (got, self.filtered()))
        return got

    def filtered(self):
        got = self.field()
        while self.take("|"):
            kind, name = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}; there are {', '.join(FILTERS)}")
            got = Apply(name, (got,))
        return got

    def field(self):
        got = self.atom()
        while mark := self.take(".", "["):
            if mark == "[":
                got = Get(got, self.choice())
                self.need("]")
            elif self.tokens and self.tokens[0][0] == "name":
                got = Get(got, Const(self.tokens.pop(0)[1]))
            else:
                raise TemplateError(f"a name is missing after '.' in {self.source!r}")
        return got

    def atom(self):
        if self.take("("):
            got = self.choice()
            self.need(")")
            return got
        if not self.tokens or self.tokens[0][0] == "mark":
            raise TemplateError(f"a value is missing in {self.source!r}")
        kind, value = self.tokens.pop(0)
        if kind == "const":
            return Const(value)
        plain = {"true": True, "false": False, "none": None}
        return Const(plain[value]) if value in plain else Name(value)


def parse(source: str) -> tuple:
    """The template's nodes."""
    pieces: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        pieces.append(("text", text.rstrip() if m[0][2] == "-" else text))
        strip, at = m[0][-3] == "-" and m[0][1] != "#", m.end()
        if m[1] is not None:
            pieces.append(("out", m[1]))
        elif m[2] is not None:
            pieces.append(("tag", m[2]))
    pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
    for kind, text in pieces:
        if kind == "text" and re.search(r"\{[{%#]", text):
            raise TemplateError(f"a tag is not closed: {text!r}")

    def block(*ends: str) -> tuple[tuple, str]:
        """Nodes up to a tag that begins with one of ends, and that tag."""
        nodes: list = []
        while pieces:
            kind, text = pieces.pop(0)
            word = text.split(None, 1)[0] if text.split() else ""
            if kind == "text":
                nodes.append(Out(Const(text)))
            elif kind == "out":
                nodes.append(Out(_Expression(text).whole()))
            elif word in ends:
                return tuple(nodes), text
            elif word == "if":
                branches, tag = [], text
                while tag.split()[0] in ("if", "elif"):
                    condition = _Expression(tag.split(None, 1)[1] if " " in tag else "").whole()
                    body, tag = block("elif", "else", "endif")
                    branches.append((condition, body))
                if tag == "else":
                    branches.append((Const(True), block("endif")[0]))
                nodes.append(If(tuple(branches)))
            elif text == "generation":
                nodes.append(Generation(block("endgeneration")[0]))
            elif m := re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+messages", text):
                nodes.append(For(m[1], block("endfor")[0]))
            else:
                raise TemplateError(f"unknown tag {text!r}")
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return tuple(nodes), ""

    return block()[0]


def fold(node, constants: dict[str, object]):
    """The node with all that does not depend on a conversation computed; a tuple of nodes has neighbouring texts joined."""
    if isinstance(node, tuple):
        out: list = []
        for x in (fold(x, constants) for x in node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Out) and isinstance(y.value, Const):
                    y = Out(Const("" if y.value.value is None else str(y.value.value)))
                    if out and isinstance(out[-1], Out) and isinstance(out[-1].value, Const):
                        y = Out(Const(out.pop().value.value + y.value.value))
                    if not y.value.value:
                        continue
                out.append(y)
        return tuple(out)
    if isinstance(node, Name):
        return Const(constants[node.name]) if node.name in constants else node
    if isinstance(node, Get):
        got = Get(fold(node.of, constants), fold(node.key, constants))
        return Const(_evaluate(got)) if isinstance(got.of, Const) and isinstance(got.key, Const) else got
    if isinstance(node, Apply):
        args = tuple(fold(x, constants) for x in node.args)
        if node.op in ("and", "or", "if") and isinstance(args[0], Const):
            return (args[1] if args[0].value else args[2]) if node.op == "if" else args[1] if bool(args[0].value) == (node.op == "and") else args[0]
        return Const(_evaluate(Apply(node.op, args))) if all(isinstance(x, Const) for x in args) else Apply(node.op, args)
    if isinstance(node, Out):
        return Out(fold(node.value, constants))
    if isinstance(node, If):
        branches = []
        for condition, body in ((fold(c, constants), fold(b, constants)) for c, b in node.branches):
            if isinstance(condition, Const) and not condition.value:
                continue
            branches.append((condition, body))
            if isinstance(condition, Const):
                break
        return branches[0][1] if branches and isinstance(branches[0][0], Const) else If(tuple(branches)) if branches else ()
    if isinstance(node, (Generation, For)):
        return replace(node, body=fold(node.body, constants))
    return node


def _evaluate(node):
    try:
        return expression(node)({})
    except (TypeError, AttributeError, KeyError) as error:
        raise TemplateError(f"a constant expression fails: {error}") from None


def expression(node) -> Callable[[dict], object]:
    """A closure that gives the expression's value for names' values."""
    if isinstance(node, Const):
        value = node.value
        return lambda names: value
    if isinstance(node, Name):
        name = node.name
        return lambda names: names[name]
    if isinstance(node, Get):
        of, key = expression(node.of), expression(node.key)

        def get(names: dict):
            held = of(names)
            if not isinstance(held, dict):
                raise TypeError("only records have fields")
            return held.get(key(names))

        return get
    args = [expression(x) for x in node.args]
    if node.op == "if":
        test, then, other = args
        return lambda names: then(names) if test(names) else other(names)
    if node.op == "not":
        return lambda names: not args[0](names)
    if node.op == "and":
        return lambda names: args[0](names) and args[1](names)
    if node.op == "or":
        return lambda names: args[0](names) or args[1](names)
    if node.op in _BINARY:
        op, (a, b) = _BINARY[node.op], args
        return lambda names: op(a(names), b(names))
    use, (of,) = FILTERS[node.op], args
    return lambda names: use(of(names))


@dataclass
class Rendered:
    """Text in parts, with the spans (start, end in code points) of what is to be generated."""

    parts: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def statements(nodes: tuple) -> Callable[[dict, Rendered], None]:
    """A closure that renders the nodes for names' values."""
    steps: list[Callable[[dict, Rendered], None]] = []
    for node in nodes:
        if isinstance(node, Out):
            value = expression(node.value)

            def step(names, out, value=value):
                got = value(names)
                out.add("" if got is None else got if isinstance(got, str) else str(got))
        elif isinstance(node, If):
            branches = [(expression(c), statements(b)) for c, b in node.branches]

            def step(names, out, branches=branches):
                for condition, body in branches:
                    if condition(names):
                        body(names, out)
                        break
        elif isinstance(node, Generation):
            body = statements(node.body)

            def step(names, out, body=body):
                start = out.length
                body(names, out)
                out.spans.append((start, out.length))
        else:
            raise TemplateError("the loop over messages stands alone, outside of other blocks, once")
        steps.append(step)

    def run(names: dict, out: Rendered) -> None:
        for s in steps:
            s(names, out)

    return run


def _names(node) -> set[str]:
    if isinstance(node, Name):
        return {node.name}
    inner = node if isinstance(node, tuple) else [getattr(node, f) for f in getattr(node, "__dataclass_fields__", ())]
    return set().union(*(_names(x) for x in inner if isinstance(x, tuple) or hasattr(x, "__dataclass_fields__")), set())


@dataclass(frozen=True)
class Template:
    """What stands before the turns, at each turn, and after them; name: of the loop's variable."""

    before: Callable[[dict, Rendered], None]
    turn: Callable[[dict, Rendered], None]
    after: Callable[[dict, Rendered], None]
    name: str

    def render(self, message: dict, index: int, last: bool, out: Rendered) -> None:
        """Add one turn, with what stands before the first and after the last."""
        if index == 0:
            self.before({}, out)
        self.turn({self.name: message, "loop": {"index0": index, "index": index + 1, "first": index == 0, "last": last}}, out)
        if last:
            self.after({}, out)


def compile_template(source: str, constants: dict[str, object] | None = None) -> Template:
    """The template as closures; TemplateError where it breaks the language's rules."""
    nodes = fold(parse(source), constants or {})
    loops = [i for i, n in enumerate(nodes) if isinstance(n, For)]
    if len(loops) != 1:
        raise TemplateError("a template has one loop over messages")
    loop = nodes[loops[0]]
    for part, known in ((nodes[: loops[0]], set()), (loop.body, {loop.name, "loop"}), (nodes[loops[0] + 1 :], set())):
        if unknown := _names(part) - known:
            raise TemplateError(f"unknown names: {', '.join(sorted(unknown))}")
    return Template(statements(nodes[: loops[0]]), statements(loop.body), statements(nodes[loops[0] + 1 :]), loop.name)
