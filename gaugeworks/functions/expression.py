"""The metric expression language, compiled to Spark columns.

    or < and < not < comparison (one) < + - < * / % < unary - < primary
    primary: number, duration, metric, IF(c, a, b), function(...), (expression)

Every node becomes two columns: its value and its error. An error is a message, null where there is none; the value is
null where there is an error. Errors aren't nulls: a rule skips a sample with an error, but holds on a null.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeworks.functions.durations import parse_duration

NUMBER, BOOLEAN = "number", "boolean"
DEPTH = 100
COMPARISONS = ("<", ">", "<=", ">=", "==", "!=")
HISTORY = ("avg", "delta", "rate")


class ExpressionError(ValueError):
    """An expression that can't be parsed or doesn't fit its types."""


@dataclass(frozen=True)
class Node:
    """kind: number, duration, metric, unary, binary, if, call."""

    kind: str
    text: str = ""
    value: float = 0.0
    args: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Compiled:
    value: Column
    error: Column
    kind: str


_TOKEN = re.compile(
    r"\s+|(?P<number>(?:\d[\d.]*|\.[\d.]*)(?:[eE][+-]?\d+)?)(?P<suffix>[A-Za-z]*)|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<string>'[^']*')|(?P<op><=|>=|==|!=|[-+*/%<>!])|(?P<mark>[(),])"
)


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character {source[at]!r} at {at}")
        at = m.end()
        if m["number"] is not None:
            text = m["number"]
            if m["suffix"]:
                out.append(("name", text + m["suffix"]))
                continue
            try:
                value = float(text)
            except ValueError:
                raise ExpressionError(f"invalid number {text!r}") from None
            if value in (float("inf"), float("-inf")):
                raise ExpressionError(f"number out of range {text!r}")
            out.append(("number", text))
        elif m.lastgroup:
            out.append((m.lastgroup, m[0]))
    return [*out, ("end", "")]


class _Reader:
    def __init__(self, source: str):
        self.tokens, self.at, self.depth = _tokens(source), 0, 0

    @property
    def now(self) -> tuple[str, str]:
        return self.tokens[self.at]

    def take(self, *wanted: tuple[str, str]) -> str | None:
        kind, text = self.now
        if (kind, text.lower() if kind == "name" else text) in wanted:
            self.at += 1
            return text
        return None

    def need(self, mark: str) -> None:
        if not self.take(("mark", mark)):
            raise ExpressionError(f"expected {mark!r} before {self.now[1]!r}")

    def deeper(self, f: Callable[[], Node]) -> Node:
        self.depth += 1
        if self.depth > DEPTH:
            raise ExpressionError("expression nesting too deep")
        out = f()
        self.depth -= 1
        return out

    def chain(self, words: tuple[tuple[str, str], ...], below: Callable[[], Node]) -> Node:
        left = below()
        while op := self.take(*words):
            left = Node("binary", op.lower(), args=(left, below()))
        return left

    def either(self) -> Node:
        return self.chain((("name", "or"),), self.both)

    def both(self) -> Node:
        return self.chain((("name", "and"),), self.negated)

    def negated(self) -> Node:
        if self.take(("name", "not")):
            return Node("unary", "not", args=(self.deeper(self.negated),))
        return self.comparison()

    def comparison(self) -> Node:
        left = self.sums()
        if op := self.take(*(("op", x) for x in COMPARISONS)):
            return Node("binary", op, args=(left, self.sums()))
        return left

    def sums(self) -> Node:
        return self.chain((("op", "+"), ("op", "-")), self.products)

    def products(self) -> Node:
        return self.chain((("op", "*"), ("op", "/"), ("op", "%")), self.signed)

    def signed(self) -> Node:
        if self.take(("op", "-")):
            return Node("unary", "-", args=(self.deeper(self.signed),))
        return self.deeper(self.primary)

    def listed(self) -> tuple[Node, ...]:
        args = []
        if not self.take(("mark", ")")):
            args.append(self.either())
            while self.take(("mark", ",")):
                args.append(self.either())
            self.need(")")
        return tuple(args)

    def primary(self) -> Node:
        kind, text = self.now
        if kind == "number":
            self.at += 1
            return Node("number", text, float(text))
        if kind == "name":
            self.at += 1
            if re.fullmatch(r"\d+(ms|s|m|h|d)", text):
                try:
                    return Node("duration", text, float(parse_duration(text)))
                except ValueError as e:
                    raise ExpressionError(str(e)) from None
            if text[0].isdigit() or text[0] == ".":
                raise ExpressionError(f"invalid number {text!r}")
            if self.take(("mark", "(")):
                args = self.listed()
                if text.lower() == "if":
                    if len(args) != 3:
                        raise ExpressionError("IF takes three arguments")
                    return Node("if", args=args)
                return Node("call", text.lower(), args=args)
            if text.lower() == "if":
                raise ExpressionError("expected '(' after IF")
            return Node("metric", text)
        if self.take(("mark", "(")):
            out = self.either()
            self.need(")")
            return out
        raise ExpressionError(f"unexpected token {text!r}")


def parse(source: str) -> Node:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 40 * DEPTH))  # each level takes about ten calls
    reader = _Reader(source)
    out = reader.either()
    if reader.now[0] != "end":
        raise ExpressionError(f"unexpected token {reader.now[1]!r}")
    return out


def metric_refs(node: Node) -> list[str]:
    """Metric names in order of first appearance."""
    out = [node.text] if node.kind == "metric" else []
    for a in node.args:
        out += [x for x in metric_refs(a) if x not in out]
    return out


def longest_duration(node: Node) -> int:
    """The longest duration that an expression looks back, in microseconds."""
    return max([int(node.value) if node.kind == "duration" else 0, *(longest_duration(a) for a in node.args)])


Builder = Callable[..., Compiled]
_functions: dict[str, tuple[int, int | None, Builder]] = {}


def register_function(name: str, least: int, most: int | None, builder: Builder) -> None:
    """Add a function; builder gets its compiled arguments."""
    _functions[name.lower()] = (least, most, builder)


def none() -> Column:
    """The error column of a node that can't fail."""
    return F.lit(None).cast("string")


def _first_error(*errors: Column) -> Column:
    return F.coalesce(*errors)


def _guarded(value: Column, *errors: Column) -> Compiled:
    error = _first_error(*errors)
    return Compiled(F.when(error.isNull(), value), error, NUMBER)


@dataclass
class Compiler:
    """metric: a name's column. history(function, metric, microseconds): the column of AVG, DELTA or RATE.

    lenient: where types don't fit, the expression compiles to an error column and doesn't raise."""

    metric: Callable[[str], Column]
    history: Callable[[str, str, int], Column] | None = None
    lenient: bool = False
    messages: list[str] = field(default_factory=list)

    def misfit(self, message: str, kind: str) -> Compiled:
        if not self.lenient:
            raise ExpressionError(message)
        self.messages.append(message)
        return Compiled(F.lit(None).cast("double" if kind == NUMBER else "boolean"), F.lit(message), kind)

    def compile(self, node: Node) -> Compiled:
        if node.kind in ("number", "duration"):
            return Compiled(F.lit(node.value), none(), NUMBER)
        if node.kind == "metric":
            return Compiled(self.metric(node.text).cast("double"), none(), NUMBER)
        if node.kind == "unary":
            return self.unary(node)
        if node.kind == "binary":
            return self.logic(node) if node.text in ("and", "or") else self.binary(node)
        return self.conditional(node) if node.kind == "if" else self.call(node)

    def unary(self, node: Node) -> Compiled:
        a = self.compile(node.args[0])
        wanted = BOOLEAN if node.text == "not" else NUMBER
        if a.kind != wanted:
            return self.misfit(f"{node.text} needs a {wanted}", wanted)
        return Compiled(~a.value if wanted == BOOLEAN else -a.value, a.error, wanted)

    def logic(self, node: Node) -> Compiled:
        a, b = map(self.compile, node.args)
        if a.kind != BOOLEAN or b.kind != BOOLEAN:
            return self.misfit(f"{node.text} needs booleans", BOOLEAN)
        decided = F.coalesce(a.value, F.lit(node.text == "and")) == F.lit(node.text == "or")  # the right side doesn't count
        error = F.coalesce(a.error, F.when(~decided, b.error))
        value = F.when(decided, a.value).otherwise(a.value & b.value if node.text == "and" else a.value | b.value)
        return Compiled(F.when(error.isNull(), value), error, BOOLEAN)

    def binary(self, node: Node) -> Compiled:
        a, b = map(self.compile, node.args)
        op = node.text
        if a.kind != NUMBER or b.kind != NUMBER:
            return self.misfit(f"{op} needs numbers", BOOLEAN if op in COMPARISONS else NUMBER)
        if op in COMPARISONS:
            nan = F.isnan(a.value) | F.isnan(b.value)
            value = {"<": a.value < b.value, ">": a.value > b.value, "<=": a.value <= b.value, ">=": a.value >= b.value, "==": a.value == b.value, "!=": a.value != b.value}[op]
            return Compiled(F.when(a.value.isNull() | b.value.isNull(), F.lit(None)).when(nan, F.lit(op == "!=")).otherwise(value), _first_error(a.error, b.error), BOOLEAN)
        if op in "/%":
            zero = F.when(a.value.isNotNull() & (b.value == 0), F.lit("division by zero" if op == "/" else "modulo by zero"))
            safe = F.when(b.value != 0, b.value)
            return _guarded(a.value / safe if op == "/" else a.value % safe, a.error, b.error, zero)
        return _guarded({"+": a.value + b.value, "-": a.value - b.value, "*": a.value * b.value}[op], a.error, b.error)

    def conditional(self, node: Node) -> Compiled:
        c, a, b = map(self.compile, node.args)
        if c.kind != BOOLEAN or a.kind != b.kind:
            return self.misfit("IF needs a boolean and two values of one type", a.kind)
        error = F.coalesce(c.error, F.when(c.value, a.error).when(~c.value, b.error))
        return Compiled(F.when(error.isNull(), F.when(c.value, a.value).when(~c.value, b.value)), error, a.kind)

    def call(self, node: Node) -> Compiled:
        if node.text in HISTORY:
            if len(node.args) != 2 or node.args[0].kind != "metric" or node.args[1].kind != "duration":
                return self.misfit(f"{node.text} needs a metric and a duration", NUMBER)
            if self.history is None:
                return Compiled(F.lit(None).cast("double"), F.lit(f"no history for {node.text}"), NUMBER)
            return Compiled(self.history(node.text, node.args[0].text, int(node.args[1].value)).cast("double"), none(), NUMBER)
        if node.text not in _functions:
            return self.misfit(f"unknown function {node.text}", NUMBER)
        least, most, builder = _functions[node.text]
        if len(node.args) < least or (most is not None and len(node.args) > most):
            return self.misfit(f"wrong number of arguments for {node.text}", NUMBER)
        args = [self.compile(a) for a in node.args]
        if any(a.kind != NUMBER for a in args):
            return self.misfit(f"{node.text} needs numbers", NUMBER)
        return builder(*args)


def compile_expression(source: str, metric: Callable[[str], Column], history: Callable[[str, str, int], Column] | None = None, lenient: bool = False) -> Compiled:
    return Compiler(metric, history, lenient).compile(parse(source))


def _extreme(pick: Callable[..., Column], *args: Compiled) -> Compiled:
    known = functools.reduce(lambda x, y: x & y, (a.value.isNotNull() for a in args))
    return _guarded(F.when(known, pick(*(a.value for a in args))), *(a.error for a in args))


def _clamp(v: Compiled, low: Compiled, high: Compiled) -> Compiled:
    known = v.value.isNotNull() & low.value.isNotNull() & high.value.isNotNull()
    wrong = F.when(known & (low.value > high.value), F.lit("CLAMP: low is above high"))
    return _guarded(F.when(known, F.greatest(low.value, F.least(v.value, high.value))), v.error, low.error, high.error, wrong)


register_function("abs", 1, 1, lambda a: _guarded(F.abs(a.value), a.error))
register_function("min", 2, None, lambda *args: _extreme(F.least, *args))
register_function("max", 2, None, lambda *args: _extreme(F.greatest, *args))
register_function("clamp", 3, 3, _clamp)
register_function("sqrt", 1, 1, lambda a: _guarded(F.sqrt(F.when(a.value >= 0, a.value)), a.error, F.when(a.value < 0, F.lit("SQRT of a negative number"))))
register_function("pow", 2, 2, lambda a, b: _guarded(F.pow(a.value, b.value), a.error, b.error))
