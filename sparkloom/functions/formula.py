"""The formula language: tokens, a precedence parser, and compilation to Columns.

Text is never evaluated: only the functions and operators below exist.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.errors import FormulaError

TOKENS = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+|\d+(?:[eE][+-]?\d+)?)|(?P<str>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<quoted>`[^`]+`)|(?P<op>\*\*|==|!=|<>|<=|>=|&&|\|\||[-+*/%<>!(),\[\]=])|(?P<name>[^\W\d][\w.]*))"""
)


@dataclass(frozen=True)
class Node:
    """A node of the syntax tree: ``kind`` and its parts."""

    kind: str
    value: Any = None
    args: tuple[Node, ...] = ()


BINARY = {"or": 1, "||": 1, "and": 2, "&&": 2, "in": 4, "==": 4, "=": 4, "!=": 4, "<>": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "**": 8}


def tokenize(text: str) -> list[tuple[str, str]]:
    """``(kind, text)`` of all tokens."""
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKENS.match(text, at)
        if not m or m.end() == at:
            raise FormulaError(f"unexpected {text[at]!r} at {at} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class Parser:
    """Precedence climbing over the tokens of one formula."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.tokens = tokenize(text)
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise FormulaError(f"expected {value or 'more'} in {self.text!r}")
        self.at += 1
        return token

    def parse(self) -> Node:
        node = self.binary(1)
        if self.peek()[0] != "end":
            raise FormulaError(f"unexpected {self.peek()[1]!r} in {self.text!r}")
        return node

    def binary(self, least: int) -> Node:
        left = self.unary()
        while (p := BINARY.get(self.peek()[1].lower(), 0)) >= least and self.peek()[0] in ("op", "name"):
            op = self.take()[1].lower()
            right = self.binary(p if op == "**" else p + 1)
            left = Node("binary", op, (left, right))
        return left

    def unary(self) -> Node:
        kind, value = self.peek()
        if kind == "op" and value in "-!+":
            self.take()
            return Node("unary", value, (self.binary(7),))
        if kind == "name" and value.lower() == "not":
            self.take()
            return Node("unary", "!", (self.binary(3),))
        return self.primary()

    def arguments(self, close: str) -> tuple[Node, ...]:
        args = []
        while self.peek()[1] != close:
            args.append(self.binary(1))
            if self.peek()[1] == ",":
                self.take()
            elif self.peek()[1] != close:
                raise FormulaError(f"expected , or {close} in {self.text!r}")
        self.take(close)
        return tuple(args)

    def primary(self) -> Node:
        kind, value = self.take()
        if kind == "num":
            return Node("lit", float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return Node("lit", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        if kind == "quoted":
            return Node("col", value[1:-1])
        if value == "(":
            node = self.binary(1)
            self.take(")")
            return node
        if value == "[":
            return Node("list", None, self.arguments("]"))
        if kind == "name":
            low = value.lower()
            if low in ("true", "false"):
                return Node("lit", low == "true")
            if low in ("null", "none"):
                return Node("lit", None)
            if self.peek()[1] == "(":
                self.take("(")
                return Node("call", value, self.arguments(")"))
            return Node("col", value)
        raise FormulaError(f"unexpected {value!r} in {self.text!r}")


def blank(c: Column) -> Column:
    """Null or empty text."""
    return c.isNull() | (c.cast("string") == "")


UNITS = {"year": "YEAR", "years": "YEAR", "month": "MONTH", "months": "MONTH", "week": "WEEK", "weeks": "WEEK", "day": "DAY", "days": "DAY", "hour": "HOUR", "hours": "HOUR", "minute": "MINUTE", "minutes": "MINUTE", "second": "SECOND", "seconds": "SECOND"}


def literal(node: Node) -> Any:
    """The value of an argument that must be a literal."""
    if node.kind == "unary" and node.value == "-":
        return -literal(node.args[0])
    if node.kind != "lit":
        raise FormulaError("this argument must be a literal")
    return node.value


def _unit(node: Node) -> str:
    unit = str(literal(node)).lower()
    if unit not in UNITS:
        raise FormulaError(f"unknown unit {unit!r}")
    return UNITS[unit]


#: Functions over compiled arguments.
FUNCTIONS = {
    "abs": F.abs, "ceil": F.ceil, "floor": F.floor, "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "exp": F.exp, "ln": F.ln, "log": F.ln, "log10": F.log10, "log2": F.log2,
    "pow": F.pow, "mod": F.pmod, "min": F.least, "max": F.greatest, "sin": F.sin, "cos": F.cos, "tan": F.tan, "sign": F.signum,
    "length": F.length, "upper": F.upper, "lower": F.lower, "touppercase": F.upper, "tolowercase": F.lower, "trim": lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""), "reverse": F.reverse,
    "contains": lambda a, b: a.contains(b), "startswith": lambda a, b: a.startswith(b), "endswith": lambda a, b: a.endswith(b), "indexof": lambda a, b: F.position(b, a) - 1,
    "concat": lambda *cs: F.concat(*[c.cast("string") for c in cs]), "coalesce": F.coalesce, "isnull": lambda c: c.isNull(), "isnotnull": lambda c: c.isNotNull(), "isblank": blank, "isnonblank": lambda c: ~blank(c),
    "if": lambda c, a, b=None: F.when(c, a).otherwise(b if b is not None else F.lit(None)), "and": lambda *cs: _fold(cs, lambda a, b: a & b), "or": lambda *cs: _fold(cs, lambda a, b: a | b), "not": lambda c: ~c,
    "tonumber": lambda c: c.try_cast("double"), "tostring": lambda c: c.cast("string"), "todate": lambda c: c.try_cast("timestamp"),
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "now": F.current_timestamp, "get": lambda a, i: F.get(a, i), "parsejson": F.try_parse_json,
    "md5": F.md5, "sha1": F.sha1,
}


def _fold(cs, f):
    out = cs[0]
    for c in cs[1:]:
        out = f(out, c)
    return out


def _call(name: str, args: tuple[Node, ...], this: Column | None) -> Column:
    low = name.lower()
    cols = [compile_node(a, this) for a in args]
    if low in ("val", "strval", "numval"):
        c = F.col(quoted(str(literal(args[0]))))
        return c.try_cast("double") if low == "numval" else c
    if low == "round":
        return F.round(cols[0], int(literal(args[1])) if len(args) > 1 else 0)
    if low == "substring":
        start = cols[1] + 1
        return F.substring(cols[0], start, cols[2] - cols[1] if len(cols) > 2 else F.length(cols[0]))
    if low == "replace":
        return F.replace(cols[0], cols[1], cols[2])
    if low == "split":
        return F.split(cols[0], re.escape(str(literal(args[1]))))
    if low == "match":
        p = str(literal(args[1]))
        return F.when(cols[0].rlike(p), F.regexp_extract(cols[0], p, 1 if "(" in p else 0))
    if low == "diff":
        return F.timestamp_diff(_unit(args[2]), cols[0], cols[1])
    if low == "inc":
        return F.timestamp_add(_unit(args[2]), cols[1].cast("int"), cols[0])
    if low == "trunc":
        return F.date_trunc(_unit(args[1]), cols[0])
    if low == "geocontains":
        from sparkloom.operators.joins import contains_udf

        return contains_udf(*cols)
    if low not in FUNCTIONS:
        raise FormulaError(f"unknown function {name!r}")
    try:
        return FUNCTIONS[low](*cols)
    except TypeError as e:
        raise FormulaError(f"wrong number of arguments for {name!r}") from e


def quoted(name: str) -> str:
    """A column name that may hold any character."""
    return "`" + name.replace("`", "``") + "`"


def _texty(n: Node) -> bool:
    return n.kind == "lit" and isinstance(n.value, str) or n.kind == "call" and n.value.lower() in ("concat", "upper", "lower", "trim", "tostring", "strval") or n.kind == "binary" and n.value == "+" and any(map(_texty, n.args))


def compile_node(n: Node, this: Column | None = None) -> Column:
    """The Column of a syntax tree; ``this`` is what the bare name ``val`` stands for."""
    if n.kind == "lit":
        return F.lit(n.value)
    if n.kind == "col":
        return this if n.value == "val" and this is not None else F.col(quoted(n.value))
    if n.kind == "list":
        return F.array(*[compile_node(a, this) for a in n.args])
    if n.kind == "call":
        return _call(n.value, n.args, this)
    if n.kind == "unary":
        c = compile_node(n.args[0], this)
        return -c if n.value == "-" else c if n.value == "+" else ~c
    a, b = n.args
    op = n.value
    left = compile_node(a, this)
    if op == "in":
        if b.kind != "list":
            raise FormulaError("in needs a list")
        return left.isin([literal(x) for x in b.args])
    null = b.kind == "lit" and b.value is None
    if op in ("==", "="):
        return left.isNull() if null else left == compile_node(b, this)
    if op in ("!=", "<>"):
        return left.isNotNull() if null else ~left.eqNullSafe(compile_node(b, this))
    right = compile_node(b, this)
    if op == "+":
        return F.concat(left.cast("string"), right.cast("string")) if _texty(a) or _texty(b) else left + right
    if op == "/":
        return F.try_divide(left.cast("double"), right.cast("double"))
    simple = {"<": lambda: left < right, "<=": lambda: left <= right, ">": lambda: left > right, ">=": lambda: left >= right, "-": lambda: left - right, "*": lambda: left * right, "%": lambda: F.when(right != 0, F.pmod(left, right)), "**": lambda: F.pow(left, right), "&&": lambda: left & right, "and": lambda: left & right, "||": lambda: left | right, "or": lambda: left | right}
    return simple[op]()


def compile_formula(text: str, this: Column | None = None) -> Column:
    """A formula as a Column."""
    return compile_node(Parser(text).parse(), this)


def columns_of(text: str) -> set[str]:
    """Names of the columns a formula reads."""
    out: set[str] = set()
    stack = [Parser(text).parse()]
    while stack:
        n = stack.pop()
        if n.kind == "col":
            out.add(n.value)
        elif n.kind == "call" and n.value.lower() in ("val", "strval", "numval") and n.args:
            out.add(str(literal(n.args[0])))
        stack.extend(n.args)
    return out


def truthy(c: Column) -> Column:
    """A filter's reading of a formula: true, a number other than zero, or the text ``true``."""
    text = F.lower(c.cast("string"))
    return F.coalesce((text == "true") | (c.cast("string").try_cast("double") != 0), F.lit(False))
