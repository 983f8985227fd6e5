"""Arithmetic expressions: a token scanner and a precedence parser into flat post-order node lists.

A node is (kind, value or None, child numbers); children come before their parents and the root is last. Kinds
are "number" and the operators add, sub, mul, div, floor_div, pos, neg.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction

from . import exact

#: Fixed limits of an expression.
LONGEST, MOST_NODES, MOST_DIGITS, MOST_RESULT_DIGITS = 256, 64, 50, 256
BINARY = {"+": ("add", 1), "-": ("sub", 1), "*": ("mul", 2), "/": ("div", 2), "//": ("floor_div", 2)}
UNARY = {"+": "pos", "-": "neg"}
ANNOTATION = re.compile(r"<<(.*?)(>>|$)", re.DOTALL)
THOUSANDS = re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?")
_TOKEN = re.compile(r"(?P<number>(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+))|(?P<op>//|[-+*/()])|(?P<blank>[ \t\f]|\\\n)|(?P<line>\n)|(?P<note>#[^\n]*)")

Node = tuple[str, Fraction | None, tuple[int, ...]]


class Refused(ValueError):
    """The text is no supported expression."""


def without_thousands(text: str) -> str:
    return THOUSANDS.sub(lambda m: m[0].replace(",", ""), text.strip())


def _tokens(text: str) -> list[str]:
    out, at, depth = [], 0, 0
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m["line"] and not depth:
            raise Refused("syntax")
        if m["number"]:
            whole = m["number"]
            if "." not in whole and whole[0] == "0" and whole.strip("0"):
                raise Refused("leading zero")
            out.append(whole)
        elif m["op"]:
            depth += {"(": 1, ")": -1}.get(m["op"], 0)
            out.append(m["op"])
        at = m.end()
    return out


def parse(text: str) -> list[Node]:
    """Post-order nodes of an expression with at least one binary operation; signs stay operations of their own."""
    plain = without_thousands(text)
    if not plain or len(plain) > LONGEST:
        raise Refused("length")
    tokens, nodes, binary, at = _tokens(plain), [], 0, 0

    def put(*node) -> int:
        nodes.append(node)
        return len(nodes) - 1

    def factor() -> int:
        nonlocal at
        t = tokens[at] if at < len(tokens) else ""
        at += 1
        if t in UNARY:
            return put(UNARY[t], None, (factor(),))
        if t == "(":
            inner = level(1)
            if at >= len(tokens) or tokens[at] != ")":
                raise Refused("parenthesis")
            at += 1
            return inner
        if not t or t in "*//)":
            raise Refused("operand")
        if sum(c.isdigit() for c in t) > MOST_DIGITS:
            raise Refused("digits")
        return put("number", Fraction(t.rstrip(".") or "0"), ())

    def level(rank: int) -> int:
        nonlocal at, binary
        left = factor() if rank > 2 else level(rank + 1)
        while at < len(tokens) and BINARY.get(tokens[at], ("", 0))[1] == rank:
            name = BINARY[tokens[at]][0]
            at, binary = at + 1, binary + 1
            right = factor() if rank > 1 else level(rank + 1)
            left = put(name, None, (left, right))
        return left

    level(1)
    if at != len(tokens):
        raise Refused("syntax")
    # Nodes and operators count one each, and so does the whole.
    if 1 + sum(1 if n[0] == "number" else 2 for n in nodes) > MOST_NODES:
        raise Refused("nodes")
    if not binary:
        raise Refused("no operation")
    return nodes


def fold_signs(nodes: list[Node]) -> list[Node]:
    """The same tree with signs on bare numbers made part of them."""
    out: list[Node] = []
    place: list[int] = []
    for kind, value, children in nodes:
        if kind in ("pos", "neg") and out[place[children[0]]][0] == "number":
            at = place[children[0]]
            out[at] = ("number", -out[at][1] if kind == "neg" else out[at][1], ())
            place.append(at)
        else:
            out.append((kind, value, tuple(place[c] for c in children)))
            place.append(len(out) - 1)
    return out


def apply(kind: str, args: list[Fraction]) -> Fraction:
    a, b = args[0], args[-1]
    match kind:
        case "pos" | "copy":
            return a
        case "neg":
            return -a
        case "add":
            return a + b
        case "sub":
            return a - b
        case "mul":
            return a * b
        case "div":
            return a / b
        case "floor_div":
            return Fraction(a // b)
    raise Refused(kind)


def evaluate(nodes: list[Node], bounded: bool = False) -> Fraction:
    """Value of the root; ``bounded`` refuses results with too many digits."""
    values: list[Fraction] = []
    for kind, value, children in nodes:
        got = value if kind == "number" else apply(kind, [values[c] for c in children])
        if bounded and kind not in ("number", "pos") and max(len(str(abs(got.numerator))), len(str(got.denominator))) > MOST_RESULT_DIGITS:
            raise ArithmeticError("result is too large")
        values.append(got)
    return values[-1]


@dataclass
class Formula:
    """One annotation and its verdict; ``error`` is None if the claim holds."""

    raw: str
    start: int
    end: int
    expression: str | None = None
    claimed: str | None = None
    claimed_text: str | None = None
    value: Fraction | None = None
    error: str | None = None
    parsed: bool = False
    executed: bool = False
    nodes: list[Node] | None = None
    expression_span: tuple[int, int] | None = None
    claimed_span: tuple[int, int] | None = None

    @property
    def correct(self) -> bool:
        return self.parsed and self.executed and self.error is None

    @property
    def shown(self) -> str | None:
        return None if self.value is None or not self.executed else exact.show(self.value)


def _span(text: str, at: int) -> tuple[int, int] | None:
    body = text.strip()
    begin = at + len(text) - len(text.lstrip())
    return (begin, begin + len(body)) if body else None


def judge(found: re.Match[str]) -> Formula:
    """The verdict on one match of ANNOTATION."""
    f = Formula(found[0], *found.span())
    left, equals, right = found[1].rpartition("=")
    at = found.start(1)
    f.expression_span = _span(left if equals else found[1], at)
    if equals:
        f.claimed_span, f.claimed_text = _span(right, at + len(left) + 1), right.strip() or None
    if found[2] != ">>":
        f.error = "unclosed_annotation"
        return f
    if not equals:
        f.error = "missing_equals"
        return f
    f.expression = left.strip() or None
    claim = exact.read(right)
    if f.expression is None or claim is None:
        f.error = "empty_expression" if f.expression is None else "invalid_claimed_result"
        return f
    f.claimed = exact.show(claim)
    try:
        nodes = parse(f.expression)
    except (Refused, RecursionError):
        f.error = "invalid_expression"
        return f
    f.parsed, f.nodes = True, fold_signs(nodes)
    try:
        f.value = evaluate(nodes, bounded=True)
    except ArithmeticError:
        f.error = "execution_error"
        return f
    f.executed = True
    f.error = None if exact.accepts(right, f.value) else "incorrect_result"
    return f


def formulas(text: str | None) -> list[Formula]:
    """Verdicts on all annotations of a text, in order."""
    return [judge(m) for m in ANNOTATION.finditer(text or "")]
