"""The language of generated functions: token lists over a decision vector, as columns.

A function is a postfix list of tokens. An operand is a scalar or a vector of ``d`` coordinates;
binary operators act per coordinate and spread a scalar over a vector.

The meaning of a list is that of its infix text, in which operands are joined by + - * / without
brackets: ``a b + c *`` reads ``a+b*c``. So an operand is kept as a sum of products, joining two
operands joins their neighbouring terms, and brackets appear only around the argument of a
function. ``semantics="tree"`` brackets every operation instead.

Division by zero and the logarithm of zero give infinities as in IEEE arithmetic: ``a / b`` is
written ``a * b ** -1``, which is infinite at zero and never NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from fellscape.functions.program import Program, num

# Tokens of the function language.
TOKENS = {
    1: "constant in [1, 10)", 2: "decision vector", 3: "first variable", 4: "shifted vector (x2..xd, 0)",
    5: "vector times a random matrix", 6: "index vector 1..d", 7: "constant in [1, 1.1)",
    11: "add", 12: "subtract", 13: "multiply", 14: "divide",
    21: "negative", 22: "reciprocal", 23: "times 10", 24: "square", 25: "square root of the absolute value",
    26: "absolute value", 27: "round half to even", 28: "sin(2 pi .)", 29: "cos(2 pi .)",
    30: "log of the absolute value", 31: "exp",
    32: "sum", 33: "mean", 34: "cumulative sum", 35: "product", 36: "maximum"}
OPERANDS = (1, 2, 3, 4, 5, 6, 7)
BINARY = (11, 12, 13, 14)
UNARY = (21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31)
REDUCERS = (32, 33, 34, 35, 36)
SMALL = 1e-20  # fixed value: smaller results count as zero
LONG = 200  # longer texts get a name, so that they are not repeated


@dataclass
class Operand:
    """A signed sum of products; each factor is one text, or one per coordinate."""

    terms: list[tuple[int, list[tuple[str, list[str]]]]]

    @classmethod
    def of(cls, texts: list[str]) -> "Operand":
        return cls([(1, [("*", texts)])])


class Compiler:
    """Turns one token list into expressions of a program."""

    def __init__(self, prog: Program, x: Sequence[str], semantics: str = "text"):
        if semantics not in ("text", "tree"):
            raise ValueError(f"semantics {semantics} is neither text nor tree")
        self.prog, self.x, self.tree = prog, list(x), semantics == "tree"

    # Vectors are lists of texts; a scalar is a list of one.

    def each(self, template: str, *args: list[str]) -> list[str]:
        width = max(len(a) for a in args)
        out = [template.format(*[a[i] if len(a) > 1 else a[0] for a in args]) for i in range(width)]
        return [self.prog.bind(text) if len(text) > LONG else text for text in out]

    def value(self, operand: Operand) -> list[str]:
        """Left to right: products first, then the sum."""
        total = None
        for sign, factors in operand.terms:
            product = factors[0][1]
            for op, texts in factors[1:]:
                product = self.each("({0} * {1})" if op == "*" else "({0} * power({1}, -1e0))", product, texts)
            if total is None:
                total = product if sign > 0 else self.each("(-{0})", product)
            else:
                total = self.each("({0} + {1})" if sign > 0 else "({0} - {1})", total, product)
        return total

    def join(self, token: int, a: Operand, b: Operand) -> Operand:
        if self.tree:
            a, b = Operand.of(self.value(a)), Operand.of(self.value(b))
        (sign, first), rest = b.terms[0], b.terms[1:]
        if token in (11, 12):
            return Operand(a.terms + [(sign if token == 11 else -sign, first)] + rest)
        last_sign, last = a.terms[-1]
        touching = [("*" if token == 13 else "/", first[0][1])] + first[1:]
        return Operand(a.terms[:-1] + [(last_sign * sign, last + touching)] + rest)

    def wave(self, name: str, a: Operand) -> list[str]:
        """The factor 2 pi binds to the first term only, as in the text."""
        if self.tree:
            a = Operand.of(self.value(a))
        (sign, first), rest = a.terms[0], a.terms[1:]
        turned = Operand([(sign, [("*", [num(2 * math.pi)]), ("*", first[0][1])] + first[1:])] + rest)
        return self.each(name + "({0})", self.value(turned))

    def reduce(self, token: int, v: list[str]) -> list[str]:
        if token == 34:
            out = v[:1]
            for text in v[1:]:
                out = out + [self.prog.bind(f"({out[-1]} + {text})")]
            return out
        if token == 36:
            return [self.prog.bind(f"greatest({', '.join(v)})") if len(v) > 1 else v[0]]
        folded = "(" + (" * " if token == 35 else " + ").join(v) + ")"
        return [self.prog.bind(f"({folded} / {num(len(v))})" if token == 33 else folded)]

    def unary(self, token: int, a: Operand) -> Operand:
        if token in (28, 29):
            return Operand.of(self.wave("sin" if token == 28 else "cos", a))
        v = self.value(a)
        if token == 24:
            v = [self.prog.bind(text) for text in v]
        d = self.prog.dialect
        template = {
            21: "(-{0})", 22: "power({0}, -1e0)", 23: "(10e0 * {0})", 24: "({0} * {0})", 25: "sqrt(abs({0}))",
            26: "abs({0})", 27: d.rint, 30: d.log_abs, 31: "exp({0})"}.get(token)
        texts = self.reduce(token, v) if token in REDUCERS else self.each(template, v)
        if token == 21:  # -(a) is a negated factor
            return Operand.of(texts)
        if token == 22:  # 1/(a) is a quotient in the text
            return Operand([(1, [("*", [num(1.0)]), ("/", v)])])
        if token == 23:  # 10*(a) is a product in the text
            return Operand([(1, [("*", [num(10.0)]), ("*", v)])])
        return Operand.of(texts)

    def leaf(self, token: int, constant: float | None, matrix) -> Operand:
        d = len(self.x)
        if token in (1, 7):
            return Operand.of([num(constant)])
        if token == 2:
            return Operand.of(list(self.x))
        if token == 3:
            return Operand.of(self.x[:1])
        if token == 4:
            return Operand.of(self.x[1:] + [num(0.0)])
        if token == 5:
            return Operand.of([self.prog.bind("(" + " + ".join(f"{self.x[i]} * {num(matrix[i][j])}" for i in range(d)) + ")")
                               for j in range(d)])
        return Operand.of([num(i + 1.0) for i in range(d)])

    def compile(self, rpn: Sequence[int], consts: Sequence[float] = (), rots: Sequence = ()) -> list[str]:
        """Value of the whole list. ``consts`` and ``rots`` are used up in the order of tokens 1, 7 and 5."""
        stack: list[Operand] = []
        constants, matrices = iter(consts), iter(rots)
        for token in rpn:
            if token < 0:
                stack.append(Operand.of([num(abs(token))]))
            elif token in OPERANDS:
                stack.append(self.leaf(token, next(constants) if token in (1, 7) else None,
                                       next(matrices) if token == 5 else None))
            elif token in BINARY:
                b, a = stack.pop(), stack.pop()
                stack.append(self.join(token, a, b))
            elif token in UNARY or token in REDUCERS:
                stack.append(self.unary(token, stack.pop()))
            else:
                raise ValueError(f"token {token} is not defined")
        if len(stack) != 1:
            raise ValueError(f"{list(rpn)} leaves {len(stack)} operands")
        return self.value(stack[0])


def add_expression(prog: Program, x: Sequence[str], name: str, rpn: Sequence[int], consts: Sequence[float] = (),
                   rots: Sequence = (), semantics: str = "text") -> str:
    """One generated function as an output: the mean of what remains, tiny values as zero."""
    compiler = Compiler(prog, x, semantics)
    v = compiler.compile(rpn, consts, rots)
    y = prog.bind(compiler.reduce(33, v)[0] if len(v) > 1 else v[0])
    prog.output(name, prog.dialect.case([(f"abs({y}) < {num(SMALL)}", "0e0")], f"{y} + 0e0"))
    return name


def unknown_tokens(rpn: Column) -> Column:
    """Tokens of a list that the language lacks, which the compiler refuses; negative ones are literals."""
    known = [F.lit(t) for t in (*OPERANDS, *BINARY, *UNARY, *REDUCERS)]
    return F.filter(rpn, lambda t: (t >= 0) & ~t.isin(*known))
