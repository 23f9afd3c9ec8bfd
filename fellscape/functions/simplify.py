"""Simplification of generated token lists: a small helper run on one short list at a time."""

from __future__ import annotations

from fellscape.functions.expression import BINARY, OPERANDS, REDUCERS

# Rewrite rules of the function language.
UNDO = {(21, 21), (22, 22), (24, 25), (25, 24), (30, 31), (31, 30)}  # outer, inner: both vanish
NEVER_NEGATIVE = (25, 26, 30)  # abs around these vanishes, and abs inside these vanishes
SWAP = {21: 12, 22: 14}  # negated difference, reciprocal quotient: operands change places
OPPOSITE = {11: 12, 12: 11, 13: 14, 14: 13}
INVERSE_OF = {11: 21, 12: 21, 13: 22, 14: 22}  # the unary operator a family can absorb
FAMILY = {11: 0, 12: 0, 13: 1, 14: 1}
PLAIN = (11, 13)
CONSTANT = (1,)


def literal(node) -> bool:
    return len(node) == 1 and node[0] <= 1


def parsed(rpn) -> tuple:
    """Nodes ``(token, child, ...)`` of a token list."""
    stack = []
    for token in rpn:
        if token < 0 or token in OPERANDS:
            stack.append((token,))
        elif token in BINARY:
            b, a = stack.pop(), stack.pop()
            stack.append((token, a, b))
        else:
            stack.append((token, stack.pop()))
    return stack[0]


def flat(node) -> list[int]:
    return [t for child in node[1:] for t in flat(child)] + [node[0]]


def with_fewer_unary(node) -> tuple[tuple, bool]:
    """The node after its children, and whether its value is a scalar."""
    if len(node) == 1:
        return node, node[0] <= 1 or node[0] in (3, 7)
    if len(node) == 3:
        (a, one), (b, two) = (with_fewer_unary(c) for c in node[1:])
        return (node[0], a, b), one and two
    op, (a, scalar) = node[0], with_fewer_unary(node[1])
    if scalar and op in REDUCERS:
        return a, True
    if op == 26 and a[0] in NEVER_NEGATIVE:
        new = a
    elif op in NEVER_NEGATIVE and a[0] == 26:
        new = (op, a[1])
    elif (op, a[0]) in UNDO:
        new = a[1]
    elif SWAP.get(op) == a[0]:
        new = (a[0], a[2], a[1])
    else:
        new = (op, a)
    return new, scalar or (new[0] in REDUCERS and new[0] != 34)


def without_constant(op, a, b):
    """``a op (p q)`` of one family with a literal p or q, less that literal; whole if neither is one."""
    if literal(b[2]):
        return op, a, b[1]
    if literal(b[1]):
        plain = PLAIN[FAMILY[op]]
        return (plain if op == b[0] else OPPOSITE[plain]), a, b[2]
    return op, a, b


def joined(op, a, b, fixed_a, fixed_b):
    """A binary node after its children; the first case that applies decides, even where it changes nothing."""
    family = lambda node: FAMILY.get(node[0], -1)
    if b[0] in (21, 22):
        return (OPPOSITE[op], a, b[1]) if INVERSE_OF[op] == b[0] else (op, a, b)
    if op in PLAIN and a[0] == INVERSE_OF[op]:
        return OPPOSITE[op], b, a[1]
    if family(a) >= 0 and fixed_b:
        return a if family(a) == FAMILY[op] and literal(a[1]) and literal(a[2]) else (op, a, b)
    if family(b) == FAMILY[op] and (fixed_a or family(a) == FAMILY[op] and (literal(a[1]) or literal(a[2]))):
        return without_constant(op, a, b)
    return op, a, b


def with_fewer_binary(node) -> tuple[tuple, bool]:
    """The node after its children, and whether no variable occurs below."""
    if len(node) == 1:
        return node, literal(node)
    if len(node) == 2:
        a, fixed = with_fewer_binary(node[1])
        return (node[0], a), fixed
    (a, one), (b, two) = (with_fewer_binary(c) for c in node[1:])
    return (CONSTANT, True) if one and two else (joined(node[0], a, b, one, two), False)


def unary_pass(rpn) -> list[int]:
    return flat(with_fewer_unary(parsed(rpn))[0])


def binary_pass(rpn) -> list[int]:
    return flat(with_fewer_binary(parsed(rpn))[0])


def simplify(rpn) -> list[int]:
    """Unary operators, then binary ones, and both again: a rewrite can open the way for another one above it."""
    return binary_pass(unary_pass(binary_pass(unary_pass(rpn))))


# How each token reads in the text of a function.
TEXT = {
    2: "x", 3: "x[1]", 4: "shift(x)", 5: "dot(x, M)", 6: "index", 11: "{0}+{1}", 12: "{0}-{1}", 13: "{0}*{1}",
    14: "{0}/{1}", 21: "-({0})", 22: "1/({0})", 23: "10*({0})", 24: "square({0})", 25: "sqrt(abs({0}))",
    26: "abs({0})", 27: "round({0})", 28: "sin(2*pi*{0})", 29: "cos(2*pi*{0})", 30: "log(abs({0}))", 31: "exp({0})",
    32: "sum({0})", 33: "mean({0})", 34: "cumsum({0})", 35: "prod({0})", 36: "max({0})"}


def to_text(rpn, consts) -> str:
    """Infix text of a token list; operands are joined without brackets."""
    stack, values = [], iter(consts)
    for token in rpn:
        if token in (1, 7):
            stack.append(repr(next(values)))
        elif token < 0:
            stack.append(f"abs({token})")
        elif token in BINARY:
            b, a = stack.pop(), stack.pop()
            stack.append(TEXT[token].format(a, b))
        elif token in OPERANDS:
            stack.append(TEXT[token])
        else:
            stack.append(TEXT[token].format(stack.pop()))
    return stack[0]
