"""Staged column expressions over sample points.

A program is a list of named expressions in SQL text, each using inputs and earlier names. It is
applied as a few stacked projections, so a value used many times (a rotated coordinate, say) is
computed once per row; the same text runs in any SQL engine with the usual maths functions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from fellscape.functions.columns import col

_NAME = re.compile(r"\b_[a-z][a-z0-9]*\b")
_OPERATION = re.compile(r" [-+*/<>=] |\w\(|\(-|CASE")


def num(v: float) -> str:
    """A double literal; the exponent keeps it from being read as a decimal."""
    text = repr(float(v))
    if text in ("inf", "-inf", "nan"):
        raise ValueError(f"{text} has no literal")
    text = text if "e" in text else text + "e0"
    return f"({text})" if v < 0 else text


@dataclass
class Dialect:
    """Spellings that differ between SQL engines and arrays."""

    rint: str = "rint({0})"
    log_abs: str = "coalesce(ln(abs({0})), double('-Infinity'))"
    arrays: bool = False

    def case(self, branches: Sequence[tuple[str, str]], default: str) -> str:
        """The value of the first condition that holds."""
        if not self.arrays:
            return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in branches) + f" ELSE {default} END"
        for condition, value in reversed(branches):
            default = f"where({condition.replace(' = ', ' == ')}, {value}, {default})"
        return default


SPARK = Dialect()
DUCKDB = Dialect(rint="round_even({0}, 0)", log_abs="ln(abs({0}))")
ARRAYS = Dialect(rint="rint({0})", log_abs="ln(abs({0}))", arrays=True)

#: What the texts of ``ARRAYS`` may call.
NUMPY = {"where": np.where, "power": np.power, "abs": np.abs, "sqrt": np.sqrt, "exp": np.exp, "ln": np.log, "sin": np.sin, "cos": np.cos,
         "floor": np.floor, "rint": np.rint, "greatest": lambda *a: reduce(np.maximum, a), "least": lambda *a: reduce(np.fmin, a)}


@lru_cache(maxsize=1 << 16)
def compiled(text: str):
    return compile(text, "<program>", "eval")


@dataclass
class Program:
    dialect: Dialect = field(default_factory=lambda: SPARK)
    prefix: str = "_v"
    levels: list[list[tuple[str, str]]] = field(default_factory=list)
    outputs: dict[str, str] = field(default_factory=dict)
    _level: dict[str, int] = field(default_factory=dict)
    _seen: dict[str, str] = field(default_factory=dict)

    def bind(self, text: str) -> str:
        """Name an expression; equal expressions share a name, bare names pass through."""
        if text in self._seen or text in self._level or re.fullmatch(r"\w+", text):
            return self._seen.get(text, text)
        level = max([self._level[n] for n in _NAME.findall(text) if n in self._level], default=-1) + 1
        name = f"{self.prefix}{len(self._level)}"
        self._level[name] = level
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, text))
        self._seen[text] = name
        return name

    def output(self, name: str, text: str) -> None:
        self.outputs[name] = text

    def size(self) -> int:
        """Operations of all expressions, as a measure of the code that they compile to."""
        texts = [t for level in self.levels for _, t in level] + list(self.outputs.values())
        return sum(len(_OPERATION.findall(t)) for t in texts)

    def values(self, inputs: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray]]:
        """The outputs over arrays of inputs, for a program of dialect ``ARRAYS``."""
        held, n = {**NUMPY, **inputs}, len(next(iter(inputs.values())))
        with np.errstate(all="ignore"):
            for level in self.levels:
                for name, text in level:
                    held[name] = eval(compiled(text), {"__builtins__": {}}, held)
            for name, text in self.outputs.items():
                yield name, np.broadcast_to(np.asarray(eval(compiled(text), {"__builtins__": {}}, held), float), n)

    def apply(self, df: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
        """The kept columns of ``df`` (all by default) and the outputs."""
        keep = list(keep if keep is not None else df.columns)
        for level in self.levels:
            df = df.select("*", *[F.expr(t).alias(n) for n, t in level])
        return df.select(*[col(c) for c in keep], *[F.expr(t).alias(n) for n, t in self.outputs.items()])

    def sql(self, source: str, keep: Sequence[str]) -> str:
        for level in self.levels:
            source = f"(SELECT *, {', '.join(f'{t} AS {n}' for n, t in level)} FROM {source})"
        outs = [f'{t} AS "{n}"' for n, t in self.outputs.items()]
        return f"SELECT {', '.join([*keep, *outs])} FROM {source}"
