"""The 24 noiseless BBOB benchmark functions as staged column expressions.

Definitions and instance data follow Hansen, Finck, Ros, Auger (2009) and the published instance
generator: an instance is fixed by function, instance number and dimension.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from fellscape.functions.program import Program, num

FIDS = range(1, 25)
NAMES = {  # fixed values
    1: "sphere", 2: "ellipsoid, separable", 3: "Rastrigin, separable", 4: "Bueche-Rastrigin", 5: "linear slope",
    6: "attractive sector", 7: "step ellipsoid", 8: "Rosenbrock", 9: "Rosenbrock, rotated", 10: "ellipsoid, rotated",
    11: "discus", 12: "bent cigar", 13: "sharp ridge", 14: "different powers", 15: "Rastrigin, rotated",
    16: "Weierstrass", 17: "Schaffers F7", 18: "Schaffers F7, ill-conditioned", 19: "Griewank-Rosenbrock",
    20: "Schwefel", 21: "Gallagher, 101 peaks", 22: "Gallagher, 21 peaks", 23: "Katsuura", 24: "Lunacek bi-Rastrigin"}
SCHWEFEL_OPT = 4.2096874633
SCHWEFEL_SHIFT = 4.189828872724339
LUNACEK_MU = 2.5


# ---- instance data -------------------------------------------------------------------------------

def uniform_stream(n: int, seed: int) -> np.ndarray:
    """The published shuffled Lehmer generator: 16807 modulo 2**31 - 1 with a table of 32."""
    state = max(1, abs(int(seed)))

    def step(s):
        return 16807 * s % 2147483647

    table = [0] * 32
    for i in range(39, -1, -1):
        state = step(state)
        if i < 32:
            table[i] = state
    last, out = table[0], np.empty(n)
    for i in range(n):
        state = step(state)
        slot = last // 67108865
        last, table[slot] = table[slot], state
        out[i] = last / 2.147483647e9 or 1e-99
    return out


def normal_stream(n: int, seed: int) -> np.ndarray:
    u = uniform_stream(2 * n, seed)
    g = np.sqrt(-2 * np.log(u[:n])) * np.cos(2 * np.pi * u[n:])
    return np.where(g == 0, 1e-99, g)


def rotation(seed: int, d: int) -> np.ndarray:
    """Orthonormal columns of a seeded Gaussian matrix (Gram-Schmidt)."""
    b = normal_stream(d * d, seed).reshape(d, d).T.copy()
    for i in range(d):
        for j in range(i):
            b[:, i] -= (b[:, i] @ b[:, j]) * b[:, j]
        b[:, i] /= math.sqrt(b[:, i] @ b[:, i])
    return b


def base_seed(fid: int, iid: int) -> int:
    """Functions 4 and 18 share the data of 3 and 17."""
    return {4: 3, 18: 17}.get(fid, fid) + 10000 * iid


def f_opt(fid: int, iid: int) -> float:
    seed = base_seed(fid, iid)
    ratio = normal_stream(1, seed)[0] / normal_stream(1, seed + 1)[0]
    return float(min(1000.0, max(-1000.0, math.floor(1e4 * ratio + 0.5) / 100)))


@lru_cache(maxsize=4096)
def x_opt(fid: int, iid: int, d: int) -> tuple[float, ...]:
    """Location of the optimum."""
    seed = base_seed(fid, iid)
    u = uniform_stream(d, seed)
    x = 8 * np.floor(1e4 * u) / 1e4 - 4
    x[x == 0] = -1e-5
    if fid == 4:
        x[::2] = np.abs(x[::2])
    elif fid == 5:
        x = np.where(x < 0, -5.0, 5.0)
    elif fid == 8:
        x = 0.75 * x
    elif fid in (9, 19):
        scale = max(1.0, math.sqrt(d) / 8)
        x = rotation(seed, d).T @ np.full(d, 0.5 / scale)
    elif fid == 20:
        x = np.where(u - 0.5 < 0, -1.0, 1.0) * SCHWEFEL_OPT / 2
    elif fid in (21, 22):
        x = gallagher(fid, iid, d)[3]
    elif fid == 24:
        x = np.where(normal_stream(d, seed) < 0, -1.0, 1.0) * LUNACEK_MU / 2
    return tuple(float(v) for v in x)


def gallagher(fid: int, iid: int, d: int):
    """Peak heights, scales (peaks x d), rotated centres (peaks x d) and the optimum."""
    seed = base_seed(fid, iid)
    peaks, first, width, half = (101, math.sqrt(1000.0), 10.0, 5.0) if fid == 21 else (21, 1000.0, 9.8, 4.9)
    order = np.argsort(uniform_stream(peaks - 1, seed), kind="stable")
    condition = np.concatenate([[first], 1000.0 ** (order / (peaks - 2))])
    height = np.concatenate([[10.0], 1.1 + 8.0 * np.arange(peaks - 1) / (peaks - 2)])
    scale = np.array([condition[i] ** (np.argsort(uniform_stream(d, seed + 1000 * i), kind="stable") / (d - 1) - 0.5)
                      for i in range(peaks)])
    places = width * uniform_stream(d * peaks, seed).reshape(peaks, d) - half
    places[0] *= 0.8
    return height, scale, places @ rotation(seed, d).T, places[0]


# ---- vector helpers ---------------------------------------------------------------------------------

PEAKS = 12  # peaks of a projection, to bound the generated code


class Builder:
    """One function in one dimension, written into a program."""

    def __init__(self, prog: Program, x: Sequence[str], fid: int, iid: int):
        if len(x) < 2:
            raise ValueError("benchmark functions need at least two inputs")
        self.p, self.x, self.fid, self.iid, self.d = prog, list(x), fid, iid, len(x)
        self.seed = base_seed(fid, iid)
        self.opt = x_opt(fid, iid, self.d)
        self.w = [i / (self.d - 1) for i in range(self.d)]

    def bind(self, texts):
        return [self.p.bind(t) for t in texts]

    def case(self, branches, default):
        return self.p.dialect.case(branches, default)

    def shifted(self):
        return self.bind([f"({x} - {num(o)})" for x, o in zip(self.x, self.opt)])

    def matrix(self, m, z, add=0.0):
        rows = [" + ".join(f"{num(m[i, j])} * {z[j]}" for j in range(self.d)) for i in range(self.d)]
        return self.bind([f"({r} + {num(add)})" if add else f"({r})" for r in rows])

    def rot1(self):
        return rotation(self.seed + 1000000, self.d)

    def rot2(self):
        return rotation(self.seed, self.d)

    def scaled(self, alpha):
        """Diagonal of the conditioning matrix."""
        return np.diag([alpha ** (w / 2) for w in self.w])

    def osz(self, z):
        logs = self.bind([self.case([(f"{v} = 0", "0e0")], f"ln(abs({v}))") for v in z])
        return self.bind([
            self.case([(f"{v} > 0", f"exp({l} + 0.049e0 * (sin(10e0 * {l}) + sin(7.9e0 * {l})))"),
                       (f"{v} < 0", f"-exp({l} + 0.049e0 * (sin(5.5e0 * {l}) + sin(3.1e0 * {l})))")], "0e0")
            for v, l in zip(z, logs)])

    def asy(self, z, beta):
        return self.bind([self.case([(f"{v} > 0", f"power({v}, 1e0 + {num(beta * w)} * sqrt(abs({v})))")], v) for v, w in zip(z, self.w)])

    def times(self, weights, z):
        return self.bind([f"({num(a)} * {v})" for a, v in zip(weights, z)])

    def sum(self, texts):
        return "(" + " + ".join(texts) + ")"

    def sumsq(self, z, weights=None):
        return self.sum([f"{num(a)} * {v} * {v}" if weights is not None else f"{v} * {v}"
                         for a, v in zip(weights if weights is not None else z, z)])

    def pen(self, factor, z=None):
        z = z or self.x
        return f"{num(factor)} * " + self.sum([f"power(greatest(0e0, abs({v}) - 5e0), 2e0)" for v in z])

    def rastrigin(self, z):
        return f"10e0 * ({num(self.d)} - {self.sum([f'cos({num(2 * math.pi)} * {v})' for v in z])}) + {self.sumsq(z)}"

    def rosenbrock_terms(self, z):
        return self.bind([f"(100e0 * power({a} * {a} - {b}, 2e0) + power({a} - 1e0, 2e0))" for a, b in zip(z, z[1:])])

    # One method per function: the value above the optimum.

    def f1(self):
        return self.sumsq(self.shifted())

    def f2(self):
        return self.sumsq(self.osz(self.shifted()), [10 ** (6 * w) for w in self.w])

    def f3(self):
        return self.rastrigin(self.times(np.diag(self.scaled(10)), self.asy(self.osz(self.shifted()), 0.2)))

    def f4(self):
        z = self.osz(self.shifted())
        s = [10 ** (w / 2) for w in self.w]
        z = self.bind([f"({self.case([(f'{v} > 0', num(10 * a))], num(a))} * {v})" if i % 2 == 0 else f"({num(a)} * {v})"
                       for i, (v, a) in enumerate(zip(z, s))])
        return f"{self.rastrigin(z)} + {self.pen(100)}"

    def f5(self):
        terms = []
        for x, o, w in zip(self.x, self.opt, self.w):
            s = math.copysign(10 ** w, o)
            terms.append(f"(5e0 * {num(abs(s))} - {num(s)} * {self.case([(f'{x} * {num(o)} < 25e0', x)], num(o))})")
        return self.sum(terms)

    def f6(self):
        z = self.matrix(self.rot1() @ self.scaled(10) @ self.rot2(), self.shifted())
        total = self.p.bind(self.sum([f"power({self.case([(f'{v} * {num(o)} > 0', '100e0')], '1e0')} * {v}, 2e0)" for v, o in zip(z, self.opt)]))
        return f"power({self.osz([total])[0]}, 0.9e0)"

    def f7(self):
        z = self.matrix(self.scaled(10) @ self.rot2(), self.shifted())
        steps = self.bind([f"({self.case([(f'abs({v}) > 0.5e0', f'floor({v} + 0.5e0)')], f'floor(10e0 * {v} + 0.5e0) / 10e0')})" for v in z])
        turned = self.matrix(self.rot1(), steps)
        total = self.sumsq(turned, [100 ** w for w in self.w])
        return f"0.1e0 * greatest(abs({z[0]}) * 1e-4, {total}) + {self.pen(1)}"

    def f8(self):
        c = max(1.0, math.sqrt(self.d) / 8)
        z = self.bind([f"({num(c)} * {v} + 1e0)" for v in self.shifted()])
        return self.sum(self.rosenbrock_terms(z))

    def f9(self):
        c = max(1.0, math.sqrt(self.d) / 8)
        return self.sum(self.rosenbrock_terms(self.matrix(c * self.rot2(), self.x, add=0.5)))

    def f10(self):
        return self.sumsq(self.osz(self.matrix(self.rot1(), self.shifted())), [10 ** (6 * w) for w in self.w])

    def f11(self):
        z = self.osz(self.matrix(self.rot1(), self.shifted()))
        return self.sumsq(z, [1e6] + [1.0] * (self.d - 1))

    def f12(self):
        r = self.rot1()
        z = self.matrix(r, self.asy(self.matrix(r, self.shifted()), 0.5))
        return self.sumsq(z, [1.0] + [1e6] * (self.d - 1))

    def f13(self):
        z = self.matrix(self.rot1() @ self.scaled(10) @ self.rot2(), self.shifted())
        return f"{z[0]} * {z[0]} + 100e0 * sqrt({self.sumsq(z[1:])})"

    def f14(self):
        z = self.matrix(self.rot1(), self.shifted())
        return "sqrt(" + self.sum([f"power(abs({v}), {num(2 + 4 * w)})" for v, w in zip(z, self.w)]) + ")"

    def f15(self):
        r = self.rot1()
        z = self.asy(self.osz(self.matrix(r, self.shifted())), 0.2)
        return self.rastrigin(self.matrix(r @ self.scaled(10) @ self.rot2(), z))

    def f16(self):
        r, k = self.rot1(), range(12)
        z = self.matrix(r @ self.scaled(0.01) @ self.rot2(), self.osz(self.matrix(r, self.shifted())))
        f0 = sum(2.0 ** -j * math.cos(math.pi * 3 ** j) for j in k)
        waves = self.bind([self.sum([f"{num(2.0 ** -j)} * cos({num(2 * math.pi * 3 ** j)} * ({v} + 0.5e0))" for j in k]) for v in z])
        return f"10e0 * power({self.sum(waves)} / {num(self.d)} - {num(f0)}, 3e0) + {self.pen(10 / self.d)}"

    def f17(self, alpha=10):
        z = self.asy(self.matrix(self.rot1(), self.shifted()), 0.5)
        z = self.matrix(self.scaled(alpha) @ self.rot2(), z)
        s = self.bind([f"sqrt(sqrt({a} * {a} + {b} * {b}))" for a, b in zip(z, z[1:])])
        waves = [f"{v} * (1e0 + power(sin(50e0 * power({v}, 0.4e0)), 2e0))" for v in s]
        return f"power({self.sum(waves)} / {num(self.d - 1)}, 2e0) + {self.pen(10)}"

    def f18(self):
        return self.f17(1000)

    def f19(self):
        c = max(1.0, math.sqrt(self.d) / 8)
        s = self.rosenbrock_terms(self.matrix(c * self.rot2(), self.x, add=0.5))
        return f"{num(10 / (self.d - 1))} * {self.sum([f'({v} / 4000e0 - cos({v}))' for v in s])} + 10e0"

    def f20(self):
        sign = [math.copysign(1.0, o) for o in self.opt]
        xh = self.bind([f"({num(2 * g)} * {x})" for g, x in zip(sign, self.x)])
        centre = [2 * abs(o) for o in self.opt]
        zh = [xh[0]] + self.bind([f"({xh[i + 1]} + 0.25e0 * ({xh[i]} - {num(centre[i])}))" for i in range(self.d - 1)])
        z = self.bind([f"(100e0 * ({num(10 ** (w / 2))} * ({v} - {num(c)}) + {num(c)}))" for w, v, c in zip(self.w, zh, centre)])
        wave = self.sum([f"{v} * sin(sqrt(abs({v})))" for v in z])
        return (f"{num(-1 / (100 * self.d))} * {wave} + {num(SCHWEFEL_SHIFT)} + "
                f"{self.pen(100, [f'({v} / 100e0)' for v in z])}")

    def f21(self):
        height, scale, centre, _ = gallagher(self.fid, self.iid, self.d)
        turned = self.matrix(self.rot2(), self.x)
        peaks = []
        for h, s, c in zip(height, scale, centre):
            gap = " + ".join(f"{num(-a / (2 * self.d))} * ({v} - {num(y)}) * ({v} - {num(y)})" for a, v, y in zip(s, turned, c))
            peaks.append(f"{num(h)} * exp({gap})")
        # The running maximum is used twice, so that the projections stay apart and each compiles.
        highest = self.p.bind(f"greatest({', '.join(peaks[:PEAKS])})")
        for k in range(PEAKS, len(peaks), PEAKS):
            highest = self.p.bind(f"greatest({', '.join([highest, highest, *peaks[k:k + PEAKS]])})")
        best = self.p.bind(f"(10e0 - {highest})")
        return f"power({self.osz([best])[0]}, 2e0) + {self.pen(1)}"

    def f22(self):
        return self.f21()

    def f23(self):
        z = self.matrix(self.rot1() @ self.scaled(100) @ self.rot2(), self.shifted())
        factors = []
        for i, v in enumerate(z):
            digits = [f"abs({num(2.0 ** j)} * {v} - floor({num(2.0 ** j)} * {v} + 0.5e0)) / {num(2.0 ** j)}" for j in range(1, 33)]
            factors.append(f"power(1e0 + {num(i + 1)} * {self.sum(digits)}, {num(10 / self.d ** 1.2)})")
        c = num(10 / self.d ** 2)
        return f"{c} * ({' * '.join(self.bind(factors))}) - {c} + {self.pen(1)}"

    def f24(self):
        s = 1 - 1 / (2 * math.sqrt(self.d + 20) - 8.2)
        mu1 = -math.sqrt((LUNACEK_MU ** 2 - 1) / s)
        xh = self.bind([f"({num(2 * math.copysign(1.0, o))} * {x} - {num(LUNACEK_MU)})" for x, o in zip(self.x, self.opt)])
        z = self.matrix(self.rot1() @ self.scaled(100) @ self.rot2(), xh)
        near = self.sumsq(xh)
        far = self.sum([f"power({v} + {num(LUNACEK_MU - mu1)}, 2e0)" for v in xh])
        waves = self.sum([f"cos({num(2 * math.pi)} * {v})" for v in z])
        return (f"least({near}, {num(self.d)} + {num(s)} * {far}) + 10e0 * ({num(self.d)} - {waves}) + {self.pen(1e4)}")


def add_function(prog: Program, x: Sequence[str], fid: int, iid: int = 1, name: str | None = None) -> str:
    """Write one benchmark function into a program as an output column; returns its name."""
    if fid not in FIDS:
        raise ValueError(f"there is no benchmark function {fid}")
    value = getattr(Builder(prog, x, fid, iid), f"f{fid}")()
    name = name or f"bbob_f{fid}_ins{iid}"
    prog.output(name, f"({value} + {num(f_opt(fid, iid))})")
    return name
