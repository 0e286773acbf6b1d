"""Pieces of SQL text shared by the oracle texts."""

from __future__ import annotations

W = "partition by symbol order by datetime"


def frame(n: int, shift: int = 0) -> str:
    if shift == 0:
        return f"rows between {n - 1} preceding and current row"
    return f"rows between {n - 1 + shift} preceding and {shift} preceding"


def roll(fn: str, c: str, n: int, w: str = W, need: int | None = None, shift: int = 0) -> str:
    f = f"over ({w} {frame(n, shift)})"
    call = fn.format(c) if "{}" in fn else f"{fn}({c})"
    return f"case when count({c}) {f} >= {n if need is None else need} then {call} {f} end"


def mean(c, n, w=W, need=None, shift=0):
    return roll("avg", c, n, w, need, shift)


def std(c, n, w=W, need=None, shift=0):
    return roll("stddev_samp", c, n, w, need, shift)


def med(c, n, w=W, need=None, shift=0):
    return roll("quantile_cont({}, 0.5)", c, n, w, need, shift)


def z(c, n, w=W):
    return f"({c} - {mean(c, n, w)}) / nullif({std(c, n, w)}, 0)"


def ln(x: str) -> str:
    return f"case when {x} > 0 then ln({x}) end"


def lnr(a: str, b: str) -> str:
    return ln(f"({a}) / nullif({b}, 0)")


def rnd(cols: list[str] | str, d: int = 6) -> str:
    names = cols.split() if isinstance(cols, str) else cols
    return ", ".join(f"round({c}, {d}) as {c}" for c in names)


def hash_int(text: str) -> str:
    return f"cast('0x' || substr(md5({text}), 1, 8) as bigint)"


def erf(x: str) -> str:
    """Error function as its series of positive terms exp(-x^2) x^(2m+1) / Gamma(m + 3/2)."""
    terms = f"exp(-({x}) * ({x}) + (2 * m + 1) * ln(abs({x})) - lgamma(m + 1.5))"
    series = f"sign({x}) * list_sum(list_transform(range(0, 160), lambda m: {terms}))"
    return f"(case when {x} is null then null when {x} = 0 then 0 when abs({x}) > 6 then sign({x}) else {series} end)"


def cdf(x: str) -> str:
    return f"(0.5 * (1 + {erf(f'(({x}) / sqrt(2))')}))"


def chi2_tail(x: str, k: int) -> str:
    """Upper tail for one or an even number of degrees of freedom."""
    if k == 1:
        return f"(1 - {erf(f'sqrt({x} / 2)')})"
    terms = f"exp(-({x}) / 2 + j * ln(({x}) / 2) - lgamma(j + 1.0))"
    return f"list_sum(list_transform(range(0, {k // 2}), lambda j: {terms}))"
