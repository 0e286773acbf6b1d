"""Tail probabilities and quantiles as JVM expressions, and the few scalars behind them.

The error function is Cody's rational approximation (1969) and the normal quantile that of
Wichura (AS 241, 1988); both have relative errors near the double precision. Nothing here
runs in Python per row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_ND = NormalDist()

# Coefficients of the published approximations, highest power first.
ERF_UP = (1.85777706184603153e-1, 3.16112374387056560e0, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
ERF_DOWN = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
ERFC_UP = (
    2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594e0, 6.61191906371416295e1, 2.98635138197400131e2,
    8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3,
)
ERFC_DOWN = (
    1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3,
    3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3,
)
FAR_UP = (
    1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2,
    6.58749161529837803e-4,
)
FAR_DOWN = (
    1.0, 2.56852019228982242e0, 1.87295284992346047e0, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3,
)
CENTER_UP = (
    2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4,
    1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0,
)
CENTER_DOWN = (
    5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4,
    5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0,
)
NEAR_UP = (
    7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0,
    3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0,
)
NEAR_DOWN = (
    1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1,
    6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0,
)
TAIL_UP = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2,
    2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0,
)
TAIL_DOWN = (
    2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4,
    1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0,
)


def _bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f reads it."""
    return F.element_at(F.transform(F.array(x.cast("double")), f), 1)


def _poly(t: Column, coefficients: Sequence[float]) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * t + c
    return out


def _ratio(t: Column, up: Sequence[float], down: Sequence[float]) -> Column:
    return _poly(t, up) / _poly(t, down)


def _erfc(x: Column) -> Column:
    y = F.abs(x)
    square = y * y
    near = 1 - x * _ratio(square, ERF_UP, ERF_DOWN)
    # exp(-y^2) as a product, so that the rounding of y^2 is not magnified
    head = F.floor(y * 16) / 16
    bell = F.exp(-head * head) * F.exp(-(y - head) * (y + head))
    middle = bell * _ratio(y, ERFC_UP, ERFC_DOWN)
    inverse = 1 / F.greatest(square, F.lit(1.0))
    far = bell * (1 / math.sqrt(math.pi) - inverse * _ratio(inverse, FAR_UP, FAR_DOWN)) / F.greatest(y, F.lit(1.0))
    tail = F.when(y <= 4, middle).when(y < 27.3, far).otherwise(F.lit(0.0))
    return F.when(y <= 0.46875, near).when(x < 0, 2 - tail).otherwise(tail)


def _known(x: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & ~F.isnan(x), value)


def erfc(x: Column) -> Column:
    """Complementary error function; null and NaN give null."""
    return _bound(x, lambda v: _known(v, _erfc(v)))


def norm_cdf(x: Column) -> Column:
    """Standard normal distribution function."""
    return 0.5 * erfc(-x / math.sqrt(2.0))


def norm_ppf(p: Column) -> Column:
    """Standard normal quantile, null outside (0, 1)."""

    def quantile(v: Column) -> Column:
        q = v - 0.5
        low = F.least(v, 1 - v)
        r = F.sqrt(-F.log(F.when(low > 0, low).otherwise(0.5)))
        side = F.when(r <= 5, _ratio(r - 1.6, NEAR_UP, NEAR_DOWN)).otherwise(_ratio(r - 5, TAIL_UP, TAIL_DOWN))
        inner = q * _ratio(0.180625 - q * q, CENTER_UP, CENTER_DOWN)
        return F.when((v > 0) & (v < 1), F.when(F.abs(q) <= 0.425, inner).when(q < 0, -side).otherwise(side))

    return _bound(p, lambda v: _known(v, quantile(v)))


def chi2_sf(x: Column, k: Column) -> Column:
    """Upper tail of chi-square with a whole number of degrees of freedom.

    Q(a + 1) = Q(a) + h^a e^-h / Gamma(a + 1), from e^-h or erfc(sqrt h), h = x / 2. Null for
    negative x.
    """

    def tail(v: Column) -> Column:
        h, n = v / 2, k.cast("int")
        odd = n % 2 == 1
        root = F.sqrt(h)
        first = F.when(odd, _erfc_of(root)).otherwise(F.exp(-h))
        # the term before the first one added: its successor is this times h / (a + 1)
        term = F.when(odd, F.exp(-h) / (root * math.sqrt(math.pi))).otherwise(F.exp(-h))
        steps = F.when(n > 2, F.sequence(F.lit(1), F.floor((n - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
        shift = F.when(odd, 0.5).otherwise(0.0)
        start = F.struct(first.alias("q"), term.alias("t"))

        def add(acc: Column, i: Column) -> Column:
            t = acc["t"] * h / (i - shift)
            return F.struct((acc["q"] + t).alias("q"), t.alias("t"))

        total = F.aggregate(steps, start, add, lambda acc: acc["q"])
        return F.when(v == 0, 1.0).when(v > 0, F.least(total, F.lit(1.0)))

    return _bound(x, lambda v: F.when(k.isNotNull(), _known(v, tail(v))))


def _erfc_of(x: Column) -> Column:
    return _bound(x, _erfc)


def log_gamma(x: Column) -> Column:
    """Log of the gamma function for x >= 1: Stirling's series at x + 8."""

    def value(v: Column) -> Column:
        z = v + 8
        rise = v
        for i in range(1, 8):
            rise = rise * (v + i)
        w = 1 / (z * z)
        series = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z
        return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - F.log(rise)

    return _bound(x, lambda v: _known(v, F.when(v >= 1, value(v))))


def two_sided(t: Column) -> Column:
    """Two-sided normal p-value."""
    return 2 * norm_cdf(-F.abs(t))


def norm_quantile(p: float) -> float:
    return _ND.inv_cdf(p)


def norm_density(z: float) -> float:
    return _ND.pdf(z)
