"""Normal density, pooled t and the p-value of Student's t as column expressions; the p-value also as plain arithmetic."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_pdf(x: Column, mean: Column, std: Column) -> Column:
    return F.exp(F.lit(-0.5) * F.pow((x - mean) / std, F.lit(2.0))) / (F.sqrt(F.lit(2.0) * F.pi()) * std)


def two_sided_p(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if not (math.isfinite(t) and df > 0):
        return 0.0 if math.isinf(t) and df > 0 else math.nan
    return _regularised_beta(df / (df + t * t), t * t / (df + t * t), df / 2, 0.5)


def _log_half_step(a: float) -> float:
    """log(gamma(a + 1/2) / gamma(a)), without the difference of two large logarithms."""
    shift = 16
    z = a + shift
    rest = lambda w: 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5)
    ahead = z * math.log1p(0.5 / z) + 0.5 * math.log(z) - 0.5 + rest(z + 0.5) - rest(z)
    return ahead - math.fsum(math.log1p(0.5 / (a + j)) for j in range(shift))


def _regularised_beta(x: float, y: float, a: float, b: float, steps: int | None = None) -> float:
    """I_x(a, b), where y = 1 - x and a or b is 1/2. Not to converge within ``steps`` is an error."""
    if x <= 0 or y <= 0:
        return float(y <= 0)
    if x > (a + 1) / (a + b + 2):
        return 1 - _regularised_beta(y, x, b, a, steps)
    log_x = math.log1p(-y) if y < 0.5 else math.log(x)
    log_y = math.log1p(-x) if x < 0.5 else math.log(y)
    log_front = _log_half_step(a if b == 0.5 else b) - 0.5 * math.log(math.pi) + a * log_x + b * log_y
    # continued fraction, evaluated forwards with the ratio of successive convergents; its length grows with the root
    steps = steps or 10_000 + int(100 * math.sqrt(max(a, b)))
    tiny = 1e-300
    numer, denom = 1.0, 1.0 / ((1 - (a + b) * x / (a + 1)) or tiny)
    total = denom
    for m in range(1, steps):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            denom = 1.0 / ((1 + step * denom) or tiny)
            numer = (1 + step / numer) or tiny
            total *= numer * denom
        if abs(numer * denom - 1) < 1e-15:
            return math.exp(log_front) * total / a
    raise ArithmeticError(f"no convergence within {steps} steps for x = {x}, a = {a}, b = {b}")


def pooled_t(n_a: Column, mean_a: Column, var_a: Column, n_b: Column, mean_b: Column, var_b: Column) -> Column:
    pooled = ((n_a - 1) * var_a + (n_b - 1) * var_b) / (n_a + n_b - 2)
    return (mean_a - mean_b) / F.sqrt(pooled * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))


# --- the p-value as a column --------------------------------------------------------------------------

SHIFT = 16  # steps up to where the series for the gamma function holds
CLOSE = 1e-15  # change of the fraction by one more term at which it has converged
TINY = 1e-300


def _or_tiny(x: Column) -> Column:
    return F.when(x == 0, TINY).otherwise(x)


def _log_half_step_column(a: Column) -> Column:
    """As ``_log_half_step``."""

    def rest(w: Column) -> Column:
        return 1 / (12 * w) - 1 / (360 * w * w * w) + 1 / (1260 * w * w * w * w * w)

    z = a + SHIFT
    ahead = z * F.log1p(0.5 / z) + 0.5 * F.ln(z) - 0.5 + rest(z + 0.5) - rest(z)
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(SHIFT - 1)), F.lit(0.0), lambda total, j: total + F.log1p(0.5 / (a + j)))
    return ahead - steps


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function at x, as an aggregate over its terms.

    Two terms a step. How many it takes grows with the root of the larger parameter; a fraction that has converged stays as it
    is, and one that has not after all steps stops the query.
    """
    steps = F.lit(1_000) + (20 * F.sqrt(F.greatest(a, b))).cast("bigint")
    first = 1 / _or_tiny(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("numer"), first.alias("denom"), first.alias("total"), F.lit(1.0).alias("change"))

    def term(state: Column, coefficient: Column) -> Column:
        parts = F.struct(_or_tiny(1 + coefficient / state["numer"]).alias("n"), (1 / _or_tiny(1 + coefficient * state["denom"])).alias("d"))
        return _let(parts, lambda p: F.struct(
            p["n"].alias("numer"), p["d"].alias("denom"), (state["total"] * p["n"] * p["d"]).alias("total"),
            F.abs(p["n"] * p["d"] - 1).alias("change")))

    def step(state: Column, m: Column) -> Column:
        m = m.cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(state["change"] < CLOSE, state).otherwise(_let(term(state, even), lambda s: term(s, odd)))

    done = F.aggregate(F.sequence(F.lit(1).cast("bigint"), steps), start, step)
    failed = F.raise_error(F.concat(F.lit("the p-value has not converged for x = "), x.cast("string"))).cast("double")
    return _let(done, lambda d: F.when(d["change"] < CLOSE, d["total"]).otherwise(failed))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def two_sided_p_column(t: Column, dof: Column) -> Column:
    """P(|T| >= |t|) for Student's t, as ``two_sided_p`` gives it; null where t or the degrees of freedom are, or are no numbers."""

    def parameters(v: Column) -> Column:
        x, y, a, half = v["dof"] / (v["dof"] + v["t"] * v["t"]), v["t"] * v["t"] / (v["dof"] + v["t"] * v["t"]), v["dof"] / 2, F.lit(0.5)
        # the fraction converges fast on one side of the mean of the beta distribution, so the other side is the complement
        return F.struct(x.alias("x"), y.alias("y"), a.alias("a"), (x > (a + 1) / (a + half + 2)).alias("swapped"))

    def share(v: Column) -> Column:
        x, y, a, half = v["x"], v["y"], v["a"], F.lit(0.5)
        log_x = F.when(y < 0.5, F.log1p(-y)).otherwise(F.ln(x))
        log_y = F.when(x < 0.5, F.log1p(-x)).otherwise(F.ln(y))
        front = F.exp(_log_half_step_column(a) - 0.5 * math.log(math.pi) + a * log_x + half * log_y)
        swapped = v["swapped"]
        # one fraction, as both arms of a condition would be worked out
        sides = F.struct(F.when(swapped, y).otherwise(x).alias("x"), F.when(swapped, half).otherwise(a).alias("a"),
                         F.when(swapped, a).otherwise(half).alias("b"))
        part = front * _let(sides, lambda s: _fraction(s["x"], s["a"], s["b"]) / s["a"])
        return F.when(x == 0, 0.0).when(y == 0, 1.0).when(swapped, 1 - part).otherwise(part)

    t, dof = t.cast("double"), dof.cast("double")
    infinite = F.abs(t) == float("inf")
    known = t.isNotNull() & ~F.isnan(t) & ~infinite & (dof > 0) & ~F.isnan(dof)
    p = _let(_let(F.struct(t.alias("t"), dof.alias("dof")), parameters), share)
    return F.when(infinite & (dof > 0), 0.0).when(known & (t == 0), 1.0).when(known, p)
