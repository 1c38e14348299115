"""Incomplete gamma, normal quantile and Pearson III scores as column expressions.

Scores are limited to +-3.09, so probabilities matter between 0.001 and 0.999 only; the expressions
are accurate to about 1e-12 there and stop caring beyond.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrahaz.functions.values import lit, log_gamma

LIMIT = 3.09
SERIES_UP_TO = 100
"""Shape beyond which the series gives way to an expansion of fixed length."""

# Wichura (1988), Applied Statistics 37, algorithm AS 241, inner and outer rational approximation.
_INNER = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457,
           67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
          (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610,
           28729.085735721942674, 5226.4952788528545610))
_OUTER = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258,
           0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
          (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
           0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9))


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + lit(c)
    return out


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def normal_quantile(p: Column) -> Column:
    """Inverse normal of probabilities from about 1e-11 to 1 - 1e-11."""
    def ratio(parts, x: Column) -> Column:
        return _polynomial(parts[0], x) / _polynomial(parts[1], x)

    def of(q: Column) -> Column:
        tail = F.sqrt(-F.ln(lit(0.5) - F.abs(q)))
        return F.when(F.abs(q) <= 0.425, q * ratio(_INNER, lit(0.180625) - q * q)).otherwise(
            F.signum(q) * ratio(_OUTER, tail - lit(1.6)))

    return _bound(p - lit(0.5), of)


def lower_gamma_ratio(a: Column, y: Column) -> Column:
    """Regularised lower incomplete gamma P(a, y) for shapes of moderate size, by its power series.

    Beyond six deviations over the mean it stays where it is then, next to 1; so the terms needed follow from the shape.
    """
    high = a + lit(6) * F.sqrt(a) + lit(12)
    terms = F.sequence(F.lit(1), F.ceil(lit(20) * F.sqrt(a) + lit(60)).cast("int"))

    def of(x: Column) -> Column:
        total = F.aggregate(
            terms, F.struct(lit(1).alias("t"), lit(1).alias("s")),
            lambda acc, k: F.struct((acc["t"] * x / (a + k)).alias("t"), (acc["s"] + acc["t"] * x / (a + k)).alias("s")),
            lambda acc: acc["s"])
        return F.exp(a * F.ln(x) - x - log_gamma(a + lit(1))) * total

    return F.when(y <= 0, lit(0)).otherwise(_bound(F.least(y, high), of))


def normal_cdf(z: Column) -> Column:
    half = lit(0.5) * lower_gamma_ratio(lit(0.5), z * z / lit(2))
    return F.when(z < 0, lit(0.5) - half).otherwise(lit(0.5) + half)


def _large_gamma_ratio(a: Column, y: Column) -> Column:
    """P(a, y) for large shapes by the uniform expansion, DLMF 8.12, two terms."""
    def of(v: Column) -> Column:
        mu, eta = v["mu"], v["eta"]
        near = F.abs(eta) < 0.02
        c0 = F.when(near, lit(-1 / 3) + eta / lit(12) - lit(2 / 135) * eta * eta + eta * eta * eta / lit(864)).otherwise(lit(1) / mu - lit(1) / eta)
        c1 = F.when(near, lit(-1 / 540) - eta / lit(288) + eta * eta / lit(378)).otherwise(
            lit(1) / (eta * eta * eta) - lit(1) / (mu * mu * mu) - lit(1) / (mu * mu) - lit(1) / (lit(12) * mu))
        rest = F.exp(lit(-0.5) * a * eta * eta) / F.sqrt(lit(2 * 3.141592653589793) * a) * (c0 + c1 / a)
        return F.greatest(F.least(normal_cdf(eta * F.sqrt(a)) - rest, lit(1)), lit(0))

    def bent(mu: Column) -> Column:
        eta = F.signum(mu) * F.sqrt(F.greatest(lit(2) * (mu - F.log1p(mu)), lit(0)))
        return _bound(F.struct(mu.alias("mu"), eta.alias("eta")), of)

    return F.when(y <= 0, lit(0)).otherwise(_bound(y / a - lit(1), bent))


def pearson3_score(x: str, p_zero: str, loc: str, scale: str, skew: str) -> Column:
    """Normal score of a value under Pearson III with a share of zeros; traces and the distribution's limit have rules of their own."""
    x, p_zero, loc, scale, skew = (F.col(c) for c in (x, p_zero, loc, scale, skew))
    flat = F.abs(skew) < 1e-9
    z = F.when(scale > 0, (x - loc) / scale)
    beta = lit(2) / F.when(~flat, skew)

    def part(v: Column) -> Column:
        a, y = v["a"], v["y"]
        return F.when(a > SERIES_UP_TO, _large_gamma_ratio(a, y)).otherwise(lower_gamma_ratio(a, y))

    gamma = _bound(F.struct((beta * beta).alias("a"), (beta * (z + beta)).alias("y")), part)
    end = loc - lit(2) * scale / F.when(~flat, skew)
    cdf = (
        F.when((x >= end) & (skew < 0), lit(0.9995)).when((x <= end) & (skew > 0), lit(0.0005))
        .when((x < 0.0005) & (p_zero <= 0), lit(0.0005)).when((x < 0.0005) & (p_zero > 0), lit(0))
        .when(flat, normal_cdf(z)).when(skew > 0, gamma).otherwise(lit(1) - gamma))
    prob = F.greatest(F.least(p_zero + (lit(1) - p_zero) * cdf, lit(0.9995)), lit(0.0005))
    return F.greatest(F.least(normal_quantile(prob), lit(LIMIT)), lit(-LIMIT))
