"""Tails of distributions as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

#: Hart's rational approximation of the normal tail in double precision, highest power first.
_TAIL_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_TAIL_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _polynomial(coefficients, x: str) -> str:
    return "(" * (len(coefficients) - 1) + f"CAST({coefficients[0]!r} AS DOUBLE)" + "".join(f" * {x} + CAST({c!r} AS DOUBLE))" for c in coefficients[1:])


def normal_cdf_sql(z: str) -> str:
    """The share of a normal distribution below ``z``."""
    a = f"abs({z})"
    far = f"({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65)))))"  # the tail's continued fraction
    tail = f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * {_polynomial(_TAIL_NUM, a)} / {_polynomial(_TAIL_DEN, a)} ELSE exp(-{a} * {a} / 2) / ({far} * 2.506628274631) END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END)"


def student_two_sided_sql(t: str, freedom: str) -> str:
    """The chance that a Student variable is farther from 0 than ``t``, by Hill's transformation to a normal one: for 20 degrees of freedom or more."""
    a = f"({freedom} - 0.5)"
    y = f"({a} * ln(1 + {t} * {t} / {freedom}))"
    b = f"(48 * {a} * {a})"
    z = f"(((((-0.4 * {y} - 3.3) * {y} - 24.0) * {y} - 85.5) / (0.8 * {y} * {y} + 100 + {b}) + {y} + 3) / {b} + 1) * sqrt({y})"
    return f"2 * {normal_cdf_sql(f'(-1 * {z})')}"


def kolmogorov_sql(x: str, terms: int = 30) -> str:
    """The chance that the scaled greatest gap of an empirical distribution, root of n times the statistic, is over ``x``; its asymptotic series."""
    series = " + ".join(f"{'-' if k % 2 == 0 else ''}2 * exp(-2.0 * {k * k} * {x} * {x})" for k in range(1, terms + 1))
    return f"(CASE WHEN {x} < 0.3 THEN 1.0 ELSE greatest(0.0, least(1.0, {series.replace('+ -', '- ')})) END)"


def digamma_sql(x: str) -> str:
    """The derivative of ln gamma at ``x`` of at least 1: its asymptotic series six steps up, and the recurrence down."""
    y = f"(CAST({x} AS DOUBLE) + 6)"
    series = f"ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - 1 / (252 * pow({y}, 6)) + 1 / (240 * pow({y}, 8))"
    return f"({series} - {' - '.join(f'1 / (CAST({x} AS DOUBLE) + {j})' for j in range(6))})"
