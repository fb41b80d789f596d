"""SQL of least squares by sweeps of the normal equations: the oracles of the linear models."""

from __future__ import annotations

from plinth.functions import scores
from plinth.operators.encode import hashed_sql

#: Features without an exact linear dependence, each as the SQL that centres and scales it, so sums stay small.
REGULAR = ["engine_cc_val", "mileage", "year", "risk"]
SCALED = {"engine_cc_val": "(engine_cc_val - 2250) / 1000", "mileage": "(mileage - 25000) / 10000", "year": "year - 1995", "risk": "risk / 100"}

_LADDER = " + ".join("CASE " + " ".join(f"WHEN {p}_{s} = 1 THEN {w}" for s, w in zip(scores.STATES, scores.WEIGHTS[p])) + " ELSE 0 END" for p in scores.SINGLE)
_PIECES = " + ".join(f"{w} * {g}_{side}_{s}" for g in ("door", "fender") for side in scores.SIDES for s, w in zip(scores.STATES, scores.WEIGHTS[g]))
#: The rows of ``modelling.frame``.
FRAME = f"""f AS (SELECT *, {', '.join(f'{e} AS z_{c}' for c, e in SCALED.items())}, 1.0 AS z_one FROM (
        SELECT ad_id, brand, series, price, ln(1 + price) AS y, power_hp_val, torque_nm, engine_cc_val, CAST(coalesce(kb_mileage, gb_mileage) AS DOUBLE) AS mileage, CAST(coalesce(kb_year, gb_year) AS DOUBLE) AS year,
               CAST({_LADDER} + {_PIECES} AS DOUBLE) AS risk, {hashed_sql('ad_id', 42, 5)} AS fold, {hashed_sql('ad_id', 42, 100)} < 80 AS is_train
        FROM listings WHERE price > 0) WHERE power_hp_val IS NOT NULL AND torque_nm IS NOT NULL AND mileage IS NOT NULL AND year IS NOT NULL)"""


def swept(name: str, sums: str, n: int, extra: tuple[str, ...] = ("y",), key: str = "k") -> str:
    """CTEs ``name_0 .. name_n`` from ``sums``, rows of ``key, g_i_j, g_i_y``; the last holds the inverse and, for each extra column, the coefficients."""
    cols = [*range(n), *extra]
    out = [f"{name}_0 AS ({sums})"]
    for p in range(n):
        cell = lambda i, j: f"g_{i}_{j}"
        parts = []
        for i in range(n):
            for j in cols:
                if i == p:
                    e = f"1 / {cell(p, p)}" if j == p else f"{cell(p, j)} / {cell(p, p)}"
                else:
                    e = f"-{cell(i, p)} / {cell(p, p)}" if j == p else f"{cell(i, j)} - {cell(i, p)} * {cell(p, j)} / {cell(p, p)}"
                parts.append(f"{e} AS {cell(i, j)}")
        out.append(f"{name}_{p + 1} AS (SELECT {key}, {', '.join(parts)} FROM {name}_{p})")
    return ", ".join(out)


def _sums(columns: list[str], of: str = "") -> str:
    return ", ".join([*(f"sum({of}{a} * {of}{b}) AS g_{i}_{j}" for i, a in enumerate(columns) for j, b in enumerate(columns)), *(f"sum({of}{a} * {of}y) AS g_{i}_y" for i, a in enumerate(columns))])


def fitted(name: str, features: list[str], where: str = "true") -> str:
    """CTEs of one fit with an intercept on the rows of ``f`` that ``where`` picks; predictions in ``name_p``."""
    z = ["z_one", *(f"z_{c}" for c in features)]
    sums = f"SELECT 0 AS k, {_sums(z)} FROM f WHERE {where}"
    predicted = " + ".join(f"{c} * g_{i}_y" for i, c in enumerate(z))
    return f"{swept(name, sums, len(z))}, {name}_p AS (SELECT f.*, {predicted} AS prediction FROM f, {name}_{len(z)})"


def by_fold(name: str, features: list[str]) -> str:
    """CTEs of five fits, each on the other folds; ``name_e`` has ``fold, rmse`` on the fold itself."""
    z = ["z_one", *(f"z_{c}" for c in features)]
    sums = f"SELECT k.k, {_sums(z)} FROM f JOIN (SELECT unnest(range(0, 5)) AS k) k ON f.fold <> k.k GROUP BY k.k"
    predicted = " + ".join(f"{c} * g_{i}_y" for i, c in enumerate(z))
    return f"{swept(name, sums, len(z))}, {name}_e AS (SELECT fold, sqrt(avg(pow(y - ({predicted}), 2))) AS rmse FROM f JOIN {name}_{len(z)} ON f.fold = k GROUP BY fold)"


METRICS = "round(sqrt(avg(pow(y - prediction, 2))), 4) AS rmse, round(avg(abs(y - prediction)), 4) AS mae, round(1 - sum(pow(y - prediction, 2)) / (count(*) * var_pop(y)), 4) AS r2"
