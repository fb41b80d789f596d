"""Hierarchical imputation: group statistics from fine levels to coarse ones, with provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.aggregates import counted_quantiles
from plinth.session import broadcast_if_small, checkpointed

ORIGINAL, OVERALL = "Original", "Overall"


def _name(level) -> str:
    return " & ".join(level) if level else OVERALL


def median_hierarchical(df: DataFrame, columns, levels, provenance: str = "_imputed") -> DataFrame:
    """Fills nulls by the median of the first level whose group has one.

    Each level's medians are those of the column as the levels before have
    left it.  Values that are there are never changed, and a row with a null
    in a level's key gets nothing from it.

    What fills a null depends on the row's keys only, so levels work on counts
    of distinct (keys, value), to which each level adds what it has filled;
    medians come from running counts dealt by range.  Rows are read twice, and
    joined once, with what their keys are filled with.
    """
    columns, keys = list(columns), list(dict.fromkeys(k for level in levels for k in level))
    long = df.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.explode(F.array(*(F.struct(F.lit(i).alias("_c"), F.col(c).cast("double").alias("_v")) for i, c in enumerate(columns)))).alias("_x"))
    names = ["_c", *(f"_k{i}" for i in range(len(keys)))]
    cells = checkpointed(long.select(*names[1:], "_x.*").groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("n")))
    known, missing, fills = cells.where("_v is not null"), cells.where("_v is null").drop("_v"), None
    for level in [*levels, ()]:
        own = ["_c", *(f"_k{keys.index(k)}" for k in level)]
        medians = counted_quantiles(known.dropna(subset=own).groupBy(*own, "_v").agg(F.sum("n").alias("n")), own, (0.5,)).select(*own, F.col("q")[0].alias("_v"))
        met = checkpointed(missing.join(medians, own, "left"))
        filled, missing = met.where("_v is not null"), met.where("_v is null").drop("_v")
        known = known.unionByName(filled.select(*known.columns))
        part = filled.select(*names, "_v", F.lit(_name(level)).alias("_by"))
        fills = part if fills is None else fills.unionByName(part)
    pick = lambda i, x: F.max(F.when(F.col("_c") == i, F.col(x))).alias(f"{x}{i}")
    wide = broadcast_if_small(checkpointed(fills.groupBy(*names[1:]).agg(*(pick(i, x) for i in range(len(columns)) for x in ("_v", "_by")))))
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names[1:])]
    out = df.join(wide, on, "left") if on else df.crossJoin(wide)
    kept = [c for c in df.columns if c not in columns]
    return out.select(*kept, *(F.coalesce(F.col(c).cast("double"), f"_v{i}").alias(c) for i, c in enumerate(columns)), *(F.when(F.col(c).isNotNull(), F.lit(ORIGINAL)).otherwise(F.col(f"_by{i}")).alias(c + provenance) for i, c in enumerate(columns)))


def mode_hierarchical(df: DataFrame, columns, levels, unknown: str = "Unknown", provenance: str = "_imputed") -> DataFrame:
    """Fills nulls by the mode of the first level whose group has one (of ties the least), else ``unknown``; every level's modes are those of the column as it was.

    As for medians, levels work on counts of distinct (keys, value), and rows are joined once, with what their keys are filled with.
    """
    columns, keys = list(columns), list(dict.fromkeys(k for level in levels for k in level))
    names, out, picked = [f"_k{i}" for i in range(len(keys))], df, []
    for j, c in enumerate(columns):
        cells = checkpointed(df.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names)), F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("n")))
        known, missing, fills = cells.where("_v is not null"), cells.where("_v is null").select(*names), None
        for level in [*levels, ()]:
            own = [names[keys.index(k)] for k in level]
            counts = (known.dropna(subset=own) if own else known).groupBy(*own, "_v").agg((-F.sum("n")).alias("n"))
            modes = counts.groupBy(*own).agg(F.min(F.struct("n", "_v")).alias("m")).select(*own, F.col("m._v").alias("_v"))
            met = checkpointed(missing.join(modes, own, "left") if own else missing.crossJoin(F.broadcast(modes)))
            part = met.where("_v is not null").select(*(F.col(n).alias(f"{n}_{j}") for n in names), F.col("_v").alias(f"_v{j}"), F.lit(_name(level)).alias(f"_by{j}"))
            fills, missing = part if fills is None else fills.unionByName(part), met.where("_v is null").select(*names)
        fills = broadcast_if_small(checkpointed(fills), 100_000)
        on = [F.col(k).eqNullSafe(F.col(f"{n}_{j}")) for k, n in zip(keys, names)]
        out = out.join(fills, on, "left") if on else out.join(fills, F.lit(True), "left")
        picked.append((c, F.coalesce(F.col(c), f"_v{j}", F.lit(unknown)), F.when(F.col(c).isNotNull(), F.lit(ORIGINAL)).otherwise(F.coalesce(f"_by{j}", F.lit(unknown)))))
    return out.select(*(c for c in df.columns if c not in columns), *(v.alias(c) for c, v, _ in picked), *(by.alias(c + provenance) for c, _, by in picked))
