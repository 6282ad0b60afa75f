"""Resampling and agreement statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 20260825
REPLICATES = 2000
#: Draws of a chunk of replicates; chunks take the generator's stream in the same order as one call.
_CHUNK = 4_000_000


def resampled_means(values: np.ndarray, replicates: int = REPLICATES, seed: int = SEED, weights: np.ndarray | None = None) -> np.ndarray:
    """Means of samples with replacement; with weights, ratios of sums (clusters of rows)."""
    rng = np.random.default_rng(seed)
    n, out, step = len(values), [], max(1, _CHUNK // max(1, len(values)))
    for at in range(0, replicates, step):
        draw = rng.integers(0, n, size=(min(step, replicates - at), n))
        out.append(values[draw].mean(axis=1) if weights is None else values[draw].sum(axis=1) / weights[draw].sum(axis=1))
    return np.concatenate(out)


#: Fields of an interval's row, and the tails that it leaves out (fixed values).
_CI = "n bigint, mean double, ci95_low double, ci95_high double"
TAILS = (0.025, 0.975)


def _interval(sums: np.ndarray, counts: np.ndarray | None, seed: int, replicates: int) -> dict[str, float]:
    """A row of ``_CI`` over values, or over clusters by their sums and counts; without any, all but n is null."""
    row = dict.fromkeys(field.split()[0] for field in _CI.split(", "))
    row["n"] = len(sums) if counts is None else int(counts.sum())
    if len(sums):
        ends = np.quantile(resampled_means(sums, replicates, seed, counts), TAILS)
        row |= {"mean": float(sums.sum() / counts.sum() if counts is not None else sums.mean()), "ci95_low": float(ends[0]), "ci95_high": float(ends[1])}
    return row


def mean_ci(values, seed: int = SEED, replicates: int = REPLICATES) -> dict[str, float]:
    """Count, mean and percentile interval of the finite values, in the order given."""
    values = np.array(values, dtype=np.float64)
    return _interval(values[np.isfinite(values)], None, seed, replicates)


def cluster_mean_ci(sums, counts, seed: int = SEED, replicates: int = REPLICATES) -> dict[str, float]:
    """The same over clusters, given each cluster's sum and count."""
    sums, counts = np.array(sums, dtype=np.float64), np.array(counts, dtype=np.float64)
    return _interval(sums, counts, seed, replicates) | {"clusters": len(sums)}


def bootstrap(df: DataFrame, by: list[str], value: str, order: str, seed: int = SEED, replicates: int = REPLICATES) -> DataFrame:
    """Bootstrap interval of the mean by group.  ``order`` fixes the row order that the draws refer to.

    A group's finite values meet in one Python call, for the interval depends on the
    generator's sequence; of large groups, :func:`cluster_bootstrap` sees the clusters alone.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, **mean_ci(pdf[value].to_numpy(), seed, replicates)}])

    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    return df.select(*by, value, order).filter(F.col(value).isNotNull()).groupBy(*by).applyInPandas(run, f"{keys}, {_CI}")


def cluster_bootstrap(df: DataFrame, by: list[str], value: str, cluster: str, seed: int = SEED, replicates: int = REPLICATES) -> DataFrame:
    """Clusters are summed up first (with a map-side combine); Python sees one row for each cluster."""
    sums = df.filter(F.col(value).isNotNull()).groupBy(*by, cluster).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cluster, kind="stable")
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in by}, **cluster_mean_ci(pdf["_s"], pdf["_n"], seed, replicates)}])

    keys = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by)
    return sums.groupBy(*by).applyInPandas(run, f"{keys}, n bigint, clusters bigint, mean double, ci95_low double, ci95_high double")


def icc_a1(a: str, b: str, *by: str):
    """``df -> by, n, icc``: two-way absolute agreement of single measures a and b, from sums alone."""

    def run(df: DataFrame) -> DataFrame:
        x, y = F.col(a), F.col(b)
        s = df.groupBy(*by).agg(
            F.count("*").alias("n"), F.avg(x).alias("_ma"), F.avg(y).alias("_mb"),
            F.var_samp(x + y).alias("_vs"), F.var_samp(x - y).alias("_vd"),
        )
        n = F.col("n")
        rows, error = F.col("_vs") / 2, F.col("_vd") / 2  # mean squares of rows and of the residual, for two columns
        columns = n * F.pow(F.col("_ma") - F.col("_mb"), 2) / 2
        low = rows + error + 2 * (columns - error) / n
        return s.select(*by, "n", F.when((n > 1) & (F.abs(low) > 1e-12), (rows - error) / low).alias("icc"))

    return run


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def lcg_index(i: Column, rep: Column, n: Column, seed: int = 42) -> Column:
    """The row that draw i of a replicate takes: a congruential rule that any engine evaluates alike."""
    return F.pmod(F.pmod(i * 1103515245 + rep * 12345 + seed, F.lit(2147483647)), n)
