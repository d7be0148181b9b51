"""Scaling by fitted statistics. Fitting returns a table (column, median, mean, std_pop)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.physics import clip, finite
from isobar.operators.features import numeric_columns

STATS = "column string, median double, mean double, std_pop double"
ACCURACY = 10_000
# Bins of a histogram per column and round.
BINS = 512


def exact_medians(df: DataFrame, columns: Sequence[str], bins: int = BINS) -> dict[str, float | None]:
    """Exact median of each column, None for a column without values.

    The middle values are found by refined histograms: each round one job counts, for all columns at once, the values in
    equal bins of the column's bracket, with the smallest and largest value of each bin. The bin that holds the middle is the next
    bracket; its ends are values, so it holds fewer distinct values each time, however they are spread or repeated. Only the
    bins reach the driver, a fixed number per column and round. ``df`` is read once a round: give a table.
    """
    columns = list(columns)
    clean = df.select(*[finite(F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    ends = clean.agg(*[f(f"c{i}").alias(f"{f.__name__}{i}") for i in range(len(columns)) for f in (F.count, F.min, F.max)]).first()
    medians: dict[str, float | None] = dict.fromkeys(columns)
    # Per column: bracket, values below it, and the places of the two middle values.
    left = {}
    for i, c in enumerate(columns):
        n, lo, hi = ends[f"count{i}"], ends[f"min{i}"], ends[f"max{i}"]
        if n and lo == hi:
            medians[c] = lo
        elif n:
            left[i] = (lo, hi, 0, (n - 1) // 2, n // 2)
    while left:
        found: dict[int, list] = {i: [] for i in left}
        for r in _histograms(clean, {i: x[:2] for i, x in left.items()}, bins):
            found[r["column"]].append((r["bin"], r["n"], r["lo"], r["hi"]))
        for i, rows in found.items():
            _, _, below, first, last = left.pop(i)
            middle = []
            for _, n, lo, hi in sorted(rows):
                middle += [(lo, hi, below, k - below, n) for k in (first, last) if below <= k < below + n]
                below += n
            low, high = middle
            # Two middle values in different bins are the end of one and the start of the other.
            if low[:2] != high[:2]:
                medians[columns[i]] = (low[1] + high[0]) / 2
            elif low[0] == low[1]:
                medians[columns[i]] = low[0]
            else:
                left[i] = (low[0], low[1], low[2], first, last)
    return medians


def _histograms(clean: DataFrame, brackets: Mapping[int, tuple[float, float]], bins: int) -> list:
    """(column, bin, n, lo, hi) of the values of each column inside its bracket."""
    parts = []
    for i, (lo, hi) in brackets.items():
        v, low, high = F.col(f"c{i}"), F.lit(lo), F.lit(hi)
        share = (v - low) / (high - low) if math.isfinite(hi - lo) else (v / 2 - low / 2) / (high / 2 - low / 2)
        place = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
        parts.append(F.when(v.between(lo, hi), F.struct(F.lit(i).alias("column"), place.alias("bin"), v.alias("v"))))
    return (clean.select(F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p")).groupBy("p.column", "p.bin")
            .agg(F.count(F.lit(1)).alias("n"), F.min("p.v").alias("lo"), F.max("p.v").alias("hi")).collect())


def approximate_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    row = df.agg(*[F.percentile_approx(finite(F.col(c).cast("double")), 0.5, ACCURACY).alias(c) for c in columns]).first()
    return {c: row[c] for c in columns}


def fit_scaler(df: DataFrame, columns: Sequence[str] | None = None, median: str = "exact",
               exclude: Sequence[str] = ("location_id",)) -> DataFrame:
    """Median, and mean and population deviation after missing values took the median.

    A column without any value gets median 0, a constant column deviation 1.
    """
    columns = list(columns or numeric_columns(df, exclude))
    medians = {"exact": exact_medians, "approx": approximate_medians}[median](df, columns)
    medians = {c: 0.0 if m is None else m for c, m in medians.items()}
    filled = {c: _filled(c, medians[c]) for c in columns}
    row = df.agg(
        *[F.avg(e).alias(f"{c}__mean") for c, e in filled.items()],
        *[F.stddev_pop(e).alias(f"{c}__std") for c, e in filled.items()],
    ).first()
    rows = [(c, float(medians[c]), row[f"{c}__mean"], row[f"{c}__std"] or 1.0) for c in columns]
    return df.sparkSession.createDataFrame(rows, STATS)


def _filled(c: str, median: float) -> Column:
    return F.coalesce(finite(F.col(c).cast("double")), F.lit(float(median)))


def stats_by_name(stats: DataFrame) -> dict[str, tuple[float, float, float]]:
    """Statistics as plain numbers: one row per column of the model."""
    return {r["column"]: (r["median"], r["mean"], r["std_pop"]) for r in stats.collect()}


def check_columns(df: DataFrame, stats: DataFrame | Mapping, exclude: Sequence[str] = ("location_id",)) -> bool:
    """Whether the numeric columns are exactly those of the statistics."""
    known = stats if isinstance(stats, Mapping) else stats_by_name(stats)
    return set(numeric_columns(df, exclude)) == set(known)


def normalize(df: DataFrame, stats: DataFrame | Mapping, columns: Sequence[str] | None = None,
              on_mismatch: str = "raise") -> DataFrame:
    """Missing values take the median, then (x - mean) / std. Other columns stay as they are.

    If the numeric columns differ from the fitted ones: an error, or new statistics with "refit".
    Passing ``columns`` scales just those.
    """
    known = stats if isinstance(stats, Mapping) else stats_by_name(stats)
    if columns is None:
        if not check_columns(df, known):
            if on_mismatch != "refit":
                raise ValueError(f"columns differ from the fitted ones: {sorted(set(numeric_columns(df)) ^ set(known))}")
            known = stats_by_name(fit_scaler(df))
        columns = list(known)
    return df.withColumns({c: (_filled(c, known[c][0]) - known[c][1]) / known[c][2] for c in columns if c in df.columns})


def denormalize(df: DataFrame, stats: DataFrame | Mapping, columns: Sequence[str] | None = None) -> DataFrame:
    """x * std + mean for the fitted columns that exist, matched by name."""
    known = stats if isinstance(stats, Mapping) else stats_by_name(stats)
    names = [c for c in (columns or known) if c in known and c in df.columns]
    return df.withColumns({c: F.col(c) * known[c][2] + known[c][1] for c in names})


def denormalize_typical(df: DataFrame) -> DataFrame:
    """Denormalise targets with typical values and keep them physically possible."""
    return df.withColumns({
        c: clip(F.col(c) * std + mean, *C.TYPICAL_CLAMPS.get(c, (None, None)))
        for c, (mean, std) in C.TYPICAL_STATS.items() if c in df.columns
    })
