"""Scores of predictions against truth. Pairs are long: one row per sequence, step and variable."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar import constants as C

STEP = ["location_id", "origin_ts", "horizon"]
IDS = [*STEP, "variable"]


def pair(predictions: DataFrame, truth: DataFrame, variables: Sequence[str] = C.TARGETS, ids: Sequence[str] = STEP) -> DataFrame:
    """``variable``, ``prediction`` and ``target`` of the steps that both sides have.

    Both sides have one row per step with a column per variable; the wide rows are joined, and only then turned into one
    row per variable, so the shuffle carries each step once.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*ids, F.struct(*[F.col(v).cast("double").alias(v) for v in variables]).alias(name))

    both = side(predictions, "_p").join(side(truth, "_t"), list(ids))
    values = [F.struct(F.lit(v).alias("variable"), F.col("_p")[v].alias("prediction"), F.col("_t")[v].alias("target")) for v in variables]
    return both.select(*ids, F.inline(F.array(*values)))


def _weight(variable: Column, weights: Mapping[str, float]) -> Column:
    chosen = F.lit(1.0)
    for name, w in weights.items():
        chosen = F.when(variable == name, F.lit(w)).otherwise(chosen)
    return chosen


def weighted_mse(pairs: DataFrame, weights: Mapping[str, float] = C.LOSS_WEIGHTS, prediction: str = "prediction",
                 target: str = "target") -> DataFrame:
    """Mean over all values of weight times squared error."""
    error = F.col(prediction) - F.col(target)
    return pairs.agg(F.avg(_weight(F.col("variable"), weights) * error * error).alias("weighted_mse"))


def per_variable(pairs: DataFrame, prediction: str = "prediction", target: str = "target",
                 by: Sequence[str] = ("variable",)) -> DataFrame:
    """MSE, RMSE, MAE and R² of each variable; pairs with a missing side do not count."""
    e = F.col(prediction) - F.col(target)
    known = pairs.filter(F.col(prediction).isNotNull() & F.col(target).isNotNull())
    total = F.var_pop(target) * F.count(F.lit(1))
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(total != 0, 1 - F.sum(e * e) / total).otherwise(F.lit(0.0)).alias("r2"),
    )
