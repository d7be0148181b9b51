"""Training jobs: dataset of all locations, multi-horizon forecaster, evaluation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.operators import align, features, metrics, scaling, sequences, series
from isobar.plans.stage import materialized
from isobar.sources import tables

IDS = ["location_id", "origin_ts"]
MODEL = "target string, feature string, horizon int, value double"


@dataclass
class Dataset:
    """Samples with column ``split``, the statistics that scaled them, and the column lists."""

    samples: DataFrame
    stats: DataFrame
    features: list[str]
    targets: list[str]


def model_rows(unified: DataFrame, chunk: int = series.CHUNK, regular: bool = True) -> DataFrame:
    """Selected model features of a unified series, unscaled."""
    return features.model_features(unified, regular=regular, chunk=chunk)


def build_dataset(unified: DataFrame, per_location: int = 40, seed: int = 42, fit_scope: str = "train",
                  inputs: str = "window", exact_split: bool = True, chunk: int = series.CHUNK,
                  rank: Column | None = None) -> Dataset:
    """Scaled, sampled and split windows of a unified regular series of many locations.

    With fit scope "train" the statistics come from all rows that no validation or test window holds;
    with "first_location" from all rows of the first location by name. ``rank`` replaces the seeded hash
    by which origins are chosen and split; it is a bigint.
    """
    if fit_scope not in ("train", "first_location"):
        raise ValueError(f"fit_scope must be 'train' or 'first_location', not {fit_scope!r}")
    rows = materialized(model_rows(unified, chunk))
    names = [c for c in rows.columns if c not in ("location_id", "ts")]
    targets = [t for t in C.TARGETS if t in names]

    # The choice and the split depend on keys only, so origins are known before scaling.
    origins = materialized(_split(materialized(_origins(unified, per_location, seed, chunk, rank)), exact_split, seed, rank))
    if fit_scope == "train":
        fit_on = sequences.outside_windows(rows, origins.filter(F.col("split") != "train"))
    else:
        fit_on = rows.filter(F.col("location_id") == rows.agg(F.min("location_id")).scalar())
    stats = scaling.fit_scaler(materialized(fit_on), names)
    scaled = scaling.normalize(rows, scaling.stats_by_name(stats), names)
    return Dataset(sequences.windows_at(scaled, origins, names, targets, inputs=inputs), stats, names, targets)


def _origins(unified: DataFrame, per_location: int, seed: int, chunk: int, rank: Column | None = None) -> DataFrame:
    """Keys of the sampled windows. On a regular series the possible origins follow from its extent."""
    ext = align.extents([unified])
    lead, tail = (C.INPUT_STEPS - 1) * C.STEP_SECONDS, C.OUTPUT_STEPS * C.STEP_SECONDS
    usable = align.spine(ext.select(
        "location_id", align.plus_seconds(F.col("start_ts"), lead).alias("start_ts"),
        align.plus_seconds(F.col("end_ts"), -tail).alias("end_ts"),
    ).filter(F.col("start_ts") <= F.col("end_ts")), chunk=chunk)
    return sequences.balance(usable.withColumnRenamed("ts", "origin_ts"), per_location, seed, rank=rank)


def _split(samples: DataFrame, exact: bool, seed: int, rank: Column | None = None) -> DataFrame:
    unique = [*IDS, "copy"]
    if exact:
        return sequences.split_exact(samples, unique, seed=seed, rank=rank)
    return sequences.split_hashed(samples, unique, seed=seed)


@dataclass
class Forecaster:
    """Linear models of all targets: slopes per target and feature, and an intercept per target and step."""

    features: list[str]
    targets: list[str]
    slopes: list[list[float]]
    intercepts: list[list[float]]

    def predict(self, rows: DataFrame, prefix: str = "") -> DataFrame:
        """``rows`` with a column ``{prefix}{target}`` for each target; they have the features at the origin and ``horizon``."""
        out = {}
        for target, slopes, steps in zip(self.targets, self.slopes, self.intercepts):
            intercept = F.element_at(F.array(*[F.lit(float(x)) for x in steps]), F.col("horizon").cast("int"))
            out[f"{prefix}{target}"] = reduce(lambda s, p: s + F.lit(float(p[1])) * F.col(p[0]), zip(self.features, slopes), intercept)
        return rows.withColumns(out)

    def write(self, spark: SparkSession, path: str) -> None:
        rows = [(t, f, None, float(v)) for t, vs in zip(self.targets, self.slopes) for f, v in zip(self.features, vs)]
        rows += [(t, None, h, float(v)) for t, vs in zip(self.targets, self.intercepts) for h, v in enumerate(vs, 1)]
        spark.createDataFrame(rows, MODEL).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def read(spark: SparkSession, path: str, features: Sequence[str], targets: Sequence[str] = C.TARGETS) -> Forecaster:
        rows = spark.read.schema(MODEL).parquet(path).collect()
        slope = {(r["target"], r["feature"]): r["value"] for r in rows if r["feature"] is not None}
        step = {(r["target"], r["horizon"]): r["value"] for r in rows if r["horizon"] is not None}
        steps = max(h for _, h in step)
        return Forecaster(list(features), list(targets), [[slope[t, f] for f in features] for t in targets],
                          [[step[t, h] for h in range(1, steps + 1)] for t in targets])


def normal_sums(samples: DataFrame, feature_names: Sequence[str], n_targets: int, steps: int = C.OUTPUT_STEPS) -> dict[str, float]:
    """Everything that the least squares of all targets and steps depend on, in one pass and one row.

    Each sample has the same features for all its steps, so with an intercept per step the slopes follow from the mean
    target over the steps. The sums are partial in every task, and their number does not depend on the data.
    """
    mean = [F.expr(f"aggregate(y, 0D, (s, v) -> s + v[{t}]) / {steps}") for t in range(n_targets)]
    ready = samples.select(*feature_names, "y", *[m.alias(f"_y{t}") for t, m in enumerate(mean)])
    names = [*feature_names, *[f"_y{t}" for t in range(n_targets)]]
    sums = {"n": F.count(F.lit(1))}
    for i, a in enumerate(names):
        sums[f"s_{i}"] = F.sum(a)
        for j in range(i, len(names)) if i < len(feature_names) else ():
            sums[f"p_{i}_{j}"] = F.sum(F.col(a) * F.col(names[j]))
    for t in range(n_targets):
        for h in range(steps):
            sums[f"y_{t}_{h}"] = F.sum(F.col("y")[h][t].cast("double"))
    return ready.agg(*[c.alias(n) for n, c in sums.items()]).first().asDict()


def fit_forecaster(samples: DataFrame, feature_names: Sequence[str], targets: Sequence[str] = C.TARGETS,
                   steps: int = C.OUTPUT_STEPS, reg: float = 1e-3) -> Forecaster:
    """One linear model per target over all steps, each step with its own intercept, by ridge regression.

    ``samples`` have the features at the origin and ``y``. Only sums reach the driver, which solves one system of as many
    unknowns as features for all targets at once.
    """
    k, m = len(feature_names), len(targets)
    sums = normal_sums(samples, feature_names, m, steps)
    n = sums["n"]
    if not n:
        raise ValueError("no samples to fit on")
    mean = np.array([sums[f"s_{i}"] for i in range(k + m)]) / n
    cov = np.array([[sums[f"p_{min(i, j)}_{max(i, j)}"] for j in range(k + m)] for i in range(k)]) / n - np.outer(mean[:k], mean)
    slopes = np.linalg.solve(cov[:, :k] + reg * np.eye(k), cov[:, k:]).T
    steps_mean = np.array([[sums[f"y_{t}_{h}"] for h in range(steps)] for t in range(m)]) / n
    return Forecaster(list(feature_names), list(targets), slopes.tolist(), (steps_mean - (slopes @ mean[:k])[:, None]).tolist())


def score(model: Forecaster, origins: DataFrame, targets: Sequence[str] = C.TARGETS, steps: int = C.OUTPUT_STEPS,
          keep: Sequence[str] = ()) -> DataFrame:
    """Predictions for all steps after each origin: one row per step, one column per target, still scaled."""
    if "horizon" not in origins.columns:
        origins = origins.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    scored = model.predict(origins, "_predicted_")
    return scored.select(*IDS, "horizon", *keep, *[F.col(f"_predicted_{t}").alias(t) for t in targets])


def evaluate(model: Forecaster, dataset: Dataset, split: str = "test") -> dict[str, DataFrame]:
    """Weighted error on scaled values, and scores per variable in original units.

    Predictions stand beside their targets from the start, so nothing is joined.
    """
    test = sequences.long_targets(dataset.samples.filter(F.col("split") == split), dataset.targets)
    pairs = ", ".join(f"'{t}', `predicted_{t}`, `target_{t}`" for t in dataset.targets)
    scaled = model.predict(test, "predicted_").select(
        *IDS, "copy", "horizon", F.expr(f"stack({len(dataset.targets)}, {pairs}) as (variable, prediction, target)"))
    known = scaling.stats_by_name(dataset.stats)
    std, mean = (_per_variable({t: known[t][i] for t in dataset.targets}) for i in (2, 1))
    original = scaled.withColumns({
        "prediction": F.col("prediction") * std + mean, "target": F.col("target") * std + mean,
    })
    return {"loss": metrics.weighted_mse(scaled), "per_variable": metrics.per_variable(original)}


def _per_variable(values: Mapping[str, float]) -> Column:
    chosen = F.lit(None).cast("double")
    for name, v in values.items():
        chosen = F.when(F.col("variable") == name, F.lit(v)).otherwise(chosen)
    return chosen


def train(spark: SparkSession, unified: DataFrame, path: str | None = None, per_location: int = 40, seed: int = 42,
          chunk: int = series.CHUNK, rank: Column | None = None) -> tuple[Forecaster, Dataset, dict[str, DataFrame]]:
    """Prepare, fit, evaluate, and keep the model with its statistics under ``path``."""
    dataset = build_dataset(materialized(unified), per_location, seed, inputs="last", chunk=chunk, rank=rank)
    dataset.samples = materialized(dataset.samples)
    model = fit_forecaster(dataset.samples.filter(F.col("split") == "train"), dataset.features, dataset.targets)
    scores = evaluate(model, dataset)
    if path:
        model.write(spark, f"{path}/model")
        tables.write_dataset_info(spark, f"{path}/info", dataset.features, dataset.targets, C.INPUT_STEPS,
                                  C.OUTPUT_STEPS, dataset.stats)
        tables.write_feature_list(spark, f"{path}/feature_columns", dataset.features)
    return model, dataset, scores


def readiness(all_locations: DataFrame, observed: DataFrame, min_rows: int = C.INPUT_STEPS + C.OUTPUT_STEPS) -> DataFrame:
    """How many locations are known, and how many have enough rows for a training window."""
    enough = align.row_counts(observed, min_rows=min_rows)
    return all_locations.select("location_id").join(enough, "location_id", "left").agg(
        F.count(F.lit(1)).alias("n_locations"), F.count("n_rows").alias("n_observed"),
        F.count_if(F.col("enough")).alias("n_trainable"),
    )
