"""Supervised windows, and the samples and splits taken from them."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isobar import constants as C
from isobar.functions.timegrid import sql_seconds
from isobar.operators import series

KEYS = ["location_id"]


def windows(df: DataFrame, features: Sequence[str], targets: Sequence[str] = C.TARGETS,
            input_steps: int = C.INPUT_STEPS, output_steps: int = C.OUTPUT_STEPS, inputs: str = "window",
            keys: Sequence[str] = KEYS, ts: str = "ts", regular: bool = False, step: int = C.STEP_SECONDS,
            chunk: int = series.CHUNK, bucket_seconds: int = 30 * 86400) -> DataFrame:
    """One row per position that has enough rows before and after it.

    ``origin_ts`` is the time of the last input row. ``y`` holds the target values of the following
    steps. ``X`` holds the feature values of the input rows, single precision; with inputs "last" the
    features of the origin row stay as plain columns instead.

    Values must be filled before; anything missing counts as 0.
    """
    if regular:
        placed = df.withColumn("_pos", series.chunk_of(sql_seconds(ts), step))
    else:
        placed = series.row_positions(df, keys, [F.col(ts)], series.chunk_of(sql_seconds(ts), bucket_seconds), "_pos")
    w = series.chunk_window(keys, "_pos")
    before = w.rowsBetween(-(input_steps - 1), 0)
    after = w.rowsBetween(1, output_steps)
    known = [t for t in targets if t in df.columns]
    spread = series.with_halo(placed, keys, "_pos", input_steps - 1, output_steps, chunk)
    if inputs == "window":
        kept = [F.collect_list(_vector(features)).over(before).alias("X")]
    elif inputs == "last":
        kept = [F.col(c) for c in features]
    else:
        raise ValueError(f"inputs must be 'window' or 'last', not {inputs!r}")
    wide = spread.select(
        *keys, F.col(ts).alias("origin_ts"), "_pos", series.CHUNK_COL, *kept,
        F.count(F.lit(1)).over(before).alias("_n_in"),
        F.collect_list(_vector(known)).over(after).alias("y"),
    )
    whole = (F.col("_n_in") == input_steps) & (F.size("y") == output_steps)
    return series.drop_halo(wide, "_pos", chunk).filter(whole).drop("_pos", "_n_in")


def windows_at(df: DataFrame, origins: DataFrame, features: Sequence[str], targets: Sequence[str] = C.TARGETS,
               input_steps: int = C.INPUT_STEPS, output_steps: int = C.OUTPUT_STEPS, inputs: str = "window",
               keys: Sequence[str] = KEYS, ts: str = "ts", step: int = C.STEP_SECONDS) -> DataFrame:
    """``windows`` of a regular series at the given origins only, with the other columns of ``origins``.

    The origins name the ticks they need, and only rows at those ticks go on, before anything is put together; a row
    goes to each of its origins, so a group has as many rows as a window has steps. Origins without a whole window are left out.
    """
    if inputs not in ("window", "last"):
        raise ValueError(f"inputs must be 'window' or 'last', not {inputs!r}")
    known = [t for t in targets if t in df.columns]
    needed = window_ticks(origins.select(*keys, "origin_ts").distinct(), input_steps, output_steps, step)
    ids = [*keys, "origin_ts"]
    rows = df.withColumn("_tick", series.chunk_of(sql_seconds(ts), step)).join(needed, [*keys, "_tick"])
    past, at = F.col("_ahead") <= 0, F.col("_ahead") == 0

    def in_order(chosen: Column, columns: Sequence[str]) -> Column:
        pairs = F.sort_array(F.collect_list(F.when(chosen, F.struct("_ahead", _vector(columns).alias("v")))))
        return F.transform(pairs, lambda p: p["v"])

    kept = [in_order(past, features).alias("X")] if inputs == "window" else [F.max(F.when(at, F.col(c))).alias(c) for c in features]
    found = rows.groupBy(*ids).agg(*kept, F.count_if(past).alias("_n_in"), in_order(~past, known).alias("y"))
    whole = found.filter((F.col("_n_in") == input_steps) & (F.size("y") == output_steps)).drop("_n_in")
    return whole.join(origins, ids)


def window_ticks(origins: DataFrame, input_steps: int = C.INPUT_STEPS, output_steps: int = C.OUTPUT_STEPS, step: int = C.STEP_SECONDS) -> DataFrame:
    """One row per origin and tick of its window: ``_tick``, and ``_ahead``, its distance in steps from the origin."""
    return origins.withColumn("_ahead", F.explode(F.sequence(F.lit(1 - input_steps), F.lit(output_steps)))).withColumn(
        "_tick", series.chunk_of(sql_seconds("origin_ts"), step) + F.col("_ahead"))


def outside_windows(df: DataFrame, origins: DataFrame, keys: Sequence[str] = KEYS, ts: str = "ts", step: int = C.STEP_SECONDS) -> DataFrame:
    """Rows of a regular series that no window of the given origins holds."""
    taken = window_ticks(origins.select(*keys, "origin_ts").distinct(), step=step).select(*keys, "_tick")
    return df.withColumn("_tick", series.chunk_of(sql_seconds(ts), step)).join(taken, [*keys, "_tick"], "left_anti").drop("_tick")


def _vector(columns: Sequence[str]) -> Column:
    return F.expr("array(" + ", ".join(f"coalesce(cast({c} as float), 0F)" for c in columns) + ")")


def long_targets(samples: DataFrame, targets: Sequence[str] = C.TARGETS) -> DataFrame:
    """One row per horizon step (from 1), with one column per target."""
    others = [c for c in samples.columns if c not in ("X", "y")]
    return samples.select(*others, F.posexplode("y").alias("_h", "_t")).select(
        *others, (F.col("_h") + 1).alias("horizon"),
        *[F.col("_t")[i].cast("double").alias(f"target_{t}") for i, t in enumerate(targets)],
    )


def _hash(seed: int, columns: Sequence[str]) -> Column:
    return F.xxhash64(F.lit(seed), *columns)


def cap_per_location(df: DataFrame, n: int = 40, seed: int = 42, keys: Sequence[str] = KEYS,
                     unique: Sequence[str] = ("origin_ts",), rank: Column | None = None) -> DataFrame:
    """A random choice of at most n rows per location. ``rank`` replaces the seeded hash."""
    rank = _hash(seed, [*keys, *unique]) if rank is None else rank
    order = Window.partitionBy(*keys).orderBy(rank, *unique)
    return df.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= n).drop("_rn")


def pad_per_location(df: DataFrame, n: int = 40, seed: int = 42, keys: Sequence[str] = KEYS,
                     unique: Sequence[str] = ("origin_ts",), draw: Column | None = None) -> DataFrame:
    """Repeat randomly drawn rows of each location that has fewer than n, up to n; adds ``copy`` (0 for originals).

    ``draw`` gives a non-negative number for the columns ``keys`` and ``copy``; its remainder picks the row.
    """
    draw = F.pmod(_hash(seed, [*keys, "copy"]), F.lit(2**31)) if draw is None else draw
    short = df.groupBy(*keys).count().filter(F.col("count") < n)
    draws = (
        short.withColumn("copy", F.explode(F.sequence(F.lit(1), n - F.col("count").cast("int"))))
        .withColumn("_rn", (F.pmod(draw, F.col("count")) + 1).cast("int")).drop("count")
    )
    few = df.join(short.drop("count"), list(keys), "left_semi")
    numbered = few.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*unique)))
    copies = numbered.join(draws, [*keys, "_rn"]).drop("_rn")
    return df.withColumn("copy", F.lit(0)).unionByName(copies)


def balance(df: DataFrame, n: int = 40, seed: int = 42, keys: Sequence[str] = KEYS,
            unique: Sequence[str] = ("origin_ts",), rank: Column | None = None) -> DataFrame:
    """Exactly n rows per location: a choice of many, or repeats of few. ``rank`` replaces the seeded hash of the choice."""
    return pad_per_location(cap_per_location(df, n, seed, keys, unique, rank), n, seed, keys, unique)


def split_sizes(n: int, test: float = 0.15, val: float = 0.15) -> tuple[int, int, int]:
    """Train, validation and test sizes; the held-out sizes are rounded up, test first."""
    n_test = math.ceil(test * n)
    n_val = math.ceil(val / (1 - test) * (n - n_test))
    return n - n_test - n_val, n_val, n_test


def split_exact(df: DataFrame, unique: Sequence[str], test: float = 0.15, val: float = 0.15, seed: int = 42,
                rank: Column | None = None) -> DataFrame:
    """Shuffled split with exact sizes, as column ``split``: rows in order of a bigint ``rank`` (a seeded hash), then of ``unique``.

    The two cutting ranks are found by refined histograms, so rows are only compared with them and stay where they are; none
    but the rows at a cutting rank that several rows share are ordered. ``df`` is read once a round: give a table.
    """
    rank = _hash(seed, unique) if rank is None else rank

    def places(n: int) -> list[int]:
        _, n_val, n_test = split_sizes(n, test, val)
        return [n_test, n_test + n_val]

    ranked = df.withColumn("_rank", rank)
    cuts = cutting_ranks(ranked.select("_rank"), places)
    shared = [cut for cut, before in cuts if before]
    if shared:
        at_cut = F.coalesce(F.col("_rank").isin(shared), F.lit(False))
        tied = ranked.filter(at_cut).withColumn("_tie", F.row_number().over(Window.partitionBy("_rank").orderBy(*unique)))
        ranked = ranked.filter(~at_cut).withColumn("_tie", F.lit(1)).unionByName(tied)

    def before(cut: int | None, n: int) -> Column:
        if cut is None:
            return F.lit(True)
        below = F.col("_rank") < cut
        return below | ((F.col("_rank") == cut) & (F.col("_tie") <= n)) if n else below

    first, second = (before(*cut) for cut in cuts)
    part = F.when(first, "test").when(second, "val").otherwise("train")
    return ranked.withColumn("split", part).drop("_rank", "_tie")


# Bits of a rank that one round of histograms tells apart.
ROUND_BITS = 12


def cutting_ranks(ranks: DataFrame, places: Callable[[int], Sequence[int]]) -> list[tuple[int | None, int]]:
    """For each place k, counted from 0, the rank found there in sorted order, and how many rows of that rank lie before it.

    ``ranks`` has one bigint column without nulls; ``places`` gives the places from the number of rows. Each round is one job that
    counts rows by the next bits of the rank, for all places at once, in the parts that hold a place: at most 4,096 counts a
    place reach the driver. A place behind the last row has no rank (None).
    """
    rank = F.col(ranks.columns[0])
    shift = 64 - ROUND_BITS
    counts = _part_counts(ranks, rank, shift)
    wanted = places(sum(n for _, n, _, _ in counts))
    held = {k: _part_at(counts, 0, k) for k in wanted}
    while open_parts := {part for _, part, lo, hi in held.values() if lo != hi}:
        # Parts of few rows are told apart to the last bit at once.
        few = sum(n for part, n, _, _ in counts if part in open_parts) <= 2**ROUND_BITS
        step = shift if few else min(ROUND_BITS, shift)
        ranks = ranks.filter(F.shiftright(rank, shift).isin(sorted(open_parts)))
        shift -= step
        counts = _part_counts(ranks, rank, shift)
        for k, (before, part, lo, hi) in held.items():
            if lo != hi:
                held[k] = _part_at([c for c in counts if c[0] >> step == part], before, k)
    return [(held[k][2], 0 if held[k][2] is None else k - held[k][0]) for k in wanted]


def _part_counts(ranks: DataFrame, rank: Column, shift: int) -> list[tuple[int, int, int, int]]:
    """(part, rows, smallest rank, largest rank) in order."""
    parts = ranks.groupBy(F.shiftright(rank, shift).alias("part")).agg(F.count(F.lit(1)), F.min(rank), F.max(rank))
    return sorted(map(tuple, parts.collect()))


def _part_at(counts: Sequence[tuple[int, int, int, int]], before: int, k: int) -> tuple[int, int | None, int | None, int | None]:
    """Rows before the part that holds place k, the part, and its smallest and largest rank."""
    for part, n, lo, hi in counts:
        if k < before + n:
            return before, part, lo, hi
        before += n
    return before, None, None, None


def split_hashed(df: DataFrame, unique: Sequence[str], test: float = 0.15, val: float = 0.15, seed: int = 42) -> DataFrame:
    """Split by hash thresholds: expected sizes only, but no shuffle at all."""
    u = F.pmod(_hash(seed, unique), F.lit(1_000_000))
    part = F.when(u < int(test * 1e6), "test").when(u < int((test + val) * 1e6), "val").otherwise("train")
    return df.withColumn("split", part)


def stack_samples(parts: Sequence[DataFrame]) -> DataFrame:
    """Samples of several collections as one table; their columns must be the same, in any order."""
    first, *others = parts
    for part in others:
        if set(part.columns) != set(first.columns):
            raise ValueError(f"columns differ: {sorted(set(part.columns) ^ set(first.columns))}")
    return reduce(DataFrame.unionByName, parts)


def dataset_statistics(samples: DataFrame) -> DataFrame:
    """Per split: number of samples, shapes, and mean and deviation of all input and target values.

    All samples have equal shapes, so the mean of all values is the mean of the samples' means, and the variance of all
    values is the mean of the variances inside samples plus the variance of their means: one pass, nothing exploded.
    """
    shapes = ["size(X) AS _in", "size(X[0]) AS _features", "size(y) AS _out", "size(y[0]) AS _targets"]
    rows = samples.selectExpr("split", *shapes, *[f"transform(flatten({c}), x -> cast(x as double)) AS _{c}" for c in ("X", "y")])
    for fold, name in (("a + x", "mean"), ("a + power(x - _{c}_mean, 2)", "var")):
        rows = rows.selectExpr("*", *[
            f"aggregate(_{c}, 0D, (a, x) -> {fold.format(c=c)}) / size(_{c}) AS _{c}_{name}" for c in ("X", "y")])
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_samples"), F.max("_in").alias("input_steps"), F.max("_features").alias("n_features"),
        F.max("_out").alias("output_steps"), F.max("_targets").alias("n_targets"),
        *[e for c in ("X", "y") for e in (
            F.avg(f"_{c}_mean").alias(f"{c}_mean"), F.sqrt(F.avg(f"_{c}_var") + F.var_pop(f"_{c}_mean")).alias(f"{c}_std"))])
