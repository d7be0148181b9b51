"""Derived features of a series: lags, moving statistics, differences, and row-local ones."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from isobar import constants as C
from isobar.functions import calendar, categories, physics
from isobar.functions.timegrid import sql_seconds
from isobar.operators import series

KEYS = ["location_id"]


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns; text, boolean and time columns are left out."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


# Moving statistics up to this length are worked out from the single earlier values, all in one
# generated projection; longer ones from running aggregates of blocks, at a cost that does not grow with the length.
SHORT = 12


class History:
    """Earlier values of a series. Each value or statistic asked for becomes one window column.

    Expressions are SQL text.
    """

    def __init__(self):
        self.columns: dict[str, tuple[str, int | None]] = {}
        self.sums: dict[str, str] = {}
        # Per length, the running aggregates of each block of that many positions.
        self.blocks: dict[int, dict[str, str]] = {}

    def total(self, v: str, n: int) -> str:
        """Sum of the last n values, empty until all are known; worked out once for all its users."""
        name = f"_{v}_total_{n}"
        self.sums[name] = " + ".join(self.back(v, k) for k in range(n))
        return name

    def back(self, v: str, k: int) -> str:
        """Value k rows earlier."""
        if k == 0:
            return v
        name = f"_{v}_back_{k}"
        self.columns[name] = (f"lag({v}, {k})", None)
        return name

    def running(self, v: str, agg: str, n: int) -> tuple[str, str]:
        """An aggregate from the start of the row's block of n positions to the row, and one from the
        window's first row to the end of the block before: together they are the last n rows."""
        name = f"_{v}_{agg}_{n}"
        self.blocks.setdefault(n, {})[name] = f"{agg}({v})"
        self.columns[f"{name}_earlier"] = (f"lag({name}_tail, {n - 1})", None)
        return f"{name}_head", f"{name}_earlier"

    def block_columns(self, n: int, keys: Sequence[str], pos: str) -> list[str]:
        """Running aggregates of the blocks of length n, forward and backward: each row is added once."""
        block = f"PARTITION BY {', '.join(keys)}, {series.CHUNK_COL}, {series.sql_chunk(pos, n)} ORDER BY {pos}"
        through = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        return [f"{e} OVER ({block}{order} {through}) AS {name}_{side}"
                for side, order in (("head", ""), ("tail", " DESC")) for name, e in self.blocks[n].items()]

    def heads(self) -> list[str]:
        return [f"{name}_head" for names in self.blocks.values() for name in names]

    def window_columns(self, keys: Sequence[str], pos: str) -> list[str]:
        over = f"PARTITION BY {', '.join(keys)}, {series.CHUNK_COL} ORDER BY {pos}"
        return [
            f"{e} OVER ({over}{'' if n is None else f' ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW'}) AS {name}"
            for name, (e, n) in self.columns.items()
        ]


def _moving(h: History, v: str, n: int, what: str) -> str:
    """A statistic of the last n values; empty until all of them are known."""
    if n > SHORT:
        return _moving_by_blocks(h, v, n, what)
    values = [h.back(v, k) for k in range(n)]
    total = h.total(v, n)
    if what == "sum":
        return total
    if what == "mean":
        return f"{total} / {n}"
    if what == "std":
        if n == 1:
            return "cast(NULL as double)"
        squares = " + ".join(f"power({x} - {total} / {n}, 2)" for x in values)
        return f"sqrt(({squares}) / {n - 1})"
    extreme = values[0] if n == 1 else f"{'least' if what == 'min' else 'greatest'}({', '.join(values)})"
    return f"CASE WHEN {total} IS NOT NULL THEN {extreme} END"


def _moving_by_blocks(h: History, v: str, n: int, what: str) -> str:
    """As ``_moving``: a window is the end of one block and the start of the next, or one whole block."""
    whole = f"pmod(_pos + 1, {n}) = 0"
    here, before = h.running(v, "count", n)

    def joined(agg: str, both: str) -> str:
        head, earlier = h.running(v, agg, n)
        return f"IF({whole}, {head}, {both.format(a=earlier, b=head)})"

    if what in ("sum", "mean"):
        value = joined("sum", "{a} + {b}") + (f" / {n}" if what == "mean" else "")
    elif what == "std":
        mean, mean_before = h.running(v, "avg", n)
        spread, spread_before = h.running(v, "var_pop", n)
        apart = f"power({mean} - {mean_before}, 2) * {here} * {before} / {n}"
        value = f"sqrt(IF({whole}, {spread} * {n}, {spread} * {here} + {spread_before} * {before} + {apart}) / {n - 1})"
    else:
        value = joined(what, f"{'least' if what == 'min' else 'greatest'}({{a}}, {{b}})")
    return f"CASE WHEN IF({whole}, {here}, {before} + {here}) = {n} THEN {value} END"


def lag_features(variables: Sequence[str], h: History, lags: Sequence[int] = C.LAGS) -> dict[str, str]:
    return {f"{v}_lag_{k}": h.back(v, k) for v in variables for k in lags}


def rolling_features(variables: Sequence[str], h: History, windows: Sequence[int] = C.WINDOWS) -> dict[str, str]:
    return {
        f"{v}_rolling_{what}_{n}": _moving(h, v, n, what)
        for v in variables for n in windows for what in ("mean", "std", "min", "max")
    }


def cumulative_features(variables: Sequence[str], h: History, periods: Sequence[int] = C.WINDOWS) -> dict[str, str]:
    return {
        f"{v}_{name}_{n}": _moving(h, v, n, what)
        for v in variables for n in periods for name, what in (("cumsum", "sum"), ("cummean", "mean"))
    }


def difference_features(variables: Sequence[str], h: History, diffs: Sequence[int] = C.DIFFS) -> dict[str, str]:
    out = {}
    for v in variables:
        for d in diffs:
            out[f"{v}_diff_{d}"] = f"{v} - {h.back(v, d)}"
            out[f"{v}_rate_{d}"] = f"({v} - {h.back(v, d)}) / {d}"
    return out


def pressure_tendency(h: History, v: str = C.PRESSURE, steps: int = C.PRESSURE_TENDENCY_STEPS) -> dict[str, str]:
    return {"pressure_change_3h": f"{v} - {h.back(v, steps)}"}


def weather_features(columns: Sequence[str], h: History) -> dict[str, Column | str]:
    """Weather-specific features for the variables that exist, in output order."""
    t, rh, v = F.col(C.TEMP), F.col(C.HUMIDITY), F.col(C.WIND_SPEED)
    out = {}
    if C.TEMP in columns and C.HUMIDITY in columns:
        out["heat_index"] = physics.heat_index(t, rh)
        out["dewpoint_approx"] = physics.dewpoint(t, rh)
    if C.TEMP in columns and C.WIND_SPEED in columns:
        out["wind_chill"] = physics.wind_chill(t, v)
    if C.PRESSURE in columns:
        out.update(pressure_tendency(h))
    if C.PRECIP in columns:
        intensity = physics.hourly_intensity(F.col(C.PRECIP))
        out["precip_intensity"] = intensity
        out.update(calendar.one_hot(categories.precip_class(intensity), C.PRECIP_CLASSES, "precip"))
    if C.CLOUD in columns:
        out.update(calendar.one_hot(categories.cloud_class(F.col(C.CLOUD)), C.CLOUD_CLASSES, "cloud"))
    return out


def over_series(df: DataFrame, make, before: int, keys: Sequence[str] = KEYS, ts: str = "ts",
                regular: bool = False, step: int = C.STEP_SECONDS, chunk: int = series.CHUNK,
                bucket_seconds: int = 30 * 86400) -> DataFrame:
    """Add columns that look back at most ``before`` rows; ``make(history)`` returns them by name.

    With ``regular`` every key has a row at each step, so that a row's position follows from its
    time. Otherwise rows are numbered first, which costs one more shuffle.
    """
    names = df.columns
    if regular:
        placed = df.withColumn("_pos", series.chunk_of(sql_seconds(ts), step))
    else:
        bucket = series.chunk_of(sql_seconds(ts), bucket_seconds)
        placed = series.row_positions(df, keys, [F.col(ts)], bucket, "_pos")
    history = History()
    added = make(history)
    wide = series.with_halo(placed, keys, "_pos", before, chunk=chunk)
    for n in history.blocks:
        wide = wide.selectExpr("*", *history.block_columns(n, keys, "_pos"))
    wide = wide.selectExpr(*names, "_pos", series.CHUNK_COL, *history.heads(), *history.window_columns(keys, "_pos"))
    wide = series.drop_halo(wide, "_pos", chunk).selectExpr("*", *[f"{e} AS {n}" for n, e in history.sums.items()])
    shown = [F.expr(f"{e} AS {n}") if isinstance(e, str) else e.alias(n) for n, e in added.items()]
    return wide.select(*names, *shown)


def moving_features(df: DataFrame, variables: Sequence[str], families: Sequence[str] = ("lag", "rolling", "cumulative", "difference"),
                    lags: Sequence[int] = C.LAGS, windows: Sequence[int] = C.WINDOWS, periods: Sequence[int] = C.WINDOWS,
                    diffs: Sequence[int] = C.DIFFS, **layout) -> DataFrame:
    """The named feature families for the variables that exist."""
    known = [v for v in variables if v in df.columns]
    build = {
        "lag": (lambda h: lag_features(known, h, lags), max(lags)),
        "rolling": (lambda h: rolling_features(known, h, windows), max(windows) - 1),
        "cumulative": (lambda h: cumulative_features(known, h, periods), max(periods) - 1),
        "difference": (lambda h: difference_features(known, h, diffs), max(diffs)),
    }

    def make(h):
        out = {}
        for f in families:
            out.update(build[f][0](h))
        return out

    return over_series(df, make, max(build[f][1] for f in families), **layout)


def all_features(df: DataFrame, variables: Sequence[str] | None = None, ts: str = "ts", **layout) -> DataFrame:
    """Every feature in fixed order: calendar, lags, moving statistics, sums, differences, weather.

    All moving features share one partitioning and one sort.
    """
    keys = layout.get("keys", KEYS)
    if variables is None:
        variables = numeric_columns(df, exclude=keys)
    known = [v for v in variables if v in df.columns]

    def make(h):
        return {
            **calendar.temporal(ts),
            **lag_features(known, h), **rolling_features(known, h), **cumulative_features(known, h),
            **difference_features(known, h), **weather_features(df.columns, h),
        }

    return over_series(df, make, max(C.PRESSURE_TENDENCY_STEPS, *C.LAGS, *C.WINDOWS, *C.DIFFS), ts=ts, **layout)


def preferred_features() -> list[list[str]]:
    """Names of model features in order of preference: a fixed block, then two blocks that only fill up what is left.

    The first block is taken in its own order, the others in the order of the table's columns.
    """
    lead = C.BASE_FEATURES[:3]
    lags = [f"{v}_lag_{k}" for v, k in itertools.product(lead, (1, 2))]
    fixed = C.BASE_FEATURES + C.CYCLIC_FEATURES + lags + C.EXTRA_FEATURES
    return [fixed, [f"{v}_diff_1" for v in lead], [f"{v}_cumsum_4" for v in lead]]


def select_features(columns: Sequence[str], max_features: int = 20) -> list[str]:
    """Names of the model's features among the given columns, at most `max_features`."""
    place = {c: i for i, c in enumerate(columns)}
    fixed, *fillers = ([c for c in block if c in place] for block in preferred_features())
    return list(itertools.chain(fixed, *(sorted(block, key=place.__getitem__) for block in fillers)))[:max_features]


def model_features(df: DataFrame, max_features: int = 20, ts: str = "ts", **layout) -> DataFrame:
    """Keys, time and the model's features, computing only what the selection can pick."""
    keys = layout.get("keys", KEYS)
    lead = [v for v in numeric_columns(df, exclude=keys) if v in C.BASE_FEATURES[:3]]

    def make(h):
        return {
            **calendar.cyclic(ts), **lag_features(lead, h, [1, 2]), **cumulative_features(lead, h, [4]),
            **difference_features(lead, h, [1]), **weather_features(df.columns, h),
        }

    wide = over_series(df, make, C.PRESSURE_TENDENCY_STEPS, ts=ts, **layout)
    return model_frame(wide, max_features, keys, ts)


def model_frame(df: DataFrame, max_features: int = 20, keys: Sequence[str] = KEYS, ts: str = "ts") -> DataFrame:
    """Keys, time and the selected features."""
    return df.select(*keys, ts, *select_features(df.columns, max_features))


def expected_columns(df: DataFrame, expected: Sequence[str]) -> list[str]:
    """The expected features that exist, in expected order; an error when there are none."""
    found = [c for c in expected if c in df.columns]
    if not found:
        raise ValueError(f"none of the expected features exists: {list(expected)}")
    return found
