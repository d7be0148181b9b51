"""Building blocks for long series: every step works on chunks of a series, so that one
location holding a large share of all rows is spread over many tasks.

A series is identified by its key columns and ordered by a position. A chunk is a stretch of
positions; rows that a chunk needs from outside travel with it:

* ``with_halo`` copies the few rows before or after a chunk that fixed frames look at;
* ``neighbours`` adds the nearest known values on both sides, however far away they are;
* ``row_positions`` numbers rows exactly from per-bucket counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 32_768
CHUNK_COL = "_chunk"


def chunk_of(pos: str, size: float) -> Column:
    """Chunk number of a position expression."""
    return F.expr(sql_chunk(pos, size))


def sql_chunk(pos: str, size: float) -> str:
    return f"cast(floor(({pos}) / {size}) as bigint)"


def row_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                  name: str = "pos") -> DataFrame:
    """Number the rows of each key from 0 in the given order.

    ``bucket`` must not decrease along the order. Only the counts per bucket are summed along a
    whole key; rows are numbered inside their bucket.
    """
    groups = [*keys, "_bucket"]
    tagged = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        tagged.groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*groups, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*groups).orderBy(*order)
    return (
        tagged.join(offsets, groups)
        .withColumn(name, F.col("_offset") + F.row_number().over(inside) - 1)
        .drop("_bucket", "_offset")
    )


def ordered_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str) -> DataFrame:
    """Number the rows of each key from 1 in the given order, and leave all rows sorted by key and number.

    As ``row_positions``, but with one shuffle: buckets are dealt in ranges, and a marker row brings
    the number of rows in the buckets before. ``bucket`` must not decrease along the order.
    """
    groups = [*keys, "_bucket"]
    tagged = df.withColumn("_bucket", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    markers = (
        tagged.groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*groups, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    together = tagged.unionByName(markers, allowMissingColumns=True).repartitionByRange(shuffle_partitions(df), *groups)
    marker_first = Window.partitionBy(*groups).orderBy(F.col("_offset").desc_nulls_last(), *order)
    inside = marker_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        together.withColumn(name, F.first("_offset").over(inside) + F.row_number().over(inside) - 1)
        .filter(F.col("_offset").isNull())
        .drop("_bucket", "_offset")
    )


def with_halo(df: DataFrame, keys: Sequence[str], pos: str = "pos", before: int = 0, after: int = 0,
              chunk: int = CHUNK) -> DataFrame:
    """Add ``_chunk`` and copy each row into the neighbouring chunks that look back or ahead at it.

    A chunk sees ``before`` positions ahead of its first row and ``after`` positions behind its
    last one. Windows go over ``(*keys, "_chunk")``; ``drop_halo`` then removes the copies.
    """
    chunks = f"sequence({sql_chunk(f'{pos} - {after}', chunk)}, {sql_chunk(f'{pos} + {before}', chunk)})"
    spread = df.withColumn(CHUNK_COL, F.expr(f"explode({chunks})"))
    return spread.repartition(shuffle_partitions(df), *keys, CHUNK_COL)


def shuffle_partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions, stated so that small-looking ones are not merged:
    the rows of a chunk multiply after the shuffle, in number or in width."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def drop_halo(df: DataFrame, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    return df.filter(F.col(CHUNK_COL) == chunk_of(pos, chunk)).drop(CHUNK_COL)


def chunk_window(keys: Sequence[str], pos: str = "pos", descending: bool = False):
    order = F.desc(pos) if descending else F.asc(pos)
    return Window.partitionBy(*keys, CHUNK_COL).orderBy(order)


def neighbours(rows: DataFrame, keys: Sequence[str], pos: str, values: Sequence[str],
               chunk: float = CHUNK, last: str | None = None,
               carried: Sequence[str] = ()) -> DataFrame:
    """For every row, the nearest known value of each variable at or before and at or after it.

    Adds ``{v}__pp``/``{v}__pv`` (position and value before) and ``{v}__np``/``{v}__nv`` (after).
    A key has at most one known value per position and variable. ``carried`` columns depend on the
    key and position only.

    With ``last``, a column with the last position of the key, the result has one row for each
    position from 0 to there instead of the input rows; every key has a row in the first chunk, and
    then carried columns depend on the key only.

    Rows are shuffled once. Each chunk gets one marker row that brings the known values
    just outside of it, taken from per-chunk summaries, and the stretch of positions it covers.
    """
    keys = list(keys)
    carried = list(carried)
    groups = [*keys, CHUNK_COL]
    by = ", ".join(groups)
    constant = [*carried, last] if last else []
    tagged = rows.select(*keys, pos, *dict.fromkeys([*carried, *constant]), *values).withColumn(
        CHUNK_COL, chunk_of(pos, chunk))

    def known(v: str) -> str:
        return f"CASE WHEN {v} IS NOT NULL THEN {pos} END"

    markers = tagged.groupBy(*groups).agg(*[F.expr(e) for v in values for e in (
        f"min({known(v)}) AS {v}__fp", f"min_by({v}, {known(v)}) AS {v}__fv",
        f"max({known(v)}) AS {v}__lp", f"max_by({v}, {known(v)}) AS {v}__lv",
    )], *[F.expr(f"max({c}) AS {c}") for c in constant])
    past = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    earlier = f"(PARTITION BY {', '.join(keys)} ORDER BY {CHUNK_COL} {past})"
    later = f"(PARTITION BY {', '.join(keys)} ORDER BY {CHUNK_COL} DESC {past})"
    around = [e for v in values for e in (
        f"last({v}__lp, true) OVER {earlier} AS {v}__pp", f"last({v}__lv, true) OVER {earlier} AS {v}__pv",
        f"last({v}__fp, true) OVER {later} AS {v}__np", f"last({v}__fv, true) OVER {later} AS {v}__nv",
    )]
    if last is None:
        markers = markers.selectExpr(*groups, "true AS _marker", *around)
    else:
        # Chunks without any row follow the last chunk before them that has one.
        following = f"lead({CHUNK_COL}) OVER (PARTITION BY {', '.join(keys)} ORDER BY {CHUNK_COL})"
        upto = f"coalesce({following} - 1, {sql_chunk(last, chunk)})"
        inside = [c for v in values for c in (f"{v}__lp", f"{v}__lv")]
        markers = markers.selectExpr(*groups, *constant, *inside, *around, f"{upto} AS _upto").selectExpr(
            "*", f"explode(sequence({CHUNK_COL}, _upto)) AS _part").selectExpr(
            *keys, f"_part AS {CHUNK_COL}", *constant, "true AS _marker", *[e for v in values for e in (
                f"IF(_part > {CHUNK_COL}, coalesce({v}__lp, {v}__pp), {v}__pp) AS {v}__pp",
                f"IF(_part > {CHUNK_COL} AND {v}__lp IS NOT NULL, {v}__lv, {v}__pv) AS {v}__pv",
                f"{v}__np", f"{v}__nv",
            )])

    together = (
        tagged.withColumn("_marker", F.lit(False))
        .unionByName(markers, allowMissingColumns=True)
        .repartition(shuffle_partitions(rows), *groups)
    )

    types = {f.name: f.dataType.simpleString() for f in tagged.schema.fields}

    def item(place: str, keep: str, v: str | None = None, value: str = "") -> str:
        fields = [f"'at', cast({place} as {types[pos]})", f"'keep', {keep}"]
        fields += [f"'{x}', cast({value if x == v else 'NULL'} as {types[x]})" for x in values]
        return f"named_struct({', '.join(fields)})"

    extra = "array(" + ", ".join(
        item(f"{v}__{side}p", "false", v, f"{v}__{side}v") for v in values for side in ("p", "n")) + ")"
    kept = "NOT _marker"
    if last is not None:
        end = f"least({last}, {CHUNK_COL} * {chunk} + {chunk - 1})"
        extra = f"concat(transform(sequence({CHUNK_COL} * {chunk}, {end}), _x -> {item('_x', 'true')}), {extra})"
        kept = "_marker AND _item.keep"
    merged = (
        together.selectExpr("*", f"explode_outer(CASE WHEN _marker THEN {extra} END) AS _item")
        .selectExpr(
            *groups, *carried, f"IF(_marker, _item.at, {pos}) AS {pos}", f"{kept} AS _keep",
            *[f"IF(_marker, _item.{v}, {v}) AS {v}" for v in values],
        )
        .filter(f"{pos} IS NOT NULL")
        .groupBy(*groups, pos)
        .agg(*[F.expr(f"max({c}) AS {c}") for c in ("_keep", *carried, *values)])
    )

    through = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    up = f"(PARTITION BY {by} ORDER BY {pos} {through})"
    down = f"(PARTITION BY {by} ORDER BY {pos} DESC {through})"
    return (
        merged.selectExpr(*keys, pos, *carried, *values, "_keep", *[e for v in values for e in (
            f"last({known(v)}, true) OVER {up} AS {v}__pp", f"last({v}, true) OVER {up} AS {v}__pv",
            f"last({known(v)}, true) OVER {down} AS {v}__np", f"last({v}, true) OVER {down} AS {v}__nv",
        )])
        .filter("_keep")
        .drop("_keep")
    )


def sql_interpolated(v: str, pos: str = "pos", limit: int | None = None) -> str:
    """Linear by position, forward only: a gap gets its first ``limit`` values, a trailing gap takes
    the last value, a leading gap stays empty. For rows of ``neighbours``."""
    reach = f"{v}__pp IS NOT NULL" if limit is None else f"{pos} - {v}__pp <= {limit}"
    return f"coalesce({v}, CASE WHEN {reach} THEN {_sql_line(v, f'({pos} - {v}__pp)')} END)"


def sql_interpolated_and_held(v: str, pos: str = "pos", limit: int | None = None) -> str:
    """As ``sql_interpolated``, then forward fill: beyond the limit the last interpolated value holds."""
    steps = f"({pos} - {v}__pp)" if limit is None else f"least({pos} - {v}__pp, {limit})"
    return f"coalesce({v}, CASE WHEN {v}__pp IS NOT NULL THEN {_sql_line(v, steps)} END)"


def _sql_line(v: str, steps: str) -> str:
    rise = f"({v}__nv - {v}__pv) * {steps} / ({v}__np - {v}__pp)"
    return f"CASE WHEN {v}__np IS NULL THEN {v}__pv ELSE {v}__pv + {rise} END"
