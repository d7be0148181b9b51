"""Near-duplicate embeddings: exact pairs over a cosine threshold, within labels, by dual traversal of cover trees.

Equal vectors are first reduced to one. The vectors of a label are one cell; a cell of more than CELL vectors is split around
centres drawn from it, until none is larger. Pairs of cells are followed down these splits, and a pair goes as soon as its
centres are further apart than the threshold and both covering radii. What is left is worked on pair by pair: each task builds
the cover trees of its two cells and traverses them together. A task returns each vector's number of links and one edge to its
group, never the pairs themselves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.llm import covertree
from isobar.llm.common import query, table, written
from isobar.llm.links import components

CELL, CENTRES, FINEST = 8192, 16, 0.05
# Points of a cell that one task compares with the cell's centres.
PART = 20_000


def stacked(column: pd.Series) -> np.ndarray:
    return covertree.unit(np.stack([np.asarray(v, np.float64) for v in column]))


def sizes_of(points: DataFrame) -> DataFrame:
    return points.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))


def split(points: DataFrame, large: DataFrame, centres: int, cell: int, turn: int) -> DataFrame:
    """Points of large cells (cell, size) with their new cell, the centre's class and their distance from the centre.

    Centres are the points with the lowest hashes (each task keeps its lowest before the shuffle). A point goes to its nearest
    centre, and among centres at the same distance to one by its number, so that copies up to length are split as well.
    """
    wanted = F.least(F.lit(centres), F.ceil(F.col("size") / cell) * 2)
    lowest = W.partitionBy("cell").orderBy(F.xxhash64("cls", F.lit(turn)), "cls")
    some = points.join(large, "cell").select("cell", "cls", "size", wanted.alias("wanted"), F.row_number().over(lowest).alias("k")).filter(f"k <= least({centres}, wanted)")
    some = some.select("cell", "cls", "size").join(points.select("cls", "vec"), "cls")
    some = some.withColumn("parts", F.ceil(F.col("size") / PART).cast("int"))
    given = written(some.select("cell", F.col("cls").alias("centre"), F.col("vec").alias("at"), "parts")).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    moved = points.join(large, "cell").withColumn("part", F.pmod(F.col("cls"), F.ceil(F.col("size") / PART)).cast("int")).drop("size")

    def nearest(mine: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return mine.drop(columns="part").assign(centre=pd.Series(dtype="int64"), far=pd.Series(dtype="float64"))
        centres = centres.sort_values("centre")
        names = centres["centre"].to_numpy()
        d = covertree.distances(stacked(mine["vec"]), stacked(centres["at"]))
        tie = d <= d.min(1, keepdims=True) + covertree.SLACK
        place = np.cumsum(tie, 1)
        k = (place == (mine["cls"].to_numpy() % place[:, -1] + 1)[:, None]).argmax(1)
        return mine.drop(columns="part").assign(centre=names[k], far=d[np.arange(len(d)), k])

    moved = moved.groupBy("cell", "part").cogroup(given.groupBy("cell", "part")).applyInPandas(
        nearest, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema) + ", centre long, far double")
    return moved.select(F.col("cell").alias("parent"), F.concat_ws(".", "cell", "centre").alias("cell"), *[c for c in points.columns if c != "cell"], "centre", "far")


def cell_pairs(pairs: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of cells one split below the given pairs; cells has parent, cell, at (centre; null if none) and radius."""
    a, b = (cells.select(F.col("parent").alias(f"p{s}"), F.col("cell").alias(f"c{s}"), F.col("at").alias(f"v{s}"), F.col("radius").alias(f"r{s}")) for s in "ab")
    both = pairs.join(a, F.col("a") == F.col("pa")).join(b, F.col("b") == F.col("pb")).filter("a <> b or ca <= cb")
    gap = F.sqrt(F.aggregate(F.zip_with("va", "vb", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    near = F.coalesce(gap <= F.col("ra") + F.col("rb") + (threshold + covertree.SLACK), F.lit(True))
    return both.filter(near).select(F.col("ca").alias("a"), F.col("cb").alias("b"))


def near_vectors(rows: DataFrame, cosine: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cell: int = CELL, centres: int = CENTRES) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of rows; links join rows with equal labels and at least the cosine.

    Rows with a null key, label or vector, and vectors that are empty, zero or hold null or non-finite components, link with
    nothing: 0 links, their own key as component, kept. Vectors of other lengths are not compared. Repeated rows are vectors of
    their own; a component is named by its smallest key. No rows give no rows; other columns are not read.
    """
    value = F.col(vector).cast("array<double>")
    sound = (F.size(value) > 0) & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
    source = rows.select(F.col(key).alias("id"), F.col(label).alias("_label"), F.col(vector).alias("vec"), F.coalesce(
        F.col(key).isNotNull() & F.col(label).isNotNull() & sound, F.lit(False)).alias("sound"))
    keyed = written(source.select("id", "sound", "vec", F.monotonically_increasing_id().alias("row"),
                                  F.concat_ws("|", F.col("_label").cast("string"), F.size("vec").cast("string")).alias("cell"),
                                  F.when(F.col("sound"), F.xxhash64("vec", "_label")).alias("h1"), F.when(F.col("sound"), F.xxhash64(F.lit(1), "_label", "vec")).alias("h2")))
    # Two 64-bit hashes stand for a label and vector; one row of each class lends its vector.
    classes = written(keyed.filter("sound").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("row").alias("cls"), F.count(F.lit(1)).alias("n")))
    points = written(keyed.select("cell", "vec", F.col("row").alias("cls")).join(classes.select("cls", "rep", "n"), "cls").select("cls", "rep", "n", "cell", "vec"))
    threshold = float(np.sqrt(max(2 - 2 * cosine, 0)))
    sizes = sizes_of(points)
    pairs = sizes.select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    turn = 0
    # Cells as they are now, with centre and radius where they came from a split.
    known = sizes.select("cell", F.lit(None).cast("array<double>").alias("at"), F.lit(None).cast("double").alias("radius"))
    while True:
        large = sizes.filter(F.col("size") > cell)
        if large.isEmpty():
            break
        large = written(large)
        turn += 1
        moved = written(split(points, large, centres, cell, turn))
        radii = moved.groupBy("parent", "cell", "centre").agg(F.max("far").alias("radius"))
        lent = points.select(F.col("cls").alias("centre"), "vec")
        new = radii.join(lent, "centre").select("parent", "cell", unit_vector("vec").alias("at"), "radius")
        names = large.select(F.col("cell").alias("_large"))
        same = known.join(names, F.col("cell") == F.col("_large"), "left_anti")
        cells = written(new.unionByName(same.select(F.col("cell").alias("parent"), "cell", "at", "radius")))
        pairs = written(cell_pairs(pairs, cells, threshold))
        known = cells.drop("parent")
        rest = points.join(names, F.col("cell") == F.col("_large"), "left_anti")
        points = written(rest.unionByName(moved.select(*points.columns)))
        sizes = sizes_of(points)
    sides = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("cell"), F.lit(0).alias("side")))).otherwise(
        F.array(F.struct(F.col("a").alias("cell"), F.lit(0).alias("side")), F.struct(F.col("b").alias("cell"), F.lit(1).alias("side"))))
    sent = pairs.select("a", "b", F.explode(sides).alias("s")).select("a", "b", "s.cell", "s.side").join(points, "cell")

    def traverse(block: pd.DataFrame) -> pd.DataFrame:
        parts = [block[block["side"] == s].sort_values("rep", kind="stable") for s in (0, 1)]
        trees = [covertree.CoverTree(stacked(p["vec"]), FINEST) for p in parts if len(p)]
        weights = [p["n"].to_numpy() for p in parts if len(p)]
        one, two, forest = covertree.linked(trees[0], trees[-1], cosine, weights[0], weights[-1])
        links = one + two if len(trees) == 1 else np.concatenate([one, two])
        found = pd.concat([p[["cls", "rep"]] for p in parts if len(p)], ignore_index=True)
        root = forest.find(np.arange(len(found)))
        out = found.assign(links=links, root=found["rep"].to_numpy()[root])
        return out[links > 0]

    id_type = dict(keyed.dtypes)["id"]
    found = written(sent.groupBy("a", "b").applyInPandas(traverse, f"cls long, rep {id_type}, links long, root {id_type}"))
    edges = found.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct()
    groups = components(classes.select(F.col("rep").alias("id")).distinct(), edges)
    totals = found.groupBy("cls").agg(F.sum("links").alias("links"))
    done = classes.join(totals, "cls", "left").join(groups.withColumnRenamed("id", "rep"), "rep").select(
        "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component")
    out = keyed.select("id", "h1", "h2").join(done, ["h1", "h2"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def unit_vector(name: str):
    """A vector column at length 1."""
    value = F.col(name).cast("array<double>")
    top = F.array_max(F.transform(value, F.abs))
    scaled = F.transform(value, lambda x: x / top)
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(scaled, lambda x: x / norm)


@query(r"""
WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER () AS rid FROM embeddings),
s AS MATERIALIZED (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT x.rid AS a, y.rid AS b, x.vec_id AS ia, y.vec_id AS ib FROM s x JOIN s y ON x.label = y.label AND x.rid <> y.rid AND list_cosine_similarity(x.e, y.e) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS c FROM v UNION SELECT ib, r.c FROM r JOIN l ON ia = r.a),
m AS (SELECT a, min(c) AS component_id FROM r GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM l WHERE a = rid) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN m ON a = vec_id""")
def op12_embedding_dedup(spark, sf):
    return near_vectors(table(spark, sf, "embeddings"))
