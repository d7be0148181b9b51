"""Near-duplicate documents by one-permutation MinHash.

Texts with equal shingle sets are first reduced to one. A set's hashes fall into bins by one permutation; empty bins take the
value of another bin by optimal densification. Bands of bins form buckets, and in a bucket every text gets an edge to one
centre only, so a bucket of n texts gives n - 1 candidate edges. Candidate edges join texts into groups that no link leaves.

Links are confirmed on full sets inside these groups: each text of a bucket in turn is the centre of a star to the others that
are not yet known to be in its component, and a pair that shares several buckets is looked at in the first. So no link is lost,
and no pair is written. A group of more shingles than one task should hold is dealt out as pairs of its parts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import given_back, query, table, written
from isobar.llm.covertree import Forest
from isobar.llm.links import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BINS, BAND_ROWS = 128, 4
# Shingles of one part of a group, shingles compared at a time, distinct words remembered per task.
PART_SHINGLES, AT_ONCE, KNOWN_WORDS = 2_000_000, 2_000_000, 200_000
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of all shingles of `size` words, A-Z lower-cased; with fewer words the whole sequence is one."""
    tokens = WORD.findall((text or b"").lower())
    if not tokens:
        return np.zeros(0, np.uint64)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(tokens):
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    codes = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    size = min(size, len(tokens))
    with np.errstate(over="ignore"):
        out = np.full(len(tokens) - size + 1, size, np.uint64)
        for k in range(size):
            out = mix(out * ODD + codes[k:len(codes) - size + 1 + k])
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def signature(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Smallest hash per bin; an empty bin copies the first filled one in its own pseudo-random order of bins."""
    out = np.full(bins, np.iinfo(np.uint64).max, np.uint64)
    where = (hashes % np.uint64(bins)).astype(np.int64)
    np.minimum.at(out, where, hashes)
    filled = np.zeros(bins, bool)
    filled[where] = True
    empty = np.flatnonzero(~filled)
    values = out.copy()
    attempt = 0
    while len(empty):
        attempt += 1
        donor = (mix(empty.astype(np.uint64) * ODD + np.uint64(attempt)) % np.uint64(bins)).astype(np.int64)
        found = filled[donor]
        values[empty[found]] = out[donor[found]]
        empty = empty[~found]
    return values


def band_hashes(values: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    blocks = values.reshape(-1, rows)
    with np.errstate(over="ignore"):
        h = np.arange(1, len(blocks) + 1, dtype=np.uint64)
        for k in range(rows):
            h = mix(h * ODD + blocks[:, k])
    return h.view(np.int64)


def shared_counts(centre: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a set with each of the others; all are sorted and not empty."""
    out, start = [], 0
    while start < len(others):
        end, held = start, 0
        while end < len(others) and (not held or held + len(others[end]) <= AT_ONCE):
            held += len(others[end])
            end += 1
        flat = np.concatenate(others[start:end])
        place = np.minimum(np.searchsorted(centre, flat), len(centre) - 1)
        begins = np.cumsum([0] + [len(x) for x in others[start:end - 1]])
        out.append(np.add.reduceat((centre[place] == flat).astype(np.int64), begins))
        start = end
    return np.concatenate(out)


def confirmed(sets: list[np.ndarray], bands: np.ndarray, part: np.ndarray, percent: int) -> Forest:
    """Components of texts that share a band and are similar enough; where there are two parts, only pairs between them are looked at.

    bands has a row per text. Pairs already known to be in one component are passed over.
    """
    n, forest = np.array([len(x) for x in sets]), Forest(len(sets))
    between = len(np.unique(part)) > 1
    for b in range(bands.shape[1]):
        order = np.argsort(bands[:, b], kind="stable")
        edges = np.flatnonzero(np.diff(bands[order, b], prepend=bands[order[0], b] - 1, append=bands[order[-1], b] + 1))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if hi - lo < 2:
                continue
            group = np.sort(order[lo:hi])
            for k, c in enumerate(group[:-1]):
                roots = forest.find(group)
                if (roots == roots[0]).all():
                    break
                rest = group[k + 1:][roots[k + 1:] != roots[k]]
                rest = rest[~(bands[rest, :b] == bands[c, :b]).any(1) & (100 * np.minimum(n[rest], n[c]) >= percent * np.maximum(n[rest], n[c]))]
                if between:
                    rest = rest[part[rest] != part[c]]
                if len(rest):
                    shared = shared_counts(sets[c], [sets[i] for i in rest])
                    forest.join(np.r_[c, rest[100 * shared >= percent * (n[c] + n[rest] - shared)]])
    return forest


def near_groups(keyed: DataFrame, shingle: int, percent: int, bins: int, band_rows: int, part_shingles: int) -> DataFrame:
    """(_row, id, n, component, chosen) of rows with _row, id and _text, see near_duplicates."""
    def sketch(batches):
        known: dict[bytes, int] = {}
        for batch in given_back(batches):
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, one, two, bands = [], [], [], []
                for named, text in zip(part.column(1).is_valid().to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist()):
                    h = shingle_hashes(text, shingle, known)
                    n.append(len(h))
                    if named and len(h):
                        digest = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), np.int64)
                        one.append(int(digest[0]))
                        two.append(int(digest[1]))
                        bands.append(band_hashes(signature(h, bins), band_rows).tolist())
                    else:
                        one.append(None)
                        two.append(None)
                        bands.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                                                  pa.array(bands, pa.list_(pa.int64()))], names=["_row", "id", "n", "h1", "h2", "bands"])

    id_type = dict(keyed.dtypes)["id"]
    sketched = written(keyed.select("_row", "id", "_text").mapInArrow(sketch, f"_row long, id {id_type}, n long, h1 long, h2 long, bands array<long>"))
    # A class is all rows of one set; its node is the row with the smallest id.
    classes = written(sketched.filter("h1 is not null").groupBy("h1", "h2").agg(F.min(F.struct("id", "_row")).alias("first")).select(
        "h1", "h2", F.col("first.id").alias("rep"), F.col("first._row").alias("row")))
    member = sketched.join(classes.select("row"), F.col("_row") == F.col("row")).select("row", F.explode("bands").alias("band"))
    centres = member.groupBy("band").agg(F.min("row").alias("centre"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("band", "centre")
    stars = member.join(centres, "band").filter("row <> centre").select(F.col("row").alias("a"), F.col("centre").alias("b")).distinct()
    stars = written(stars)
    touched = written(stars.select(F.col("a").alias("id")).union(stars.select(F.col("b").alias("id"))).distinct())
    groups = written(components(touched, stars).join(sketched.select(F.col("_row").alias("id"), "n"), "id"))
    sizes = groups.groupBy("component").agg(F.sum("n").alias("total")).withColumn("parts", F.ceil(F.col("total") / part_shingles)).drop("total")
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j")))
    dealt = groups.join(sizes, "component").withColumn("part", part).select(F.col("id").alias("_row"), "component", "part", F.explode(pairs).alias("p")).select(
        "_row", "component", "part", "p.i", "p.j")

    def confirm(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_row")
        known: dict[bytes, int] = {}
        sets = [shingle_hashes(t, shingle, known) for t in rows.column("_text").cast(pa.large_binary()).to_pylist()]
        bands = np.stack([band_hashes(signature(h, bins), band_rows) for h in sets])
        root = confirmed(sets, bands, rows.column("part").to_numpy(), percent).find(np.arange(len(sets)))
        row = rows.column("_row").to_numpy()
        moved = root != np.arange(len(sets))
        return pa.table({"a": row[moved], "b": row[root[moved]]})

    # What is dealt grows with the texts, so both sides are shuffled at any size; neither is broadcast.
    links = written(dealt.hint("merge").join(keyed.select("_row", "_text"), "_row").groupBy("component", "i", "j").applyInArrow(confirm, "a long, b long"))
    ends = written(links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct())
    named = components(ends, links).join(classes.select(F.col("row").alias("id"), "h1", "h2", "rep"), "id")
    named = written(named.select("h1", "h2", "component", F.struct("rep", F.col("id").alias("row")).alias("first")))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    found = named.join(least, "component").select("h1", "h2", F.col("least.rep").alias("component"), F.col("least.row").alias("row"))
    alone = classes.join(named.select("h1", "h2"), ["h1", "h2"], "left_anti").select("h1", "h2", F.col("rep").alias("component"), "row")
    out = sketched.select("_row", "id", "n", "h1", "h2").join(found.unionByName(alone), ["h1", "h2"], "left")
    return out.select("_row", "id", "n", F.coalesce("component", "id").alias("component"), F.coalesce(F.col("_row") == F.col("row"), F.lit(True)).alias("chosen"))


def keyed_rows(docs: DataFrame, key: str, text: str, stored: bool) -> DataFrame:
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("id"), F.col(text).alias("_text"), F.struct(*docs.columns).alias("_all"))
    return rows if stored else written(rows.drop("id", "_text")).select("_row", F.col(f"_all.`{key}`").alias("id"), F.col(f"_all.`{text}`").alias("_text"), "_all")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id",
                    bins: int = BINS, band_rows: int = BAND_ROWS, stored: bool = False, part_shingles: int = PART_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, chosen) per row of docs, for sets of `shingle`-word shingles.

    Texts are linked if 100 * shared >= percent * all of their shingles; a component is named by its smallest key. kept says
    that the row's key is that name, chosen is true for one row per component, the first with that key. Null, empty and
    wordless texts have no shingles and link with nothing. Equal texts are one. Rows with equal keys are rows of their own.
    Rows with a null key link with nothing, have a null component and are kept and chosen. No rows give no rows; other columns
    are not read. Keys are integers or strings. docs are read several times and must give the same rows in the same order
    each time: say stored=True of a plain table, everything else is written first.
    """
    out = near_groups(keyed_rows(docs, key, text, stored), shingle, percent, bins, band_rows, part_shingles)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
                      F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"), "chosen")


def one_per_group(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id", stored: bool = False) -> DataFrame:
    """The chosen rows of docs, see near_duplicates."""
    keyed = keyed_rows(docs, key, text, stored)
    gone = written(near_groups(keyed, shingle, percent, BINS, BAND_ROWS, PART_SHINGLES).filter("not chosen").select("_row"))
    return keyed.join(gone, "_row", "left_anti").select("_all.*")


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g FROM d),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM i JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS c FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.a),
m AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""")
def op1_minhash_dedup(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), shingle=2, stored=True).drop("chosen")
