"""A Merkle manifest of a dataset: one root over all rows, and a proof for every row.

Rows become leaves, the leaves of a group (a source) form a tree of runs of 16, and the groups' roots form one tree of the same
kind. A superblock is a subtree of three levels, at most 4,096 nodes. Going up, every superblock is reduced to one node, which
is a leaf of the next round, until one node per tree is left. Going down, the nodes of each superblock are cogrouped with the
outer nodes that their proofs need, and one task finishes the reduction, joins the proofs and folds them. No task holds
more than a superblock and its outer nodes, however large a group is.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import lower_ascii, query, table, written
from isobar.llm.places import numbered

RUN, LEVELS = 16, 3
SPAN = RUN ** LEVELS
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
PROOF = "array<struct<before:string,after:string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes: list[str], total: int) -> list[list[str]]:
    """Node lists from a superblock's nodes to its top. A tree of one superblock ends at one node, a larger one after three levels."""
    out = [nodes]
    while (len(out) <= LEVELS) if total > SPAN else len(out[-1]) > 1:
        last = out[-1]
        out.append([digest("".join(last[i:i + RUN])) for i in range(0, len(last), RUN)])
    return out


def siblings(nodes: list[str]) -> list[tuple[str, str]]:
    """For each node the others of its run, those before it and those after it."""
    out = []
    for i in range(0, len(nodes), RUN):
        run = nodes[i:i + RUN]
        out += [("".join(run[:j]), "".join(run[j + 1:])) for j in range(len(run))]
    return out


def block_proofs(nodes: list[str], total: int, outer: list[tuple[str, str]]) -> list[list[tuple[str, str]]]:
    """The proof of every node of a superblock: its siblings level by level, then the outer ones."""
    sides = [siblings(level) for level in levels(nodes, total)[:-1]]
    above: dict[int, list[tuple[str, str]]] = {}
    out = []
    for i in range(len(nodes)):
        if i // RUN not in above:
            place, upper = i // RUN, []
            for level in sides[1:]:
                upper.append(level[place])
                place //= RUN
            above[i // RUN] = upper + outer
        out.append([*(sides[0][i:i + 1] if sides else []), *above[i // RUN]])
    return out


def fold(leaf: str, proof: list[tuple[str, str]]) -> str:
    """The root that follows from a leaf and its proof."""
    for before, after in proof:
        leaf = digest(before + leaf + after)
    return leaf


def record_hash(columns: list[Column]) -> Column:
    """Digest of a row: per column `-` if null, else its length in UTF-8 bytes, `:` and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def climb(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(node tables of every round, tops) of leaves with tree, idx, total and node; a top is (tree, node).

    A round holds only trees that had more than one node left.
    """
    def reduce(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        nodes = block.sort_values("idx")["node"].tolist()
        total = int(block["total"].iloc[0])
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "total": [-(-total // SPAN)], "node": [levels(nodes, total)[-1][0]]})

    rounds, tops = [leaves], None
    while True:
        nodes = rounds[-1].select("tree", "idx", "total", "node")
        up = written(nodes.groupBy("tree", F.floor(F.col("idx") / SPAN).alias("block"))
                     .applyInPandas(reduce, "tree string, idx long, total long, node string"))
        ended = up.filter("total = 1").select("tree", "node")
        tops = ended if tops is None else tops.unionByName(ended)
        left = up.filter("total > 1")
        if left.isEmpty():
            return rounds, tops
        rounds.append(left)


def descend(rounds: list[DataFrame], given: DataFrame) -> DataFrame:
    """(tree, block, proof, top) of every superblock of the first round: the outer nodes of its proofs, and its tree's top.

    given holds (tree, proof, top): what leads from a tree's top to the root of all.
    """
    def join_proofs(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame({"tree": [], "block": [], "proof": [], "top": []})
        nodes = nodes.sort_values("idx")
        found = block_proofs(nodes["node"].tolist(), int(nodes["total"].iloc[0]), pairs(outer["proof"].iloc[0]))
        return pd.DataFrame({"tree": nodes["tree"].tolist(), "block": nodes["idx"].tolist(),
                             "proof": [[{"before": b, "after": a} for b, a in p] for p in found], "top": outer["top"].iloc[0]})

    outer = None
    for k in range(len(rounds) - 1, -1, -1):
        # Trees whose top is made in this round start from what was given.
        own = rounds[k].filter(F.col("total") <= SPAN).select(F.col("tree").alias("_own")).distinct()
        start = given.join(own, F.col("tree") == F.col("_own")).select(F.col("tree").alias("tree"), F.lit(0).cast("long").alias("block"), "proof", "top")
        outer = start if outer is None else outer.unionByName(start)
        if k:
            nodes = rounds[k].withColumn("block", F.floor(F.col("idx") / SPAN))
            outer = written(nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
                            .applyInPandas(join_proofs, f"tree string, block long, proof {PROOF}, top string"))
    return outer


def pairs(proof) -> list[tuple[str, str]]:
    return [(p["before"], p["after"]) for p in proof]


def manifest(rows: DataFrame, fields: list[str] | None = None, key: str = "doc_id", group: str = "source", text: str = "text",
             tampered: Column | None = None) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of rows.

    Leaves hash `fields`; per group they ascend by key (a null key first, then by leaf; repeated rows are leaves of their own,
    in any order). A null group is a group, ordered before all others. A group of one leaf has that leaf as its subroot, a
    dataset of one group that subroot as its root; a proof without siblings is the digest of an empty text. Rows for which
    `tampered` holds are folded from the leaf they would have after lower-casing A-Z of `text`. No rows give no rows; columns
    outside `fields` are not read, and their names may clash with the result's.
    """
    fields = fields or FIELDS
    plain = record_hash([F.col(c) for c in fields])
    changed = record_hash([lower_ascii(F.col(c)) if c == text else F.col(c) for c in fields])
    tampered = F.lit(False) if tampered is None else tampered
    tree = F.coalesce(F.concat(F.lit("1"), F.col(group).cast("string")), F.lit("0"))
    hashed = written(rows.select(F.col(key).alias("_key"), tree.alias("tree"), plain.alias("node"),
                                 F.when(F.coalesce(tampered, F.lit(False)), changed).alias("_changed")))
    leaves = numbered(hashed, "tree", [F.asc_nulls_first("_key"), F.col("node")])
    rounds, subroots = climb(leaves)
    subroots = written(subroots)
    groups = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node"), "tree", [F.col("name")])
    upper, root = climb(groups)
    root = written(root)

    def group_proofs(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame({"tree": [], "proof": [], "top": []})
        nodes = nodes.sort_values("idx")
        found = block_proofs(nodes["node"].tolist(), int(nodes["total"].iloc[0]), pairs(outer["proof"].iloc[0]))
        return pd.DataFrame({"tree": nodes["name"].tolist(), "top": nodes["node"].tolist(),
                             "proof": [[{"before": b, "after": a} for b, a in p] for p in found]})

    nothing = root.select("tree", F.array().cast(PROOF).alias("proof"), F.col("node").alias("top"))
    blocks = groups.withColumn("block", F.floor(F.col("idx") / SPAN))
    given = written(blocks.groupBy("tree", "block").cogroup(descend(upper, nothing).groupBy("tree", "block"))
                    .applyInPandas(group_proofs, f"tree string, top string, proof {PROOF}"))
    outer = descend(rounds, given)

    def finish(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        if not len(nodes):
            return pd.DataFrame({c: [] for c in ("_key", "leaf", "subroot", "proof_sha256", "folded_root")})
        nodes = nodes.sort_values("idx")
        leaf = nodes["node"].tolist()
        proofs = block_proofs(leaf, int(nodes["total"].iloc[0]), pairs(outer["proof"].iloc[0]))
        return pd.DataFrame({
            "_key": nodes["_key"].tolist(), "leaf": leaf, "subroot": outer["top"].iloc[0],
            "proof_sha256": [digest("".join(s for pair in p for s in pair)) for p in proofs],
            "folded_root": [fold(a if c is None else c, p) for a, c, p in zip(leaf, nodes["_changed"], proofs)]})

    # The key goes along as text, so that nulls and large integers pass pandas unchanged.
    kind = dict(hashed.dtypes)["_key"]
    source = leaves.withColumn("_key", F.col("_key").cast("string")).withColumn("block", F.floor(F.col("idx") / SPAN))
    finished = source.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        finish, "_key string, leaf string, subroot string, proof_sha256 string, folded_root string")
    last = root.first()
    return finished.select(F.col("_key").cast(kind).alias(key), "leaf", "subroot", F.lit(last and last["node"]).cast("string").alias("root"), "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.lit(last and last["node"])).alias("verified"))


@query(r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, row_number() OVER () AS rid, coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
        || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
    text, coalesce(octet_length(encode(text)) || ':', '-') AS size FROM documents),
leaf AS MATERIALIZED (SELECT doc_id, rid, coalesce('1' || source, '0') AS tree, sha256(head || size || coalesce(text, '')) AS leaf,
    sha256(head || size || coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')) AS changed FROM d),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
node AS (SELECT tree, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
    UNION ALL SELECT tree, min(level) + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 15) // 16 FROM node WHERE n > 1 GROUP BY tree, i // 16),
sub AS MATERIALIZED (SELECT tree, h, level, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM node WHERE n = 1),
top AS (SELECT 0 AS level, place AS i, h, count(*) OVER () AS n FROM sub
    UNION ALL SELECT min(level) + 1, i // 16, sha256(string_agg(h, '' ORDER BY i)), (min(n) + 15) // 16 FROM top WHERE n > 1 GROUP BY i // 16),
nodes AS MATERIALIZED (SELECT tree, level, i, h FROM node WHERE n > 1 UNION ALL SELECT tree, sub.level + top.level, top.i, top.h FROM top, sub WHERE top.n > 1),
crc AS MATERIALIZED (SELECT rid, doc_id::VARCHAR AS s FROM d WHERE doc_id IS NOT NULL),
poly AS (SELECT list(c ORDER BY b) AS t FROM (WITH RECURSIVE z AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) r(b)
        UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM z WHERE k < 8) SELECT b, c FROM z WHERE k = 8)),
run AS (SELECT rid, s, 4294967295::BIGINT AS c, 1 AS k FROM crc
    UNION ALL SELECT rid, s, xor(c >> 8, t[(xor(c, ascii(substr(s, k, 1))) & 255) + 1]), k + 1 FROM run, poly WHERE k <= length(s)),
hit AS (SELECT rid FROM run WHERE k > length(s) AND xor(c, 4294967295) % 5 = 0),
place AS MATERIALIZED (SELECT rid, placed.tree, l, CASE WHEN l < level THEN i >> (4 * l) ELSE place >> (4 * (l - level)) END AS p
    FROM (SELECT *, unnest(range(0, 12)) AS l FROM placed) placed JOIN sub ON sub.tree = placed.tree),
mate AS MATERIALIZED (SELECT rid, l, p, o.i, o.h FROM place JOIN nodes o ON o.tree = place.tree AND o.level = l AND o.i >> 4 = p >> 4),
proof AS (SELECT rid, sha256(string_agg(h, '' ORDER BY l, i)) AS proof_sha256 FROM mate WHERE i <> p GROUP BY rid),
walk AS (SELECT rid, 0 AS l, CASE WHEN rid IN (SELECT rid FROM hit) THEN changed ELSE leaf END AS h FROM placed
    UNION ALL SELECT rid, min(walk.l) + 1, sha256(string_agg(CASE WHEN mate.i = mate.p THEN walk.h ELSE mate.h END, '' ORDER BY mate.i)) FROM walk JOIN mate USING (rid, l) GROUP BY rid),
ended AS (SELECT rid, arg_max(h, l) AS folded_root FROM walk GROUP BY rid)
SELECT doc_id, leaf, sub.h AS subroot, top.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = top.h AS verified
FROM placed JOIN sub USING (tree) JOIN top ON top.n = 1 JOIN ended USING (rid) LEFT JOIN proof USING (rid)""")
def op13_merkle_manifest(spark, sf):
    docs = table(spark, sf, "documents")
    return manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
