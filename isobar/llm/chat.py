"""Chat formatting of reply trees.

Messages form trees by their parent. Iterative self-joins find every message's root, depth and path score, doubling the
distance each time; branches are ranked by score, and each chosen path is formatted as one conversation.

Template: `<s>` at the start, `<|role|>` and a line end before a text, `</s>` and a line end after it. Inside texts and
roles `&` and `<` become `&amp;` and `&lt;`, and `[` becomes `&lb;`, so no marker can begin there; inside roles `|` becomes
`&vb;`, so that the end of a role is its marker. Reading back undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isobar.llm.common import query, table, written
from isobar.llm.places import numbered

ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;")]
ROLE_ESCAPES = [*ESCAPES, ("|", "&vb;")]
OPEN, CLOSE = "<|", "</s>\n"


def escape(c: Column, codes: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, codes: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def climbed(messages: DataFrame) -> tuple[DataFrame, list[DataFrame], DataFrame]:
    """(nodes, jumps, ends) of messages with columns id, parent and score.

    nodes numbers the messages: n, id. jumps[k] has n and up, the message 2^k replies above, where there is one. ends has n, the
    number of its root, its depth (0 is a root) and the sum of scores on its path. Each round joins the jumps with themselves,
    so the longest chain of m replies takes log2(m) rounds, each written.
    """
    nodes = written(messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), F.monotonically_increasing_id().alias("n")))
    first = nodes.filter("id is not null").groupBy(F.col("id").alias("parent")).agg(F.min("n").alias("up"))
    state = written(nodes.join(first, "parent", "left").select(
        "n", "up", F.col("up").isNotNull().cast("long").alias("depth"), F.col("score").alias("total"), F.when(F.col("up").isNull(), F.col("n")).alias("root")))
    limit, step, jumps = state.count(), 1, []
    climbing, ended = state.filter("up is not null"), state.filter("up is null")
    while step <= limit and not climbing.isEmpty():
        jumps.append(climbing.select("n", "up"))
        above = climbing.unionByName(ended).select(
            F.col("n").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("total").alias("total2"), F.col("root").alias("root2"))
        state = written(climbing.drop("root").join(above, "up").select(
            "n", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), (F.col("total") + F.col("total2")).alias("total"),
            F.col("root2").alias("root")))
        # Only messages that have not met their root go on.
        climbing, ended = state.filter("up is not null"), ended.unionByName(state.filter("up is null"))
        step *= 2
    return nodes.select("n", "id"), jumps, ended.select("n", "root", "depth", "total")


def ranked_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(root, leaf, rank, depth, id) of every message on the root-to-leaf paths, for columns id, parent and score.

    Branches of a root are ranked by the sum of scores (null: 0), then by leaf id; best keeps that many branches. Leaves are
    ranked before any path is listed; then a set of messages and their ancestors 2^k replies above is doubled, round by round.
    Messages of a null or unknown parent are roots. Replies to an id that is there twice answer its first row. Messages with
    a null id are answered by none. Circles have no root and are left out. No messages give no paths; other columns are not read.
    """
    nodes, jumps, ends = climbed(messages)
    leaves = ends.join(jumps[0].select(F.col("up").alias("n")).distinct(), "n", "left_anti") if jumps else ends
    ids = nodes.select(F.col("n").alias("leaf"), F.col("id").alias("leaf_id"))
    named = written(leaves.withColumnRenamed("n", "leaf").join(ids, "leaf").select("leaf", "leaf_id", "root", F.col("total").alias("sum"), F.col("depth").alias("deep")))
    if best is None:
        chosen = numbered(named, "root", [F.desc("sum"), F.asc_nulls_first("leaf_id")]).withColumn("rank", (F.col("idx") + 1).cast("int"))
    else:
        chosen = named.withColumn("rank", F.row_number().over(W.partitionBy("root").orderBy(F.desc("sum"), F.asc_nulls_first("leaf_id"), "leaf"))).filter(F.col("rank") <= best)
    roots = nodes.select(F.col("n").alias("root"), F.col("id").alias("root_id"))
    paths = written(chosen.join(roots, "root").select(F.col("root_id").alias("root"), F.col("leaf_id").alias("leaf"), "rank", F.col("leaf").alias("n"), "deep"))
    whole = []
    for k, jump in enumerate(jumps):
        # A branch of fewer replies than the jump is long is whole.
        whole.append(paths.filter(F.col("deep") < 2 ** k))
        paths = written(paths.filter(F.col("deep") >= 2 ** k).join(jump, "n", "left").select(
            "root", "leaf", "rank", F.explode(F.filter(F.array("n", "up"), lambda x: x.isNotNull())).alias("n"), "deep"))
    for part in whole:
        paths = paths.unionByName(part)
    return paths.join(ends.select("n", "depth"), "n").join(nodes, "n").select("root", "leaf", "rank", "depth", "id")


def format_conversations(turns: DataFrame, key: list[str]) -> DataFrame:
    """key and `formatted` from rows with turn, role and text.

    Null roles and texts are empty; equal turns go by role and text, a null turn first; repeated rows are turns of their own. A
    null key is a conversation like any other. No rows give no conversations. One conversation is one row, in one task.
    """
    each = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy(*key).agg(F.sort_array(F.collect_list(each)).alias("_t"))
    one = F.transform("_t", lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit("|>\n"), escape(t["text"]), F.lit(CLOSE)))
    return rows.select(*key, F.concat(F.lit("<s>"), F.array_join(one, "")).alias("formatted"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) of a formatted conversation; the texts of assistants are its loss mask."""
    parts = F.filter(F.split(F.substr(formatted, F.lit(4)), CLOSE), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, "|>\n", 1), F.lit(3)), ROLE_ESCAPES).alias("role"),
        unescape(F.substr(p, F.instr(p, "|>\n") + 3)).alias("text")))


@query(r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    3 + sum(10 + length(r) + length(t)) AS n FROM (SELECT *, replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&lb;'), '|', '&vb;') AS r,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&lb;') AS t FROM c) GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars FROM g""")
def op2_chat_format(spark, sf):
    """Every conversation is a tree of one branch: each row answers the one before it."""
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
                                  "conv_id long, turn long, role string, text string")
    given = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = written(given.withColumn("turn", F.row_number().over(order).cast("long")))

    def node(turn: Column) -> Column:
        return F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), turn.cast("string"))

    rows = rows.withColumn("id", node(F.col("turn")))
    messages = rows.select("id", F.when(F.col("turn") > 1, node(F.col("turn") - 1)).alias("parent"), F.lit(0.0).alias("score"))
    paths = ranked_paths(messages, best=1).select("id", "depth")
    chosen = rows.join(paths, "id").select("conv_id", F.col("depth").alias("turn"), "role", "text")
    out = format_conversations(chosen, ["conv_id"]).withColumn("_b", read_back(F.col("formatted")))
    turns = F.array_join(F.transform("_b", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("_b", lambda x: x["role"] == "assistant"), lambda x: x["text"]), "")
    return out.select("conv_id", F.size("_b").cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
                      F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))
