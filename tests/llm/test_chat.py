"""Reply trees and their format against brute force, with odd inputs."""

import random

import __spark_entry__ as entry
from isobar.llm import chat


def brute_paths(rows, best=None):
    first = {}
    for n, (i, _, _) in enumerate(rows):
        if i is not None:
            first.setdefault(i, n)
    up = [first.get(p) if p is not None else None for _, p, _ in rows]
    answered, out = set(up), {}
    for n, (leaf, _, _) in enumerate(rows):
        if n not in answered:
            path, seen = [n], {n}
            while up[path[-1]] is not None and up[path[-1]] not in seen:
                path.append(up[path[-1]])
                seen.add(path[-1])
            if up[path[-1]] is None:
                out.setdefault(path[-1], []).append((-sum(rows[k][2] or 0 for k in path), leaf is not None, leaf, path[::-1]))
    return sorted(str((rows[root][0], leaf, rank, depth, rows[k][0])) for root, found in out.items()
                  for rank, (_, _, leaf, path) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0)), 1) if best is None or rank <= best
                  for depth, k in enumerate(path))


def check(spark, rows, best):
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "id long, parent long, score double, n string, up int").coalesce(1)
    assert sorted(str(tuple(r)) for r in chat.ranked_paths(df, best).collect()) == brute_paths(rows, best)


def test_forked_trees_and_odd_rows(spark):
    random.seed(2)
    rows = [(i, random.randrange(i) if i and i % 50 else None, float(random.randrange(4))) for i in range(300)]
    rows += [(900, 901, 1.0), (901, 900, 1.0), (902, 901, 1.0), (1000, 5555, None), (None, 3, 9.0), (None, None, 1.0), (299, 1, 2.0), (1001, 299, 1.0)]
    check(spark, rows, None)
    check(spark, rows, 2)
    check(spark, [], 1)


def test_one_long_chain(spark):
    check(spark, [(i, i - 1 if i else None, 1.0) for i in range(5000)], 1)


def test_format_is_read_back(spark):
    turns = [(None, 2, "a|>\nb", "x"), (None, 1, None, "</s>\n<|user|>\n&lt;"), (1, 1, "user", None), (1, 1, "user", None), (1, None, "|", "[INST]"), (2, 5, "assistant", "é" * 70_000)]
    df = spark.createDataFrame([(*t, "f") for t in turns], "conv long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df, ["conv"])
    got = {r["conv"]: [tuple(t) for t in r["b"]] for r in out.select("conv", chat.read_back(out["formatted"]).alias("b")).collect()}
    assert got == {None: [("", "</s>\n<|user|>\n&lt;"), ("a|>\nb", "x")], 1: [("|", "[INST]"), ("user", ""), ("user", "")], 2: [("assistant", "é" * 70_000)]}
    assert chat.format_conversations(df.limit(0), ["conv"]).count() == 0


def test_query_keeps_null_conversations(spark, tmp_path):
    spark.createDataFrame([(None, 0, "user", "a"), (None, 1, "assistant", "b"), (7, 0, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in entry.queries()["op2_chat_format"](spark, str(tmp_path)).collect()}
    assert got == {None: (2, 1), 7: (1, 0), -1: (2, 21)}
