"""Near-duplicates against brute force: loose groups, groups in parts, odd keys, repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from isobar.llm import links, neardup


def brute(rows, size, percent=80):
    """(key, n, component, kept) per row, with A-Z lower-cased alone, and the rows that stay."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().decode().split()
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    groups = {}
    for i, x in enumerate(label):
        groups.setdefault(x, []).append(i)
    out, stay = [], []
    for g in groups.values():
        name = min((rows[i][0] for i in g), default=None) if rows[g[0]][0] is not None else None
        out += [(rows[i][0], len(sets[i]), name, rows[i][0] == name) for i in g]
        stay.append(next(i for i in g if rows[i][0] == name))
    return sorted(map(str, out)), sorted(stay)


def check(spark, rows, kind="long", size=2, **how):
    df = spark.createDataFrame([(*r, i, "b") for i, r in enumerate(rows)], f"doc_id {kind}, text string, _row int, h1 string").coalesce(2)
    want, stay = brute(rows, size)
    got = neardup.near_duplicates(df, shingle=size, **how).collect()
    assert sorted(str(tuple(r)[:4]) for r in got) == want
    assert sum(r["chosen"] for r in got) == len(stay)
    return df, stay


@pytest.mark.parametrize("least, most, part", [(4, 6, 2_000_000), (3, 6, 5_000)])
def test_one_large_loose_group(spark, least, most, part):
    random.seed(least)
    base = [f"w{random.randrange(2000)}" for _ in range(120)]
    rows = []
    for k in range(400):
        w = list(base)
        for _ in range(random.randint(least, most)):
            w[random.randrange(120)] = f"x{random.randrange(10_000)}"
        rows.append((k, " ".join(w)))
    check(spark, rows + [(1000, " ".join(base))] * 3, part_shingles=part)
    check(spark, rows, part_shingles=part)


ODD = [(1, "X one two three"), (1, "Y four five six"), (0, "y four five six"), (7, "x one two three q"), (None, "x one two three"), (None, None), (5, None), (4, ""), (3, " \n"),
       (8, "single"), (9, "SINGLE"), (9, "single"), (10, "é É é"), (11, "long word " * 30_000), (12, "long word " * 29_000)]


def test_odd_rows(spark):
    df, stay = check(spark, ODD)
    kept = [r["_row"] for r in neardup.one_per_group(df, shingle=2).collect()]
    assert sorted(kept) == stay and 0 in kept and 2 in kept
    check(spark, [(None if k is None else f"k{k}", t) for k, t in ODD], kind="string")
    check(spark, [])


def test_components_of_chains_and_stars(spark):
    random.seed(1)
    ids = list(range(500))
    random.shuffle(ids)
    pairs = [(ids[i], ids[i + 1]) for i in range(300)] + [(ids[310], ids[i]) for i in range(311, 450)] + [(ids[460], ids[460])] + [(ids[1], ids[0])] * 5
    got = links.components(spark.range(500), spark.createDataFrame(pairs, "a long, b long")).collect()
    least = {ids[i]: min(ids[:301]) for i in range(301)} | {ids[i]: min(ids[310:450]) for i in range(310, 450)}
    assert {r["id"]: r["component"] for r in got} == {i: least.get(i, i) for i in range(500)}
    assert links.components(spark.range(3), spark.createDataFrame([], "a long, b long")).filter(F.col("id") == F.col("component")).count() == 3
