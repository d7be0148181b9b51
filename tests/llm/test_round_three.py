"""Resampling, manifest and embedding links against brute force, with odd inputs."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from isobar.llm import covertree, manifest, resample, vectors

DOCS = "doc_id long, source string, lang string, n_chars long, text string, idx string, weight string"


def test_buckets_of_odd_texts():
    texts = [None, "", " - ", "A", "Ünï ça", "a b a b", "x" * 200 + " " + "y" * 100 + " z", "日本 語!q", "one\ntwo"]
    f = resample.Features(10_000)
    doc, bucket, n = f.of([t and t.encode() for t in texts])
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        want = sorted(zlib.crc32(x.encode()) % 10_000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:])])
        assert sorted(bucket[doc == i]) == want and n[i] == len(w)


def test_resampling_of_odd_rows(spark):
    words = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, words, "x"), (3, words, "x"), (None, words + " a", "x"), (4, words * 2, "x"), (5, "few", "x")],
                                 "doc_id long, text string, score string")
    target = spark.createDataFrame([(None,), ("w1 w2",)], "text string")
    rows = [tuple(r) for r in resample.resample(docs, target, percent=50).collect()]
    assert len(rows) == 7 and sorted(r[4] for r in rows if r[4]) == [1, 2]
    raw, want = resample.bucket_counts(docs), resample.bucket_counts(target)
    gains = resample.gains(raw, want)
    assert raw.sum() == 39 * 2 + 41 + (2 * 39 - 1 + 0) + 1 and want.sum() == 3
    for key, n, weight, score, _ in rows:
        noise = (int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        assert score == weight + math.floor(-1000 * math.log(-math.log(noise)))
        if key == 5:
            assert weight == gains[zlib.crc32(b"few") % 10_000]
        if key in (1, 2):
            assert (n, weight) == (0, 0)
    able = sorted([r for r in rows if r[1] >= 39], key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    assert [r[4] for r in able] == [1, 2] + [None] * (len(able) - 2)
    assert resample.resample(docs.limit(0), target).count() == 0
    assert {r[4] for r in resample.resample(docs, target.limit(0), percent=0).collect()} == {None}


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """doc_id -> expected columns, by plain recursion over whole lists."""
    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], text)))

    def build(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
        return out

    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r, r[4]), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: build([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    top = build([built[s][-1][0] for s in order])
    out = []
    for g, s in enumerate(order):
        for i, (_, _, node, r) in enumerate(sorted(trees[s], key=lambda x: x[:3])):
            low = r[4] and r[4].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            fold, proof = leaf(r, low) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else node, ""
            for levels, p in ((built[s], i), (top, g)):
                for level in levels[:-1]:
                    start = p // 16 * 16
                    a, b = "".join(level[start:p]), "".join(level[p + 1:start + 16])
                    proof, fold, p = proof + a + b, h(a + fold + b), p // 16
            out.append((r[0], node, built[s][-1][0], top[-1][0], h(proof), fold, fold == top[-1][0]))
    return out


def check_manifest(spark, rows):
    df = spark.createDataFrame([(*r, "i", "w") for r in rows], DOCS)
    got = manifest.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    # Equal rows may change places.
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute_manifest(rows)))


def test_manifest_of_several_rounds(spark):
    rows = [(i * 7919 % 5003, "hot", "en", i, f"Text {i} É") for i in range(5003)] + [(9000 + i, f"s{i}", None, None, "A" * i) for i in range(40)]
    check_manifest(spark, rows)


def test_manifest_of_odd_rows(spark):
    check_manifest(spark, [(5, None, None, None, None), (None, "b", "de", 1, "X"), (1, "", "de", 1, "x" * 100_000), (2, "é", "de", -1, ""), (3, "z", "a", 0, "Ab")])
    check_manifest(spark, [(5, "one", "en", 3, "ABC")])
    check_manifest(spark, [])
    twice = spark.createDataFrame([(1, "a", "en", 1, "T", "", "")] * 17, DOCS)
    assert manifest.manifest(twice).filter("verified").count() == 17


def brute_links(rows, cosine=0.98):
    links = {i: [] for i in range(len(rows))}
    ok = [r[0] is not None and r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2]) for r in rows]
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and ok[i] and ok[j] and a[1] == b[1] and len(a[2]) == len(b[2]):
                x, y = covertree.unit(np.array([a[2], b[2]]))
                if x @ y >= cosine:
                    links[i].append(j)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(links[todo.pop()]) - seen
            seen |= new
            todo += new
        least = r[0] if len(seen) == 1 else min(rows[k][0] for k in seen)
        out.append((r[0], len(links[i]), least, least == r[0] if r[0] is not None else True))
    return sorted(map(str, out))


def test_embeddings_in_one_cell_and_in_many(spark):
    random.seed(4)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(25, 12))
    rows = []
    for i in range(420):
        b = base[0] if i % 3 == 0 else base[rng.integers(25)]
        v = b if i % 20 == 0 else b * rng.uniform(0.5, 2) if i % 7 == 0 else b + rng.normal(size=12) * 0.12
        rows.append((i, 1 if i % 4 else 2, [float(x) for x in v], "c"))
    rows += [(1000, None, [1.0] * 12, "c"), (1001, 1, None, "c"), (1002, 1, [0.0] * 12, "c"), (1003, 1, [float("nan")] * 12, "c"), (1004, 1, [None] * 12, "c"),
             (1005, 1, [], "c"), (1006, 1, [1e200] * 12, "c"), (1007, 1, [1.0] * 12, "c"), (1008, 1, [1e-200] * 12, "c"), (1009, 1, [1.0] * 3, "c"),
             (None, 1, [1.0] * 12, "c"), (1010, 1, [float("inf")] * 12, "c")]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, cell string")
    want = brute_links(rows)
    for cell in (8192, 40, 7):
        got = vectors.near_vectors(df, cell=cell, centres=4).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_many_copies_up_to_length_are_split(spark):
    df = spark.range(300).select(F.col("id").alias("vec_id"), F.lit(1).alias("label"), F.array(F.col("id") + 1.0, (F.col("id") + 1) * 2.0).alias("embedding"))
    got = vectors.near_vectors(df, cell=50).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(299, 0)} and len(got) == 300
