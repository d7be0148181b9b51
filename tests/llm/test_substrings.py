"""Repeated windows against brute force, over several blocks and hash ranges, with odd inputs."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from isobar.llm import substrings


def brute(texts, size):
    """(kept words, number of words) of each text."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i:i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - size + 1) if count[tuple(w[i:i + size])] > 1 for k in range(i, i + size)}
        out.append((" ".join(x for i, x in enumerate(w) if i not in gone), len(w)))
    return out


def texts_of(seed):
    random.seed(seed)
    texts = [" ".join(random.choice("abcdefgh") for _ in range(random.randint(0, 60))) for _ in range(60)]
    return texts + [None, "", " \n", "x", "one two three four", "one two three four", "q w " * 400, "é è ü\tö\x1cä b"]


def test_windows_over_blocks_and_ranges(spark):
    texts = texts_of(1)
    docs = spark.createDataFrame(list(enumerate(texts)), "_row long, _text string").repartition(3)
    for limit, range_bytes in ((50, 100), (7, 10_000), (1 << 21, 1)):
        spans = {r["_row"]: r["spans"] for r in substrings.repeated_spans(docs, 4, limit, range_bytes).collect()}
        for i, (kept, n) in enumerate(brute(texts, 4)):
            w, gone = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or ""), set()
            for s in substrings.joined_spans([r.asDict() for r in spans.get(i, [])]):
                gone |= set(range(s["a"], s["b"]))
            assert " ".join(x for k, x in enumerate(w) if k not in gone) == kept


def test_odd_rows_and_clashing_names(spark):
    texts = texts_of(2)
    names = "_row string, _starts int, spans int, _all int, _text string, text string, removed int, n_words int, i int"
    docs = spark.createDataFrame([(f"r{i}", i, 1, 2, "t", t, 0, 0, i) for i, t in enumerate(texts)], names)
    got = substrings.kept_words(substrings.removal_intervals(docs, 4)).collect()
    assert sorted((r["i"], r["_row"], r["_starts"], r["_text"], r["kept_text"], r["n_words"]) for r in got) == [
        (i, f"r{i}", i, "t", *k) for i, k in enumerate(brute(texts, 4))]
    assert substrings.removal_intervals(docs.limit(0)).count() == 0
    assert substrings.removal_intervals(docs.filter("text is null")).select(F.size("removed")).distinct().first()[0] == 0
