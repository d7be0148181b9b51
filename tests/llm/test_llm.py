"""Training-data operators against SQL, brute force, the tokenizers library and held-out labels."""

import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from isobar.llm import bpe, chat, decontaminate, html, language, licenses, neardup, quality, substrings
from isobar.llm.common import SQL

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, kept string, n_words long")


ODD = [None, "", "   \n", "a", "a", "word " * 5000, "one two three " * 20, "é" * 40, "<html>", None]


@pytest.mark.parametrize("texts", [ODD, []])
def test_odd_inputs_give_one_row_each(spark, texts):
    docs = rows_of(spark, texts)
    bench = spark.createDataFrame([("1", None), ("2", ""), ("3", "one two"), ("3", "a")], "item_id string, text string")
    net = language.train([("the", "en"), ("und", "de")])
    n = len(texts)
    assert quality.apply_policy(quality.ledger(docs)).count() == n
    assert licenses.scan(docs).count() == n
    assert decontaminate.decontaminate(docs, bench).count() == n
    assert decontaminate.decontaminate(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert language.predict(docs, net).count() == n
    assert bpe.encode(docs, bpe.word_vocabulary()).count() == n
    assert substrings.kept_words(substrings.removal_intervals(docs)).count() == n
    assert neardup.near_duplicates(docs).count() == n
    assert html.extract(docs.withColumnRenamed("text", "html")).count() == n


def test_bpe_equals_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.Codec(bpe.word_vocabulary())
    random.seed(3)
    letters = "aaabbe'stre  \n\t<|endoftext|>ÀéΣσİß\x1c\x85 日本٣²é😀_-12"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["a" * 99, "<|endoftext|>a<|startoftext|>"]
    pieces = codec.pieces(texts)
    coded = codec.encoded(pieces)
    for text, ps in zip(texts, pieces):
        ids = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for w in ps for i in coded[w][0].split()] == ids
        assert " ".join(coded[w][1] for w in ps) == library.decode(ids, skip_special_tokens=False)


def test_bpe_query_and_long_words_equal_library(spark):
    import hashlib
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    random.seed(11)
    codec = bpe.Codec(bpe.word_vocabulary())
    words = ["".join(random.choice("etaoinshrdlu") for _ in range(n)) for n in (1024, 1025, 3000, 80_000)] + ["a" * 5001, "tion" * 2000, "é" * 1500]
    start = time.perf_counter()
    coded = codec.merge(words)
    assert time.perf_counter() - start < 10
    assert coded == [library.encode(w, add_special_tokens=False).ids for w in words]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in entry.queries()["op7_bpe"](spark, DATA).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        plain = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest())


def test_language_gradients_and_held_out_accuracy(spark):
    net = language.Network(["a", "b"])
    codes, mask = language.padded([b" ab ", b" c "])
    target, weight = np.array([0, 1]), np.ones(2, np.float32)

    def loss():
        p = net.log_probabilities(codes, mask)
        return -(p[:, np.arange(2), target] * mask.T).sum() / mask.sum()

    grad = net.gradients(codes, mask, target, weight)
    for name in ("uf", "ub", "o"):
        net.w[name] = net.w[name].astype(np.float64)
        net.w[name][1, 1] += 1e-3
        up = loss()
        net.w[name][1, 1] -= 2e-3
        assert abs((up - loss()) / 2e-3 - grad[name][1, 1]) < 1e-3
        net.w[name][1, 1] += 1e-3
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    out = entry.queries()["op3_language_id"](spark, "/root/testdata/sf0.01").filter("held_out").join(docs, "doc_id").filter("lang is not null")
    assert out.selectExpr("avg(cast(lang_pred = lang as int))").first()[0] > 0.95


def test_near_duplicates_against_brute_force(spark):
    random.seed(5)
    base = [[random.choice("abcdefghij") + str(random.randint(0, 300)) for _ in range(80)] for _ in range(30)]
    texts = []
    for b in base:
        for k in range(4):
            c = list(b)
            for _ in range(k):
                c[random.randrange(len(c))] = "new"
            texts.append(" ".join(c))
    sets = [{tuple(w[i:i + 2]) for i in range(len(w) - 1)} for w in map(str.split, texts)]
    parent = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    got = neardup.near_duplicates(rows_of(spark, texts), shingle=2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(parent))


def test_reply_tree_paths(spark):
    m = spark.createDataFrame([(1, None, 0.0), (2, 1, 1.0), (3, 1, 5.0), (4, 2, 1.0), (9, 77, None)], "id long, parent long, score double")
    got = {(r["root"], r["leaf"], r["rank"], r["depth"], r["id"]) for r in chat.ranked_paths(m).collect()}
    assert got == {(1, 3, 1, 0, 1), (1, 3, 1, 1, 3), (1, 4, 2, 0, 1), (1, 4, 2, 1, 2), (1, 4, 2, 2, 4), (9, 9, 1, 0, 9)}


def test_html_keeps_the_article():
    page = ("<html><head><title>t</title></head><body><nav><a>menu</a></nav><div class='ad'>buy</div><article><h1>A &amp; B</h1><p>One <b>two<br>x<p>three"
            "<script>var a='</p>'</script></article><div id=comments><p>no</p></div><footer>f</footer></body></html>")
    assert html.main_text(page) == "A & B\nOne two\nx\nthree"
    assert html.main_text(None) == ""


def test_ablation_counts(spark):
    rows = quality.ledger(rows_of(spark, ["a b", "x " * 40, " ".join(map(str, range(1000, 1040)))]))
    got = {r["rule"]: (r["n_failed"], r["n_kept_without"]) for r in quality.ablation(rows, "base").collect()}
    assert got == {"few_words": (1, 2), "repeated_windows": (1, 2)}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, DATA))
        assert docs.columns == corpus_pipeline.COLUMNS
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    assert entry.queries()["pipeline"](spark, DATA).count() == seen[-1]
