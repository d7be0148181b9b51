"""The stages of the pipeline against brute force, one by one, on texts with copies, shared passages and benchmark items."""

import hashlib
import random
import re

import pytest

import corpus_pipeline as pipe

SPACE, MARK = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return (text or "").encode().lower().decode()


@pytest.fixture(scope="module")
def rows():
    random.seed(8)
    words = [f"wort{i}" for i in range(3000)]
    texts = [" ".join(random.choice(words) for _ in range(random.randint(60, 200))) for _ in range(60)]
    shared = " ".join(f"s{i}" for i in range(50))
    texts += [texts[0], texts[1] + " extra", texts[2].upper(), "Start " + texts[5] + "\n" + shared, shared + " " + texts[6], None, "", " \n", "short text", "short text"]
    texts += [texts[7] + " " + " ".join(f"b{i}" for i in range(30)), " ".join(f"b{i}" for i in range(5, 25)) + " tail", "x " * 20_000]
    keyed = [(i, t, "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    # Repeated and null keys: rows of their own.
    return keyed + [(1, texts[9] + " one more", "de", "s", 1), (0, texts[10], "de", "s", 1), (None, texts[11], "de", "s", 1), (None, texts[11], "de", "s", 1)]


@pytest.fixture()
def stored(spark, tmp_path):
    def store(rows, schema=SCHEMA, name="docs"):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        return spark.read.parquet(str(tmp_path / f"{name}.parquet"))

    return store


def as_rows(df):
    return sorted(map(str, map(tuple, df.select(*pipe.COLUMNS).collect())))


def test_near_copies(spark, stored, rows):
    sets = []
    for r in rows:
        w = re.findall(SPACE, low(r[1]))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and label[i] != label[j]:
                label = [label[i] if x == label[j] else x for x in label]
    got = [r["doc_id"] for r in pipe.drop_near_copies(spark, stored(rows), "").collect()]
    want = [min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for g in ([i for i, x in enumerate(label) if x == k] for k in set(label))]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert pipe.drop_near_copies(spark, stored([], name="none"), "").count() == 0


def test_repeated_passages(spark, stored, rows):
    words = [re.findall(SPACE, r[1] or "") for r in rows]
    count = {}
    for w in words:
        for i in range(len(w) - 34):
            count[tuple(w[i:i + 35])] = count.get(tuple(w[i:i + 35]), 0) + 1
    want = []
    for r, w in zip(rows, words):
        gone = {k for i in range(len(w) - 34) if count[tuple(w[i:i + 35])] > 1 for k in range(i, i + 35)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r[1]
        want.append(str((r[0], text, r[2], r[3], None if text is None else len(text))))
    assert as_rows(pipe.cut_repeated_passages(spark, stored(rows), "")) == sorted(want)


def test_contamination(spark, stored, rows, tmp_path):
    items = [("i1", " ".join(f"B{i}" for i in range(30))), ("i2", None), ("i3", "short"), ("i4", "")]
    stored(items, "item_id string, text string", "benchmark")
    windows = {tuple(w[i:i + 13]) for _, t in items for w in [re.findall(MARK, low(t))] if w for i in range(max(1, len(w) - 12))}
    want = []
    for r in rows:
        w = re.findall(MARK, low(r[1]))
        hit = {k for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i:i + n]) in windows for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(str(r))
    assert as_rows(pipe.drop_contaminated(spark, stored(rows), str(tmp_path))) == sorted(want)


def test_encoding(spark, stored, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append(str((r[0], len(ids), ids, *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text)))))
    assert sorted(map(str, map(tuple, pipe.encode_texts(spark, stored(rows), "").collect()))) == sorted(want)


def test_languages(spark, stored):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*pipe.COLUMNS)
    odd = [(900_001 + i, t, None, None, 0) for i, t in enumerate([None, "", "12 34 !?", "\n"])]
    both = docs.unionByName(spark.createDataFrame(odd, SCHEMA))
    got = {r["doc_id"] for r in pipe.identify_language(spark, both, "").collect()}
    prose = {r["doc_id"] for r in docs.filter("lang is not null and length(text) > 300").collect()}
    assert not got & {900_001 + i for i in range(4)} and len(prose & got) >= 0.98 * len(prose)
