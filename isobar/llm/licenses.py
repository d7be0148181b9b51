"""Licence scan by a positional index of rare words, in DataFrame expressions only.

Of each template the words with the highest inverse document frequency over all documents are its rare words. In a
document, their places shifted by their offsets in the template are intersected; what is left are possible starts,
and there the template's whole phrase is compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import NON_WORD, let, lower_ascii, query, table, words

# Mandatory phrases and their labels: fixed values. The first three are the base.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
MORE = [
    ("permission is hereby granted free of charge", "mit"),
    ("licensed under the apache license", "apache"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("mozilla public license", "mpl"),
    ("creative commons attribution", "cc-by"),
    ("released into the public domain", "public-domain"),
]


def document_frequency(tokens: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each vocabulary word stands; at most one row per vocabulary word reaches the driver."""
    found = tokens.select(F.explode(F.array_distinct(F.filter("_words", lambda w: w.isin(vocabulary)))).alias("w"))
    return dict(found.groupBy("w").count().collect())


def scan(docs: DataFrame, templates=tuple(BASE + MORE), n_base: int = len(BASE), rare: int = 2, text: str = "text",
         key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_words and `places`, an array of (label, start, base) of verified phrases.

    Null texts are empty. A template of fewer words than `rare` uses all its words. Repeated rows stay.
    """
    tokens = docs.select(F.col(key), words(lower_ascii(F.col(text)), NON_WORD).alias("_words"))
    split = [(p.split(" "), label) for p, label in templates]
    frequency = document_frequency(tokens, sorted({w for p, _ in split for w in p}))
    anchors = [sorted(range(len(p)), key=lambda i, p=p: (frequency.get(p[i], 0), i))[:rare] for p, _ in split]
    wanted = sorted({p[i] for (p, _), at in zip(split, anchors) for i in at})

    def places(ws: Column) -> Column:
        posted = F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x["w"].isin(wanted))

        def templates_in(post):
            out = []
            for k, ((phrase, label), at) in enumerate(zip(split, anchors)):
                both = reduce(F.array_intersect, [shifted(post, phrase[o], o) for o in at[1:]],
                              F.array_distinct(shifted(post, phrase[at[0]], at[0])))
                out.append(verified(both, phrase, label, k < n_base))
            return F.concat(*out)

        def shifted(post, word, offset):
            return F.transform(F.filter(post, lambda x: x["w"] == word), lambda x: x["i"] - offset)

        def verified(starts, phrase, label, base):
            target = F.array(*map(F.lit, phrase))
            sure = F.filter(starts, lambda s: (s >= 0) & (F.slice(ws, F.greatest(s, F.lit(0)) + 1, len(phrase)) == target))
            return F.transform(sure, lambda s: F.struct(
                F.lit(label).alias("label"), s.cast("long").alias("start"), F.lit(base).alias("base")))

        return let(posted, templates_in)

    return tokens.select(key, F.size("_words").cast("long").alias("n_words"), let(F.col("_words"), places).alias("places"))


def _sql() -> str:
    parts = []
    for k, (phrase, label) in enumerate(BASE + MORE):
        n, target = len(phrase.split()), "['" + "','".join(phrase.split()) + "']"
        parts.append(f"""SELECT rid, '{label}' AS label, {str(k < len(BASE)).lower()} AS base,
            unnest(list_filter(range(len(w)), lambda i: w[i + 1] = '{phrase.split()[0]}' AND list_slice(w, i + 1, i + {n}) = {target})) AS start FROM d""")
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS ({" UNION ALL ".join(parts)}),
g AS (SELECT rid, count(*) FILTER (base) AS nb, min(start) FILTER (base) AS f, max(start) FILTER (base) AS l,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS bl, string_agg(DISTINCT label, ',' ORDER BY label) AS al,
    count(*) AS na FROM p GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(nb, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
    coalesce(bl, '') AS base_labels, coalesce(al, '') AS labels, round(1 - 1 / (1.0::DOUBLE + coalesce(na, 0)), 6) AS score
FROM d LEFT JOIN g USING (rid)"""


@query(_sql())
def op9_license_scan(spark, sf):
    """score: 1 - 1 / (1 + number of verified places of all templates)."""
    base = F.filter("places", lambda x: x["base"])

    def labels(a):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")

    return scan(table(spark, sf, "documents")).withColumn("_base", base).select(
        "doc_id", "n_words", F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["start"])).alias("last_word"),
        labels(F.col("_base")).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.round(1 - 1 / (F.size("places") + F.lit(1.0)), 6).alias("score"))
