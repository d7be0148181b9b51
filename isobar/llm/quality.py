"""Quality rules as a bitmask ledger, in DataFrame expressions only.

Every rule is worked out once per document; its measurement and one failure bit are kept. A policy is a version name
with a mask of the bits that count, so another policy, or one rule less, needs no second look at the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import SPACES, let, query, table, words

WINDOW = 8
# Rule name -> condition of failure over the measurements, in whole numbers.
RULES = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 5 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
POLICIES = {"base": BASE, "v1": BASE | BIT["symbols"] | BIT["duplicate_lines"], "v2": sum(BIT.values())}


def repeated_words(tokens: Column, size: int = WINDOW) -> Column:
    """Number of words inside windows of `size` words that occur twice or more in the array."""

    def hashed(hs):
        return F.transform(F.sequence(F.lit(1), F.size(hs) - (size - 1)),
                           lambda i: F.struct(F.xxhash64(F.slice(hs, i, size)).alias("h"), i.alias("i")))

    def repeats(s):
        return F.array_sort(F.transform(
            F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])), lambda x: x["i"]))

    def covered(p):
        spans = F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(size), F.get(p, k + 1) - x), F.lit(size)))
        return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(F.transform(tokens, lambda w: F.xxhash64(w)), lambda hs: let(F.array_sort(hashed(hs)), lambda s: let(repeats(s), covered)))
    return F.when(F.size(tokens) > size, found).otherwise(F.lit(0).cast("long"))


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, measurements and `failed_bits`.

    Null and empty texts have no words and fail `few_words`. Repeated rows stay; other columns are left out.
    """
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_words", words(F.col("_text")))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.regexp_replace(x, SPACES, "") != "")
    measured = base.select(
        key,
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACES, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", "[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).cast("long").alias("n"))).alias("_lines"),
        repeated_words(F.col("_words")).alias("n_repeat_words"),
    ).select("*", F.col("_lines.dup").alias("n_dup_lines"), F.col("_lines.n").alias("n_lines")).drop("_lines")
    bits = sum((F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()), F.lit(0))
    return measured.withColumn("failed_bits", bits.cast("int"))


def apply_policy(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Ledger rows with `kept`: no failure bit of the policy is set."""
    return rows.withColumn("kept", F.col("failed_bits").bitwiseAND(F.lit(POLICIES[version])) == 0)


def ablation(rows: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of the policy: documents failing it, and documents kept if that rule alone were dropped.

    Documents are first counted per distinct mask, at most 2 ** len(RULES) rows.
    """
    mask = POLICIES[version]
    masks = rows.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).alias("bit")) for r, b in BIT.items() if b & mask])
    each = masks.withColumn("r", F.explode(rules)).select("m", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("m").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"))


@query(r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS l FROM documents),
n AS (SELECT *, row_number() OVER () AS rid FROM d),
e AS (SELECT rid, i, list_slice(w, i, i + 7) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM n)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM e) WHERE c > 1),
s AS (SELECT rid, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS rep FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM n LEFT JOIN s USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_dup_lines > 5 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM b""")
def op10_quality_rules(spark, sf):
    rows = apply_policy(ledger(table(spark, sf, "documents")), "v2")
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       (F.col("failed_bits").bitwiseAND(F.lit(BASE)) != 0).alias("base_failed"), "kept")
