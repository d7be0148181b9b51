"""Importance resampling towards a target corpus.

Hashed features (runs of one and two words) are counted over the whole raw corpus and over the target texts; a bucket's gain
is the logarithm of how much more frequent it is in the target. A document's weight is its mean gain, and a fixed draw of
Gumbel noise per document turns weights into a sample without replacement.

Texts of a batch are joined with separators, one pass of a regular expression finds all words, their offsets tell the
document, and pairs of words over a document's border are masked out before counting.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import extended, query, table, written
from isobar.llm.places import numbered

BUCKETS, PERCENT, LEAST_WORDS, SEED = 10_000, 25, 20, 7
# A word of ASCII letters, digits and anything beyond ASCII, with the separators that follow it.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
WORD_AND_GAP = re.compile(rb"[0-9a-z\x80-\xff]+[^0-9a-z\x80-\xff]*")
SENTINEL = b"\n"
# Bytes of text that are worked on at a time (one longer text is taken alone), distinct words remembered per task.
BLOCK_BYTES, KNOWN_WORDS = 4_000_000, 300_000
# Words up to this many bytes are appended to a checksum by tables.
TABLED = 48


def append_tables(longest: int = TABLED) -> np.ndarray:
    """[n, k, b]: the checksum register after n zero bytes, from byte b at place k."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = np.empty((longest + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(longest):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ one[out[n] & np.uint32(255)]
    return out


class Features:
    """Buckets of the features of texts; remembers the checksums of words it has met."""

    def __init__(self, buckets: int):
        self.buckets = np.uint32(buckets)
        self.tables = append_tables()
        self._forget()

    def _forget(self):
        self.number: dict[bytes, int] = {}
        self.size, self.alone, self.spaced, self.word = [], [], [], []

    def _lookup(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.number) > KNOWN_WORDS:
            self._forget()
        for token in set(tokens) - self.number.keys():
            word = WORD.match(token).group()
            self.number[token] = len(self.size)
            self.size.append(len(word))
            self.alone.append(zlib.crc32(word))
            self.spaced.append(zlib.crc32(word + b" "))
            self.word.append(word if len(word) > TABLED else b"")
        return np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document number and bucket of every feature, words per document)."""
        parts = [t or b"" for t in texts]
        blob = SENTINEL.join(parts).lower()
        lead = WORD.search(blob)
        tokens = WORD_AND_GAP.findall(blob)
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(parts), np.int64)
        ends = lead.start() + np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        starts = np.r_[lead.start(), ends[:-1]]
        begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        doc = np.searchsorted(begins, starts, side="right") - 1
        at = self._lookup(tokens)
        size, alone = np.array(self.size)[at], np.array(self.alone, np.uint32)[at]
        inside = np.flatnonzero(doc[1:] == doc[:-1])
        left, n = np.array(self.spaced, np.uint32)[at[inside]], size[inside + 1]
        short = np.minimum(n, TABLED)
        both = alone[inside + 1]
        for k in range(4):
            both = both ^ self.tables[short, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
        for i in np.flatnonzero(n > TABLED):
            both[i] = zlib.crc32(self.word[at[inside[i] + 1]], int(left[i]))
        bucket = np.concatenate([alone % self.buckets, both % self.buckets]).astype(np.int64)
        return np.concatenate([doc, doc[inside]]), bucket, np.bincount(doc, minlength=len(parts))


def blocks(batches, column: int):
    """(slice of a batch, its texts as bytes), each of about BLOCK_BYTES of text, or one longer text."""
    for batch in batches:
        texts = batch.column(column).cast(pa.large_binary()).to_pylist()
        start, held = 0, 0
        for i, t in enumerate(texts):
            n = len(t or b"") + 1
            if held and held + n > BLOCK_BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, held = i, 0
            held += n
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def bucket_counts(rows: DataFrame, text: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows. Each task sends its sums, and the driver gets one number per bucket."""
    def run(batches):
        features, total = Features(buckets), np.zeros(buckets, np.int64)
        for _, texts in blocks(batches, 0):
            total += np.bincount(features.of(texts)[1], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(smoothed share in the target / smoothed share in the raw corpus)) of every bucket."""
    k = len(raw)
    ratio = (target + 1.0) * (raw.sum() + float(k)) / ((raw + 1.0) * (target.sum() + float(k)))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(docs: DataFrame, target: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """docs with n_words, n_features and weight (floored mean gain of its features; 0 without any)."""
    table_of = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    docs = docs.drop("n_words", "n_features", "weight")
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        features = Features(buckets)
        for part, texts in blocks(batches, at):
            doc, bucket, n_words = features.of(texts)
            n = np.bincount(doc, minlength=len(texts))
            total = np.bincount(doc, weights=table_of[bucket], minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                                             names=[*names, "n_words", "n_features", "weight"])

    return docs.mapInArrow(run, extended(docs.schema, "n_words long, n_features long, weight long"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT,
             least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of docs; rank is null for rows that are not drawn.

    Of the N rows with `least_words` words or more, the floor(percent * N / 100) with the highest scores are drawn, ties to the
    smaller key, a null key first; rows equal in both are drawn in any order. Noise depends on key and seed alone, a null key
    counting as an empty one. Null and empty texts have no features, weight 0, and are never drawn if least_words > 0. With no
    target text all gains come from the raw corpus alone; with no docs the result is empty. Other columns are left out.
    """
    rows = weighted(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), target.select(F.col(text).alias("_text")), "_text", buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(rows.drop("_text").withColumn("score", F.col("weight") + noise))
    able = scored.filter(F.col("n_words") >= least_words).withColumn("_all", F.lit(0))
    drawn = numbered(able, "_all", [F.desc("score"), F.asc_nulls_first("_key")])
    rank = F.when(F.col("idx") < F.floor(F.col("total") * percent / 100), F.col("idx") + 1)
    out = ["n_features", "weight", "score"]
    return drawn.select(F.col("_key").alias(key), *out, rank.cast("long").alias("rank")).unionByName(
        scored.filter(F.col("n_words") < least_words).select(F.col("_key").alias(key), *out, F.lit(None).cast("long").alias("rank")))


@query(r"""
WITH RECURSIVE poly AS (SELECT list(c ORDER BY b) AS t FROM (WITH RECURSIVE z AS (SELECT b, b::BIGINT AS c, 0 AS k FROM range(256) r(b)
        UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM z WHERE k < 8) SELECT b, c FROM z WHERE k = 8)),
w AS (SELECT 0 AS side, doc_id AS id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
    UNION ALL SELECT 1, NULL, -row_number() OVER (), list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
f AS MATERIALIZED (SELECT side, rid, f, count(*) AS n FROM (SELECT side, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w) GROUP BY ALL),
g AS MATERIALIZED (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f)),
step AS (SELECT f, x, 4294967295::BIGINT AS c, 0 AS i FROM g
    UNION ALL SELECT f, x, xor(c >> 8, t[(xor(c, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) & 255) + 1]), i + 1 FROM step, poly WHERE 2 * i < length(x)),
b AS MATERIALIZED (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM step WHERE 2 * i = length(x)),
s AS (SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM f JOIN b USING (f) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM s) + 10000) / ((s + 1) * ((SELECT sum(t) FROM s) + 10000))))::BIGINT AS gain FROM s),
d AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM f JOIN b USING (f) JOIN gain USING (bucket) WHERE side = 0 GROUP BY rid),
h AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM w LEFT JOIN d USING (rid) WHERE side = 0),
r AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM h)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM h WHERE n_words >= 20) THEN place END AS rank FROM r""")
def op11_resample(spark, sf):
    return resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
