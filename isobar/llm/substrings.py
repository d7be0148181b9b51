"""Removal of repeated passages: Rabin-Karp hashes of every window of words, counted by Spark.

Windows are hashed in blocks of bounded size. A block marks what repeats inside it, and sends each of its distinct hashes once, sorted
and packed, to the reducer of the hash's range. A reducer names the windows whose hash came from two blocks or more, and what
it names goes back to the blocks' directories and from there to documents. Each document's places are merged into maximal intervals.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import extended, given_back, query, table, written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WINDOW = 35
# Windows of a block, bytes of text whose windows make one range of hashes, distinct words remembered per task.
BLOCK, RANGE_BYTES, KNOWN_WORDS = 1 << 20, 16_000_000, 200_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(tokens: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hash of each word."""
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in set(tokens):
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp polynomial (mod 2 ** 64) of every window of `size` word hashes, scrambled at the end.

    Horner's rule over all windows at once: no inverse and no running state is needed.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * BASE + hashes[k:k + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def merge_starts(starts: np.ndarray, n_words: int, size: int) -> list[tuple[int, int]]:
    """Maximal intervals [from, to) of words under the windows that begin at `starts`."""
    edges = np.zeros(n_words + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    cover = np.flatnonzero(np.diff(np.r_[0, (np.cumsum(edges[:-1]) > 0).astype(np.int8), 0]))
    return list(zip(cover[::2].tolist(), cover[1::2].tolist()))


def pack(values: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane, so that their leading zeros are neighbours and compress."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


class Block:
    """Hashes of up to BLOCK windows, and a directory of the documents and first windows that they belong to."""

    def __init__(self):
        self.parts, self.entries, self.size = [], [], 0

    def add(self, row: int, start: int, hashes: np.ndarray):
        self.parts.append(hashes)
        self.entries.append((row, start, len(hashes)))
        self.size += len(hashes)

    def rows(self, name: int, ranges: int) -> pa.RecordBatch:
        """One row per range of hashes with hashes and window numbers, and the directory with its own repeats for range -1 - (name mod ranges)."""
        flat = np.concatenate(self.parts)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        first = np.r_[True, ranked[1:] != ranked[:-1]]
        again = np.r_[~first[1:], False] | ~first
        marks = np.zeros(len(flat), bool)
        marks[order] = again
        # A hash that the block has marked already is sent for the others, without a window.
        window = np.where(again, BLOCK, order).astype(np.uint32)[first]
        ranked = ranked[first]
        width = (1 << 64) // ranges + 1
        cuts = np.searchsorted(ranked, np.array([min(k * width, (1 << 64) - 1) for k in range(ranges + 1)], np.uint64))
        cuts[-1] = len(ranked)
        full = np.flatnonzero(np.diff(cuts))
        hashes = [pack(ranked[cuts[k]:cuts[k + 1]]) for k in full] + [np.packbits(marks).tobytes()]
        windows = [window[cuts[k]:cuts[k + 1]].view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes() for k in full] + [np.array(self.entries, np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([*full, -1 - name % ranges], pa.int64()), pa.array([name] * len(hashes), pa.int64()),
                                           pa.array(hashes, pa.binary()), pa.array(windows, pa.binary())], names=["part", "block", "hashes", "windows"])


def repeated_spans(docs: DataFrame, size: int = WINDOW, limit: int = BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(_row, spans) of documents with windows that start at two places or more of all; docs has _row and _text.

    A block holds at most `limit` windows, and one hash range the windows of about `range_bytes` bytes of text.
    """
    spread = docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    ranges = max(1, -(-spread // range_bytes))

    def cut(batches):
        known: dict[str, int] = {}
        task, count, block = TaskContext.get().partitionId(), 0, Block()
        for batch in given_back(batches):
            for row, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                h = window_hashes(word_hashes(WORD.findall(text), known), size) if text else ()
                start = 0
                while start < len(h):
                    n = min(len(h) - start, limit - block.size)
                    block.add(row.as_py(), start, h[start:start + n])
                    start += n
                    if block.size == limit:
                        yield block.rows((task << 32) + count, ranges)
                        count, block = count + 1, Block()
        if block.size:
            yield block.rows((task << 32) + count, ranges)

    def compare(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """The windows of each block whose hashes another block sent too; a directory passes as it is."""
        if key[0].as_py() < 0:
            return rows.select(["block", "hashes", "windows"])
        parts = [unpack(x.as_py()) for x in rows.column("hashes")]
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        same = ranked[1:] == ranked[:-1]
        again = np.zeros(len(flat), bool)
        again[order] = np.r_[same, False] | np.r_[False, same]
        blocks, found, at = [], [], 0
        for block, part, packed in zip(rows.column("block"), parts, rows.column("windows")):
            window = np.zeros((len(part), 4), np.uint8)
            window[:, :3] = np.frombuffer(packed.as_py(), np.uint8).reshape(3, -1).T
            window = window.view(np.uint32).ravel()[again[at:at + len(part)]]
            at += len(part)
            window = window[window < BLOCK]
            if len(window):
                blocks.append(block.as_py())
                found.append(window.tobytes())
        return pa.table({"block": pa.array(blocks, pa.int64()), "hashes": pa.nulls(len(found), pa.binary()), "windows": pa.array(found, pa.binary())})

    def place(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Spans of words per document of a block, from its directory and the windows named by the reducers."""
        directory, marks, others = None, None, []
        for h, w in zip(rows.column("hashes"), rows.column("windows")):
            if h.is_valid:
                directory = np.frombuffer(w.as_py(), np.int64).reshape(-1, 3)
                marks = np.unpackbits(np.frombuffer(h.as_py(), np.uint8)).astype(bool)
            else:
                others.append(np.frombuffer(w.as_py(), np.uint32))
        for w in others:
            marks[w] = True
        names, spans, at = [], [], 0
        for row, start, n in directory.tolist():
            starts = np.flatnonzero(marks[at:at + n])
            at += n
            if len(starts):
                names.append(row)
                spans.append([{"a": a + start, "b": b + start} for a, b in merge_starts(starts, n + size - 1, size)])
        return pa.table({"_row": pa.array(names, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    sent = docs.select("_row", "_text").mapInArrow(cut, "part long, block long, hashes binary, windows binary")
    answers = sent.groupBy("part").applyInArrow(compare, "block long, hashes binary, windows binary")
    spans = answers.groupBy("block").applyInArrow(place, "_row long, spans array<struct<a:int,b:int>>")
    # A document of several blocks has spans from each.
    return spans.groupBy("_row").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def joined_spans(spans) -> list[dict]:
    """Sorted spans with overlapping and touching ones made one."""
    out: list[dict] = []
    for s in spans or []:
        if out and s["a"] <= out[-1]["b"]:
            out[-1]["b"] = max(out[-1]["b"], s["b"])
        else:
            out.append(dict(s))
    return out


def removal_intervals(docs: DataFrame, size: int = WINDOW, text: str = "text", stored: bool = False) -> DataFrame:
    """docs with `removed`, an array of (first, last + 1) word intervals that repeated windows cover, and `n_words`.

    Two windows are the same if their 64-bit hashes are. Null and empty texts and texts under `size` words have no
    windows. Repeated rows repeat all their windows. No rows give no rows. Other columns stay, whatever their names; input
    columns named removed and n_words go. docs are read several times and must give the same rows in the same order each
    time: say stored=True of a plain table, everything else is written first.
    """
    source = docs.drop("removed", "n_words")
    keyed = source.select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"), F.struct(*source.columns).alias("_all"))
    if not stored:
        keyed = written(keyed.drop("_text")).select("_row", F.col(f"_all.`{text}`").alias("_text"), "_all")
    found = written(repeated_spans(keyed.select("_row", "_text"), size))
    # Spans grow with the texts, so they are shuffled at any size and never broadcast.
    joined = keyed.join(found.hint("merge"), "_row", "left").select("_all.*", F.col("spans").alias("__spans"))
    names, at_text, at_spans = source.columns, source.columns.index(text), len(source.columns)

    def mark(batches):
        for batch in given_back(batches):
            removed = [joined_spans(s) for s in batch.column(at_spans).to_pylist()]
            n_words = [len(WORD.findall(t or "")) for t in batch.column(at_text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(removed, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(n_words, pa.int64())],
                names=[*names, "removed", "n_words"])

    schema = extended(source.schema, "removed array<struct<a:int,b:int>>, n_words long")
    return joined.mapInArrow(mark, schema)


def kept_words(rows: DataFrame, text: str = "text", out: str = "kept_text") -> DataFrame:
    """Adds the words outside `removed`, joined by one space."""
    names = [c for c in rows.columns if c != out]
    rows = rows.select(*names)
    at_text, at_removed = names.index(text), names.index("removed")

    def run(batches):
        for batch in given_back(batches):
            kept = []
            for t, removed in zip(batch.column(at_text).to_pylist(), batch.column(at_removed).to_pylist()):
                w, left, end = WORD.findall(t or ""), [], 0
                for r in removed or []:
                    left += w[end:r["a"]]
                    end = r["b"]
                kept.append(" ".join(left + w[end:]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string())], names=[*names, out])

    return rows.mapInArrow(run, extended(rows.schema, f"`{out}` string"))


@query(r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
e AS (SELECT rid, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS win FROM (SELECT rid, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY win) AS c FROM e) WHERE c > 1),
x AS (SELECT DISTINCT rid, unnest(range(i, i + 35)) AS p FROM r),
c AS (SELECT rid, list(p) AS ps, count(*) AS n FROM x GROUP BY rid),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d)
    ANTI JOIN x USING (rid, p) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN c USING (rid) LEFT JOIN k USING (rid)""")
def op8_substring_dedup(spark, sf):
    rows = kept_words(removal_intervals(table(spark, sf, "documents").select("doc_id", "text"), stored=True))
    n = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return rows.select("doc_id", "n_words", n.alias("n_removed"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
