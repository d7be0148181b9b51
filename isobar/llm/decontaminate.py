"""Benchmark decontamination with a generalised suffix automaton over the words of all items.

The automaton is built from one bounded block of items at a time and sent to the tasks; documents pass through one step per
block, without a shuffle. A document's words are streamed through it; the matching length at each word tells which
windows end there. Stretches whose neighbouring word pairs occur in no item cannot reach a window and are skipped.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import LOWER, UPPER, query, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TO_LOWER = str.maketrans(UPPER, LOWER)
WINDOW = 13
# Words of items in one automaton; bounds what is sent to the tasks at once.
BLOCK_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(TO_LOWER))


class Automaton:
    """Generalised suffix automaton: states with a longest length, a suffix link and transitions by word number."""

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(name, [self.number.setdefault(w, len(self.number)) for w in ws]) for name, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        # State -> items: those with the state's window of full length, and short items that are the whole match.
        self.full: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        pairs, self.least = set(), window
        for name, codes in coded:
            pairs.update(zip(codes, codes[1:]))
            if len(codes) < window:
                state = 0
                for c in codes:
                    state = self.next[state][c]
                self.short.setdefault(state, (len(codes), set()))[1].add(name)
                self.least = min(self.least, len(codes))
                continue
            state = size = 0
            for c in codes:
                state, size = self.step(state, size, c)
                if size >= window:
                    self.full.setdefault(self.window_state(state), set()).add(name)
        self.pairs = np.array(sorted(a * len(self.number) + b for a, b in pairs), np.int64)

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """State and length of the longest suffix of what was read that stands in an item."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.length[state]
        found = self.next[state].get(c)
        return (0, 0) if found is None else (found, size + 1)

    def window_state(self, state: int) -> int:
        """The state that holds the last `window` words of a match at least that long."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, tokens: list[str]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word intervals inside occurring windows, and the items they come from."""
        get = self.number.get
        codes = np.array([get(w, -1) for w in tokens], np.int64)
        if not len(codes) or not self.number:
            return [], set()
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        known = codes >= 0
        pair = codes[:-1] * len(self.number) + codes[1:]
        joined = known[:-1] & known[1:]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined &= self.pairs[at] == pair
        else:
            joined &= False
        # Runs of known words whose neighbouring pairs are all known; a run may be a single word.
        open_ = np.flatnonzero(known & ~np.r_[False, joined])
        close = np.flatnonzero(known & ~np.r_[joined, False])
        for a, b in zip(open_.tolist(), close.tolist()):
            if b - a + 1 < self.least:
                continue
            state = size = 0
            for i, c in enumerate(codes[a:b + 1].tolist(), a):
                state, size = self.step(state, size, c)
                if size >= self.window:
                    spans.append((i - size + 1, i + 1))
                    items |= self.full[self.window_state(state)]
                if self.short and size >= self.least:
                    s = state
                    while s > 0:
                        hit = self.short.get(s)
                        if hit and hit[0] <= size:
                            spans.append((i - hit[0] + 1, i + 1))
                            items |= hit[1]
                        s = self.link[s]
        return spans, items


def blocks(benchmark: DataFrame, limit: int):
    """Items in blocks of at most `limit` words, or of one item; one partition at a time comes to the driver."""
    block: list[tuple[str, list[str]]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        ws = words_of(row[1])
        if block and size + len(ws) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], ws))
        size += len(ws)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, `spans` (disjoint word intervals inside occurring windows), n_hit, items (sorted ids) and contaminated.

    A null or empty text has no words and is clean; an empty benchmark leaves all clean. Items without words match
    nothing. Items with the same id count once. Input columns of the added names are replaced; repeated rows stay.
    """
    added = ["n_words", "spans", "n_hit", "items"]
    rows = docs.drop(*added, "contaminated").withColumns(
        {"n_words": F.lit(0).cast("long"), "spans": F.array().cast("array<struct<a:int,b:int>>"), "n_hit": F.lit(0).cast("long"),
         "items": F.array().cast("array<string>")})
    names, at = rows.columns, rows.columns.index(text)
    schema = rows.schema
    for block in blocks(benchmark, block_words):
        rows = rows.mapInArrow(_through(docs.sparkSession.sparkContext.broadcast(block), names, at, window), schema)
    return rows.withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def _through(block, names, at, window):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches):
        automaton = Automaton(block.value, window)
        for batch in batches:
            old_spans, old_items = batch.column(len(names) - 3).to_pylist(), batch.column(len(names) - 1).to_pylist()
            columns: list[list] = [[], [], [], []]
            for t, spans, items in zip(batch.column(at).to_pylist(), old_spans, old_items):
                tokens = words_of(t)
                more, found = automaton.matches(tokens)
                merged: list[list[int]] = []
                for a, b in sorted([(s["a"], s["b"]) for s in spans] + more):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                columns[0].append(len(tokens))
                columns[1].append([{"a": a, "b": b} for a, b in merged])
                columns[2].append(sum(b - a for a, b in merged))
                columns[3].append(sorted(found | set(items)))
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], kind), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *arrays], names=names)

    return run


@query(r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item, list_slice(w, i, i + least(13, len(w)) - 1) AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT len(win) AS n FROM q),
e AS (SELECT rid, i, list_slice(w, i, i + n - 1) AS win FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d JOIN l ON len(w) >= n)),
h AS (SELECT rid, i, len(win) AS n, item FROM e JOIN q USING (win)),
c AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)""")
def op5_decontaminate(spark, sf):
    rows = decontaminate(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")
