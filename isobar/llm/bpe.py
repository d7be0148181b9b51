"""BPE encoding and decoding with batched numpy merge rounds.

Texts are normalised and split into words; the symbols of all new words of a batch lie in one flat array. Each round
finds the rank of every adjacent pair by binary search over the sorted pair keys and merges, in every word at once,
its lowest-ranked pair from left to right. A word of very many symbols would need a round over all of them per rank, so its
pairs wait in a heap instead. Each distinct word is encoded once per task.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import extended, query, table

# Words held in a task's memory before the store starts anew.
WORDS_KEPT = 400_000
# Longest word that is remembered; longer ones are encoded each time.
LONGEST_KEPT = 64
# Words of more characters are merged by a heap, in n log n.
LONGEST_BATCHED = 1024


def byte_letters() -> list[str]:
    """Printable letter of each byte, by the public rule of byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Codec:
    """A word-level BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.word_pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.size = max(vocabulary.values()) + 1
        self.token = {i: t for t, i in (vocabulary | self.special).items()}
        letters = byte_letters()
        self.inner = np.array([vocabulary[x] for x in letters])
        self.last = np.array([vocabulary[x + self.end] for x in letters])
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in merges])
        order = np.argsort(keys, kind="stable")
        first = np.r_[True, np.diff(keys[order]) > 0] if len(keys) else np.zeros(0, bool)
        self.keys, self.ranks = keys[order][first], order[first]
        self.merged = np.array([vocabulary[a + b] for a, b in merges])
        self.known: dict[str, tuple[str, str, int]] = {}

    def words_of(self, text: str) -> list[str]:
        text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        return self.word_pattern.findall(text)

    def ranked(self, pair: np.ndarray) -> np.ndarray:
        """Rank of each pair key by binary search; the number of merges where there is none."""
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], len(self.merged))

    def merge_long(self, word: str) -> list[int]:
        """Ids of one word: its lowest-ranked pair, the leftmost of equal ones, is merged until there is none."""
        data = np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)
        start = self.inner[data]
        start[-1] = self.last[data[-1]]
        ranks = self.ranked(start[:-1] * self.size + start[1:])
        ids, n, none = start.tolist(), len(start), len(self.merged)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(int(ranks[i]), int(i), ids[i], ids[i + 1]) for i in np.flatnonzero(ranks < none)]
        heapq.heapify(heap)
        seen: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = ids[i], ids[j]
            if pair not in seen:
                seen[pair] = int(self.ranked(np.array([pair[0] * self.size + pair[1]]))[0])
            if seen[pair] < none:
                heapq.heappush(heap, (seen[pair], i, *pair))

        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            # A merged-away symbol is -1; a pair that has changed since is out of date.
            if ids[i] != left or j == n or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.merged[rank]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        long = {k: self.merge_long(w) for k, w in enumerate(words) if len(w) > LONGEST_BATCHED}
        if long:
            rest = iter(self.merge([w for k, w in enumerate(words) if k not in long]) if len(long) < len(words) else [])
            return [long[k] if k in long else next(rest) for k in range(len(words))]
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(b) for b in raw])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(sizes)
        ids = self.inner[data]
        ids[ends - 1] = self.last[data[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        none = len(self.merged)
        while len(ids):
            rank = np.where(word[:-1] == word[1:], self.ranked(ids[:-1] * self.size + ids[1:]), none)
            best = np.full(len(words), none)
            np.minimum.at(best, word[:-1], rank)
            ready = best[word] == none
            if ready.any():
                done.append((word[ready], ids[ready]))
                keep = ~ready
                rank = np.append(rank, none)[keep][:-1] if keep.any() else rank[:0]
                ids, word = ids[keep], word[keep]
                if not len(ids):
                    break
            hit = np.flatnonzero((rank == best[word[:-1]]) & (rank < none))
            # In a run of overlapping pairs every second one is merged, from the left.
            new_run = np.r_[True, np.diff(hit) > 1]
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(new_run, place, 0))) % 2 == 0]
            ids[hit] = self.merged[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        if not done:
            return [[] for _ in words]
        word, ids = np.concatenate([w for w, _ in done]), np.concatenate([i for _, i in done])
        order = np.argsort(word, kind="stable")
        cuts = np.searchsorted(word[order], np.arange(1, len(words)))
        return [part.tolist() for part in np.split(ids[order], cuts)]

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """Words and special tokens of each text, in order."""
        out = []
        for text in texts:
            found: list[str] = []
            for part in self.special_pattern.split(text):
                found += [part] if part in self.special else self.words_of(part) if part else []
            out.append(found)
        return out

    def encoded(self, pieces: list[list[str]]) -> dict[str, tuple[str, str, int]]:
        """(ids as text, decoded text, number of ids) of every distinct piece."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        fresh = list({w for p in pieces for w in p if w not in self.known and w not in self.special})
        extra = {s: (str(i), s, 1) for s, i in self.special.items()}
        for w, ids in zip(fresh, self.merge(fresh) if fresh else []):
            entry = (" ".join(map(str, ids)), self.decode(ids), len(ids))
            (self.known if len(w) <= LONGEST_KEPT else extra)[w] = entry
        return {w: extra[w] if w in extra else self.known[w] for p in pieces for w in p}

    def decode(self, ids) -> str:
        """Tokens joined by one space, as for a vocabulary without a decoder; special tokens stay."""
        return " ".join([self.token[i] for i in ids])


def encode(docs: DataFrame, content: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids_text (decimal ids joined by a space) and decoded to docs; a null text is empty.

    Without keep_ids the hex digests ids_sha256 and decoded_sha256 stand in place of the two texts. Input columns of
    these names are replaced. A text of a million words is encoded whole.
    """
    names = ["n_tokens", "ids_text", "decoded"] if keep_ids else ["n_tokens", "ids_sha256", "decoded_sha256"]
    docs = docs.drop(*names)
    other = [c for c in docs.columns]
    position = other.index(text)

    def run(batches):
        codec = Codec(content)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                pieces = codec.pieces([t or "" for t in part.column(position).to_pylist()])
                coded = codec.encoded(pieces)
                columns: list[list] = [[], [], []]
                for p in pieces:
                    entries = [coded[w] for w in p]
                    ids, plain = " ".join([e[0] for e in entries]), " ".join([e[1] for e in entries])
                    columns[0].append(sum(e[2] for e in entries))
                    columns[1].append(ids if keep_ids else hashlib.sha256(ids.encode()).hexdigest())
                    columns[2].append(plain if keep_ids else hashlib.sha256(plain.encode()).hexdigest())
                arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=[*other, *names])

    schema = extended(docs.schema, f"{names[0]} long, {names[1]} string, {names[2]} string")
    return docs.mapInArrow(run, schema)


def word_vocabulary() -> str:
    """Content of the public vocabulary file; about 2 MB, a fixed size."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


@query()
def op7_bpe(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return encode(docs, word_vocabulary(), keep_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
