"""Language of documents by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the whole lower-cased text, its state carried over words, blanks, digits and marks, and labels
every byte; a document's class has the greatest sum of log-probabilities over all its bytes. Texts are cut into segments
that are read side by side; each is read with some bytes of its neighbours, so that its states are warm where its own bytes
begin. The network is trained by backpropagation through time in numpy on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isobar.llm.common import extended, given_back, query, table, written

# Bounds of the training sample: distinct labelled texts, pieces of each, and characters of a piece.
SAMPLE_DOCS, PIECES, PIECE_CHARS = 500, 2, 140
HIDDEN, EPOCHS, BATCH, RATE, SEED = 12, 10, 64, 0.015, 7
# Bytes of a segment, bytes of its neighbours on either side, segments read side by side, and rows whose texts are held at a time.
SEGMENT, MARGIN, SIDE, ROWS = 128, 16, 4096, 1000
LETTER = regex.compile(r"\p{L}")


def segments(raw: bytes) -> np.ndarray:
    """The segments of a text, one per row, each with its margins; zero bytes stand before the first and after the last byte."""
    n = max(1, -(-len(raw) // SEGMENT))
    line = np.zeros(2 * MARGIN + n * SEGMENT, np.uint8)
    line[MARGIN:MARGIN + len(raw)] = np.frombuffer(raw, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(line, SEGMENT + 2 * MARGIN)[::SEGMENT]


def own_bytes(size: int) -> np.ndarray:
    """How many bytes of each segment of a text of that many bytes are its own."""
    n = max(1, -(-size // SEGMENT))
    return np.minimum(size - np.arange(n) * SEGMENT, SEGMENT)


def padded(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    width = max(map(len, parts))
    codes = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width).astype(np.int64)
    sizes = np.array([len(p) for p in parts])
    return codes, (np.arange(width)[None, :] < sizes[:, None]).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """Weights as a dict of arrays: x (input rows per byte), u (recurrent) and b (recurrent bias) per direction, and the output."""

    def __init__(self, labels: list[str], weights: dict[str, np.ndarray] | None = None):
        self.labels = labels
        rng = np.random.default_rng(SEED)
        h, k = HIDDEN, len(labels)
        self.w = weights or {
            **{f"x{d}": rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32) for d in "fb"},
            **{f"u{d}": rng.normal(0, 1 / np.sqrt(h), (h, 3 * h)).astype(np.float32) for d in "fb"},
            **{f"b{d}": np.zeros(3 * h, np.float32) for d in "fb"},
            "o": rng.normal(0, 0.1, (2 * h, k)).astype(np.float32), "c": np.zeros(k, np.float32)}

    def _read(self, codes, d, trace=None):
        n, width = codes.shape
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.zeros((width, n, HIDDEN), np.float32)
        for t in range(width) if d == "f" else range(width - 1, -1, -1):
            x, g = self.w[f"x{d}"][codes[:, t]], h @ self.w[f"u{d}"] + self.w[f"b{d}"]
            zr = sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN:] + r * g[:, 2 * HIDDEN:])
            if trace is not None:
                trace.append((t, h, z, r, new, g[:, 2 * HIDDEN:]))
            h = h + z * (new - h)
            states[t] = h
        return states

    def log_probabilities(self, codes, mask=None):
        """Per position and label; shape (width, rows, labels)."""
        out = np.concatenate([self._read(codes, "f"), self._read(codes, "b")], 2) @ self.w["o"] + self.w["c"]
        out -= out.max(2, keepdims=True)
        return out - np.log(np.exp(out).sum(2, keepdims=True))

    def gradients(self, codes, mask, target, weight):
        """Loss gradients by backpropagation through time; every masked position of a row has the row's label."""
        tf, tb = [], []
        states = np.concatenate([self._read(codes, "f", tf), self._read(codes, "b", tb)], 2)
        logits = states @ self.w["o"] + self.w["c"]
        p = np.exp(logits - logits.max(2, keepdims=True))
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(target)), target] -= 1
        share = mask.T[:, :, None] * weight[None, :, None]
        delta = p * share / share.sum()
        grad = {"o": np.tensordot(states, delta, ((0, 1), (0, 1))), "c": delta.sum((0, 1))}
        back = delta @ self.w["o"].T
        for d, trace, part in (("f", tf, back[:, :, :HIDDEN]), ("b", tb, back[:, :, HIDDEN:])):
            u = self.w[f"u{d}"]
            gx, gu, gb = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u), np.zeros_like(self.w[f"b{d}"])
            dh = np.zeros((len(target), HIDDEN), np.float32)
            for t, h, z, r, new, gn in reversed(trace):
                dh = dh + part[t]
                dn = dh * z * (1 - new * new)
                dz = dh * (new - h) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                np.add.at(gx, codes[:, t], np.concatenate([dz, dr, dn], 1))
                dg = np.concatenate([dz, dr, dn * r], 1)
                gu += h.T @ dg
                gb += dg.sum(0)
                dh = dh * (1 - z) + dg @ u.T
            grad |= {f"x{d}": gx, f"u{d}": gu, f"b{d}": gb}
        return grad

    def label_sums(self, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Summed log-probabilities (segments, labels) over each segment's own bytes.

        codes has a segment per row. The same sums as of log_probabilities, with a column per segment and without keeping states.
        """
        h2 = 2 * HIDDEN
        steps = np.ascontiguousarray(codes.T)
        width, n = steps.shape
        forward = np.empty((SEGMENT, len(self.labels), n), np.float32)
        total = np.zeros((len(self.labels), n), np.float64)
        for d, out in (("f", self.w["o"][:HIDDEN].T), ("b", self.w["o"][HIDDEN:].T)):
            # The bias of the gates is part of the input rows; that of the candidate stays inside the reset product.
            x = np.ascontiguousarray(self.w[f"x{d}"].T).astype(np.float32)
            x[:h2] += self.w[f"b{d}"][:h2, None]
            u, inner = np.ascontiguousarray(self.w[f"u{d}"].T).astype(np.float32), self.w[f"b{d}"][h2:, None].astype(np.float32)
            x[:h2] *= np.float32(0.5)
            u[:h2] *= np.float32(0.5)
            out = np.ascontiguousarray(out).astype(np.float32)
            h = np.zeros((HIDDEN, n), np.float32)
            for t in range(MARGIN + SEGMENT) if d == "f" else range(width - 1, MARGIN - 1, -1):
                given, g = np.take(x, steps[t], axis=1), u @ h
                gates = given[:h2]
                gates += g[:h2]
                np.tanh(gates, out=gates)
                gates *= np.float32(0.5)
                gates += np.float32(0.5)
                new = g[h2:]
                new += inner
                new *= gates[HIDDEN:]
                new += given[h2:]
                np.tanh(new, out=new)
                new -= h
                new *= gates[:HIDDEN]
                h += new
                k = t - MARGIN
                if 0 <= k < SEGMENT:
                    logits = out @ h
                    if d == "f":
                        forward[k] = logits
                    else:
                        logits += forward[k] + self.w["c"][:, None]
                        logits -= logits.max(0)
                        logits -= np.log(np.exp(logits).sum(0))
                        logits *= k < sizes
                        total += logits
        return total.T


def train(samples: list[tuple[str, str]]) -> Network:
    """A network from (text, label) pairs; Adam, fixed seed, labels weighted to equal shares. With one label there is nothing to learn."""
    labels = sorted({label for _, label in samples})
    net = Network(labels)
    if len(labels) < 2:
        return net
    texts = [(raw, labels.index(label)) for text, label in sorted(set(samples)) if (raw := text.lower().encode("utf-8", "surrogatepass"))]
    codes = np.concatenate([segments(raw) for raw, _ in texts]).astype(np.int64)
    sizes = np.concatenate([own_bytes(len(raw)) for raw, _ in texts])
    target = np.concatenate([np.full(len(own_bytes(len(raw))), k) for raw, k in texts])
    place = np.arange(codes.shape[1])[None, :] - MARGIN
    mask = ((place >= 0) & (place < sizes[:, None])).astype(np.float32)
    weight = (1 / np.maximum(np.bincount(target, weights=sizes, minlength=len(labels)), 1))[target].astype(np.float32)
    rng = np.random.default_rng(SEED)
    mean, square, step = {k: 0 for k in net.w}, {k: 0 for k in net.w}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(codes))
        for at in range(0, len(order), BATCH):
            i = order[at:at + BATCH]
            step += 1
            for k, g in net.gradients(codes[i], mask[i], target[i], weight[i]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - RATE * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return net


def fit(labelled: DataFrame, text: str = "text", label: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Network:
    """Train on a sample of at most `sample_docs` distinct labelled texts, dealt out evenly among the labels.

    Copies of a text are one text. Of each label the texts with the lowest hashes are taken, and of each text PIECES pieces of
    PIECE_CHARS characters; of more labels than `sample_docs` the most frequent are learned. The driver gets label counts and
    about twice the sample's hashes, whatever the number of tasks. Rows with a null text or label are not used; without any
    the network has no labels, and with one label only every text with a letter gets it.
    """
    rows = labelled.select(F.xxhash64(text).alias("_h"), F.col(label).cast("string").alias("_l"), F.col(text).alias("_t")).filter("_t is not null and _l is not null")
    distinct = written(rows.select("_h", "_l").distinct())
    sizes = distinct.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(sample_docs).collect()
    if not sizes:
        return train([])
    each = sample_docs // len(sizes)
    spark = labelled.sparkSession
    shares = spark.createDataFrame([(r["_l"], 2 * each / r["count"] + 8 / r["count"]) for r in sizes], "_l string, _share double")
    u = F.pmod(F.xxhash64("_h", "_l"), F.lit(1 << 30)) / float(1 << 30)
    low = distinct.join(F.broadcast(shares), "_l").select("_h", "_l", u.alias("_u"), "_share").filter("_u < _share").collect()
    chosen, taken = [], {}
    for r in sorted(low, key=lambda r: (r["_u"], r["_h"], r["_l"])):
        if taken.setdefault(r["_l"], 0) < each:
            taken[r["_l"]] += 1
            chosen.append((r["_h"], r["_l"]))
    wanted = F.broadcast(spark.createDataFrame(chosen, "_h long, _l string"))
    last = F.greatest(F.length("_t") - PIECE_CHARS + 1, F.lit(1)).cast("long")
    pieces = F.array(*[F.substr("_t", (F.pmod(F.xxhash64("_h", F.lit(i)), last) + 1).cast("int"), F.lit(PIECE_CHARS)) for i in range(PIECES)])
    found = rows.join(wanted, ["_h", "_l"]).groupBy("_h", "_l").agg(F.min(pieces).alias("_p")).collect()
    return train([(p, r["_l"]) for r in found for p in r["_p"]])


def predict(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1: the class's share of the mean byte probability).

    Null texts, texts without a letter, and all texts if no label was learned: `und` and 0. With one label its score is 1. Ties go
    to the first label by name. Input columns of the added names are replaced; repeated rows stay, and no rows give none.
    """
    docs = docs.drop("lang_pred", "score")
    names, at = docs.columns, docs.columns.index(text)

    def run(batches):
        for whole in given_back(batches):
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                raw = [t.lower().encode("utf-8", "surrogatepass") if t and net.labels and LETTER.search(t) else None for t in batch.column(at).to_pylist()]
                mean = mean_scores(net, [r for r in raw if r is not None])
                p = np.exp(mean - mean.max(1, keepdims=True)) if len(mean) else mean
                answers = iter(zip(p.argmax(1).tolist(), (p.max(1) / p.sum(1)).tolist())) if len(mean) else iter(())
                out = [("und", 0.0) if r is None else next(answers) for r in raw]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([k if isinstance(k, str) else net.labels[k] for k, _ in out], pa.string()),
                                                  pa.array([x for _, x in out], pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, extended(docs.schema, "lang_pred string, score double"))


def mean_scores(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean log-probabilities (texts, labels) over all bytes of each text; SIDE segments are read at a time, of one text or many."""
    total, count = np.zeros((len(texts), len(net.labels))), np.array([max(len(t), 1) for t in texts], np.float64)
    held, sizes, owners, n = [], [], [], 0

    def flush():
        nonlocal held, sizes, owners, n
        if n:
            np.add.at(total, np.concatenate(owners), net.label_sums(np.concatenate(held), np.concatenate(sizes)))
        held, sizes, owners, n = [], [], [], 0

    for i, t in enumerate(texts):
        parts, own = segments(t), own_bytes(len(t))
        while len(parts):
            take = min(len(parts), SIDE - n)
            held.append(parts[:take])
            sizes.append(own[:take])
            owners.append(np.full(take, i))
            n += take
            parts, own = parts[take:], own[take:]
            if n == SIDE:
                flush()
    flush()
    return total / count[:, None]


def held_out(doc_id):
    """The fold that is never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


@query()
def op3_language_id(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    net = fit(docs.filter(~F.col("held_out")))
    return predict(docs.select("doc_id", "text", "held_out"), net).select("doc_id", "held_out", "lang_pred", "score")
