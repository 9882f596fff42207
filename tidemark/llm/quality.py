"""Document quality by a linear-chain conditional random field over lines.

Each line is described by binned statistics of its characters and words, its neighbours' along with its own; the chain
labels every line good or bad. Training lines take the label of their document. Forward-backward marginals, weighted by the
lines' lengths, are the document's score. With two labels, messages are single log-odds, so a batch of documents is one
numpy recursion over line numbers.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, text_batches

#: Labelled documents the model is fitted on at most (the first by a hash of their id), lines of a training chain, and most
#: chains of a training document (spread evenly over it).
TRAIN_DOCUMENTS, CHAIN, CHAINS = 6_000, 64, 4
#: Bins of a feature, rounds and rate of the fit, weight of the squared penalty.
BINS, ROUNDS, RATE, PENALTY = 8, 150, 0.08, 1e-3

#: Classes of bytes: 0 other symbols, 1 lower, 2 upper, 3 digits, 4 blanks, 5 full stops, 6 commas and quotes, 7 marks of alarm, 8 beyond ASCII, 9 control.
BYTE_CLASS = np.zeros(256, np.uint8)
for _codes, _class in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t", 4), (b".", 5), (b",;:'\"()-", 6), (b"!?", 7), (range(128, 256), 8), ([*range(9), *range(10, 32), 127], 9)):
    BYTE_CLASS[list(_codes)] = _class
N_CLASSES = 10
FEATURES = 16


def lines_of(text: bytes | None) -> list[bytes]:
    """Lines that are not blank."""
    return [x for x in (text or b"").split(b"\n") if x.strip()]


def features(lines: list[bytes]) -> np.ndarray:
    """FEATURES statistics of each line."""
    if not lines:
        return np.zeros((0, FEATURES), np.float32)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = BYTE_CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    counts = np.bincount(np.repeat(np.arange(len(lines)) * N_CLASSES, size) + codes, minlength=len(lines) * N_CLASSES).reshape(-1, N_CLASSES).astype(np.float64)
    words, distinct, twice, longest = (np.empty(len(lines)) for _ in range(4))
    for i, line in enumerate(lines):
        w = line.split()
        words[i], distinct[i] = len(w), len(set(w))
        twice[i] = sum(map(operator.eq, w, w[1:]))
        longest[i] = max(map(len, w), default=0)
    letters = counts[:, 1] + counts[:, 2] + counts[:, 8]
    share = lambda x, of: x / np.maximum(of, 1)
    first, last = BYTE_CLASS[[x.lstrip()[0] for x in lines]], BYTE_CLASS[[x.rstrip()[-1] for x in lines]]
    out = np.stack([
        np.log1p(size), share(letters, size), share(counts[:, 2], letters), share(counts[:, 3], size), share(counts[:, 4], size), share(counts[:, 5], words), share(counts[:, 6], words),
        share(counts[:, 7], words), share(counts[:, 0], size), share(counts[:, 8], letters), share(letters, words), share(distinct, words), share(twice, words), np.log1p(longest),
        (last == 5) + 2.0 * (last == 7) + 3.0 * (last == 0), (first == 2) + 2.0 * (first == 3) + 3.0 * (first == 0),
    ], axis=1)
    return out.astype(np.float32)


def messages(u: np.ndarray, sizes: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward log-odds (own evidence included) and backward log-odds (own excluded) of the concatenated chains u."""
    start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    order = np.argsort(-sizes, kind="stable")
    start, size = start[order], sizes[order]
    a, b = u.astype(np.float64).copy(), np.zeros(len(u))
    lae = np.logaddexp
    for k in range(1, int(size[0]) if len(size) else 0):
        at = start[: np.searchsorted(-size, -k, side="left")] + k  # chains with more than k lines
        x = a[at - 1]
        a[at] = u[at] + lae(x + t[1, 1], t[0, 1]) - lae(x + t[1, 0], t[0, 0])
    for k in range(int(size[0]) - 2 if len(size) else -1, -1, -1):
        at = start[: np.searchsorted(-size, -(k + 1), side="left")] + k
        x = u[at + 1] + b[at + 1]
        b[at] = lae(x + t[1, 1], t[1, 0]) - lae(x + t[0, 1], t[0, 0])
    return a, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Chain:
    """A fitted field: bin edges, weights of the line's own, the previous and the next line's bins, transitions, prior."""

    edges: np.ndarray
    weights: np.ndarray
    outer: np.ndarray
    move: np.ndarray
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, FEATURES), np.int64)

    def evidence(self, bins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log-odds of each line by its own bins and its neighbours'."""
        at = bins + np.arange(FEATURES) * (BINS + 1)
        own, before, after = (w.ravel()[at].sum(axis=1) for w in self.weights)
        first = np.zeros(len(bins), bool)
        first[np.concatenate([[0], np.cumsum(sizes)[:-1]])[sizes > 0].astype(np.int64)] = True
        u = own + self.outer[0]
        if len(u):
            u += np.where(first, self.outer[1], np.roll(before, 1))
            u += np.where(np.roll(first, -1), self.outer[2], np.roll(after, -1))
        return u

    def scores(self, texts: list[bytes | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Length-weighted marginals of documents, and the marginal of each of their lines."""
        parts = [lines_of(t) for t in texts]
        sizes, lines = np.array([len(p) for p in parts], np.int64), [x for p in parts for x in p]
        if not lines:
            return np.full(len(texts), self.prior), [np.zeros(0)] * len(texts)
        a, b = messages(u := self.evidence(self.bins(features(lines)), sizes), sizes, self.move)
        good = sigmoid(a + b)
        owner, length = np.repeat(np.arange(len(texts)), sizes), np.fromiter(map(len, lines), np.float64, len(lines))
        total, weight = np.bincount(owner, good * length, len(texts)), np.bincount(owner, length, len(texts))
        del u
        return np.where(weight > 0, total / np.maximum(weight, 1), self.prior), np.split(good, np.cumsum(sizes)[:-1])


def fit_chains(x: np.ndarray, sizes: np.ndarray, labels: np.ndarray, prior: float) -> Chain:
    """x: features of the lines of all chains; labels: of each chain. Maximises the conditional likelihood by Adam."""
    edges = np.full((FEATURES, BINS), np.inf, np.float32)
    for f in range(FEATURES):
        cuts = np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[:-1]).astype(np.float32)) if len(x) else []
        edges[f, : len(cuts)] = cuts
    model = Chain(edges, np.zeros((3, FEATURES, BINS + 1)), np.zeros(3), np.zeros((2, 2)), prior)
    if not len(x) or len(set(labels.tolist())) < 2:
        model.outer[0] = np.log(np.clip(prior, 1e-3, 1 - 1e-3) / np.clip(1 - prior, 1e-3, 1))
        return model
    bins = model.bins(x)
    at = bins + np.arange(FEATURES) * (BINS + 1)
    n, cells = len(x), FEATURES * (BINS + 1)
    first = np.zeros(n, bool)
    first[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = True
    last = np.roll(first, -1)
    y = np.repeat(labels, sizes).astype(np.float64)
    inner = np.flatnonzero(~first)  # lines with a previous one
    chains = len(sizes)
    weight = np.repeat(1 / sizes, sizes)  # a long chain weighs as much as a short one
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (model.weights, model.outer, model.move)]
    for step in range(1, ROUNDS + 1):
        u = model.evidence(bins, sizes)
        a, b = messages(u, sizes, model.move)
        r = (y - sigmoid(a + b)) * weight
        g_own = np.bincount(at.ravel(), np.repeat(r, FEATURES), cells)
        g_before = np.bincount(at[inner - 1].ravel(), np.repeat(r[inner], FEATURES), cells)
        g_after = np.bincount(at[inner].ravel(), np.repeat(r[inner - 1], FEATURES), cells)
        g_w = np.stack([g_own, g_before, g_after]).reshape(3, FEATURES, BINS + 1)
        g_o = np.array([r.sum(), r[first].sum(), r[last].sum()])
        x0, x1 = a[inner - 1], u[inner] + b[inner]
        logs = np.stack([np.full(len(inner), model.move[0, 0]), x1 + model.move[0, 1], x0 + model.move[1, 0], x0 + x1 + model.move[1, 1]])
        p = np.exp(logs - logs.max(axis=0))
        p /= p.sum(axis=0)
        seen = np.stack([(y[inner] == 0), np.zeros(len(inner)), np.zeros(len(inner)), (y[inner] == 1)])
        g_t = ((seen - p) * weight[inner]).sum(axis=1).reshape(2, 2)
        for (m, v), p_, g in zip(moments, (model.weights, model.outer, model.move), (g_w, g_o, g_t)):
            g = g / chains - PENALTY * p_
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p_ += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCUMENTS) -> Chain:
    """Fits on at most `most` labelled documents, the first by a hash of their id, and on at most CHAINS chains of CHAIN lines
    of each, spread evenly over it. labels: id_col and label_col (0 or 1); rows with a null id or label are ignored, an id
    with several labels counts by its largest."""
    text_batches(documents.sparkSession)
    known = labels.select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(most)
    rows = documents.select(F.col(id_col).alias("k"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), "k").select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole):
                found, ys = [], []
                for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                    lines = lines_of(text)
                    starts = range(0, len(lines), CHAIN)
                    if len(starts) > CHAINS:
                        starts = [starts[k * len(starts) // CHAINS] for k in range(CHAINS)]
                    for at in starts:
                        found.append(features(lines[at : at + CHAIN]).tobytes())
                        ys.append(y)
                yield pa.RecordBatch.from_pydict({"x": pa.array(found, pa.binary()), "y": pa.array(ys, pa.int32())})

    # At most TRAIN_DOCUMENTS * CHAINS chains (rows that share an id aside) of CHAIN lines: some 100 MB.
    got = sorted(rows.mapInArrow(run, "x binary, y int").collect())
    parts = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
    y = np.array([r["y"] for r in got], np.int64)
    x = np.concatenate(parts) if parts else np.zeros((0, FEATURES), np.float32)
    return fit_chains(x, np.array([len(p) for p in parts], np.int64), y, float((y.sum() + 1) / (len(y) + 2)))


def score(documents: DataFrame, model: Chain, *, id_col: str = "doc_id", text_col: str = "text", lines: bool = False) -> DataFrame:
    """id_col, score (0 to 1, the length-weighted share of good lines) and, on request, line_scores.

    Null, empty and blank texts get the share of good documents in training. Every row gives one; equal texts score alike.
    """
    text_batches(documents.sparkSession)
    rows = documents.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    schema = T.StructType([rows.schema.fields[0], T.StructField("score", T.DoubleType()), *([T.StructField("line_scores", T.ArrayType(T.DoubleType()))] if lines else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "__text"):
                total, each = model.scores(batch.column("__text").to_pylist())
                arrays = [batch.column(0), pa.array(np.clip(total, 0, 1))]
                if lines:
                    arrays.append(pa.array([x.tolist() for x in each], pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return rows.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> F.Column:
    """Whether a document is kept from training: the CRC-32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5): fitted on labels of documents that are not held out.

    Null, empty and blank texts get the share of good documents in training, as all do without usable labels; very long texts
    are scored whole; equal texts score alike; every row gives one, null and repeated ids included (a null id is not held
    out); an empty table gives none. Other columns are not read, so they may have any name.
    """
    model: Chain = fit(documents, labels.where(~held_out()))
    return score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


