"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, and only the bag has a label.  A passage
becomes the frequencies of pairs of adjacent character classes and of repeated words; one hidden
layer encodes it.
Gated attention, learned from the labels of the bags, gives each passage a weight (the weights
of a document sum to 1), and the weighted sum of the encodings gives the score.

The model is trained on all passages of ``SAMPLE`` labelled documents, the smallest by a hash of their
id; scoring reads every passage of every text.  Ids, labels, language and source are no inputs.  Training runs on the driver with fixed
seeds, so equal tables give equal scores.

Defined results: a null or empty text is a bag of one empty passage; labels that are null or
without a document are ignored, the mean of several labels of one document is rounded; labels of
one kind only, or none, give every document the share of label 1 (0.5 without any); repeated
rows are scored alike, and trained on once; texts of any length are read whole; an empty table gives an
empty result; the two added columns, whose names are parameters, replace others of their names, all other
columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

PASSAGE = 400  # bytes
SAMPLE = 6000  # documents
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 40, 256, 0.01, 1e-4
CHUNK = 1 << 19  # bytes in hand at once

CLASSES = 10
_KIND = np.full(256, 7, np.int64)  # bytes of other scripts and accents
_KIND[:32] = _KIND[127] = 9
for _kind, _of in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:?'\"-", "!#$%&*@~^+=", None, "|<>{}[]()/\\_`")):
    if _of:
        _KIND[np.frombuffer(_of.encode(), np.uint8)] = _kind
FEATURES = CLASSES * CLASSES + 3
_MIX = np.random.default_rng(1).integers(0, 1 << 62, 256)


def bag_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (float32), and the number of passages of each text."""
    sizes = np.array([len(t) for t in texts])
    counts = np.maximum(1, -(-sizes // PASSAGE))
    raw = _KIND[np.frombuffer(b"".join(texts), np.uint8)]
    starts = np.cumsum(sizes) - sizes
    first = np.cumsum(counts) - counts
    # of each byte: its passage; a pair belongs to the passage of its second byte
    passage = (np.arange(len(raw)) - np.repeat(starts, sizes)) // PASSAGE + np.repeat(first, sizes)
    if len(raw):
        before = np.concatenate(([4], raw[:-1]))
        before[starts[sizes > 0]] = 4  # a text begins as a line does
        pairs = np.bincount(passage * (CLASSES * CLASSES) + before * CLASSES + raw, minlength=counts.sum() * CLASSES * CLASSES)
    else:
        pairs = np.zeros(counts.sum() * CLASSES * CLASSES)
    pairs = pairs.reshape(-1, CLASSES * CLASSES).astype(np.float32)
    length = pairs.sum(1, keepdims=True)
    same = _repeats(texts, starts, sizes, passage, int(counts.sum()))
    out = np.hstack((np.sqrt(pairs / np.maximum(length, 1)), length / PASSAGE, np.log1p(np.repeat(sizes, counts))[:, None] / 10, same[:, None])).astype(np.float32)
    return out, counts


def _repeats(texts: list[bytes], starts: np.ndarray, sizes: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Of the words that begin in each passage, the share equal to the word before (compared by
    length and a sum over their bytes)."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    if not len(raw):
        return np.zeros(n)
    inside = raw > 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[starts[sizes > 0]] = inside[starts[sizes > 0]]
    at = np.nonzero(begins)[0]
    if not len(at):
        return np.zeros(n)
    sums = np.add.reduceat(np.where(inside, _MIX[raw], 0), at)
    lengths = np.add.reduceat(inside, at, dtype=np.int64)
    same = np.zeros(len(at), bool)
    same[1:] = (sums[1:] == sums[:-1]) & (lengths[1:] == lengths[:-1])
    words = np.bincount(passage[at], minlength=n)
    return np.bincount(passage[at][same], minlength=n) / np.maximum(words, 1)


class AttentionModel:
    """Weights of the encoder (W), the gated attention (V, U, w) and the scorer (c)."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)

        def weights(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        zero = lambda n: np.zeros(n, np.float32)
        self.mean, self.scale = zero(FEATURES), np.ones(FEATURES, np.float32)
        self.p = {"W": weights(FEATURES, HIDDEN), "Wb": zero(HIDDEN), "V": weights(HIDDEN, GATE), "Vb": zero(GATE), "U": weights(HIDDEN, GATE), "Ub": zero(GATE), "w": weights(GATE, 1), "c": weights(HIDDEN, 1), "cb": zero(1)}
        self.constant: float | None = None

    def _forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p, starts = self.p, np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["Wb"])
        t, g = np.tanh(h @ p["V"] + p["Vb"]), 1 / (1 + np.exp(-(h @ p["U"] + p["Ub"])))
        e = ((t * g) @ p["w"])[:, 0]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        a = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "logit": (z @ p["c"])[:, 0] + p["cb"][0]}

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(counts), self.constant)
        logit = self._forward((x - self.mean) * self.scale, counts)["logit"].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def _gradients(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, f, starts = self.p, self._forward(x, counts), np.cumsum(counts) - counts
        d_logit = (1 / (1 + np.exp(-f["logit"])) - label).astype(np.float32)[:, None] / len(counts)
        d_z = np.repeat(d_logit @ p["c"].T, counts, axis=0)
        d_a = (d_z * f["h"]).sum(1)
        d_e = f["a"] * (d_a - np.repeat(np.add.reduceat(f["a"] * d_a, starts), counts))
        d_tg = d_e[:, None] @ p["w"].T
        d_v = d_tg * f["g"] * (1 - f["t"] ** 2)
        d_u = d_tg * f["t"] * f["g"] * (1 - f["g"])
        d_h = (f["a"][:, None] * d_z + d_v @ p["V"].T + d_u @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": x.T @ d_h, "Wb": d_h.sum(0), "V": f["h"].T @ d_v, "Vb": d_v.sum(0), "U": f["h"].T @ d_u, "Ub": d_u.sum(0), "w": (f["t"] * f["g"]).T @ d_e[:, None], "c": f["z"].T @ d_logit, "cb": d_logit.sum(0)}

    def train(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, seed: int = 5) -> None:
        """Adam over shuffled batches of documents."""
        if len(counts) == 0 or label.min() == label.max():
            self.constant = float(label.mean()) if len(label) else 0.5
            return
        self.mean = x.mean(0)
        self.scale = (1 / np.maximum(x.std(0), 1e-2)).astype(np.float32)
        x, rng = (x - self.mean) * self.scale, np.random.default_rng(seed)
        first = np.cumsum(counts) - counts
        m, v, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(counts))
            for k in range(0, len(order), BATCH):
                docs = order[k : k + BATCH]
                rows = np.concatenate([np.arange(first[d], first[d] + counts[d]) for d in docs])
                step += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for name, g in self._gradients(x[rows], counts[docs], label[docs]).items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    v[name] = 0.999 * v[name] + 0.001 * g * g
                    self.p[name] -= (rate * (m[name] / (1 - 0.9**step) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8) + DECAY * self.p[name])).astype(np.float32)


def held_out(doc_id: Column) -> Column:
    """The third of all documents whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _pieces(values: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """First row and texts, about CHUNK bytes at a time."""
    first, size, held = 0, 0, []
    for i, x in enumerate(values):
        held.append((x.as_py() or "").encode())
        size += len(held[-1])
        if size >= CHUNK:
            yield first, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, held


def train_model(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> AttentionModel:
    """Learn from labelled documents outside the held-out third."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id))).groupBy(F.col(doc_id).alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("_label"))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    # the chosen are at most ``sample`` rows of two numbers
    texts = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_label", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in _pieces(batch.column(2)):
                x, counts = bag_features(held)
                ends = np.cumsum(counts)
                rows = [x[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.select([0, 1]).slice(first, len(held)).columns, pa.array(rows, pa.binary())], names=["id", "label", "bag"])

    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("label", T.DoubleType()), T.StructField("bag", T.BinaryType())])
    rows = sorted((r["id"], r["label"], bytes(r["bag"])) for r in map_arrow(texts, work, schema).distinct().collect())
    model = AttentionModel()
    bags = [np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, _, b in rows]
    model.train(np.concatenate(bags) if bags else np.zeros((0, FEATURES), np.float32), np.array([len(b) for b in bags], np.int64), np.array([round(y) for _, y, _ in rows], np.float32))
    return model


def score_documents(docs: DataFrame, model: AttentionModel, text: str = "text", score_name: str = "score", predicted: str = "predicted") -> DataFrame:
    """``docs`` with the score (0 to 1) and what it predicts (0 or 1)."""
    kept = [f for f in docs.schema.fields if f.name not in (score_name, predicted)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select([f.name for f in kept])
            for first, held in _pieces(batch.column(batch.schema.get_field_index(text))):
                score = model.score(*bag_features(held))
                part = rest.slice(first, len(held))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=[*part.schema.names, score_name, predicted])

    return map_arrow(docs, work, T.StructType([*kept, T.StructField(score_name, T.DoubleType()), T.StructField(predicted, T.IntegerType())]))
