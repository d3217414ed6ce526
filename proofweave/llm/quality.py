"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

Every 512-byte passage of a whole text is encoded from its byte classes, their transitions and its word repetition. Gated
attention (tanh gate times sigmoid gate) weighs the encoded passages; the weighted sum is scored. Only document labels are
needed to learn the encoder, the attention and the score together.

Training takes at most ``sample`` labelled documents (those with the smallest id hashes) and of each at most
``sample_passages`` evenly spaced passages; scoring takes all passages of all documents. Labels, language, source and id
are never inputs of a score.

Null and empty texts are one empty passage. Several labels of one document count as their mean, rounded half up; null labels
do not count. Without labels of both kinds every score is the share of label 1 (0.5 without any label). Repeated rows get
equal scores. Empty table: no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fold, settle, small_slices

PASSAGE = 512
SAMPLE = 4000
SAMPLE_PASSAGES = 48
HIDDEN, GATE = 24, 12

_MARKS = b"!|*#$%&.,\n "
#: class of each byte: single marks, then upper, lower, digit, other ASCII, beyond ASCII
_CLASS = np.full(256, len(_MARKS) + 3, np.uint8)
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1] = len(_MARKS), len(_MARKS) + 1, len(_MARKS) + 2
_CLASS[128:] = len(_MARKS) + 4
for _k, _c in enumerate(_MARKS):
    _CLASS[_c] = _k
CLASSES = len(_MARKS) + 5
FEATURES = CLASSES + 8
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def passages(column) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages of an Arrow string column, and the number of passages of each text."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data, ends = raw[ends[0] : ends[-1]], ends - ends[0]
    per_doc = np.maximum(1, -(-np.diff(ends) // PASSAGE))
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = ends[:-1][owner] + rank * PASSAGE
    size = np.minimum(ends[1:][owner] - start, PASSAGE)
    of = np.repeat(np.arange(len(owner)), size)  # the passage of each byte
    n = len(owner)
    kind = _CLASS[data]
    counts = np.bincount(of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float32)
    inside = of[1:] == of[:-1] if len(of) else np.zeros(0, bool)
    step = of[1:][inside] if len(of) else of

    def share(mask):
        return np.bincount(step[mask[inside]], minlength=n)

    upper, lower = kind == len(_MARKS), kind == len(_MARKS) + 1
    same = share(data[1:] == data[:-1])
    shout, shift = share(upper[1:] & upper[:-1]), share(upper[1:] & lower[:-1])
    blank = _SPACE[data]
    # words: starts after white space or at a passage's edge; their hashes from running sums
    first = ~blank
    if len(data):
        first[1:] &= blank[:-1] | ~inside
    begin = np.flatnonzero(first)
    word = of[begin]
    total = np.bincount(word, minlength=n)
    mixed = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    lead = np.zeros(len(data), np.int64)
    lead[begin] = begin
    spot = np.arange(len(data)) - np.maximum.accumulate(lead)  # place in the word
    mixed *= (spot.astype(np.uint64) * np.uint64(2) + np.uint64(1))
    mixed[blank] = 0
    code = np.add.reduceat(mixed, begin) if len(begin) else mixed[:0]
    code ^= code >> np.uint64(27)
    keyed = np.sort((word.astype(np.uint64) << np.uint64(36)) | (code & np.uint64((1 << 36) - 1)))
    fresh = np.ones(len(keyed), bool)
    fresh[1:] = keyed[1:] != keyed[:-1]
    distinct = np.bincount((keyed[fresh] >> np.uint64(36)).astype(np.int64), minlength=n)
    again = np.zeros(len(code), bool)
    again[1:] = (code[1:] == code[:-1]) & (word[1:] == word[:-1])
    twice = np.bincount(word[again], minlength=n)
    long = np.maximum(size, 1)
    extra = [same / long, shout / long, shift / long, total / long * 6, distinct / np.maximum(total, 1), twice / np.maximum(total, 1), np.log1p(size) / 6, (size - blank_count(of, blank, n)) / np.maximum(total, 1) / 8]
    return np.column_stack([counts / long[:, None], *extra]).astype(np.float32), per_doc


def blank_count(of: np.ndarray, blank: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(of[blank], minlength=n)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """Encoder, gated attention and score; ``w`` holds the weights."""

    def __init__(self, mean, spread, base, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.spread, self.base = mean, spread, base
        scale = lambda a, b: r.normal(0, 1 / np.sqrt(a), (a, b))
        self.w = {"e": scale(FEATURES, HIDDEN), "eb": np.zeros(HIDDEN), "t": scale(HIDDEN, GATE), "g": scale(HIDDEN, GATE), "a": scale(GATE, 1)[:, 0], "c": scale(HIDDEN, 1)[:, 0], "c0": np.array(base)}

    def forward(self, x, per_doc):
        w, at = self.w, np.cumsum(per_doc) - per_doc
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(x @ w["e"] + w["eb"])
        t, g = np.tanh(h @ w["t"]), _sigmoid(h @ w["g"])
        a = (t * g) @ w["a"]
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, at), per_doc))
        alpha = e / np.repeat(np.add.reduceat(e, at), per_doc)
        z = np.add.reduceat(alpha[:, None] * h, at)
        return x, h, t, g, alpha, z, _sigmoid(z @ w["c"] + w["c0"])

    def score(self, x, per_doc):
        return self.forward(x, per_doc)[-1] if len(per_doc) else np.zeros(0)

    def gradient(self, x, per_doc, y):
        w, at = self.w, np.cumsum(per_doc) - per_doc
        x, h, t, g, alpha, z, p = self.forward(x, per_doc)
        d = (p - y) / len(y)
        dz = np.repeat(d, per_doc)[:, None] * w["c"]
        dalpha = (dz * h).sum(1)
        da = alpha * (dalpha - np.repeat(np.add.reduceat(alpha * dalpha, at), per_doc))
        dtg = da[:, None] * w["a"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = alpha[:, None] * dz + dt @ w["t"].T + dg @ w["g"].T
        pre = dh * (1 - h * h)
        return {"e": x.T @ pre, "eb": pre.sum(0), "t": h.T @ dt, "g": h.T @ dg, "a": (t * g).T @ da, "c": z.T @ d, "c0": d.sum()}

    def learn(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 128, rate: float = 0.01, decay: float = 1e-4):
        r, m, v, step = np.random.default_rng(11), {}, {}, 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at : at + batch]
                grads = self.gradient(np.vstack([bags[k] for k in pick]), np.array([len(bags[k]) for k in pick]), y[pick])
                step += 1
                for k, g in grads.items():
                    g = g + decay * self.w[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    now = rate * (1 - epoch / epochs) + 1e-4
                    self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_passages: int = SAMPLE_PASSAGES) -> Attention:
    """Model from the labelled documents outside the held-out fold (crc32 of the id modulo 3 is 1)."""
    bounded_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").where(fold(F.col("doc_id"), 3) != 1)
    known = known.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("q")).select("doc_id", (F.col("q") >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in (part for whole in batches for part in small_slices(whole, 0)):
            x, per_doc = passages(batch.column(0))
            at = np.concatenate(([0], np.cumsum(per_doc)))
            bags = []
            for k, n in enumerate(per_doc):
                pick = at[k] + np.unique(np.linspace(0, n - 1, min(n, sample_passages)).astype(int))
                bags.append(x[pick].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bags, pa.binary()), batch.column(1), batch.column(2)], names=["bag", "y", "k"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y", F.xxhash64("doc_id", "text").alias("k"))
    rows = joined.mapInArrow(run, "bag binary, y int, k long").toArrow()
    order = np.argsort(rows["k"].to_numpy(), kind="stable")
    raw, y = rows["bag"].to_pylist(), rows["y"].to_numpy()[order].astype(float)
    bags = [np.frombuffer(raw[i], np.float32).reshape(-1, FEATURES) for i in order]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        model = Attention(np.zeros(FEATURES), np.ones(FEATURES), base)
        model.w["c"] = model.w["c"] * 0
        return model
    every = np.vstack(bags)
    return Attention(every.mean(0), every.std(0) + 1e-3, base).learn(bags, y)


def with_scores(docs: DataFrame, model: Attention, column: str) -> DataFrame:
    """``docs`` with all its columns and the score (0 to 1, higher: label 1 likelier) as ``column``."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    from pyspark.sql.types import DoubleType, StructField, StructType

    if column in docs.columns:
        raise ValueError(f"column {column} exists")
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])

    def run(batches):
        for batch in batches:
            scores = [model.score(*passages(part.column(at))) for part in small_slices(batch, at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate([*scores, np.zeros(0)]), pa.float64())], names=[*batch.schema.names, column])
        settle()

    return docs.mapInArrow(run, schema)
