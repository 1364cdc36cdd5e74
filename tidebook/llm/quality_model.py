"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

Words are runs of letters or of digits; each other visible character is a word of its own.  Features are hashed n-grams of
one and two lowered words, and of one to three word shapes (capitals, capitalised, small, digits, the mark itself, line
end), so that words never seen before still count.  A text's vector has unit length; its score is the logistic function of
one sparse dot product.  Training takes at most ``max_rows`` labelled rows (those of least hash), all of their whole texts;
features are computed where the texts lie, and one task runs the learner over the bounded sample.

A null or empty text has only the bias; without labelled rows of both classes every score is the share of label 1 (0.5 if
there are no rows); a null label does not count; repeated rows are scored alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import bytestext as bt
from tidebook.llm.shared import staged

BITS = 18
_KIND = np.full(256, 3, np.uint8)  # 0 space, 1 letter, 2 digit, 3 mark
_KIND[[32, 9, 11, 12, 13]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = _KIND[128:] = 1


def _grams(h: np.ndarray, text: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n words of one text, and their texts."""
    x = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        x = x * np.uint64(0x100000001B3) + h[j : len(h) - n + 1 + j]
    keep = text[: len(x)] == text[n - 1 :]
    return bt.mix(x + np.uint64(salt))[keep], text[: len(x)][keep]


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, index, value): the sparse unit vectors of the texts; ``first`` has one more entry than texts."""
    n_texts = len(offsets) - 1
    kind = _KIND[data]
    new = np.zeros(len(data) + 1, bool)
    new[offsets] = True
    if len(data):
        change = np.ones(len(data), bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 3)
        starts = np.flatnonzero(change | new[:-1])
        ends = np.append(starts[1:], len(data))
        keep = kind[starts] != 0
        starts, ends = starts[keep], ends[keep]
    else:
        starts = ends = np.zeros(0, np.int64)
    text = np.searchsorted(offsets, starts, "right") - 1
    parts, owners = [], []
    if len(starts):
        low = bt.hash_words(bt.lowered(data), starts, ends)
        upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        small = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
        ups, lows = upper[ends] - upper[starts], small[ends] - small[starts]
        k = kind[starts]
        shape = np.where(k == 3, data[starts].astype(np.int64), np.where(k == 2, 300, np.where((ups > 0) & (lows == 0), 301, np.where(ups > 0, 302, 303))))
        shape = bt.mix(shape.astype(np.uint64) + np.uint64(7))
        for h, sizes, salt in ((low, (1, 2), 1), (shape, (1, 2, 3), 11)):
            for n in sizes:
                if len(h) >= n:
                    g, t = _grams(h, text, n, salt + n)
                    parts.append(g)
                    owners.append(t)
    if parts:
        index = (np.concatenate(parts) & np.uint64((1 << bits) - 1)).astype(np.int64)
        key, count = np.unique(np.concatenate(owners) * (1 << bits) + index, return_counts=True)
        owner, index = key >> bits, key & ((1 << bits) - 1)
        value = np.sqrt(count.astype(np.float64))
        norm = np.sqrt(np.bincount(owner, value * value, n_texts))
        value /= norm[owner]
    else:
        owner = index = np.zeros(0, np.int64)
        value = np.zeros(0)
    return np.searchsorted(owner, np.arange(n_texts + 1)), index, value


def passes(rows: int) -> int:
    """Passes over a sample: a small one is seen more often."""
    return max(4, min(30, 50_000 // max(1, rows)))


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """FTRL-proximal logistic regression; the last weight is the bias."""
    n = (1 << bits) + 1
    z, g2 = np.zeros(n), np.zeros(n)
    bias = np.array([1 << bits])
    order = np.random.default_rng(0)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(g2[i])) / alpha + l2))

    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            label, index, value = rows[r]
            i, x = np.concatenate([index, bias]), np.append(value, 1.0)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - label) * x
            sigma = (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / alpha
            z[i] += g - sigma * w
            g2[i] += g * g
    return weights(np.arange(n))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, max_rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """label and text of at most ``max_rows`` labelled rows, those of least hash of doc_id, which stands for it; of several labels
    of one doc_id the largest holds."""
    own = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    own = staged(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), f"labels-{label}")
    texts = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return texts.join(own, "doc_id").select(F.xxhash64("doc_id").alias("doc_id"), "label", "text")


def train(documents: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = 12_000, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights, of a size that ``BITS`` fixes."""
    rows = labelled_sample(documents, labels, label, max_rows, doc_id, text)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in bt.blocks(batch):
                first, index, value = features(data, offsets)
                packed = [index[a:b].astype("<i4").tobytes() + value[a:b].astype("<f4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(packed, pa.binary())], ["doc_id", "label", "vector"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = []
        for batch in batches:
            for doc, y, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(v) // 8
                sample.append((doc, y, np.frombuffer(v, "<i4", n), np.frombuffer(v, "<f4", n, 4 * n)))
        sample.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        positive = sum(r[1] for r in sample)
        if 0 < positive < len(sample):
            w = ftrl([r[1:] for r in sample], epochs=passes(len(sample)))
        else:
            w = np.zeros((1 << BITS) + 1)
            w[-1] = 0.0 if not sample else (30.0 if positive else -30.0)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary())], ["weights"])

    sparse = staged(rows.mapInArrow(vectors, "doc_id long, label int, vector binary"), "vectors")
    model = staged(sparse.repartition(1).mapInArrow(learn, "weights binary"), "quality-model").collect()
    return np.frombuffer(model[0].weights, "<f8") if model else np.zeros((1 << BITS) + 1)


def score(documents: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """doc_id and the score of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(weights)  # 2 MB: fixed by BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            for part, data, offsets in bt.blocks(batch):
                first, index, value = features(data, offsets)
                total = np.concatenate([[0.0], np.cumsum(w[index] * value)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(logistic(total[first[1:]] - total[first[:-1]] + w[-1]))], ["doc_id", out])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {out} double")
