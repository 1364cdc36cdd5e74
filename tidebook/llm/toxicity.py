"""Toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are hashed n-grams of three, five and seven characters (A-Z lowered), present or not.  On at most ``max_rows`` labelled
rows (those of least hash, whole texts) the log ratio of a feature's smoothed share among toxic texts to its share among the
others is its scale; features of a ratio near zero, or of fewer than ``MIN_TEXTS`` texts, carry no weight.  A logistic
regression is then learnt on the scaled features by follow-the-regularised-leader, in one task over the bounded sample,
where cross-fitting sets the bias.  Scoring gathers the weights of all n-grams of a whole text and adds each distinct one once.

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
from tidebook.llm.quality_model import ftrl, labelled_sample, logistic, passes
from tidebook.llm.shared import staged

BITS, SIZES = 21, (3, 5, 7)
MIN_TEXTS, MIN_RATIO = 4, 1.0
CUT, FOLDS = 0.7, 3
_BLOCK = 1 << 18  # bytes of text whose n-grams are made at once


def grams(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, index) of the distinct n-grams of each text, sorted; only those that ``wanted`` marks."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = bt.lowered(data)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    char = data[at].astype(np.uint64)
    rest = np.flatnonzero(~lead)
    if len(rest):
        owner = np.searchsorted(at, rest, "right") - 1
        np.add.at(char, owner, data[rest].astype(np.uint64) << ((rest - at[owner]) * 8).astype(np.uint64))
    first = np.searchsorted(at, offsets)
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    h = char * np.uint64(0x9E3779B97F4A7C15)
    keys = []
    for n in range(2, max(SIZES) + 1):
        h = h[:-1] * np.uint64(0xD6E8FEB86659FD93) + char[n - 1 :]
        if n not in SIZES or not len(h):
            continue
        index = (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)) >> np.uint64(64 - BITS)).astype(np.int32)
        keep = text[: len(h)] == text[n - 1 :]
        if wanted is not None:
            keep &= wanted[index]
        at_ = np.flatnonzero(keep)
        keys.append(text[at_].astype(np.int64) << BITS | index[at_])
    key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return key >> BITS, key & ((1 << BITS) - 1)


def scales(counted: DataFrame, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and scales: log-count ratios; those too rare or too even stay on the executors."""
    ratio = F.log((F.col("toxic") + 1) / F.lit(n_toxic + 2)) - F.log((F.col("clean") + 1) / F.lit(n_clean + 2))
    rows = counted.where(F.col("index") < 1 << BITS).select("index", (F.col("toxic") + F.col("clean")).alias("n"), ratio.alias("r"))
    table = rows.where((F.col("n") >= MIN_TEXTS) & (F.abs("r") >= MIN_RATIO)).select(F.col("index").cast("int").alias("index"), "r").toPandas()  # 2 ** BITS rows at most
    return table["index"].to_numpy(), table["r"].to_numpy()


def train(documents: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = 12_000, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Weights already times their scales; the last one is the bias.  Of a size that ``BITS`` fixes."""
    spark = documents.sparkSession
    rows = staged(labelled_sample(documents, labels, label, max_rows, doc_id, text), "toxic-sample")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, (1 << BITS) + 1), np.int32)
        for batch in batches:
            for part, data, offsets in bt.blocks(batch, size=_BLOCK):
                y = part.column(1).to_numpy()
                text_, index = grams(data, offsets)
                for k in (0, 1):
                    np.add.at(counts[k], index[y[text_] == k], 1)  # each n-gram once a text
                    counts[k, -1] += int((y == k).sum())
        seen = np.flatnonzero(counts.any(0))
        for low in range(0, len(seen), 1 << 16):
            part = seen[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(counts[1, part].astype(np.int64)), pa.array(counts[0, part].astype(np.int64))], ["index", "toxic", "clean"])

    counted = rows.mapInArrow(frequencies, "index long, toxic long, clean long").groupBy("index").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counted = staged(counted, "toxic-counts")
    whole = counted.where(F.col("index") == 1 << BITS).first()
    n_toxic, n_clean = (whole.toxic, whole.clean) if whole else (0, 0)
    if not n_toxic or not n_clean:
        weights = np.zeros((1 << BITS) + 1)
        weights[-1] = 30.0 * (n_toxic > 0) - 30.0 * (n_clean > 0)
        return weights
    scale = spark.sparkContext.broadcast(scales(counted, n_toxic, n_clean))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = dense(*scale.value)[:-1] != 0
        for batch in batches:
            for part, data, offsets in bt.blocks(batch, size=_BLOCK):
                text_, index = grams(data, offsets, wanted)
                first = np.searchsorted(text_, np.arange(part.num_rows + 1))
                packed = [index[a:b].astype("<i4").tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(packed, pa.binary())], ["doc_id", "label", "vector"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = []
        for batch in batches:
            for doc, y, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sample.append((doc, y, np.frombuffer(v, "<i4")))
        sample.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        at, values, bias = sparse(fit([r[1:] for r in sample], dense(*scale.value)[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array([at.astype("<i4").tobytes()], pa.binary()), pa.array([values.astype("<f8").tobytes()], pa.binary()), pa.array([bias])], ["at", "values", "bias"])

    made = staged(rows.mapInArrow(vectors, "doc_id long, label int, vector binary"), "toxic-vectors")
    model = staged(made.repartition(1).mapInArrow(learn, "at binary, values binary, bias double"), "toxic-model").first()
    return dense(np.frombuffer(model.at, "<i4"), np.frombuffer(model["values"], "<f8"), model.bias)


def ratios(sample: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Log-count ratios of the features of the rows; 0 for those too rare or too even."""
    counts, rows = np.zeros((2, 1 << BITS), np.int32), [0, 0]
    for y, index in sample:
        counts[y, index] += 1
        rows[y] += 1
    ratio = np.log((counts[1] + 1) / (rows[1] + 2)) - np.log((counts[0] + 1) / (rows[0] + 2))
    return np.where((counts.sum(0) >= MIN_TEXTS) & (np.abs(ratio) >= MIN_RATIO), ratio, 0.0)


def learnt(sample: list[tuple[int, np.ndarray]], scale: np.ndarray) -> np.ndarray:
    w = ftrl([(y, i, scale[i] * 0.1) for y, i in sample], BITS, epochs=passes(len(sample)), alpha=0.5, l1=0.05, l2=0.1)
    w[:-1] *= scale * 0.1
    return w


def fit(sample: list[tuple[int, np.ndarray]], scale: np.ndarray) -> np.ndarray:
    """Weights times scales.  The bias is then moved so that the score ``CUT`` lies where three times the toxic texts missed
    plus the clean ones taken are the fewest, in the middle of the widest gap between neighbouring sums for which they are.
    The sums are those that each row has from weights and scales of the two thirds of the sample it isn't in."""
    w = learnt(sample, scale)
    sums, toxic = np.zeros(len(sample)), np.array([y for y, _ in sample]) == 1
    for fold in range(FOLDS):
        rest = [row for k, row in enumerate(sample) if k % FOLDS != fold]
        part = learnt(rest, ratios(rest))
        sums[fold::FOLDS] = [part[i].sum() for _, i in sample[fold::FOLDS]]
    order = np.argsort(sums, kind="stable")
    sums, toxic = sums[order], toxic[order]
    missed, taken = np.concatenate([[0], np.cumsum(toxic)]), (~toxic).sum() - np.concatenate([[0], np.cumsum(~toxic)])
    low, high = np.concatenate([[sums[0] - 2], sums]), np.concatenate([sums, [sums[-1] + 2]])
    errors = np.where(high > low, 3 * missed + taken, np.inf)
    best = np.flatnonzero(errors == errors.min())
    at = best[np.argmax((high - low)[best])]
    w[-1] = np.log(CUT / (1 - CUT)) - (low[at] + high[at]) / 2
    return w


def sparse(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """What travels of the weights: the places that aren't zero, their values, and the bias."""
    at = np.flatnonzero(weights[:-1])
    return at.astype(np.int32), weights[at], float(weights[-1])


def dense(at: np.ndarray, values: np.ndarray, bias: float = 0.0) -> np.ndarray:
    out = np.zeros((1 << BITS) + 1)
    out[at], out[-1] = values, bias
    return out


def score(documents: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", out: str = "score") -> DataFrame:
    """doc_id and the score of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(sparse(weights))  # bounded by BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dense(*shared.value)
        wanted = w[:-1] != 0
        for batch in batches:
            for part, data, offsets in bt.blocks(batch, size=_BLOCK):
                text_, index = grams(data, offsets, wanted)
                total = np.bincount(text_, w[index], part.num_rows) + w[-1]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(logistic(total))], ["doc_id", out])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {out} double")


def without_toxic(documents: DataFrame, weights: np.ndarray, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows, all columns as they are, whose text scores below ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(sparse(weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = dense(*shared.value)
        wanted = w[:-1] != 0
        for batch in batches:
            for part, data, offsets in bt.blocks(batch, text, _BLOCK):
                text_, index = grams(data, offsets, wanted)
                total = np.bincount(text_, w[index], part.num_rows) + w[-1]
                yield part.filter(pa.array(logistic(total) < threshold))

    return documents.mapInArrow(run, documents.schema)
