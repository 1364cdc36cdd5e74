"""Substring deduplication: words of a passage that was said before are cut out.

Every window of ``window`` consecutive words of a text has a Rabin-Karp hash.  Texts travel in units of half a megabyte that
are written once.  A unit counts its own windows first: of windows that it repeats only the first is sent on, so a passage
that a third of all texts share is a row of each unit, not of each text.  Windows meet in buckets of hash ranges, packed by
unit; the number of tasks follows from the number of windows, so one compares about ``TASK_WINDOWS`` of them.  There the
first of each repeated hash, by doc_id, keeps its words; the others go back to their unit as one bit each, where windows that
start again merge into maximal removal intervals.

Two different windows are taken for equal only if their buckets and the lowest 56 bits of their hashes are the same, with some
400 buckets about 3 in 10,000 for one such pair among 130 million windows; more windows come with more buckets.  doc_id has to be integral; texts without one come last, texts of one doc_id are ordered by their unit.  A
null, empty or short text has no window and keeps all of its words.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import bytestext as bt
from tidebook.llm.shared import staged

UNIT_BYTES = 1 << 19
TASK_WINDOWS = 1 << 22  # windows that one task compares, on average
SENT = 7  # lowest bytes of a hash that travel
_LAST = np.iinfo(np.int64).max
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_UNIT = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def window_hashes(keys: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers at which a window lies within one text, and the windows' hashes, from running sums of the words' terms."""
    n = len(keys)
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + window <= ends)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    up, down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)])) for base in (_BASE, _INVERSE))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(keys * up, out=total[1:])
    return at, bt.mix((total[at + window] - total[at]) * down[at])


class Unit:
    """Texts of one unit, by doc_id, with their windows: ``at``, ``hashes``, ``repeats`` (said before in this unit) and
    ``sent`` (the others, by bucket and place)."""

    def __init__(self, blob: bytes, window: int, buckets: int):
        self.rows = pa.ipc.open_stream(blob).read_next_batch()
        self.data, self.offsets = bt.column_bytes(self.rows.column(1))
        starts, ends, self.first = bt.runs(self.data, self.offsets, bt.NOT_SPACE)
        self.at, self.hashes = window_hashes(bt.hash_words(self.data, starts, ends), self.first, window)
        order = np.argsort(self.hashes, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = self.hashes[order[1:]] != self.hashes[order[:-1]]
        self.repeats = np.zeros(len(order), bool)
        self.repeats[order[~new]] = True
        bucket = ((self.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        alone = np.flatnonzero(~self.repeats)
        self.sent = alone[np.argsort(bucket[alone], kind="stable")]
        self.buckets = bucket[self.sent]

    def slices(self) -> Iterator[tuple[int, np.ndarray]]:
        bounds = np.append(np.flatnonzero(np.diff(self.buckets, prepend=-1)), len(self.sent))
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            yield int(self.buckets[low]), self.sent[low:high]


def into_units(documents: DataFrame, window: int, unit_bytes: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """unit, windows (an upper bound), blob: texts in runs of rows, by doc_id, compressed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for part, data, offsets in bt.blocks(batch, size=unit_bytes):
                ids = part.column(0).fill_null(_LAST).to_numpy()
                rows = pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.large_string())], schema=_UNIT).take(pa.array(np.argsort(ids, kind="stable")))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _UNIT, options=options) as out:
                    out.write_batch(rows)
                words = np.diff(bt.runs(data, offsets, bt.NOT_SPACE)[2])
                yield pa.RecordBatch.from_arrays([pa.array([int(np.maximum(words - window + 1, 0).sum())], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["windows", "blob"])

    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(pack, "windows long, blob binary").withColumn("unit", F.monotonically_increasing_id())


def send_windows(units: DataFrame, window: int, buckets: int) -> DataFrame:
    """bucket, unit, hashes, ids: the windows that a unit has for a bucket, in order, packed."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                u = Unit(blob.as_buffer(), window, buckets)
                ids = u.rows.column(0).fill_null(_LAST).to_numpy()
                owner = ids[np.searchsorted(u.first, u.at, "right") - 1] if len(u.at) else np.zeros(0, np.int64)
                low = u.hashes.view(np.uint8).reshape(-1, 8)[:, :SENT]  # the bucket has the highest bits
                found = [(b, low[s].tobytes(), owner[s].tobytes()) for b, s in u.slices()]
                bucket, h, d = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array([unit] * len(found), pa.int64()), pa.array(h, pa.binary()), pa.array(d, pa.binary())], ["bucket", "unit", "hashes", "ids"])

    return units.select("unit", "blob").mapInArrow(hashes, "bucket long, unit long, hashes binary, ids binary")


def mark_later(sent: DataFrame, tasks: int) -> DataFrame:
    """unit, bucket, flags: for the windows that a unit has in a bucket a bit each, set where an earlier text has the same
    window; rows without such a window are left out.  A task sorts the hashes of its buckets as arrays."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, unit, hashes, owners = [], [], [], []
        for batch in batches:
            bucket.append(batch.column(0).to_numpy())
            unit.append(batch.column(1).to_numpy())
            hashes += [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, SENT) for x in batch.column(2)]
            owners += [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(3)]
        if not hashes:
            return
        bucket, unit, size = np.concatenate(bucket), np.concatenate(unit), np.array([len(x) for x in hashes])
        bounds, ids = np.concatenate([[0], np.cumsum(size)]), np.concatenate(owners)
        wide = np.zeros((bounds[-1], 8), np.uint8)
        np.concatenate(hashes, out=wide[:, :SENT])
        h = wide.view("<u8").ravel()
        h |= np.repeat(bucket.astype(np.uint64) << np.uint64(8 * SENT), size)
        order = np.argsort(h, kind="stable")
        same = h[order[1:]] == h[order[:-1]]
        among = order[np.append(same, False) | np.insert(same, 0, False)]
        row = np.searchsorted(bounds, among, "right") - 1
        among = among[np.lexsort((unit[row], ids[among], h[among]))]  # a unit sends a hash once
        later = np.zeros(len(h), bool)
        later[among[1:][h[among[1:]] == h[among[:-1]]]] = True
        hit = np.flatnonzero(np.add.reduceat(later, bounds[:-1]))
        for low in range(0, len(hit), 10_000):
            part = hit[low : low + 10_000]
            flags = [np.packbits(later[bounds[k] : bounds[k + 1]]).tobytes() for k in part]
            yield pa.RecordBatch.from_arrays([pa.array(unit[part]), pa.array(bucket[part]), pa.array(flags, pa.binary())], ["unit", "bucket", "flags"])

    return sent.repartition(tasks, "bucket").mapInArrow(mark, "unit long, bucket long, flags binary")


def cut_repeats(units: DataFrame, marks: DataFrame, window: int, buckets: int, tasks: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept: each text without the words of windows that start again."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, flags = {}, {}  # of this task's units; a bit for each window, and the texts compressed
        for batch in batches:
            for unit, bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket is None:
                    blobs[unit] = blob
                else:
                    flags.setdefault(unit, {})[bucket] = blob
        for unit in list(blobs):
            u = Unit(blobs.pop(unit), window, buckets)
            again, mine = u.repeats.copy(), flags.pop(unit, {})
            for bucket, places in u.slices():
                if bucket in mine:
                    again[places] |= np.unpackbits(np.frombuffer(mine[bucket], np.uint8), count=len(places)).view(bool)
            n = int(u.first[-1])
            starts = np.zeros(n + 1, np.int64)
            starts[u.at[again] + 1] = 1
            started = np.cumsum(starts)  # windows cut that start before a word
            gone = started[1:] > started[np.maximum(np.arange(n) - window + 1, 0)]
            raw, kept = u.data.tobytes(), []
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[u.first])
            for t in range(u.rows.num_rows):
                words = raw[u.offsets[t] : u.offsets[t + 1]].split()
                kept.append(b" ".join(compress(words, (~gone[u.first[t] : u.first[t + 1]]).tolist()) if removed[t] else words))
            yield pa.RecordBatch.from_arrays([u.rows.column(0), pa.array(np.diff(u.first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    rows = units.select("unit", F.lit(None).cast("long").alias("bucket"), "blob").unionByName(marks.withColumnRenamed("flags", "blob"))
    return rows.repartition(tasks, "unit").mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def remove_repeats(documents: DataFrame, window: int = 20, unit_bytes: int = UNIT_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each text: doc_id, n_words, n_removed and what is kept, words joined by one space."""
    spark = documents.sparkSession
    units = staged(into_units(documents, window, unit_bytes, doc_id, text), "units")
    total = units.agg(F.coalesce(F.sum("windows"), F.lit(0))).first()[0]
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_WINDOWS))
    buckets = 8 * tasks  # some to a task, so that tasks are even
    marks = mark_later(send_windows(units, window, buckets), tasks)
    return cut_repeats(units, marks, window, buckets, tasks)
