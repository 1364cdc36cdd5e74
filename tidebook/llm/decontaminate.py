"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window of ``window`` words of a benchmark item (a shorter item is one pattern).  The symbols of the search
are word hashes, its blocks are pairs of words.  A shift table, indexed by the hash of the block, says how far the search
may move; where it says 0, the patterns whose last block has that hash are the candidates: they are looked up by the hash of
all their words, and comparing the bytes of the words confirms them.  The search runs in lanes: one lane for each stretch of a
text as long as the largest shift, so that one numpy step moves all lanes.  Patterns of one length are searched together.

The patterns travel to the tasks in blocks of at most ``block_items`` items and ``block_bytes`` bytes of text, as far as
single items allow.  One scan of the documents searches up to ``scan_blocks`` blocks: a task holds the tables of the first
``HELD_BLOCKS``, and makes those of the others anew for every ``STRETCH`` bytes of text, so its memory is bounded whatever
the benchmark is.  Only above ``scan_blocks`` blocks there is a second scan (a filter of what the first left, where contaminated rows
only have to go); then the documents are written once with a row number, and the scans' hits are united by it, so repeated and
null ids stay rows of their own.
Null texts have no words; items without words have no pattern; an item without an id marks words but is not listed; repeated
rows and items are handled alike; extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import bytestext as bt
from tidebook.llm.shared import staged

_LEAST_BITS, _MOST_BITS = 16, 22  # of a shift table
HELD_BLOCKS = 4  # blocks whose tables a task keeps
STRETCH = 32 << 20  # bytes of text that meet a block whose tables are not kept
HITS = "n_words long, hits array<struct<first:long,last:long>>, items array<string>"


class Words:
    """The words of some texts: bytes, places and hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = bt.lowered(data)
        self.starts, self.ends, self.before = bt.runs(self.data, offsets, bt.ALNUM)
        self.hashes = bt.hash_words(self.data, self.starts, self.ends) if len(self.starts) else np.zeros(0, np.uint64)

    def joined(self, first: int, m: int) -> bytes:
        """The bytes of m words; none of them has a space."""
        return b" ".join(self.data[self.starts[k] : self.ends[k]].tobytes() for k in range(first, first + m))


def _block(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return bt.mix(first * np.uint64(0x9FB21C651E98DF25) + second)


def _whole(h: np.ndarray, begin: np.ndarray, m: int) -> np.ndarray:
    """Hashes of the m words from each place on."""
    out = np.zeros(len(begin), np.uint64)
    for j in range(m):
        out = _block(out, h[begin + j])
    return out


def _among(ordered: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values in an ordered array, and which of them are there."""
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return at, ordered[at] == values


class Patterns:
    """All patterns of one length ``m`` of a block of items: windows that begin at the words ``begin``, with their shift table,
    suffix buckets and windows by hash.  A window that several items share is one entry."""

    def __init__(self, ids: list[str | None], words: Words, item: np.ndarray, begin: np.ndarray, m: int):
        self.ids, self.words, self.m = ids, words, m
        self.b = min(2, m)  # words in a block
        most = m - self.b + 1
        # eight places for each of the patterns' blocks, so that most blocks of a text still meet an empty one
        bits = min(_MOST_BITS, max(_LEAST_BITS, (8 * most * len(begin)).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, most, np.uint8 if most < 256 else np.int64)
        for end in range(self.b - 1, m):
            np.minimum.at(self.shift, (self.blocks(words.hashes, begin + end) & self.mask).astype(np.int64), m - 1 - end)
        self.last = np.unique(self.blocks(words.hashes, begin + m - 1))
        whole = _whole(words.hashes, begin, m)
        order = np.argsort(whole, kind="stable")
        self.item, self.begin = item[order], begin[order]
        self.whole, self.low = np.unique(whole[order], return_index=True)
        self.high = np.append(self.low[1:], len(order))
        self.known: dict[int, dict[bytes, set[str]]] = {}

    def blocks(self, h: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _block(h[last - 1], h[last]) if self.b == 2 else bt.mix(h[last])

    def items(self, entry: int) -> dict[bytes, set[str]]:
        """The items of each text that has the entry's hash."""
        if entry not in self.known:
            found: dict[bytes, set[str]] = defaultdict(set)
            for k in range(self.low[entry], self.high[entry]):
                own = self.ids[self.item[k]]
                found[self.words.joined(int(self.begin[k]), self.m)].update(() if own is None else (own,))
            self.known[entry] = dict(found)
        return self.known[entry]

    def search(self, h: np.ndarray, first: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
        """(place of the first word, entry) of windows whose hash is known.  first, stop: of each lane, the last word of the
        first window tried and the end of the lane."""
        out: list[tuple[int, int]] = []
        at = first
        while len(at):
            block = self.blocks(h, at)
            move = self.shift[(block & self.mask).astype(np.int64)].astype(np.int64)
            zero = np.flatnonzero(move == 0)
            if len(zero):
                zero = zero[_among(self.last, block[zero])[1]]
                begin = at[zero] - (self.m - 1)
                entry, same = _among(self.whole, _whole(h, begin, self.m))
                out += zip(begin[same].tolist(), entry[same].tolist())
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return out

    def lanes(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lanes over texts whose words begin at ``starts`` (one more entry than texts)."""
        step = self.m - self.b + 1
        low, high = starts[:-1] + self.m - 1, starts[1:]
        keep = low < high
        low, high = low[keep], high[keep]
        n = -(-(high - low) // step)
        text = np.repeat(np.arange(len(low)), n)
        k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        first = low[text] + k * step
        return first, np.minimum(first + step, high[text])


def compile_patterns(items: pa.Table, window: int) -> list[Patterns]:
    """Patterns of a block of items (item, text), by length."""
    words = Words(*bt.column_bytes(items.column("text")))
    ids, n = items.column("item").to_pylist(), np.diff(words.before)
    sizes = np.minimum(n, window)
    out = []
    for m in np.unique(sizes[sizes > 0]).tolist():
        own = np.flatnonzero(sizes == m)
        count = n[own] - m + 1
        item = np.repeat(own, count)
        begin = words.before[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        out.append(Patterns(ids, words, item, begin, m))
    return out


class Found:
    """What a run of rows has been found to hold."""

    def __init__(self, rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray):
        self.rows, self.words = rows, Words(data, offsets)
        self.hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.items: dict[int, set[str]] = defaultdict(set)

    def search(self, patterns: list[Patterns]) -> None:
        before = self.words.before
        for p in patterns:
            for begin, entry in p.search(self.words.hashes, *p.lanes(before)):
                items = p.items(entry).get(self.words.joined(begin, p.m))
                if items is not None:
                    text = int(np.searchsorted(before, begin, "right")) - 1
                    low = begin - int(before[text])
                    self.hits[text].append((low, low + p.m))
                    self.items[text] |= items

    def columns(self) -> list[pa.Array]:
        """n_words, hits (touching ones united) and items of each row."""
        n, spans = self.rows.num_rows, []
        for text in range(n):
            own: list[dict] = []
            for low, high in sorted(self.hits.get(text, ())):
                if own and low <= own[-1]["last"]:
                    own[-1]["last"] = max(own[-1]["last"], high)
                else:
                    own.append({"first": low, "last": high})
            spans.append(own)
        kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        return [pa.array(np.diff(self.words.before)), pa.array(spans, kind), pa.array([sorted(self.items.get(t, ())) for t in range(n)], pa.list_(pa.string()))]


def stretches(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[list[Found]]:
    """Runs of rows, together until they have ``size`` bytes of text."""
    held, n = [], 0
    for batch in batches:
        for rows, data, offsets in bt.blocks(batch, text):
            held.append(Found(rows, data, offsets))
            n += len(data)
            if n >= size:
                yield held
                held, n = [], 0
    if held:
        yield held


def searched(batches: Iterator[pa.RecordBatch], shared: list[Broadcast], text: str, window: int) -> Iterator[Found]:
    """Every run of rows after all blocks of patterns have been searched in it."""
    held: dict[int, list[Patterns]] = {}
    for runs in stretches(batches, text, STRETCH if len(shared) > HELD_BLOCKS else 0):
        for k, block in enumerate(shared):
            patterns = held[k] if k in held else compile_patterns(block.value, window)
            if k < HELD_BLOCKS:
                held[k] = patterns
            for found in runs:
                found.search(patterns)
        yield from runs


def cut_blocks(sizes: dict[int, tuple[int, int]], n_buckets: int, block_items: int, block_bytes: int) -> list[tuple[int, int]]:
    """Runs [low, high) of buckets that hold at most so many items and bytes each, unless one bucket alone holds more;
    ``sizes`` has items and bytes of the buckets that are not empty."""
    out, low, items, size = [], 0, 0, 0
    for bucket in sorted(sizes):
        n, b = sizes[bucket]
        if items and (items + n > block_items or size + b > block_bytes):
            out.append((low, bucket))
            low, items, size = bucket, 0, 0
        items, size = items + n, size + b
    return [*out, (low, n_buckets)]


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_items: int, block_bytes: int) -> list[DataFrame]:
    """The distinct items (item, text), in blocks."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).where("text is not null").distinct()
    whole = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n_buckets = 32 * max(1, -(-whole.n // block_items), -(-whole.b // block_bytes))
    if n_buckets == 32:
        return [items]
    items = staged(items.withColumn("bucket", F.pmod(F.xxhash64("item", "text"), F.lit(n_buckets))), "items")
    sizes = items.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))  # 32 rows a block
    blocks = cut_blocks({r.bucket: (r.n, r.b) for r in sizes.collect()}, n_buckets, block_items, block_bytes)
    return [items.where((F.col("bucket") >= low) & (F.col("bucket") < high)) for low, high in blocks]


def _scans(documents: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, block_items: int, block_bytes: int, scan_blocks: int) -> list[list[Broadcast]]:
    """The blocks of items, each sent to the tasks, by the scan that searches them."""
    context = documents.sparkSession.sparkContext
    shared = [context.broadcast(block.select("item", "text").toArrow()) for block in item_blocks(benchmark, item_id, item_text, block_items, block_bytes)]  # a block of items at most each
    return [shared[k : k + scan_blocks] for k in range(0, len(shared), scan_blocks)]


def find_contamination(documents: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_items: int = 20_000, block_bytes: int = 8 << 20, scan_blocks: int = 16) -> DataFrame:
    """One row for each document: n_words, n_hit, items (ids as strings, sorted) and hits (word ranges, end exclusive)."""
    scans = _scans(documents, benchmark, item_id, item_text, block_items, block_bytes, scan_blocks)
    docs = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if len(scans) > 1:
        docs = staged(docs, "documents")
    found = None
    for shared in scans:

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for run in searched(batches, shared, "text", window):
                yield pa.RecordBatch.from_arrays([run.rows.column(0), run.rows.column(1), *run.columns()], ["row", "doc_id", "n_words", "hits", "items"])

        one = docs.mapInArrow(search, f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, {HITS}")
        found = one if found is None else found.unionByName(one)
    if len(scans) > 1:
        found = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        F.array_sort("hits"),
        F.struct(F.lit(0).cast("long").alias("done"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["done"], x["last"]).alias("done"), (s["n"] + F.greatest(F.lit(0), x["last"] - F.greatest(s["done"], x["first"]))).alias("n")),
        lambda s: s["n"],
    )
    return found.select("doc_id", "n_words", covered.alias("n_hit"), "items", "hits")


def without_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_items: int = 20_000, block_bytes: int = 8 << 20, scan_blocks: int = 16) -> DataFrame:
    """The rows, all columns as they are, in which no window of any item occurs: each scan filters what the one before it
    left, in the same task, without a join."""
    left = documents
    for shared in _scans(documents, benchmark, item_id, item_text, block_items, block_bytes, scan_blocks):

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for run in searched(batches, shared, text, window):
                yield run.rows.filter(pa.array([k not in run.hits for k in range(run.rows.num_rows)], pa.bool_()))

        left = left.mapInArrow(clean, documents.schema)
    return left
