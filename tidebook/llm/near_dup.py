"""MinHash near-dedup by a multi-index Hamming join.

Every document's set of word shingles is hashed; documents of equal sets are one class from the start.  A class has a
signature of ``SYMBOLS`` b-bit minhashes (16 bits each).  Sets of similarity s agree in a symbol with probability s, so the
Hamming distance limit of ``DISTANCE`` symbols lies five deviations above what similarity 0.8 gives: fewer than one pair in
100,000 of exactly that similarity is beyond it.  Every pair within the limit and of the
similarity is found, whatever the data:

* the symbols are split into ``CHUNKS`` chunks of two.  By pigeonhole, signatures within the distance agree in ``SHARED``
  chunks at least; a class with fewer chunk values that another class holds has no partner and goes;
* classes that hold the same value of a chunk meet in its bucket.  First each bucket's most popular member (the one whose
  chunk values are the most common of all, so the same one in most buckets of a dense group) is compared with the others:
  pairs in proportion to the members, after which a dense group is one component but for its outliers;
* a bucket that still holds several components is open.  Partners across components meet in ``SHARED`` open buckets at least,
  so a class in fewer of them goes.  The others are compared across components inside a task, so only pairs that may link
  leave it.  In a bucket of at most ``CROWD`` members that is every pair, taken only in the first such bucket of the two;
* texts of one template crowd its chunks without being near copies, and their pairs would grow with the square.  So members
  of ``SHARED`` larger buckets (others share a smaller one with any partner) meet by their rarest shingles: with the shingles of all crowded classes in one order, rare ones first,
  sets of similarity ``percent`` share one among the first ``n - percent * n / 100 + 1`` of each (n: the set's size), which
  in a template's texts are their own.  Any order is right; the one taken is that of the counts over all crowded classes by
  slots of the shingles' hashes (``SLOTS`` of them, so the table that tasks need has a bound), and a shingle alone in its
  slot is nobody's partner.  A pair has to agree in ``SHARED`` chunks here as well.  Long texts share hundreds of their rare
  shingles, so each member brings the ``BEFORE`` shingles before that of the bucket, in the common order, and a pair that has
  one of them in common is left to its bucket: the first shingle that two share has none before it, so no pair is lost, and
  few are given more than once.  A bucket of over ``BLOCK`` members is compared block by block; a task holds two blocks at a
  time.

Before a pair leaves the task, its symbols' distance is counted, and a bitmap of each set gives an upper bound of the shared
shingles (sets of over ``SMALL`` shingles: ``BITS`` one-bit minhashes, with a limit five deviations away).  What is left is
confirmed on the full sets.  Links are only sought between components, so no group's pairs are all emitted, and no link
between different components is lost.

Components come from alternating minimum-neighbour steps over the links, written out at each step.  Rows are told apart by
a number of their own: a doc_id that repeats with other texts has a row for each, and each row's component_id is the
smallest doc_id that it reaches; rows without a doc_id take part, and their component_id is null if no id is reached.  A
document without words, or a null text, is alone; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tidebook.llm import bytestext as bt
from tidebook.llm.shared import staged, unstage

SYMBOLS, CHUNKS = 64, 32
SHARED = 4
DISTANCE = CHUNKS - SHARED
SYMBOL_BITS = 16
CROWD = 64  # members of a chunk's bucket of which all pairs are compared
SLOTS = 1 << 21  # counts of shingles by hash
BLOCK = 4096  # members of a bucket that a task compares at once
BEFORE = 32  # rare shingles before that of a bucket which a member brings along
BITMAP = 4096  # bits of the map of a set
SMALL = 500  # shingles of a set that its map is meant for
BITS, BIT_DISTANCE = 1024, 150
_PAIRS = 1 << 14  # pairs compared in one numpy step
_PART = 1 << 20  # shingles sorted in one numpy step

_RNG = np.random.default_rng(20240607)
_MULTIPLY = _RNG.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MULTIPLY32 = _RNG.integers(1, 1 << 31, BITS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD32 = _RNG.integers(0, 1 << 32, BITS, dtype=np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, hashes): sorted distinct shingle hashes of each text; ``first`` has one more entry than texts."""
    n = len(offsets) - 1
    data = bt.lowered(data)
    starts, ends, words = bt.runs(data, offsets, bt.NOT_SPACE)
    if not len(starts):
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint64)
    h = bt.hash_words(data, starts, ends)
    text = np.repeat(np.arange(n), np.diff(words))
    m = max(0, len(h) - size + 1)
    x = np.full(m, size, np.uint64)
    for j in range(size):
        x = x * np.uint64(0x9FB21C651E98DF25) + h[j : j + m]
    keep = text[:m] == text[size - 1 :]
    x, owner = bt.mix(x)[keep], text[:m][keep]
    short = [t for t in np.flatnonzero((np.diff(words) > 0) & (np.diff(words) < size))]
    if short:
        extra = []
        for t in short:
            v = np.uint64(words[t + 1] - words[t])
            for w in h[words[t] : words[t + 1]]:
                v = np.uint64((int(v) * 0x9FB21C651E98DF25 + int(w)) & 0xFFFFFFFFFFFFFFFF)
            extra.append(v)
        x, owner = np.concatenate([x, bt.mix(np.array(extra, np.uint64))]), np.concatenate([owner, short])
    order = np.lexsort((x, owner))
    x, owner = x[order], owner[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    x, owner = x[new], owner[new]
    return np.searchsorted(owner, np.arange(n + 1)), x


def chunk_values(first: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Values of the chunks (rows: texts), each two b-bit minhashes."""
    n = len(first) - 1
    full = np.flatnonzero(first[1:] > first[:-1])
    out = np.zeros((n, CHUNKS), np.int64)
    if not len(full):
        return out
    mask = np.uint64((1 << SYMBOL_BITS) - 1)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat(sets * _MULTIPLY[k] + _ADD[k], first[:-1][full])
        value = (bt.mix(least) & mask).astype(np.int64)
        out[full, k // 2] = out[full, k // 2] << SYMBOL_BITS | value
    return out - (1 << 31)


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """row, doc_id, n_shingles, two hashes of the whole set, chunks array<int>."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in bt.blocks(batch):
                first, sets = shingles(data, offsets, size)
                n = np.diff(first)
                whole = []
                for turn in (1, 2):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bt.mix(sets * np.uint64(2 * turn + 1) + np.uint64(turn)))])
                    whole.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n), pa.array(whole[0]), pa.array(whole[1]), _lists(chunk_values(first, sets))], ["row", "doc_id", "n_shingles", "h1", "h2", "chunks"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("row", "doc_id", "text").mapInArrow(sign, f"row long, doc_id {kind}, n_shingles long, h1 long, h2 long, chunks array<int>")


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * CHUNKS), pa.array(values.astype(np.int32).ravel()))


def sketches(first: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """Of each text a row of longs: its set's bitmap (sets of up to ``SMALL``), then one-bit minhashes (sets that a larger
    one may link with); zeros where they are not meant."""
    n = np.diff(first)
    out = np.zeros((len(n), (BITMAP + BITS) // 64), np.uint64)
    owner = np.repeat(np.arange(len(n)), n)
    mapped = n[owner] <= SMALL
    bit = (sets[mapped] >> np.uint64(20)) % np.uint64(BITMAP)
    flat = np.unique(owner[mapped] * np.int64(BITMAP) + bit.astype(np.int64))
    np.bitwise_or.at(out, (flat // BITMAP, flat % BITMAP // 64), np.uint64(1) << (flat % 64).astype(np.uint64))
    for text in np.flatnonzero(n >= SMALL * 4 // 5):
        small = (sets[first[text] : first[text + 1]] >> np.uint64(32)).astype(np.uint32)
        for k in range(0, BITS, 64):
            least = np.array([(small * _MULTIPLY32[j] + _ADD32[j]).min() for j in range(k, k + 64)], np.uint64)
            out[text, (BITMAP + k) // 64] = np.bitwise_or.reduce((bt.mix(least) & np.uint64(1)) << np.arange(64, dtype=np.uint64))
    return out


def sets_of(rows: DataFrame, size: int, wanted: DataFrame) -> DataFrame:
    """rep, n, chunks, sketch and the full set of each wanted row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in bt.blocks(batch):
                first, sets = shingles(data, offsets, size)
                whole = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))
                sketch = pa.array([x.tobytes() for x in sketches(first, sets)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(first)), _lists(chunk_values(first, sets)), sketch, whole], ["rep", "n", "chunks", "sketch", "shingles"])

    texts = rows.select("row", "text").join(wanted.select(F.col("rep").alias("row")), "row", "left_semi")
    return texts.mapInArrow(run, "rep long, n long, chunks array<int>, sketch binary, shingles array<long>")


def components(links: DataFrame, name: str = "component") -> DataFrame:
    """node and the smallest node it reaches, for each end of a link (columns u, v)."""
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    before = None
    while True:
        # large star: neighbours above a node move to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below a node, and the node, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        told = Observation()
        step = small.where("u <> v").distinct().observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        old, edges = edges, staged(step, f"{name}-step")
        unstage(old)
        state = (told.get["n"], told.get["s"])
        if state == before or not state[0]:
            break
        before = state
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def symbol_distance(a: Column, b: Column) -> Column:
    """Symbols in which two signatures differ."""
    half = (1 << SYMBOL_BITS) - 1
    differ = F.zip_with(a, b, lambda x, y: (x.bitwiseXOR(y).bitwiseAND(half) != 0).cast("int") + (F.shiftrightunsigned(x.bitwiseXOR(y), SYMBOL_BITS) != 0).cast("int"))
    return F.aggregate(differ, F.lit(0), lambda s, x: s + x)


def link(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (u, v) those that link on their full sets."""
    own = lambda x: sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("shingles").alias(f"s{x}"))
    full = near.join(own("u"), "u").join(own("v"), "v")
    full = full.select("u", "v", (F.col("nu") + F.col("nv")).alias("n"), F.size(F.array_intersect("su", "sv")).alias("both"))
    return full.where(100 * F.col("both") >= percent * (F.col("n") - F.col("both"))).select("u", "v")


def hub_pairs(able: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Each class with the most popular member of each of its buckets, if sizes and signatures allow a link."""
    rows = able.select("rep", "n", "rank", F.explode("keys").alias("key"))
    hubs = rows.groupBy("key").agg(F.max_by("rep", "rank").alias("hub"), F.max_by("n", "rank").alias("hub_n"))
    pairs = rows.join(hubs, "key").where((F.col("rep") != F.col("hub")) & sizes_fit(F.col("n"), F.col("hub_n"), percent))
    pairs = pairs.select(F.least("rep", "hub").alias("u"), F.greatest("rep", "hub").alias("v")).distinct()
    own = lambda x: sets.select(F.col("rep").alias(x), F.col("chunks").alias(f"x{x}"))
    return pairs.join(own("u"), "u").join(own("v"), "v").where(symbol_distance(F.col("xu"), F.col("xv")) <= DISTANCE).select("u", "v")


def open_buckets(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, comp, ...) of buckets with several components, with the bucket's size."""
    parts = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    sizes = parts.groupBy("key").agg(F.sum("m").alias("size"), F.count("*").alias("comps")).where("comps > 1")
    return rows.join(sizes.select("key", "size"), "key")


def partnered(rows: DataFrame) -> DataFrame:
    """Rows (key, rep, comp) in open buckets, of classes that are in ``SHARED`` of them: others have no partner across components."""
    rows = open_buckets(rows).drop("size")
    enough = rows.groupBy("rep").agg(F.count("*").alias("m")).where(F.col("m") >= SHARED)
    return rows.join(enough, "rep", "left_semi")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batches (last column: a list of shingles) of a bounded number of shingles or one row, with the number of
    shingles of each row and all shingles."""
    for batch in batches:
        n = pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy().astype(np.int64)
        part = np.cumsum(n) // _PART
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            rows = batch.slice(low, high - low)
            yield rows, n[low:high], rows.column(rows.num_columns - 1).flatten().to_numpy().view(np.uint64)


def _slot(shingles: np.ndarray, slots: int) -> np.ndarray:
    return (shingles >> np.uint64(11)).astype(np.int64) % slots


def holders(crowd: DataFrame) -> np.ndarray:
    """By slot, how many sets of ``crowd`` hold its shingles (at least 1)."""
    slots = SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(slots, np.int64)
        for _, _, shingles in _sets(batches):
            held += np.bincount(_slot(shingles, slots), minlength=slots)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at])], ["slot", "held"])

    counts = crowd.select("shingles").mapInArrow(count, "slot long, held long").groupBy("slot").agg(F.sum("held").alias("held")).where("held > 1")
    found = counts.select(F.col("slot").cast("int"), F.least("held", F.lit((1 << 31) - 1)).cast("int").alias("held")).toArrow()  # a row a slot at most
    out = np.ones(slots, np.int32)
    out[found.column("slot").to_numpy()] = found.column("held").to_numpy()
    return out


def rarest(crowd: DataFrame, percent: int) -> DataFrame:
    """rep, comp, key, place: of each set (rep, comp, shingles) the rarest shingles, of which sets of the similarity share one,
    with their places in the order of all."""
    held = crowd.sparkSession.sparkContext.broadcast(holders(crowd))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, n, shingles in _sets(batches):
            owner = np.repeat(np.arange(len(n)), n)
            by = held.value[_slot(shingles, len(held.value))]
            order = np.lexsort((shingles, by, owner))
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            keep = (place < (n - -(-percent * n // 100) + 1)[owner]) & (by[order] > 1)
            key = shingles[order[keep]].view(np.int64) | np.iinfo(np.int64).min  # apart from keys of chunks, which aren't negative
            at = pa.array(owner[keep])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(key), pa.array(place[keep])], ["rep", "comp", "key", "place"])

    return crowd.select("rep", "comp", "shingles").mapInArrow(run, "rep long, comp long, key long, place long")


def meetings(able: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (key, rep, comp, size, level, chunk, small, before) of the buckets whose members are compared: those of chunks
    (level 1) and of rare shingles (level 0).  ``small`` has a bit for each chunk whose bucket of the member is compared at
    level 1; ``before`` has the rare shingles before ``key``."""
    buckets = staged(open_buckets(partnered(able.select("rep", "comp", F.explode("keys").alias("key")))), "open")
    chunk, crowded = F.shiftright("key", 32).cast("int"), F.col("size") > CROWD
    marks = buckets.groupBy("rep").agg(F.sum(F.when(crowded, 0).otherwise(F.expr("shiftleft(1L, cast(shiftright(key, 32) as int))"))).alias("small"), F.count_if(crowded).alias("crowds"))
    members = marks.where(F.col("crowds") >= SHARED).select("rep")
    crowd = staged(sets.select("rep", "shingles").join(members, "rep").join(able.select("rep", "comp"), "rep").select("rep", "comp", "shingles"), "crowd")
    rare = staged(rarest(crowd, percent), "rare")
    unstage(crowd)
    small = buckets.where(~crowded).select("key", "rep", "comp", "size", F.lit(1).alias("level"), chunk.alias("chunk"), F.array().cast("array<long>").alias("before"))
    earlier = F.collect_list("key").over(Window.partitionBy("rep").orderBy("place").rowsBetween(-BEFORE, -1))
    rows = small.unionByName(open_buckets(rare).select("key", "rep", "comp", "size", F.lit(0).alias("level"), F.lit(CHUNKS).alias("chunk"), earlier.alias("before")))
    return rows.join(marks.select("rep", "small"), "rep").select("key", "rep", "comp", "size", "level", "chunk", "small", "before")


def across(able: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) across components that may link; ``able`` has rep, comp and keys."""
    return candidates(able, sets, percent).distinct()


def candidates(able: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``across`` as it leaves the tasks: a pair with two rare shingles in common may come more than once."""
    rows = meetings(able, sets, percent)
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "comp", "rep", "level", "chunk", "small", "before")
    rows = rows.join(sets.select("rep", "n", "chunks", "sketch"), "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            # a unit (key, low, high) may go on in the next batch
            units = [batch.column(k).to_numpy() for k in range(3)]
            last = np.logical_and.reduce([x == x[-1] for x in units])
            same = bool(held) and all(x[0] == held[0].column(k)[0].as_py() for k, x in enumerate(units))
            if same and last.all():
                held.append(batch)
                continue
            begin = int(np.argmin(last[::-1])) if not last.all() else batch.num_rows
            yield from compare([*held, batch.slice(0, batch.num_rows - begin)], percent)
            held = [batch.slice(batch.num_rows - begin)]
        if held:
            yield from compare(held, percent)

    columns = ["key", "low", "high", "block", "comp", "rep", "level", "chunk", "small", "before", "n", "chunks", "sketch"]
    dealt = rows.select(*columns).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "block", "comp")
    return dealt.mapInArrow(run, "u long, v long")


def compare(batches: list[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs of whole units, sorted by key, low, high, block, comp, that lie across components and may link."""
    table = pa.Table.from_batches(batches).combine_chunks()
    rows = table.num_rows
    if not rows:
        return
    column = lambda name: table.column(name).combine_chunks()
    key, low, high, block, comp, rep, level, chunk, small, n = (column(c).to_numpy() for c in ("key", "low", "high", "block", "comp", "rep", "level", "chunk", "small", "n"))
    chunks = column("chunks").flatten().to_numpy().reshape(rows, CHUNKS)
    symbols = chunks.view(np.uint16)
    sketch = np.frombuffer(b"".join(column("sketch").to_pylist()), np.uint64).reshape(rows, -1)
    n_map = BITMAP // 64
    in_small = (small[:, None] >> np.arange(CHUNKS) & 1).astype(bool)
    n_before = pc.list_value_length(column("before")).to_numpy()
    all_before = np.append(column("before").flatten().to_numpy(), 0)
    at_before = np.cumsum(n_before) - n_before

    def before(at: np.ndarray, fill: int) -> np.ndarray:
        """The rare shingles that the rows bring along, filled up to the same number."""
        k = np.arange(BEFORE)
        there = k < n_before[at][:, None]
        return np.where(there, all_before[np.where(there, at_before[at][:, None] + k, -1)], fill)

    def run_ends(*by: np.ndarray) -> np.ndarray:
        """For each row the end of its run of equal values."""
        new = np.ones(rows + 1, bool)
        new[1:-1] = np.logical_or.reduce([x[1:] != x[:-1] for x in by])
        at = np.flatnonzero(new)
        return at[np.searchsorted(at, np.arange(rows), "right")]

    end = run_ends(key, low, high)
    begin = np.where(low == high, run_ends(key, low, high, comp), run_ends(key, low, high, block))
    many = np.where((low == high) | (block == low), end - begin, 0)
    done = np.concatenate([[0], np.cumsum(many)])
    for start in range(0, int(done[-1]), _PAIRS):
        flat = np.arange(start, min(start + _PAIRS, int(done[-1])))
        u = np.searchsorted(done, flat, "right") - 1
        v = begin[u] + flat - done[u]
        keep = (comp[u] != comp[v]) & (100 * np.minimum(n[u], n[v]) >= percent * np.maximum(n[u], n[v]))
        u, v = u[keep], v[keep]
        same = chunks[u] == chunks[v]
        met = (same & in_small[u] & (np.arange(CHUNKS) <= chunk[u][:, None])).sum(1)  # up to this one, if it is small
        keep = np.where(level[u] == 1, met == 1, (met == 0) & (same.sum(1) >= SHARED))
        u, v = u[keep], v[keep]
        keep = (symbols[u] != symbols[v]).sum(1) <= DISTANCE
        u, v = u[keep], v[keep]
        large = np.maximum(n[u], n[v]) > SMALL
        keep = np.zeros(len(u), bool)
        a, b = u[~large], v[~large]
        apart = np.bitwise_count(sketch[a, :n_map] ^ sketch[b, :n_map]).sum(1, dtype=np.int64)
        total = n[a] + n[b]
        most = (total - apart) // 2  # no more shingles are shared
        keep[~large] = 100 * most >= percent * (total - most)
        keep[large] = np.bitwise_count(sketch[u[large], n_map:] ^ sketch[v[large], n_map:]).sum(1, dtype=np.int64) <= BIT_DISTANCE
        u, v = u[keep], v[keep]
        # left to the bucket of a rare shingle before; keys are negative
        keep = ~(before(u, 0)[:, :, None] == before(v, 1)[:, None, :]).any((1, 2))
        u, v = rep[u[keep]], rep[v[keep]]
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])


def numbered(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id and text, written once, so that the number of a row holds in every later read."""
    return staged(documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "numbered")


def grouped(rows: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """row, doc_id, n_shingles, group (a row's number) and component_id for rows of stable numbers (row, doc_id, text)."""
    signed = staged(signatures(rows, size), "signatures")
    key = ["h1", "h2", "n_shingles"]
    classes = staged(signed.where("n_shingles > 0").groupBy(*key).agg(F.min("row").alias("rep"), F.min("doc_id").alias("least")), "classes")
    reps = signed.join(classes.select(F.col("rep").alias("row")), "row", "left_semi").select(F.col("row").alias("rep"), F.col("n_shingles").alias("n"), F.posexplode("chunks").alias("chunk", "value"))
    # chunk values that more than one class holds, and the classes with enough of them
    keyed = reps.select("rep", "n", (F.shiftleft(F.col("chunk").cast("long"), 32) + F.col("value").bitwiseAND(F.lit(0xFFFFFFFF))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    able = keyed.join(shared, "key").groupBy("rep").agg(F.first("n").alias("n"), F.sum("held").alias("popular"), F.collect_list("key").alias("keys")).where(F.size("keys") >= SHARED)
    rank = F.col("popular") * (1 << 20) + F.pmod(F.xxhash64("rep"), F.lit(1 << 20))
    able = staged(able.select("rep", "n", rank.alias("rank"), "keys"), "able")
    sets = staged(sets_of(rows, size, able), "sets")

    hub_links = staged(link(hub_pairs(able, sets, percent), sets, percent), "hub-links")
    first = staged(components(hub_links, "hub"), "labels")
    plain, able = able, able.join(first.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "keys", F.coalesce("component", "rep").alias("comp"))
    able = staged(able, "labelled")
    for done in (hub_links, first, plain):
        unstage(done)
    pairs = staged(across(able, sets, percent), "across")
    found = link(pairs, sets, percent)
    comps = able.select("rep", "comp")
    ends = found.join(comps.select(F.col("rep").alias("u"), F.col("comp").alias("cu")), "u").join(comps.select(F.col("rep").alias("v"), F.col("comp").alias("cv")), "v")
    across_links = staged(ends.select(F.col("cu").alias("u"), F.col("cv").alias("v")), "across-links")
    second = components(across_links, "across")
    for done in (pairs, sets, across_links):
        unstage(done)
    comps = comps.join(second.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("group"))

    classes = classes.join(comps, "rep", "left").select(*key, F.coalesce("group", "rep").alias("group"), "least")
    ids = classes.groupBy("group").agg(F.min("least").alias("component_id"))
    answer = classes.select(*key, "group").join(ids, "group")
    out = signed.select("row", "doc_id", *key).join(answer, key, "left")
    lone = F.col("n_shingles") == 0
    return out.select("row", "doc_id", "n_shingles", F.when(lone, F.col("row")).otherwise(F.col("group")).alias("group"), F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def near_duplicates(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: linked where 100 * shared >= percent * united shingles."""
    found = grouped(numbered(documents, doc_id, text), size, percent)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
