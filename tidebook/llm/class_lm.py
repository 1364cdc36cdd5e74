"""LM scoring with a class-based bigram model: exchange clustering assigns words to classes.

P(word | word before) = P(class | history class of the word before) * P(word | class).  Two clusterings give the classes:

* seeds: the ``FREQUENT`` most frequent words, and the groups of all others by their last three bytes (``GROUPS``), are
  exchanged one at a time over the matrix of their bigrams, whose size the constants fix.  This gives the first history
  classes;
* every word of at least ``FLOOR`` occurrences is then an item of its own, whatever the size of the vocabulary: a word's
  counts after each history class are a row of a table, and in rounds of exchange each task moves its words to the class
  that most raises the likelihood, against the small table of history by class, which is summed anew after each round.
  As all words of a round move at once, a round may lower the likelihood: it is undone then, and the rounds end; they also
  end where one gains less than ``LEAST_GAIN`` a token.  Words below the floor move as one item for each group.  The classes found become the history classes of the ``HOT``
  words, contexts are counted again, and the rounds repeated.

A word of no class of its own, seen or not, has its group's class, so every word has one.  Emission: the words never seen
get the Good-Turing share of their class (its words seen once over its tokens), a seen word its count's share of the rest,
so a class's probabilities sum to one with one unknown word, as in the base model.  Class transitions are interpolated with
the class unigram.  Words of the ``HOT`` most frequent (ties broken by hash) are counted inside the scan by a table of fixed
size; every other word of a text meets its corpus count and class in an equi-join on its hash.

A null or empty text is the end token alone; an empty training set gives base counts of zero and a model of one unknown
word a group; words of equal count are ordered by their hash; repeated rows are scored alike; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm import bytestext as bt
from tidebook.llm.shared import staged, unstage

HOT, FREQUENT, GROUPS, CLASSES = 1 << 16, 1200, 256, 64
FLOOR = 2  # occurrences of a word that is clustered by itself
SWEEPS = 3
LEAST_GAIN = 0.01  # nats a token that a round has to gain for another one to follow
TIES = 1 << 16  # parts of a run of words of equal count
END = -1  # hash of the end token, as a signed long
_FLUSH = 1 << 21


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and groups of all words of the texts, and the number of words before each text."""
    data = bt.lowered(data)
    starts, ends, first = bt.runs(data, offsets, bt.NOT_SPACE)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int32), first
    h = bt.hash_words(data, starts, ends).view(np.int64)
    h = np.where(h == END, np.int64(0), h)
    size = ends - starts
    tail = data[ends - 1].astype(np.uint64)
    for j in (2, 3):
        tail = tail << np.uint64(8) | np.where(size >= j, data[np.maximum(ends - j, 0)], 0).astype(np.uint64)
    return h, (bt.mix(tail) % np.uint64(GROUPS)).astype(np.int32), first


class _Table:
    """Positions of known hashes."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        self.sorted = hashes[self.order]
        top = (self.sorted.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(64 - 16)
        self.bucket = np.searchsorted(top, np.arange((1 << 16) + 1, dtype=np.uint64))
        self.depth = int(np.diff(self.bucket).max()) if len(hashes) else 0

    def find(self, h: np.ndarray) -> np.ndarray:
        """Position in the table, or -1."""
        out = np.full(len(h), -1, np.int32)
        top = ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(48)).astype(np.int64)
        at, stop = self.bucket[top], self.bucket[top + 1]
        left = np.arange(len(h))
        for _ in range(self.depth):
            keep = at < stop
            left, at, stop = left[keep], at[keep], stop[keep]
            if not len(left):
                break
            same = self.sorted[at] == h[left]
            out[left[same]] = self.order[at[same]]
            left, at, stop = left[~same], at[~same] + 1, stop[~same]
        return out


def vocabulary(documents: DataFrame, text: str) -> DataFrame:
    """hash, grp, n: of each distinct word; summed inside a task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {"h": [], "n": [], "g": [], "size": 0}

        def out() -> pa.RecordBatch:
            h, g = np.concatenate(held["h"] or [np.zeros(0, np.int64)]), np.concatenate(held["g"] or [np.zeros(0, np.int32)])
            keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            n = np.bincount(inverse, np.concatenate(held["n"] or [np.zeros(0)]), len(keys)).astype(np.int64)
            held.update(h=[keys], n=[n], g=[g[at]], size=len(keys))
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(held["g"][0]), pa.array(n)], ["hash", "grp", "n"])

        ends = 0
        for batch in batches:
            for part, data, offsets in bt.blocks(batch, batch.schema.names[0]):
                h, g, _ = words_of(data, offsets)
                ends += part.num_rows
                keys, at, n = np.unique(h, return_index=True, return_counts=True)
                held["h"].append(keys)
                held["n"].append(n)
                held["g"].append(g[at])
                held["size"] += len(keys)
                if held["size"] > _FLUSH:
                    done = out()
                    if held["size"] > _FLUSH // 2:
                        yield done
                        held.update(h=[], n=[], g=[], size=0)
        yield out()
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([0], pa.int32()), pa.array([ends])], ["hash", "grp", "n"])

    partial = documents.select(text).mapInArrow(count, "hash long, grp int, n long")
    return partial.groupBy("hash").agg(F.min("grp").alias("grp"), F.sum("n").alias("n")).where("n > 0")


def exchange(n: np.ndarray, classes: int, sweeps: int) -> np.ndarray:
    """Class of each item; ``n`` holds the item bigrams.  Item 0 is the end and keeps class 0 to itself."""
    items = len(n)
    total = n.sum(0) + n.sum(1)
    cls = np.zeros(items, np.int64)
    cls[1:][np.argsort(-total[1:], kind="stable")] = 1 + np.arange(items - 1) % (classes - 1)
    onehot = np.zeros((items, classes))
    onehot[np.arange(items), cls] = 1
    right, left = n @ onehot, n.T @ onehot  # to and from classes, by item
    pairs = onehot.T @ right

    def f(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)

    for _ in range(sweeps):
        moved = 0
        for i in np.argsort(-total, kind="stable"):
            if i == 0 or total[i] == 0:
                continue
            old, own = cls[i], n[i, i]
            r, l = right[i].copy(), left[i].copy()
            r[old] -= own
            l[old] -= own
            pairs[old] -= r
            pairs[:, old] -= l
            pairs[old, old] -= own
            rows = f(pairs)
            # gain of class c: its row takes r, its column takes l, and (c, c) takes both and the item's own pairs
            gain = (f(pairs + r[None, :]) - rows).sum(1) + (f(pairs + l[:, None]) - rows).sum(0)
            d = np.diag(pairs)
            gain += f(d + r + l + own) - f(d + r) - f(d + l) + f(d)
            out, into = pairs.sum(1) + l, pairs.sum(0) + r
            gain -= f(out + r.sum() + own) - f(out) + f(into + l.sum() + own) - f(into)
            gain[0] = -np.inf  # the end's
            new = int(np.argmax(gain))
            pairs[new] += r
            pairs[:, new] += l
            pairs[new, new] += own
            if new != old:
                moved += 1
                cls[i] = new
                right[:, old] -= n[:, i]
                right[:, new] += n[:, i]
                left[:, old] -= n[i]
                left[:, new] += n[i]
        if not moved:
            break
    return cls


def choose(table: np.ndarray, first: np.ndarray, history: np.ndarray, n: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The class that each item should have, all others staying: ``table`` counts history classes by classes, the items'
    own counts included; item i has the counts ``n`` after ``history`` of the entries first[i] to first[i + 1]."""
    items = len(own)
    if not items:
        return own
    item = np.repeat(np.arange(items), np.diff(first))
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0)
    n = n.astype(np.float64)
    rows, sizes, total = table[history], table.sum(0), np.bincount(item, n, items)
    gain = f(rows + n[:, None]) - f(rows)
    at = np.arange(len(item)), own[item]
    gain[at] = f(rows[at]) - f(rows[at] - n)
    gain = np.add.reduceat(gain, first[:-1], 0) if len(item) else np.zeros((items, len(sizes)))
    cost = f(sizes + total[:, None]) - f(sizes)
    cost[np.arange(items), own] = f(sizes[own]) - f(sizes[own] - total)
    gain -= cost
    gain[:, 0] = -np.inf  # the end's
    best = gain.argmax(1)
    better = gain[np.arange(items), best] > gain[np.arange(items), own] + 1e-9
    return np.where(better & (own > 0), best, own)


class Model:
    """What scoring needs, all of a size that the constants fix: hot words with their classes and history classes, those of
    the groups, and the table of history classes by classes."""

    def __init__(self, hot: list[tuple[int, int, int]], hot_cls: np.ndarray, group_cls: np.ndarray, hot_history: np.ndarray, group_history: np.ndarray, table: np.ndarray, once: np.ndarray, tokens: int, types: int):
        self.hot_hash = np.array([h for h, _, _ in hot], np.int64)
        self.hot_n = np.array([n for _, _, n in hot], np.int64)
        self.hot_cls, self.group_cls, self.hot_history, self.group_history = hot_cls, group_cls, hot_history, group_history
        self.tokens, self.types = tokens, types
        size = table.sum(0)  # tokens of each class
        whole = max(1.0, size.sum())
        unigram = (size + 0.5) / (whole + 0.5 * len(size))
        self.log_step = np.log10((table + 50 * unigram[None, :]) / (table.sum(1, keepdims=True) + 50))
        open_ = np.isin(np.arange(len(size)), group_cls)  # classes that unseen words have
        unseen = np.where(open_, np.minimum((once + 0.5) / (size + 1.0), 0.9), 0.0)
        if tokens == 0:
            unseen = open_.astype(np.float64)
        self.log_seen = np.log10(np.maximum(1 - unseen, 1e-12)) - np.log10(np.maximum(size, 1))
        self.log_unseen = np.log10(np.maximum(unseen, 1e-300))


def items_of(find: np.ndarray, grp: np.ndarray, frequent: int) -> np.ndarray:
    """Seed item of each word: 0 the end, then the frequent words, then the groups."""
    return np.where((find >= 0) & (find < frequent), 1 + find, 1 + frequent + grp)


def hottest(words: DataFrame, most: int = HOT) -> list[tuple[int, int, int]]:
    """(hash, group, count) of the ``most`` most frequent words; of words of equal count those of least (hash part, hash).
    A table of counts is small, so little more than the words that are wanted comes to the driver."""
    counts = words.groupBy("n").agg(F.count("*").alias("words"))
    above = F.sum("words").over(Window.orderBy(F.desc("n")))
    fits = counts.withColumn("above", above).agg(F.min(F.when(F.col("above") <= most, F.col("n"))).alias("least"), F.max(F.when(F.col("above") > most, F.col("n"))).alias("tied")).first()
    part = F.pmod(F.col("hash"), F.lit(TIES))
    rows = words.where(F.col("n") >= fits.least).collect() if fits.least is not None else []
    if fits.tied is not None:
        ties = words.where(F.col("n") == fits.tied)
        parts = ties.groupBy(part.alias("part")).agg(F.count("*").alias("words"))
        last = parts.withColumn("above", F.sum("words").over(Window.orderBy("part")) - F.col("words")).where(F.col("above") < most - len(rows)).agg(F.max("part").alias("part")).first().part
        if last is not None:
            rows += ties.where(part <= last).collect()
    return sorted(((r.hash, r.grp, r.n) for r in rows), key=lambda r: (-r[2], r[0] % TIES, r[0]))[:most]


def seeds(documents: DataFrame, hot: list[tuple[int, int, int]], text: str) -> tuple[np.ndarray, int]:
    """Class of each seed item, and how many of them are words."""
    spark = documents.sparkSession
    frequent = min(FREQUENT, len(hot))
    items = 1 + frequent + GROUPS
    shared = spark.sparkContext.broadcast(np.array([h for h, _, _ in hot[:frequent]], np.int64))

    def bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(shared.value)
        counts = np.zeros(items * items, np.int64)
        for batch in batches:
            for _, data, offsets in bt.blocks(batch, batch.schema.names[0]):
                h, g, first = words_of(data, offsets)
                own = np.insert(items_of(table.find(h), g, frequent), first[1:], 0)
                before = np.concatenate([[0], own[:-1]])
                counts += np.bincount(before * items + own, minlength=items * items)
        seen = np.flatnonzero(counts)
        for low in range(0, len(seen), 1 << 16):
            part = seen[low : low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((part // items).astype(np.int32)), pa.array((part % items).astype(np.int32)), pa.array(counts[part])], ["a", "b", "n"])

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((items, items))
        for batch in batches:
            a, b, c = (batch.column(k).to_numpy() for k in range(3))
            n[a, b] = c
        yield pa.RecordBatch.from_arrays([pa.array([exchange(n, CLASSES, SWEEPS).astype("<i8").tobytes()], pa.binary())], ["cls"])

    counted = documents.select(text).mapInArrow(bigrams, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # items x items rows at most: a fixed size, whatever the corpus
    row = staged(staged(counted, "bigrams").repartition(1).mapInArrow(cluster, "cls binary"), "seeds").first()
    return np.frombuffer(row.cls, "<i8"), frequent


def contexts(documents: DataFrame, hot: list[tuple[int, int, int]], hot_history: np.ndarray, group_history: np.ndarray, text: str) -> DataFrame:
    """hash, grp, n, history array<int>, counts array<long>: for each distinct word how often it follows each history class."""
    shared = documents.sparkSession.sparkContext.broadcast((np.array([h for h, _, _ in hot], np.int64), np.array([g for _, g, _ in hot], np.int32), hot_history, group_history))
    names = ["hash", "grp", "h", "n"]

    def rows_of(hash_: np.ndarray, grp: np.ndarray, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(hash_), 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(hash_[part]), pa.array(grp[part].astype(np.int32)), pa.array(h[part].astype(np.int32)), pa.array(n[part])], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, groups, own_history, of_group = shared.value
        table = _Table(hashes)
        frequent = np.zeros((len(hashes) + 1) * CLASSES, np.int64)  # the last word is the end
        held: list[tuple] = []
        size = 0

        def rest() -> Iterator[pa.RecordBatch]:
            w, g, h = (np.concatenate([x[k] for x in held]) for k in range(3))
            order = np.lexsort((h, w))
            w, g, h = w[order], g[order], h[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (h[1:] != h[:-1])
            at = np.flatnonzero(new)
            return rows_of(w[at], g[at], h[at], np.diff(np.append(at, len(w))))

        for batch in batches:
            for _, data, offsets in bt.blocks(batch, batch.schema.names[0]):
                w, g, first = words_of(data, offsets)
                at = table.find(w)
                history = np.where(at >= 0, own_history[at], of_group[g]) if len(hashes) else of_group[g]
                before = np.concatenate([[0], np.insert(history, first[1:], 0)[:-1]])
                own = np.insert(np.where(at >= 0, at, -1), first[1:], len(hashes))
                frequent += np.bincount(own[own >= 0] * CLASSES + before[own >= 0], minlength=len(frequent))
                cold = at < 0
                held.append((w[cold], g[cold], before[own_positions(first)][cold]))
                size += int(cold.sum())
                if size > _FLUSH:
                    yield from rest()
                    held, size = [], 0
        if held:
            yield from rest()
        seen = np.flatnonzero(frequent)
        word = seen // CLASSES
        yield from rows_of(np.append(hashes, END)[word], np.append(groups, 0)[word], seen % CLASSES, frequent[seen])

    partial = documents.select(text).mapInArrow(count, "hash long, grp int, h int, n long").repartition("hash")
    summed = partial.groupBy("hash", "h").agg(F.min("grp").alias("grp"), F.sum("n").alias("n"))
    words = summed.groupBy("hash").agg(F.min("grp").alias("grp"), F.sum("n").alias("n"), F.collect_list(F.struct("h", "n")).alias("all"))
    return words.select("hash", "grp", "n", F.col("all.h").alias("history"), F.col("all.n").alias("counts"))


def own_positions(first: np.ndarray) -> np.ndarray:
    """Places of the words where each text's end follows its words."""
    n = np.diff(first)
    return np.arange(first[-1]) + np.repeat(np.arange(len(n)), n)


def table_of(words: DataFrame) -> np.ndarray:
    """Counts of history classes by classes; a task sums its words first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES * CLASSES)
        for batch in batches:
            own = np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())
            out += np.bincount(batch.column(1).flatten().to_numpy() * CLASSES + own, batch.column(2).flatten().to_numpy(), CLASSES * CLASSES)
        seen = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array((seen // CLASSES).astype(np.int32)), pa.array((seen % CLASSES).astype(np.int32)), pa.array(out[seen].astype(np.int64))], ["h", "c", "n"])

    entries = words.select("cls", "history", "counts").mapInArrow(sums, "h int, c int, n long").groupBy("h", "c").agg(F.sum("n").alias("n"))
    out = np.zeros((CLASSES, CLASSES))
    for r in entries.collect():  # CLASSES x CLASSES rows at most
        out[r.h, r.c] = r.n
    return out


def likelihood(table: np.ndarray) -> float:
    """Log-likelihood of the classes, but for what no exchange changes."""
    f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1)), 0.0).sum()
    return float(f(table) - f(table.sum(0)))


def exchange_words(words: DataFrame, group_cls: np.ndarray, least_gain: float, name: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rounds of exchange over all words of at least ``FLOOR`` occurrences, and over the groups of the others: the words with
    their classes, the groups' classes and the last table.  ``words`` has the first classes."""
    spark = words.sparkSession
    rare = (F.col("n") < FLOOR) & (F.col("hash") != END)
    pooled = words.where(rare).select("grp", F.explode(F.arrays_zip("history", "counts")).alias("e")).groupBy("grp", "e.history").agg(F.sum("e.counts").alias("n"))
    pooled = sorted((r.grp, r.history, r.n) for r in pooled.collect())  # GROUPS x CLASSES rows at most
    which, at = np.unique([r[0] for r in pooled], return_index=True)
    first, history, counts = np.append(at, len(pooled)).astype(np.int64), np.array([r[1] for r in pooled], np.int64), np.array([r[2] for r in pooled])
    which = which.astype(np.int64)
    table = table_of(words)
    while True:
        new_groups = group_cls.copy()
        new_groups[which] = choose(table, first, history, counts, group_cls[which])
        shared = spark.sparkContext.broadcast((table, new_groups))

        def move(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            table, of_group = shared.value
            for batch in batches:
                for low in range(0, batch.num_rows, 512):
                    part = batch.slice(low, 512)
                    hash_, grp, n, own = (part.column(c).to_numpy() for c in (0, 1, 2, 3))
                    size = part.column(4).value_lengths().to_numpy()
                    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
                    new = choose(table, first, part.column(4).flatten().to_numpy(), part.column(5).flatten().to_numpy(), own.astype(np.int64))
                    new = np.where((n < FLOOR) & (hash_ != END), of_group[grp], new)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(new.astype(np.int32)), part.column(4), part.column(5)], part.schema.names)

        rows = words.select("hash", "grp", "n", "cls", "history", "counts")
        moved = staged(rows.mapInArrow(move, rows.schema), name)
        new_table = table_of(moved)
        gain = likelihood(new_table) - likelihood(table)
        if gain <= 0:
            unstage(moved)
            return words, group_cls, table
        unstage(words)
        words, group_cls, table = moved, new_groups, new_table
        if gain < least_gain * table.sum():
            return words, group_cls, table


def train(documents: DataFrame, text: str = "text", least_gain: float = LEAST_GAIN, passes: int = 2) -> tuple[Model, DataFrame]:
    """The model, and the table of all distinct words with their counts and classes.  ``passes``: how often contexts are
    counted, each time with the history classes of the pass before."""
    spark = documents.sparkSession
    vocabulary_ = staged(vocabulary(documents, text), "vocabulary")
    totals = vocabulary_.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    hot = hottest(vocabulary_.where(F.col("hash") != END))
    cls, frequent = seeds(documents, hot, text)
    hot_cls = np.array([cls[1 + i] if i < frequent else cls[1 + frequent + g] for i, (_, g, _) in enumerate(hot)], np.int64)
    group_cls = cls[1 + frequent :].copy()
    for k in range(passes):
        hot_history, group_history = hot_cls, group_cls
        counted = staged(contexts(documents, hot, hot_history, group_history, text), f"contexts{k}")
        if k == 0:
            named = spark.createDataFrame([(int(h), int(c)) for (h, _, _), c in zip(hot[:frequent], hot_cls)], "hash long, own int")
            of_group = F.element_at(F.array(*[F.lit(int(c)) for c in group_cls]), F.col("grp") + 1)
            begin = counted.join(F.broadcast(named), "hash", "left").withColumn("cls", F.when(F.col("hash") == END, 0).otherwise(F.coalesce(F.when(F.col("n") >= FLOOR, F.col("own")), of_group)))
        else:
            begin = counted.join(words.select("hash", "cls"), "hash")
        begin = staged(begin.select("hash", "grp", "n", F.col("cls").cast("int").alias("cls"), "history", "counts"), f"begin{k}")
        unstage(counted)
        words, group_cls, table = exchange_words(begin, group_cls, least_gain, f"exchange{k}")
        wanted = spark.createDataFrame([(int(h),) for h, _, _ in hot], "hash long")  # HOT rows at most
        now = {r.hash: r.cls for r in words.select("hash", "cls").join(F.broadcast(wanted), "hash").collect()}
        hot_cls = np.array([now[h] for h, _, _ in hot], np.int64)
    once = np.zeros(CLASSES)
    for r in words.where(f"n = 1 and hash <> {END}").groupBy("cls").agg(F.count("*").alias("n")).collect():  # CLASSES rows
        once[r.cls] = r.n
    return Model(hot, hot_cls, group_cls, hot_history, group_history, table, once, totals.n or 0, totals.v or 0), words.select("hash", "n", "cls")


def score(documents: DataFrame, model: Model, words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score and perplexity of each whole text."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        table = _Table(m.hot_hash)
        base = m.tokens + m.types + 1
        for batch in batches:
            for part, data, offsets in bt.blocks(batch):
                rows = part.num_rows
                h, g, first = words_of(data, offsets)
                owner = np.repeat(np.arange(rows), np.diff(first))
                at = table.find(h)
                hot = at >= 0
                history = np.where(hot, m.hot_history[at], m.group_history[g]) if len(m.hot_hash) else m.group_history[g]
                before = np.concatenate([[0], np.insert(history, first[1:], 0)[:-1]])
                ends = first[1:] + np.arange(rows)
                score = m.log_step[before[ends], 0]
                before = before[own_positions(first)]
                cls, n = m.hot_cls[at[hot]], m.hot_n[at[hot]]
                score += np.bincount(owner[hot], m.log_step[before[hot], cls] + np.log10(n) + m.log_seen[cls], rows)
                base_score = np.bincount(owner[hot], np.log10((n + 1) / base), rows)
                known = np.bincount(owner[hot], minlength=rows)
                tokens = np.diff(first) + 1
                # one row for each text, then one for each other word of a text and history class before it
                (text_, word, step, grp), count = _distinct(owner[~hot], h[~hot], before[~hot], g[~hot])
                row = part.column(0).to_numpy()
                zeros = np.zeros(len(count))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([row, row[text_]])),
                        pa.concat_arrays([part.column(1), pa.nulls(len(count), part.column(1).type)]),
                        pa.array(np.concatenate([np.full(rows, END), word])),
                        pa.array(np.concatenate([np.zeros(rows, np.int32), step.astype(np.int32)])),
                        pa.array(np.concatenate([np.zeros(rows, np.int32), grp.astype(np.int32)])),
                        pa.array(np.concatenate([tokens, count])),
                        pa.array(np.concatenate([known, np.zeros(len(count), np.int64)])),
                        pa.array(np.concatenate([base_score, zeros])),
                        pa.array(np.concatenate([score, zeros])),
                    ],
                    ["row", "doc_id", "hash", "history", "grp", "n", "known", "base", "score"],
                )

    numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = numbered.schema["doc_id"].dataType.simpleString()
    found = staged(numbered.mapInArrow(scan, f"row long, doc_id {kind}, hash long, history int, grp int, n long, known long, base double, score double"), "scanned")
    texts = found.where(F.col("hash") == END).select("row", "doc_id", F.col("n").alias("n_tokens"), "known", "base", "score")
    steps = spark.createDataFrame([(h, c, float(model.log_step[h, c]), float(model.log_seen[c]), float(model.log_unseen[c])) for h in range(CLASSES) for c in range(CLASSES)], "history int, cls int, step double, seen double, unseen double")
    of_group = F.element_at(F.array(*[F.lit(int(c)) for c in model.group_cls]), F.col("grp") + 1)
    count = F.coalesce("c", F.lit(0))
    rest = found.where(F.col("hash") != END).join(words.select("hash", F.col("n").alias("c"), F.col("cls").alias("own")), "hash", "left")
    rest = rest.withColumn("cls", F.coalesce("own", of_group)).join(F.broadcast(steps), ["history", "cls"])  # CLASSES x CLASSES rows
    rest = rest.groupBy("row").agg(
        F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("known2"),
        F.sum(F.col("n") * F.log10((count + 1) / F.lit(float(model.tokens + model.types + 1)))).alias("base2"),
        F.sum(F.col("n") * (F.col("step") + F.when(count > 0, F.log10(count) + F.col("seen")).otherwise(F.col("unseen")))).alias("score2"),
    )
    end_n = words.where(F.col("hash") == END).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    end_base = float(np.log10((end_n + 1) / (model.tokens + model.types + 1)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = texts.join(rest, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + zero("known2") + (1 if end_n else 0)).alias("n_known"),
        (F.col("base") + zero("base2") + end_base).alias("base_score"),
        (F.col("score") + zero("score2")).alias("score"),
    ).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _distinct(owner: np.ndarray, h: np.ndarray, history: np.ndarray, grp: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct words of each text, by history class, with their counts."""
    order = np.lexsort((history, h, owner))
    owner, h, history, grp = owner[order], h[order], history[order], grp[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1]) | (history[1:] != history[:-1])
    at = np.flatnonzero(new)
    return (owner[at], h[at], history[at], grp[at]), np.diff(np.append(at, len(h)))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(modulus)) == remainder
