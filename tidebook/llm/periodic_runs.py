"""Periodic runs of words, by maximal pairs.

A run of period q is a stretch whose words q apart are identical and that no neighbour extends.  Its first word and the word q
later begin a maximal pair: two suffixes whose common prefix L can be extended neither to the left nor to the right, with
L >= (exponent - 1) * q.  All such pairs of a text come from its suffix order: words of a block of texts are ranked by prefix
doubling (only suffixes that still share a prefix take part in the next step), the common prefixes of neighbours follow from
the ranks, and a bottom-up walk of the LCP intervals joins the positions below a node, kept in order and by the word to their
left.  A pair of different left words within L / (exponent - 1) of each other is a run as it stands; nothing is extended.

Nothing is shuffled: a text is judged where it lies, so equal, hot or repeated rows cost no more than others.  Memory is that
of the texts of one block (a megabyte, or one longer text) times the number of doubling steps.

Words are compared by 64-bit hashes.  A null or empty text has no words and no runs; its collapsed text is empty.  Repeated
rows are judged each for itself, an empty table gives no rows, and other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm import bytestext as bt

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = "n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"

#: (seed, number of words) -> for each place the original word that stands there, or None for the text as it is.
Arrange = Callable[[int, int], "np.ndarray | None"]


def suffix_ranks(key: np.ndarray, text: np.ndarray, ends: np.ndarray, least: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words, until all differ, and the suffixes that share at least
    ``least`` words with another (or a power of two below that), in suffix order.

    ``text``: the number of each word's text, whose words are never those of another; ``ends``: where it ends.  A rank is the
    place of the first of its group, so later ranks refine earlier ones.
    """
    n = len(key)
    order = np.lexsort((key, text))
    new = np.ones(n, bool)
    new[1:] = (key[order[1:]] != key[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, n))
    rank = np.full(n + 1, -1, np.int32)
    rank[order] = np.repeat(first, size)
    levels, width = [rank], 1
    shared = order[np.repeat(size > 1, size)]  # suffixes of groups of several, group by group
    base = shared
    while len(shared):
        after = shared + width
        second = np.where(after < ends[shared], rank[np.minimum(after, n)].astype(np.int64) + 1, 0)
        both = rank[shared].astype(np.int64) << 32 | second
        by = np.argsort(both, kind="stable")
        both, at = both[by], shared[by]
        new = np.ones(len(at), bool)
        new[1:] = both[1:] != both[:-1]
        group = both >> 32
        head = np.ones(len(at), bool)
        head[1:] = group[1:] != group[:-1]
        heads, first = np.flatnonzero(head), np.flatnonzero(new)
        size = np.diff(np.append(first, len(at)))
        offset = first - heads[np.searchsorted(heads, first, "right") - 1]
        rank = rank.copy()
        rank[at] = np.repeat(group[first] + offset, size)
        levels.append(rank)
        width *= 2
        shared = at[np.repeat(size > 1, size)]
        if width <= least:
            base = shared
    return levels, base[np.argsort(rank[base], kind="stable")]


def common_prefixes(levels: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the next of ``at``, from the ranks of the doubling steps."""
    i, j = at[:-1].copy(), at[1:].copy()
    total = np.zeros(len(i), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][i] == levels[k][j]
        step = same.astype(np.int64) << k
        i += step
        j += step
        total += step
    return total


def maximal_pairs(at: list[int], lcp: list[int], left: list[int], ratio: int) -> Iterator[tuple[int, int, int]]:
    """(start, distance, common words) of the maximal pairs of suffixes ``at`` whose distance is at most a ``ratio``-th of what they share.

    ``at`` is in suffix order, ``lcp[k]`` belongs to ``at[k]`` and ``at[k + 1]``, ``left[k]`` tells the word before ``at[k]``.
    A walk of the LCP intervals from below: each node has its positions in order, all and by left word; the smaller of two
    sets is looked up in the larger.  Near occurrences of one prefix lie a period apart, so that all of them but the first
    have the same left word: positions of other left words are met first, or not at all.
    """
    before = dict(zip(at, left, strict=True))
    found: list[tuple[int, int, int]] = []

    def join(a, b, depth):
        small, big = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
        reach, (places, classes) = depth // ratio, big
        for word, mine in small[1].items():
            same = classes.get(word, ())
            for x in mine:
                low, high = bisect_left(places, x - reach), bisect_right(places, x + reach)
                others = high - low
                if others and same:
                    others -= bisect_right(same, x + reach) - bisect_left(same, x - reach)
                while others:
                    y = places[low]
                    if before[y] != word:
                        found.append((min(x, y), abs(x - y), depth))
                        others -= 1
                    low += 1
        for word, mine in small[1].items():
            same = classes.setdefault(word, [])
            for x in mine:
                insort(places, x)
                insort(same, x)
        return big

    open_nodes: list[tuple[int, tuple]] = []
    node = ([at[0]], {left[0]: [at[0]]})
    for k, depth in enumerate([*lcp, -1]):
        while open_nodes and open_nodes[-1][0] >= depth:
            deeper, other = open_nodes.pop()
            node = join(other, node, deeper)
            if deeper == depth:
                break
        if depth >= 0:
            open_nodes.append((depth, node))
            node = ([at[k + 1]], {left[k + 1]: [at[k + 1]]})
    yield from found


def find_runs(keys: np.ndarray, first: np.ndarray, min_length: int = 6, exponent: int = 4) -> dict[int, list[tuple[int, int, int]]]:
    """Runs (start, length, period) by number of the text; ``first[t]`` is where text t's words begin in ``keys``."""
    n = len(keys)
    ratio = exponent - 1
    least = min(max(ratio * d, min_length - d) for d in range(1, min_length + 1))
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    if not n:
        return {}
    levels, at = suffix_ranks(keys, text, first[1:][text], least)
    if len(at) < 2:
        return {}
    lcp = common_prefixes(levels, at)
    word = levels[0]
    left = np.where(at == first[text[at]], -1, word[at - 1])
    # stretches of the suffix order that share enough, and of these the ones with two suffixes near enough to each other
    new = np.ones(len(at), bool)
    new[1:] = lcp < least
    chunk = np.cumsum(new) - 1
    begins = np.flatnonzero(new)
    longest = np.maximum.reduceat(np.append(np.where(lcp < least, 0, lcp), 0), begins)
    by = np.lexsort((at, chunk))
    gap = np.full(len(at), n + 1, np.int64)
    gap[:-1] = np.where(chunk[by][1:] == chunk[by][:-1], np.diff(at[by]), n + 1)
    near = np.flatnonzero(np.minimum.reduceat(gap, begins) * ratio <= longest)
    bounds = np.append(begins, len(at))
    out: dict[int, dict[tuple[int, int], int]] = {}
    for c in near:
        low, high = int(bounds[c]), int(bounds[c + 1])
        t = int(text[at[low]])
        for start, period, same in maximal_pairs(at[low:high].tolist(), lcp[low : high - 1].tolist(), left[low:high].tolist(), ratio):
            if same + period >= min_length:
                key, mine = (start - int(first[t]), same + period), out.setdefault(t, {})
                mine[key] = min(period, mine.get(key, period))  # a multiple of the period gives the same stretch
    return {t: sorted((start, length, period) for (start, length), period in found.items()) for t, found in out.items()}


def detect_runs(documents: DataFrame, min_length: int = 6, exponent: int = 4, arrange: Arrange | None = None, seed: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text: its words joined by one
    space, without what a run says again after its first period.

    ``arrange`` may put other words of the text in each place first; it is given the row's ``seed``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in bt.blocks(batch):
                starts, ends, first = bt.runs(data, offsets, bt.NOT_SPACE)
                keys = bt.hash_words(data, starts, ends)
                raw, moved = data.tobytes(), {}
                if arrange is not None:
                    for t, h in enumerate(part.column(1).to_pylist()):
                        low, high = int(first[t]), int(first[t + 1])
                        if h is not None and high > low and (places := arrange(h, high - low)) is not None:
                            moved[t] = places
                            keys[low:high] = keys[low:high][places]
                runs = find_runs(keys, first, min_length, exponent)
                collapsed = []
                for t in range(part.num_rows):
                    words = raw[offsets[t] : offsets[t + 1]].split()
                    if t in moved:
                        words = [words[k] for k in moved[t]]
                    if t in runs:
                        steps = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in runs[t]:
                            steps[start + period] += 1
                            steps[start + length] -= 1
                        words = compress(words, (np.cumsum(steps[:-1]) == 0).tolist())
                    collapsed.append(b" ".join(words))
                found = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs.get(t, ())] for t in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first).astype(np.int64)), pa.array(found, pa.list_(RUN)), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
                )

    rows = documents.select(F.col(doc_id).alias("doc_id"), (seed if seed is not None else F.lit(None)).cast("long").alias("seed"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FOUND}")
