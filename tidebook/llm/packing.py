"""Best-fit packing by minimum bin slack.

Documents become token ids (byte-level BPE, then the end id); a longer one than a sequence is cut into pieces, the first of
which takes the remainder.  What has to be packed is then a histogram of at most ``capacity`` lengths, whatever the number of
documents: for each bin a bitset subset-sum dynamic programme over the lengths still there finds the fullest bin that holds
the longest of them, and that combination is taken as often as the counts allow.  A full piece is a sequence of its own.  The
others get their rank among those of their length from windows over salts of at most about ``RANKED`` pieces, so no length
gathers in one task, plus what the salts before hold; a rank finds its bin and place in the list of combinations by binary search.

The string of an added token of the tokenizer becomes that token's id, as in ``tokenizers``.  A null or empty text is the end
id alone; repeated rows are pieces of their own; an empty table gives no pieces; extra columns are not read.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.shared import staged

END_ID = 2
RANKED = 2_000  # pieces that one window ranks
_CACHED = 500_000
_RUN = re.compile(r"\s\s")
PIECES = "piece int, start long, length int, ids_crc32 long"


class _Ids(dict):
    """Packed ids of a stretch of text that begins at a single space; remembers the first so many.

    A mark after a letter, and a line end between visible characters, are tokens of their own, so such a stretch is put
    together from shorter ones.
    """

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.marks = {mark: encode(mark) for mark in ",.;"}
        self.line = encode("\n")

    def __missing__(self, part: str) -> bytes:
        mark = self.marks.get(part[-1:])
        if mark is not None and part[-2:-1].isalpha():
            out = self[part[:-1]] + mark
            if len(self) < _CACHED:
                self[part] = out
            return out
        head, line, tail = part.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            return self[head] + self.line + self.encode(tail)
        out = self.encode(" " + part)
        if len(self) < _CACHED and len(part) < 32:
            self[part] = out
        return out


class Encoder:
    """Ids of whole texts, as little-endian unsigned 32-bit integers.

    A single space between two other visible characters always begins a token of the pre-tokenizer's pattern, so such a text
    is encoded in stretches, which repeat often; any other text is encoded at once.  The strings of ``added`` tokens are cut
    out first and become their ids; the parts between are texts of their own.
    """

    def __init__(self, vocabulary: str, pattern: str, added: tuple[tuple[str, int], ...] = ()):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = self.bpe._core_bpe.encode_ordinary if hasattr(self.bpe, "_core_bpe") else self.bpe.encode_ordinary
        self.known = _Ids(self.whole)
        self.added = {token: pack_ids("<I", n) for token, n in added}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def whole(self, text: str) -> bytes:
        return pack_ids("<%dI" % len(ids := self.encode(text)), *ids)

    def __call__(self, text: str) -> bytes:
        if self.cuts is None or not any(token in text for token in self.added):
            return self.plain(text)
        return b"".join(self.added.get(part) or self.plain(part) for part in self.cuts.split(text))

    def plain(self, text: str) -> bytes:
        if not text:
            return b""
        if _RUN.search(text) or text[0].isspace() or text[-1].isspace():
            return self._lines(text)
        head, *rest = text.split(" ")
        return self.whole(head) + b"".join(map(self.known.__getitem__, rest))

    def _lines(self, text: str) -> bytes:
        """Cut only at single spaces whose neighbours are visible."""
        parts = re.split(r"(?<=\S) (?=\S)", text)
        return self.whole(parts[0]) + b"".join(map(self.known.__getitem__, parts[1:]))


Added = tuple[tuple[str, int], ...]
_ENCODERS: dict[tuple[str, str, Added], Encoder] = {}


def tokenizer_vocabulary(name: str = "byte_bpe_50k") -> tuple[str, str, Added]:
    """Place of the vocabulary, as ranks, of the public tokenizer ``name``.json, its pattern and its added tokens."""
    import public_tokenizers

    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        tokens = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
        raise ValueError(f"{name}: added tokens that depend on their neighbours")
    return public_tokenizers.path(f"{name}.tiktoken"), public_tokenizers.PATTERN, tuple((t["content"], t["id"]) for t in tokens)


def cut(documents: DataFrame, capacity: int, vocabulary: str, pattern: str, added: Added = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece; ``row`` tells repeated documents apart."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (vocabulary, pattern, added)
        encoder = _ENCODERS.get(key) or _ENCODERS.setdefault(key, Encoder(*key))
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                out: list[list] = [[], [], [], [], []]
                for at, t in enumerate(part.column(2).to_pylist()):
                    ids = encoder(t or "") + end
                    n = len(ids) // 4
                    start, length = 0, n % capacity or capacity
                    for piece in range(-(-n // capacity)):
                        values = (at, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]))
                        for column, v in zip(out, values, strict=True):
                            column.append(v)
                        start, length = start + length, capacity
                rows_at = pa.array(out[0], pa.int64())
                pieces = [pa.array(c, k) for c, k in zip(out[1:], (pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows_at), part.column(1).take(rows_at), *pieces], ["row", "doc_id", "piece", "start", "length", "ids_crc32"])

    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(encode, f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}")


def fullest(left: dict[int, int], capacity: int) -> list[int]:
    """Lengths of the fullest bin that holds the longest length left: bitset subset sums, shortest lengths first."""
    seed = max(left)
    room = capacity - seed
    reach, stages = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted(left):
        if length > room:
            break
        many = min(left[length] - (length == seed), room // length)
        step = 1
        while many > 0:  # binary multiples of one length
            take = min(step, many)
            stages.append((length, take, reach))
            reach |= (reach << length * take) & mask
            many, step = many - take, step * 2
    total, chosen = reach.bit_length() - 1, [seed]
    for length, take, before in reversed(stages):
        if length * take <= total and before >> (total - length * take) & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def fill(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """(times, lengths) of the bins, by minimum bin slack on counts of lengths."""
    left = {k: v for k, v in histogram.items() if v}
    out = []
    while left:
        chosen = fullest(left, capacity)
        need = {k: chosen.count(k) for k in set(chosen)}
        times = min(left[k] // n for k, n in need.items())
        out.append((times, chosen))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def places(bins: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks of a length from one row's first rank on lie in
    consecutive sequences at the row's offset."""
    rows, rank, sequence = [], {}, 0
    for times, lengths in bins:
        offset = 0
        for length in lengths:
            r = rank.get(length, 0)
            rows.append((length, r, sequence, offset))
            rank[length], offset = r + times, offset + length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(documents: DataFrame, capacity: int = 1024, vocabulary: str | None = None, pattern: str | None = None, added: Added = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = documents.sparkSession
    if vocabulary is None:
        vocabulary, pattern, added = tokenizer_vocabulary()
    pieces = staged(cut(documents, capacity, vocabulary, pattern, added, doc_id, text), "pieces")
    lengths = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    # a full piece is a sequence of its own and needs no rank
    full, part = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    bins = fill({k: n for k, n in lengths.items() if k < capacity}, capacity)
    table = spark.sparkContext.broadcast(places(bins))  # a few rows for each length, whatever the number of pieces
    first_full = sum(times for times, _ in bins)
    alone = full.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.monotonically_increasing_id() + first_full).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # ranks among the pieces of a length: a window over each salt of it, and what the salts before hold
    salts = spark.createDataFrame([(k, -(-n // RANKED)) for k, n in lengths.items()] or [(0, 1)], "length int, salts int")
    part = part.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("row", "piece"), "salts").cast("int"))
    counts = part.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = staged(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "lengths")
    order = Window.partitionBy("length", "salt").orderBy("row", "piece")
    ranked = part.withColumn("own", F.row_number().over(order) - 1).join(counts.select("length", "salt", "before"), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("own")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        wide = np.int64(1 << 50)
        keys = rows[:, 0] * wide + rows[:, 1] if len(rows) else np.zeros(0, np.int64)
        for batch in batches:
            length, rank = batch.column(3).to_numpy().astype(np.int64), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            found = rows[at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(length), batch.column(4), pa.array(found[:, 2] + rank - found[:, 1]), pa.array(found[:, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = documents.schema[doc_id].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").unionByName(alone)
