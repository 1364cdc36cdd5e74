"""URL filters: longest rule first, else a cascade of Bloom filters that gives exact membership in a list of keys.

Level 0 encodes the listed keys; level 1 the keys of the universe that level 0 takes wrongly; level 2 the listed keys that
level 1 takes wrongly, and so on until a level takes none wrongly.  A key of the universe is listed if the first level
that refuses it is an odd one.  Only DataFrame functions are used.

A level's size follows from the number of its own keys.  One of at most ``max_bits`` is an array of longs, read as a scalar
subquery; if all levels are such, urls are judged in one projection without a join.  A larger level is a table of its words:
distinct keys that are still open meet the words of their positions by an equi-join, level by level, so neither a row nor a
task holds more than the words it asks for, however long the list is or however many keys a level takes wrongly.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is not listed; an empty
list blocks nothing; repeated rows are judged alike; only the columns named in ``keep`` are returned beside the results, and
one that is named like a result gets the prefix ``in_``; urls of any length are handled whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.shared import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.text)):
        fits = rule_fits(rule, host, path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


@dataclass
class Level:
    """A filter of ``bits`` bits: ``words`` has a row (word, bits) for each word that isn't zero; ``array`` one row with all
    words, if there are few enough."""

    bits: int
    words: DataFrame
    array: DataFrame | None


@dataclass
class Cascade:
    hashes: int
    levels: list[Level] = field(default_factory=list)

    @property
    def large(self) -> bool:
        return any(x.array is None for x in self.levels)

    def positions(self, level: int, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(self.levels[level].bits)) for j in range(self.hashes)]

    def takes(self, level: int, key: Column) -> Column:
        words, hit = self.levels[level].array.select("words").scalar(), F.lit(True)
        for p in self.positions(level, key):
            hit = hit & (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1)
        return hit

    def taken(self, level: int, keys: DataFrame) -> DataFrame:
        """Of distinct ``keys`` those that the level takes."""
        if self.levels[level].array is not None:
            return keys.where(self.takes(level, F.col("key")))
        asked = keys.select("key", F.explode(F.array(*self.positions(level, F.col("key")))).alias("p")).withColumn("word", F.shiftright("p", 6))
        met = asked.join(self.levels[level].words, "word").where(F.getbit("bits", (F.col("p") % 64).cast("int")) == 1)
        return met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == self.hashes).select("key")

    def listed(self, key: Column) -> Column:
        """True where the first level that refuses the key is odd."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            out = F.when(self.takes(level, key), out).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(key.isNotNull() & out, F.lit(False))

    def mark(self, df: DataFrame, key: str, out: str) -> DataFrame:
        """Add the column ``out``: is the key listed?  Keys outside the universe may be taken wrongly."""
        if not self.large:
            return df.withColumn(out, self.listed(F.col(key)) if self.levels else F.lit(False))
        open_ = staged(df.select(F.col(key).alias("key")).where("key is not null").distinct(), "open-keys")
        found: list[DataFrame] = []
        for level in range(len(self.levels)):
            taken = staged(self.taken(level, open_), f"taken{level}")
            if level % 2 == 1:
                found.append(open_.join(taken, "key", "left_anti"))
            open_ = taken
        if len(self.levels) % 2 == 1:
            found.append(open_)
        keys = found[0]
        for more in found[1:]:
            keys = keys.unionByName(more)
        keys = keys.select(F.col("key").alias("_key"), F.lit(True).alias("_on"))
        return df.join(keys, F.col(key) == F.col("_key"), "left").withColumn(out, F.coalesce("_on", F.lit(False))).drop("_key", "_on")


def _encode(cascade: Cascade, keys: DataFrame, n: int, bits_per_key: int, max_bits: int) -> None:
    """Append a level that holds ``keys`` (n of them)."""
    level = len(cascade.levels)
    cascade.levels.append(Level(max(64, 1 << (n * bits_per_key - 1).bit_length()), keys, None))
    bits = cascade.levels[level].bits
    hits = keys.select(F.explode(F.array(*cascade.positions(level, F.col("key")))).alias("p"))
    words = hits.select(F.shiftright("p", 6).alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    words = cascade.levels[level].words = staged(words, f"bloom{level}")
    if bits <= max_bits:
        blank = keys.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
        dense = words.unionByName(blank).groupBy("word").agg(F.bit_or("bits").alias("bits"))
        rows = dense.agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("w"))  # max_bits bits at most
        cascade.levels[level].array = staged(rows.select(F.transform("w", lambda x: x["bits"]).alias("words")), f"bits{level}")


def build_cascade(universe: DataFrame, listed: DataFrame, bits_per_key: int = 10, hashes: int = 4, max_bits: int = 1 << 26, max_levels: int = 40) -> Cascade:
    """Exact over the keys of ``universe`` and ``listed`` (each one column, ``key``; nulls and repeats do not count).

    ``max_bits`` bounds the array of one level (8 MB by default).
    """
    both = universe.select("key", F.lit(0).alias("on")).unionByName(listed.select("key", F.lit(1).alias("on")))
    keys = staged(both.where("key is not null").groupBy("key").agg(F.max("on").alias("on")), "keys")
    inside, outside = keys.where("on = 1").select("key"), keys.where("on = 0").select("key")
    n = inside.count()
    cascade = Cascade(hashes)
    while n:
        if len(cascade.levels) == max_levels:
            raise RuntimeError("the cascade does not close: the keys collide under every hash")
        _encode(cascade, inside, n, bits_per_key, max_bits)
        wrong = staged(cascade.taken(len(cascade.levels) - 1, outside), f"wrong{len(cascade.levels)}")
        inside, outside, n = wrong, inside, wrong.count()
    return cascade


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], url: str = "url", keep: list[str] | None = None, **options) -> DataFrame:
    """Every row of ``pages``: its kept columns (page_id by default), then host, path, rule, listed and verdict; ``listed`` has
    one column ``key`` (host and path)."""
    results = ("host", "path", "rule", "listed", "verdict")
    kept = ["page_id"] if keep is None else keep
    rows = pages.select(*[F.col(c).alias(f"in_{c}" if c in results else c) for c in kept], url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    rows = rows.withColumn("_listed_key", F.when(F.col("host") != "", F.concat("host", "path")))
    cascade = build_cascade(rows.select(F.col("_listed_key").alias("key")), listed, **options)
    rows = cascade.mark(rows, "_listed_key", "listed").drop("_listed_key")
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow"))})
