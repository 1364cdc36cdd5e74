"""Secrets: patterns propose candidates, the whole corpus tells copied examples from live-looking credentials.

Each candidate's value is hashed; over the corpus a value is counted by distinct repositories and distinct owners.  A value
held by at least ``example_owners`` owners and in at least ``example_repos`` repositories is an example that people copy.
Any other is live-looking: one owner's, in however many repositories, or a single copy that a second owner holds (a fork or
a leak is no example yet).  Base kinds (assign, access, hex) are reported whatever the verdict; the method adds three kinds
of its own.  A private key is one candidate from its BEGIN to its END line.

The count of a value that a third of all rows hold is pre-aggregated before it is shuffled.  The verdict meets the candidates
by an equi-join on the hash whose other side has one row a value, so the side of a hot value is one that Spark splits (AQE);
only rows with candidates take part, the others pass as they are.  A null text has no spans; a null repository or owner
counts as one unnamed one; repeated rows are scanned alike; columns that are not kept are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.shared import staged

# Fixed values of the contract: base kinds in their order, and their patterns.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("pem", "jwt", "prefixed")
KINDS = BASE_KINDS + ADDED_KINDS
_ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_WORDS = ("pass", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_PEM = re.compile(r"-----(BEGIN|END) [A-Z ]{0,40}PRIVATE KEY-----")
_BREAK = r"(?:\s|\\[nr])"  # white space, and line ends that are written out
_PEM_HEADERS = re.compile(_BREAK + r"*+(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+" + _BREAK + r"*+)*+")
_PEM_LINES = re.compile(r"(?:" + _BREAK + r"*+(?:[A-Za-z0-9+/]{40,}+={0,2}|[A-Za-z0-9+/]++={0,2}(?=[\x20\t]*(?:[\r\n\\\"']|\Z))))*+")
_BREAKS = re.compile(_BREAK)
_JWT = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:ghp_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{20,})")


def private_keys(text: str) -> Iterator[tuple[str, int, int, str]]:
    """Each key from its BEGIN line to its END line, or to the end of its base64 lines where END is missing.  The value is the
    whole body without white space; a BEGIN line without a body is its own value."""
    marks = list(_PEM.finditer(text))
    for m, after in zip(marks, [*marks[1:], None], strict=True):
        if m[1] == "BEGIN":
            if after is not None and after[1] == "END":
                stop, end = after.start(), after.end()
            else:
                head = _PEM_HEADERS.match(text, m.end()).end()
                stop = end = _PEM_LINES.match(text, head).end()
                if end == head:
                    stop = end = m.end()
            yield "pem", m.start(), end, _BREAKS.sub("", text[m.end() : stop]) or m[0]


def find_candidates(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind as listed."""
    out: list[tuple[str, int, int, str]] = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", *m.span(), m[0]) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += private_keys(text)
    if "eyJ" in text:
        out += [("jwt", *m.span(), m[0]) for m in _JWT.finditer(text)]
    if "ghp_" in text or "sk_live_" in text or "xox" in text:
        out += [("prefixed", *m.span(), m[0]) for m in _PREFIXED.finditer(text)]
    out.sort(key=lambda c: (c[1], KINDS.index(c[0])))
    return out


FOUND = "array<struct<kind:string,start:long,end:long,value:string>>"
SPAN = "struct<kind:string,start:long,end:long,value:string,repos:long,owners:long,live:boolean>"


def candidates(documents: DataFrame, repo: Column, owner: Column, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns of each row, _repo, _owner and its candidates, _spans; ``value`` is a hash, never the secret."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = documents.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], name(repo).alias("repo"), name(owner).alias("owner"), F.col(text).alias("text"))
    inside = keep.index(text) if text in keep else None  # the text crosses to Python once
    if inside is not None:
        rows = rows.drop("text").withColumnRenamed(f"k{inside}", "text").select(*[f"k{i}" if i != inside else "text" for i in range(len(keep))], "repo", "owner")
    at = inside if inside is not None else len(keep) + 2

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                spans = [
                    [{"kind": k, "start": s, "end": e, "value": hashlib.sha256(v.encode()).hexdigest()} for k, s, e, v in find_candidates(t)] if t else []
                    for t in part.column(at).to_pylist()
                ]
                names = [f"k{i}" for i in range(len(keep))] + ["repo", "owner", "spans"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep) + 2)), pa.array(spans, kind)], names)

    kept = ", ".join(f"k{i} {documents.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    found = rows.mapInArrow(scan, f"{kept}, repo string, owner string, spans {FOUND}")
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("repo").alias("_repo"), F.col("owner").alias("_owner"), F.col("spans").alias("_spans"))


def ownership(found: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """value, repos, owners, live: over the whole corpus."""
    held = found.select(F.explode("_spans.value").alias("value"), "_repo", "_owner").groupBy("value", "_repo", "_owner").agg(F.lit(1).alias("one"))
    repos = held.groupBy("value", "_repo").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("repos"))
    owners = held.groupBy("value", "_owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("*").alias("owners"))
    return repos.join(owners, "value").withColumn("live", ~((F.col("owners") >= example_owners) & (F.col("repos") >= example_repos)))


def scan_secrets(documents: DataFrame, repo: Column, owner: Column, keep: list[str] | None = None, text: str = "text", example_owners: int = 2, example_repos: int = 3, out: str = "spans") -> DataFrame:
    """Each row's kept columns (doc_id by default) and its spans, each with its value's repositories, owners and whether it
    looks live."""
    keep = ["doc_id"] if keep is None else keep
    found = staged(candidates(documents, repo, owner, keep, text).withColumn("_row", F.monotonically_increasing_id()), "secrets")
    some = found.where(F.size("_spans") > 0)
    flat = some.select("_row", F.posexplode("_spans").alias("pos", "s"))
    known = flat.withColumn("value", F.col("s.value")).join(ownership(some, example_owners, example_repos), "value")
    span = F.struct("s.kind", "s.start", "s.end", "value", "repos", "owners", "live")
    spans = known.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("pos", span.alias("span")))).alias("all"))
    spans = spans.select("_row", F.transform("all", lambda x: x["span"]).alias("_judged"))
    with_spans = some.join(spans, "_row").select(*keep, F.col("_judged").alias(out))
    without = found.where(F.size("_spans") == 0).select(*keep, F.from_json(F.lit("[]"), f"array<{SPAN}>").alias(out))
    return with_spans.unionByName(without)
