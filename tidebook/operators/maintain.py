"""Maintenance of a lake: compaction of small files with a proof of unchanged content, reclaiming, and orphans."""

from __future__ import annotations

import dataclasses
import datetime as dt
import re
import time
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidebook.operators.batchlog import fingerprint
from tidebook.sources.commits import DataFile, Snapshot
from tidebook.sources.lake import BRONZE_SCHEMA, Lake

EVIDENCE_SCHEMA = "table_name string, status string, started_at timestamp, finished_at timestamp, files_before long, bytes_before long, files_after long, bytes_after long, version_before long, version_after long, fingerprint_match boolean"
RUN_SCHEMA = "run_id string, table_name string, status string, tasks string, finished_at timestamp, files_before long, files_after long, bytes_before long, bytes_after long, orphan_files long, reclaimed_files long, fingerprint_match boolean"
CUTS = 256  # a day is cut into files at multiples of this share of its rows
TASKS = ("compact", "retention", "orphans")
_SIZE = {"B": 1, "kB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30}
_TIME = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def parse_size(text: str) -> int:
    m = re.fullmatch(r"(\d+)(B|kB|MB|GB)", text)
    if not m:
        raise ValueError(f"not a size: {text}")
    return int(m[1]) * _SIZE[m[2]]


def parse_duration(text: str) -> int:
    m = re.fullmatch(r"(\d+)(s|m|h|d)", text)
    if not m:
        raise ValueError(f"not a duration: {text}")
    return int(m[1]) * _TIME[m[2]]


def _identity(rows: DataFrame) -> DataFrame:
    return fingerprint(rows, *[F.col(c) for c in ("event_id", "primary_key", "source_lsn", "op", "apply_outcome", "before_json", "after_json", "stream_epoch", "batch_id", "attempt_id")])


def small_files(lake: Lake, target: int, now: Snapshot) -> dict[str, list[DataFile]]:
    """By day, the bronze files under half the target that fit into fewer ones."""
    days: dict[str, list[DataFile]] = {}
    for f in now.table("bronze"):
        if f.bytes < target // 2:
            days.setdefault(f.day, []).append(f)
    return {day: files for day, files in days.items() if -(-sum(f.bytes for f in files) // target) < len(files)}


def compact(lake: Lake, target: str = "64MB") -> dict:
    """Pack each day's small bronze files into files of about the target size, cut at positions; other files aren't read.

    What is read is fixed by one snapshot, and the new files take the places of exactly those, once their rows are proved to
    be the same.  A batch that is committed meanwhile stays as it is; one that runs again and takes files away ends the
    compaction with a ``Conflict``."""
    now, size = lake.snapshot(), parse_size(target)
    days = small_files(lake, size, now)
    old = [f for files in days.values() for f in files]
    if not old:
        return {"files_read": 0, "files_written": 0, "fingerprint_match": None, "version": now.version}
    rows, run = lake.bronze(now, old), uuid.uuid4().hex
    # a day's files are cut at as many positions as its bytes ask for; a bin is one file, whichever task writes it
    wanted = lake.spark.createDataFrame([(day, -(-sum(f.bytes for f in files) // size)) for day, files in days.items()], "day string, n long")
    cuts = rows.groupBy(F.col("source_date").cast("string").alias("day")).agg(F.percentile_approx("source_lsn", [k / CUTS for k in range(1, CUTS)], 10_000).alias("q"))
    every = F.sequence(F.lit(1), F.col("n") - 1)
    inner = F.when(F.col("n") > 1, F.transform(every, lambda k: F.element_at("q", F.greatest(F.lit(1), (k * CUTS / F.col("n")).cast("int"))))).otherwise(F.array().cast("array<long>"))
    cuts = cuts.join(wanted, "day").select(F.to_date("day").alias("source_date"), inner.alias("cuts"))
    binned = rows.join(F.broadcast(cuts), "source_date").withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("source_lsn")))).drop("cuts")  # a row a day
    folder = f"packed/run={run}"
    binned.repartition("source_date", "bin").sortWithinPartitions("source_date", "bin", "source_lsn").write.partitionBy("source_date", "bin").parquet(f"{lake.root}/{folder}")
    new = lake.written_files("bronze", f"{folder}/source_date=*/bin=*")
    at = F.regexp_extract(F.input_file_name(), r"/(packed/.*)$", 1)
    bounds = {r.path: (r.low, r.high) for r in lake.read_files(new, BRONZE_SCHEMA, "packed").groupBy(at.alias("path")).agg(F.min("source_lsn").alias("low"), F.max("source_lsn").alias("high")).collect()}  # a row a new file
    new = [dataclasses.replace(f, low=bounds[f.path][0], high=bounds[f.path][1]) for f in new]
    same = _identity(rows).first() == _identity(lake.read_files(new, BRONZE_SCHEMA, "packed")).first()
    if same:
        gone = {f.path for f in old}
        stands = lambda other, then: gone <= set(then.files) and not other.get("dead")
        now = lake.commits.commit(now, "compact", stands, lambda _: {"add": [vars(f) for f in new], "remove": sorted(gone), "note": {"run": run, "fingerprint": list(_identity(rows).first())}})
    return {"files_read": len(old), "files_written": len(new) if same else 0, "fingerprint_match": same, "version": now.version}


def expired_files(lake: Lake, older_than: str, as_of: float | None = None) -> list[str]:
    """Files that no snapshot since the cut-off references: commits took them away before it."""
    cut = (as_of if as_of is not None else time.time()) - parse_duration(older_than)
    return sorted(path for path, at in lake.snapshot().removed.items() if at < cut)


def orphan_files(lake: Lake, older_than: str, as_of) -> DataFrame:
    """Data files that no kept snapshot references, neither the newest nor one before the removal of what is still kept, and
    that are older than the retention: what crashed or lost writers left behind.  Listed, not deleted."""
    now = lake.snapshot()
    path = F.regexp_extract("path", r"/((?:bronze|rejects|state|packed|history)/.*)$", 1)
    cut = as_of - F.make_dt_interval(secs=F.lit(parse_duration(older_than)))
    known = lake.spark.createDataFrame([(p,) for p in [*now.files, *now.removed]], "at string")
    segments = [f"{s}/" for s in now.segments]
    files = lake.files().withColumn("at", path).where((F.col("at") != "") & (F.col("modified") < cut))
    part = lambda name: F.regexp_extract("at", rf"/{name}=([^/]+)/", 1)
    if segments:
        files = files.where(~F.col("at").rlike("^(" + "|".join(segments) + ")"))
    found = files.join(known, "at", "left_anti")
    return found.select("path", "length", part("stream_epoch").alias("stream_epoch"), part("batch_id").try_cast("long").alias("batch_id"), part("attempt(?:_id)?").alias("attempt_id"))


def delete_files(files: DataFrame) -> int:
    """Delete the files of column ``path``, in tasks; the number of files that were there."""

    def delete(batches):
        for batch in batches:
            gone = 0
            for path in batch.column(0).to_pylist():
                system, place = pa.fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))
                if system.get_file_info(place).type != pa.fs.FileType.NotFound:
                    system.delete_file(place)
                    gone += 1
            yield pa.RecordBatch.from_pydict({"gone": pa.array([gone], pa.int64())})

    return files.select("path").mapInArrow(delete, "gone long").agg(F.coalesce(F.sum("gone"), F.lit(0))).first()[0]


def reclaim(lake: Lake, older_than: str, as_of: float | None = None) -> int:
    """Delete the files that expired, then say so in a commit, then forget the commits before; a reader of a snapshot since
    the cut-off loses nothing.  A run that dies in between is made good by the next one."""
    paths = expired_files(lake, older_than, as_of)
    gone = 0
    if paths:
        gone = delete_files(lake.spark.createDataFrame([(f"{lake.root}/{p}",) for p in paths], "path string").repartition(max(1, len(paths) // 1000)))
        lake.commits.commit(lake.snapshot(), "reclaim", lambda other, now: True, lambda _: {"reclaimed": paths})
    lake.commits.forget((as_of if as_of is not None else time.time()) - parse_duration(older_than))
    return gone


def maintain(lake: Lake, tasks: tuple[str, ...] = TASKS, target: str = "64MB", keep: str = "7d", delete: bool = False) -> DataFrame:
    """Run tasks and append their evidence (a row a run, and a row a table in ``maintenance_tables``); a lake without rows is skipped, an unknown task is an error."""
    unknown = set(tasks) - set(TASKS)
    if unknown:
        raise ValueError(f"unknown tasks: {sorted(unknown)}")
    parse_size(target), parse_duration(keep)
    tables = lambda: {r.kind: r for r in lake.file_statistics().collect()}  # a row a table
    started, first = dt.datetime.now(dt.timezone.utc), lake.snapshot()
    before, status, match, found, reclaimed = tables(), "succeeded", None, 0, 0
    if not first.files:
        status = "skipped"
    else:
        if "compact" in tasks:
            match = compact(lake, target)["fingerprint_match"]
            status = "failed" if match is False else status
        if "retention" in tasks and status == "succeeded" and delete:
            reclaimed = reclaim(lake, keep)
        if "orphans" in tasks and status == "succeeded":
            orphans = orphan_files(lake, keep, F.current_timestamp())
            found = orphans.count()
            if delete and found:
                delete_files(orphans)
    after, last, finished, none = tables(), lake.snapshot(), dt.datetime.now(dt.timezone.utc), Row(files=0, bytes=0)
    total = lambda t, c: sum(int(getattr(r, c)) for r in t.values())
    run = (uuid.uuid4().hex, lake.pipeline, status, ",".join(tasks), finished, *(total(t, c) for c in ("files", "bytes") for t in (before, after)), found, reclaimed, match)
    row = lake.spark.createDataFrame([run], RUN_SCHEMA)
    lake.append("maintenance", row)
    evidence = [
        (kind, status, started, finished, *(int(getattr(t.get(kind, none), c)) for t in (before, after) for c in ("files", "bytes")), first.version, last.version, match if kind == "bronze" else None)
        for kind in ("bronze", "rejects", "state")
    ]
    lake.append("maintenance_tables", lake.spark.createDataFrame(evidence, EVIDENCE_SCHEMA))
    return row
