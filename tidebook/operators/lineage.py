"""Lineage on an edge table: reachability by a frontier of joins, impact, and integrity.

Cycles are legal: a node enters the result once, at its least depth, and the search ends when a step finds no new node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.sources.staging import staged


COMPACT = 8


def edges_of(jobs: DataFrame) -> DataFrame:
    """src, dst: inputs to jobs and jobs to outputs."""
    into = jobs.select(F.explode("inputs").alias("src"), F.col("id").alias("dst"))
    out = jobs.select(F.col("id").alias("src"), F.explode("outputs").alias("dst"))
    return into.unionByName(out).distinct()


def edges_of_uses(uses: DataFrame) -> DataFrame:
    """src, dst: the edges of jobs that are given as rows of a job ``id``, an ``input`` and an ``output``.  Same edges as those
    of the jobs' sets, which are not gathered to be taken apart again."""
    edge = lambda src, dst, of: F.when(F.col(of).isNotNull(), F.struct(F.col(src).alias("src"), F.col(dst).alias("dst")))
    both = F.array(edge("input", "id", "input"), edge("id", "output", "output"))
    return uses.select(F.inline(both)).where("src IS NOT NULL OR dst IS NOT NULL").distinct()  # sets hold no nulls


def downstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id, depth: all nodes that the start nodes (column ``id``) reach, themselves at depth 0."""
    seen = staged(start.select("id").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = frontier.join(edges, frontier["id"] == edges["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = staged(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % COMPACT == 0:  # a long chain's frontiers become one table again
            seen = staged(seen, "reach")


def upstream(edges: DataFrame, start: DataFrame) -> DataFrame:
    return downstream(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start)


def impact(edges: DataFrame, start: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a change of the start nodes touches: by kind of node, how many, the deepest, and the owners to tell.  A start
    node that is in ``nodes`` nowhere is an error."""
    unknown = start.join(nodes, "id", "left_anti").select("id").limit(5).collect()
    if unknown:
        raise ValueError(f"unknown nodes: {', '.join(sorted(str(r.id) for r in unknown))}")
    touched = downstream(edges, start).where("depth > 0").join(nodes, "id")
    return touched.groupBy("kind").agg(F.count("*").alias("affected"), F.max("depth").alias("deepest"), F.array_join(F.array_sort(F.collect_set("owner")), ",").alias("owners"))


def integrity(datasets: DataFrame, jobs: DataFrame) -> DataFrame:
    """Faults: ids given twice, ids that are a dataset and a job, references to datasets that don't exist."""
    twice = datasets.select("id").unionAll(jobs.select("id")).groupBy("id").agg(F.count("*").alias("n"))
    names = datasets.select("id").distinct()
    both = names.join(jobs.select("id").distinct(), "id")
    repeated = twice.where("n > 1").join(both, "id", "left_anti").select("id", F.lit("duplicate").alias("fault"))
    used = jobs.select(F.explode("inputs").alias("id")).unionAll(jobs.select(F.explode("outputs").alias("id"))).distinct()
    dangling = used.join(names, "id", "left_anti").select("id", F.lit("dangling").alias("fault"))
    return repeated.unionByName(both.select("id", F.lit("dataset_and_job").alias("fault"))).unionByName(dangling)
