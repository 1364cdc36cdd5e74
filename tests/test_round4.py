"""What the findings of round 4 were about: each test failed before."""

import glob
import random
import time

from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_planning_by_key_equals_the_history_plan(spark):
    from tidebook.operators.planner import plan_history, plan_keys

    rng = random.Random(4)
    events = [("t", f"k{rng.randrange(5)}", f"e{n}", rng.choice("cuud"), 1000 + n, 1_790_000_000_000 + n) for n in range(80)]
    rows = events + [rng.choice(events) for _ in range(40)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "t", 0, i, i // 7) for i, r in enumerate(rows)], "source_table string, primary_key string, event_id string, op string, source_lsn long, source_ts_ms long, kafka_topic string, kafka_partition int, kafka_offset long, batch_id long")

    def found(planned):
        before = F.when(F.col("apply_outcome") != "duplicate", F.col("previous_lsn"))
        return sorted(map(tuple, planned.select("kafka_offset", "apply_outcome", before).collect()))

    got = found(plan_keys(df))
    assert got == found(plan_history(df)) and {r[1] for r in got} == {"duplicate", "stale", "superseded", "applied"}


def test_checks_plan_and_fold_without_shuffling_events(spark):
    """The history was planned three times, each with six shuffles of events."""
    from tidebook.plans import catalog

    planned, _ = catalog._kept_by_key(spark, SMALL)
    orders, *_ = catalog._shop_tables(spark, SMALL, planned)
    plan = orders._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(o_orderkey" in plan


def _shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    return {b for k in range(blocks.size()) if (b := blocks.apply(k).toString()).startswith("shuffle_")}


def _left_behind(spark, query):
    """Shuffle files and staged tables that lie on disk after a query but did not before."""
    from tidebook.sources import staging

    there = lambda: _shuffle_files(spark) | set(glob.glob(f"{staging.session_dir(spark)}/*"))
    before = there()
    query(spark, SMALL).collect()
    for _ in range(50):  # files go in the background
        if not there() - before:
            break
        time.sleep(0.1)
    return there() - before


def test_checks_leave_nothing_on_disk(spark):
    from tidebook.plans import catalog

    assert not _left_behind(spark, catalog.q_checks)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_the_verdict_leaves_nothing_on_disk(spark):
    from tidebook.plans import catalog

    assert not _left_behind(spark, catalog.q11_verdict)
