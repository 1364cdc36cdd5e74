"""Operators 11 to 13 against their twins, plain versions and awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidebook.llm import periodic_runs, prefix_trie, queries, substring_dedup

from test_llm import AWKWARD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_prefix_trie", "op13_substring_dedup"])
def test_query_equals_twin(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.queries()[name](spark, small)
    result = con.sql(queries.oracle_sql()[name])
    assert df.columns == result.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(result.fetchall(), key=str)


# ---- 11: runs ---------------------------------------------------------------------------------------------------------


def plain_runs(words, least=6, exponent=4):
    """Every period's maximal stretches of words that equal those a period on."""
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e > s and e - s + q >= max(least, exponent * q):
                found.setdefault((s, e - s + q), q)
            s = max(e, s) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=5), st.integers(1, 9)), max_size=5), min_size=1, max_size=4), st.sampled_from([(6, 4), (4, 2), (5, 3), (1, 4)]))
def test_runs_of_repeated_pieces(texts, limits):
    rows = [[w for piece, times in text for w in piece * times] for text in texts]
    first = np.cumsum([0, *map(len, rows)])
    keys = np.array([w for r in rows for w in r], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    got = periodic_runs.find_runs(keys, first, *limits)
    assert [got.get(t, []) for t in range(len(rows))] == [plain_runs(r, *limits) for r in rows]


def test_runs_stay_linear_on_one_word():
    """A text of one word has one run; its suffixes all share prefixes, its pairs must not be all looked at."""
    n = 200_000
    got = periodic_runs.find_runs(np.full(n, 7, np.uint64), np.array([0, n]))
    assert got == {0: [(0, n, 1)]}


def test_op11_cycles(spark):
    """Words moved by the contract's rule, texts whose crc32 says so and others."""
    rng = np.random.default_rng(3)
    texts = {i: " \n".join(f"w{x}" for x in rng.integers(0, 40, int(rng.integers(0, 400)))) for i in range(300)}
    rows = periodic_runs.detect_runs(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5), 6, 4, queries.cycled, F.crc32(F.col("doc_id").cast("string")))
    n_cycled = 0
    for r in rows.collect():
        words, h = WORD.findall(texts[r.doc_id]), zlib.crc32(str(r.doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            n_cycled += 1
        want = plain_runs(words)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (n, want, collapsed(words, want))
    assert n_cycled > 10


# ---- 13: repeated windows ---------------------------------------------------------------------------------------------


def plain_repeats(rows, window):
    """{row: (n_words, n_removed, kept)} of rows (doc_id, text) in the order of their ids."""
    seen, out = set(), []
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        out.append((doc_id, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


@pytest.mark.parametrize("unit_bytes", [200, 5_000, 1 << 20])
def test_repeats_across_units(spark, unit_bytes):
    """Shared passages, copies, texts that repeat themselves; units smaller than a text and larger than all."""
    rng = np.random.default_rng(unit_bytes)
    passages = [[f"p{k}x{j}" for j in range(30)] for k in range(6)]
    rows = []
    for i in range(150):
        words = [f"w{x}" for x in rng.integers(0, 30, int(rng.integers(0, 60)))]
        for k in rng.integers(0, 6, int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = passages[k][int(rng.integers(0, 8)) :]
        rows.append((int(i * 7 % 150), "\t".join(words) if i % 9 else (rows[-1][1] if rows else "")))
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 8, unit_bytes).collect()
    assert sorted(map(tuple, got)) == sorted(plain_repeats(sorted(rows), 8))
    assert sum(r.n_removed for r in got) > 1000


def test_a_window_that_all_texts_share(spark):
    """The words of a passage in every text stay once; a unit sends it once, so its bucket gets a row a unit."""
    passage = " ".join(f"s{k}" for k in range(25))
    texts = spark.range(0, 3000, 1, 6).select(F.col("id").alias("doc_id"), F.concat(F.lit("own"), F.col("id"), F.lit(f" {passage} end"), F.col("id")).alias("text"))
    units = substring_dedup.into_units(texts, 20, 1 << 20)
    assert substring_dedup.send_windows(units, 20, 1).agg(F.sum(F.length("hashes"))).first()[0] <= 8 * (3000 * 2 + 6 * 6)
    got = substring_dedup.remove_repeats(texts, 20).groupBy("n_removed").count().collect()
    assert {(r.n_removed, r["count"]) for r in got} == {(0, 1), (25, 2999)}


# ---- 12: the trie -----------------------------------------------------------------------------------------------------


def plain_trie(conversations):
    """Rows of nodes of {conv_id: [(role, text)]}."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for v in members:
        if v:
            kids[v[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for v, m in members.items():
        own = (len(m) - 1) * len(WORD.findall(v[-1][1])) if v else 0
        for d in range(len(v) + 1):
            leaves[v[:d]] += v not in kids
            saved[v[:d]] += own
    return sorted((min(m), len(v), min(members[v[:-1]]) if v else -1, len(m), kids[v] if v in kids else 0, leaves[v], saved[v], sha(",".join(map(str, sorted(ends[v]))) if v in ends else "")) for v, m in members.items())


def as_rows(nodes):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect())


def turns_table(spark, conversations):
    rows = [(c, k, role, text) for c, turns in conversations.items() for k, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_trie_over_ranges(spark, ranges):
    """Common openings, equal conversations, ones that end inside others; more ranges than some nodes have members."""
    rng = np.random.default_rng(ranges)
    conversations = {}
    for c in range(300):
        n = int(rng.integers(1, 7))
        turns = [("user" if k % 2 == 0 else "assistant", f"say {x} now") for k, x in enumerate(rng.integers(0, 3, n))]
        conversations[c * 3 - 90] = [("system", "you are")] * int(c % 3 == 0) + (turns if c % 4 else [("user", "the same"), ("assistant", "to all of them")])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = as_rows(prefix_trie.prefix_trie(prefix_trie.conversation_turns(turns_table(spark, conversations))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_trie(conversations)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=5), min_size=1, max_size=25))
def test_forest_of_one_range(paths):
    """Final nodes alone: a range between two others that share nothing with it."""
    convs = sorted((b"\x01" * 16 + b"".join(bytes([x + 1]) * 16 for x in p), k) for k, p in enumerate(paths))
    ends = [(b"\x00" * 16, -1), *convs, (b"\xff" * 16, len(paths))]
    forest = prefix_trie.Forest([p for p, _ in ends], [[len(p) % 7 + 1] * (len(p) // 16) for p, _ in ends], [i for _, i in ends])
    got = sorted((r[2], r[3], r[5], r[6], r[7]) for r in forest.rows(0) if r[0] == prefix_trie.FINAL)
    text = {k: [("r", "a b")] + [("r", str(x)) for x in p] for k, p in enumerate(paths)}
    assert got == sorted((c, d, n, kids, leaves) for c, d, _, n, kids, leaves, _, _ in plain_trie(text) if d)


def test_rebuilt(spark):
    rng = np.random.default_rng(1)
    conversations = {c: [("user", f"t{c} {k}" if c % 20 else f"opening {k}") for k in range(int(rng.integers(1, 5)))] for c in range(200) if c not in (40, 43, 60)}
    want = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 4
        want[c] = conversations.get(c - c % 20, [])[:h] + turns[h:]
    assert any(not t for t in want.values())
    assert as_rows(prefix_trie.prefix_trie(queries.rebuilt(turns_table(spark, conversations)))) == plain_trie(want)


# ---- awkward rows -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "clash", "clash", 1, 1, [1]) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, runs string, unit long, windows long, seed array<int>").repartition(3)


def test_awkward_documents(awkward):
    runs = periodic_runs.detect_runs(awkward)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.collapsed, [tuple(x) for x in r.runs]) for r in runs.collect()) == sorted(
        (i is None, i or 0, len(w), collapsed(w, plain_runs(w)), plain_runs(w)) for i, t in AWKWARD for w in [WORD.findall(t or "")]
    )
    kept = substring_dedup.remove_repeats(awkward)
    # texts of one id come in any order: what they keep together is defined
    last = lambda i: (i is None, i or 0)
    want = defaultdict(list)
    for i, n, gone, _ in plain_repeats(sorted(AWKWARD, key=lambda r: last(r[0])), 20):
        want[i].append((n, gone))
    got = defaultdict(list)
    for r in kept.collect():
        got[r.doc_id].append((r.n_words, r.n_removed))
    assert {i: (len(v), sum(n for n, _ in v)) for i, v in got.items()} == {i: (len(v), sum(n for n, _ in v)) for i, v in want.items()}
    assert {i: sorted(v) for i, v in got.items() if len(v) == 1} == {i: sorted(v) for i, v in want.items() if len(v) == 1}


def test_awkward_conversations(spark):
    long = "word " * 50_000
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (2, None, "user", "first"), (2, 5, "user", long), (None, 1, "user", "lost"), (3, -1, "user", "first"), (3, 7, "", "")]
    table = spark.createDataFrame([(*r, "clash", b"clash") for r in rows], "conv_id long, turn long, role string, text string, path string, key binary").repartition(2)
    want = {1: [("user", "first"), ("", ""), ("", "")], 2: [("user", "first"), ("user", long)], 3: [("user", "first"), ("", "")]}
    assert as_rows(prefix_trie.prefix_trie(prefix_trie.conversation_turns(table))) == plain_trie(want)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.detect_runs(none).count() == 0 and substring_dedup.remove_repeats(none).count() == 0
    assert prefix_trie.prefix_trie(prefix_trie.conversation_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
