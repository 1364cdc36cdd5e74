"""The registered queries themselves, on whole small tables, against plain versions of their contracts; and awkward rows."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import class_lm, near_dup, quality_model, quality_rules, queries, toxicity
from tidebook.llm import bytestext as bt

from test_llm import AWKWARD, check_packing, labels_of, lower, plain_components, plain_hits, plain_measures, words

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i, t, "en", "s", len(t or ""), "clash", "clash", True) for i, t in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, spans string, kept boolean").repartition(3)


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def arrays(text):
    data = np.frombuffer((text or "").encode(), np.uint8)
    return data, np.array([0, len(data)])


# ---- 3, 9, 10: whole results ------------------------------------------------------------------------------------------


def test_op3(spark, small, texts):
    want = {i: (n, c, i == c) for i, (n, c) in plain_components(texts, 4, 80).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op3_minhash(spark, small).collect()} == want


def test_op3_finds_pairs_at_the_limit(spark):
    """Recall on planted pairs from 0.8 to 0.9, by a plain count of shared shingles."""
    rng = np.random.default_rng(17)
    texts, linked = {}, []
    for k in range(400):
        a = [f"p{k}w{j}" for j in range(int(rng.integers(40, 160)))]
        b = list(a)
        for j in rng.choice(len(a), max(1, int(len(a) * rng.uniform(0.01, 0.035))), replace=False):
            b[j] = f"q{k}x{j}"
        texts[2 * k], texts[2 * k + 1] = " ".join(a), " ".join(b)
        x, y = ({tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (a, b))
        if 0.8 <= len(x & y) / len(x | y) <= 0.9:
            linked.append(2 * k)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), size=4).collect()}
    assert len(linked) > 100 and sum(got[i + 1] == i for i in linked) == len(linked)


def test_op9(spark, small, texts):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    want = Counter((i, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0) for (i, n, hit, found), c in plain_hits(texts.items(), items).items() for _ in range(c))
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op9_decontamination(spark, small).collect()) == want


def test_op10(spark, small, texts):
    rows = queries.op10_packing(spark, small)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    used, least = check_packing(rows.collect(), texts.items())
    assert used <= 1.01 * least + 1


# ---- 4 and 7: the scores are sparse dot products ----------------------------------------------------------------------


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_logistic(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def plain_toxicity(text, weights):
    chars = [int.from_bytes(c.encode(), "little") for c in lower(text)]
    found = set()
    for n in toxicity.SIZES:
        for k in range(len(chars) - n + 1):
            h = chars[k] * 0x9E3779B97F4A7C15 & MASK
            for c in chars[k + 1 : k + n]:
                h = (h * 0xD6E8FEB86659FD93 + c) & MASK
            found.add(((h ^ h >> 29) * (0xBF58476D1CE4E5B9 + 2 * n) & MASK) >> 64 - toxicity.BITS)
    return plain_logistic(sum(weights[i] for i in found) + weights[-1])


def plain_quality(text, weights):
    """Words and marks by a loop, n-grams of both kinds by their definition."""
    data, parts, k = (text or "").encode(), [], 0
    kind = lambda b: 0 if b in b" \t\x0b\x0c\r" else 2 if 48 <= b < 58 else 1 if b >= 128 or 65 <= b < 91 or 97 <= b < 123 else 3
    while k < len(data):
        end = k + 1
        while kind(data[k]) != 3 and end < len(data) and kind(data[end]) == kind(data[k]):
            end += 1
        if kind(data[k]):
            parts.append(data[k:end])
        k = end
    low, shape = [], []
    for p in parts:
        q = np.frombuffer(bytes(b + 32 if 65 <= b < 91 else b for b in p), np.uint8)
        low.append(int(bt.hash_words(q, np.array([0]), np.array([len(q)]))[0]))
        up, small = any(65 <= b < 91 for b in p), any(97 <= b < 123 for b in p)
        code = p[0] if kind(p[0]) == 3 else 300 if kind(p[0]) == 2 else 301 if up and not small else 302 if up else 303
        shape.append(plain_mix(code + 7))
    counts = Counter()
    for h, sizes, salt in ((low, (1, 2), 1), (shape, (1, 2, 3), 11)):
        for n in sizes:
            for i in range(len(h) - n + 1):
                x = h[i]
                for j in h[i + 1 : i + n]:
                    x = (x * 0x100000001B3 + j) & MASK
                counts[plain_mix((x + salt + n) & MASK) & (1 << quality_model.BITS) - 1] += 1
    norm = math.sqrt(sum(counts.values()))
    return plain_logistic(sum(weights[i] * math.sqrt(c) for i, c in counts.items()) / (norm or 1) + weights[-1])


@pytest.mark.parametrize("query, model, plain, label, m, r, cut", [("op4_quality_model", quality_model, plain_quality, "quality", 5, 0, 0.3), ("op7_toxicity", toxicity, plain_toxicity, "toxic", 3, 1, 0.7)])
def test_classifier_queries(spark, small, texts, awkward, monkeypatch, query, model, plain, label, m, r, cut):
    kept = {}
    train = model.train

    def seen(documents, labels, *args):
        kept["labels"] = {x.doc_id for x in labels.collect()}
        kept["weights"] = train(documents, labels, *args)
        return kept["weights"]

    monkeypatch.setattr(model, "train", seen)
    rows = getattr(queries, query)(spark, small).collect()
    assert {x.doc_id for x in rows} == set(texts) and len(rows) == len(texts)
    assert all(x.held_out == (crc(x.doc_id, m) == r) and x.predicted == int(x.score >= cut) for x in rows)
    assert kept["labels"] and not any(crc(i, m) == r for i in kept["labels"])
    for x in rows:
        assert x.score == pytest.approx(plain(texts[x.doc_id], kept["weights"]), abs=1e-9)
    out = model.score(awkward, kept["weights"]).collect()
    assert len(out) == len(AWKWARD) and all(x.score == pytest.approx(plain(dict(AWKWARD)[x.doc_id], kept["weights"]), abs=1e-9) for x in out if x.doc_id != 10)
    y = {x.doc_id: x[label] for x in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [(x.predicted, y[x.doc_id]) for x in rows if x.held_out and y.get(x.doc_id) is not None]
    assert sum(p == v for p, v in held) >= 0.8 * len(held)


def plain_ftrl(rows, n, epochs, alpha, beta, l1, l2):
    """Per-coordinate FTRL-proximal as published, one coordinate at a time."""
    z, g2, order = [0.0] * n, [0.0] * n, np.random.default_rng(0)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(g2[i])) / alpha + l2)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            y, index, value = rows[r]
            x = {**dict(zip(index.tolist(), value.tolist())), n - 1: 1.0}
            w = {i: weight(i) for i in x}
            p = plain_logistic(sum(w[i] * v for i, v in x.items()))
            for i, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(g2[i] + g * g) - math.sqrt(g2[i])) / alpha
                z[i] += g - sigma * w[i]
                g2[i] += g * g
    return [weight(i) for i in range(n)]


def test_ftrl_is_the_published_rule():
    rng = np.random.default_rng(1)
    rows = [(int(k % 2), np.sort(rng.choice(32, 6, replace=False)), rng.uniform(0.2, 1, 6)) for k in range(60)]
    assert quality_model.ftrl(rows, bits=5, epochs=3).tolist() == pytest.approx(plain_ftrl(rows, 33, 3, 0.5, 1.0, 0.02, 0.05))


@pytest.mark.parametrize("model, label", [(quality_model, "quality"), (toxicity, "toxic")])
def test_classifiers_on_awkward_tables(spark, awkward, model, label):
    labels = labels_of(spark, [(i, i % 2, i % 2) for i in range(1, 13)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99, 1, 1)])
    weights = model.train(awkward, labels, label)
    again = model.train(awkward.repartition(1), labels, label)
    assert np.isfinite(weights).all() and np.array_equal(weights, again)
    assert model.score(awkward.where("1 = 0"), weights).count() == 0
    assert np.isfinite(model.train(awkward.where("1 = 0"), labels, label)).all()
    scores = [r.score for r in model.score(awkward, weights).collect()]
    assert len(scores) == len(AWKWARD) and all(0 <= s <= 1 for s in scores)
    named = awkward.select(F.concat(F.lit("k"), "doc_id").alias("doc_id"), "text")
    assert dict(model.score(named, weights).dtypes)["doc_id"] == "string"


def test_toxic_features_are_scaled_by_log_count_ratios():
    sample = [(1, np.array([3, 7])), (1, np.array([3])), (0, np.array([7, 9])), (0, np.array([9])), (1, np.array([3])), (1, np.array([3, 9])), (0, np.array([9])), (0, np.array([9]))]
    scale = toxicity.ratios(sample)
    # 3: in four toxic texts of four; 9: too even; 7: in too few texts
    assert scale[3] == pytest.approx(math.log(5 / 6) - math.log(1 / 6)) and np.count_nonzero(scale) == 1


# ---- 6: the score by a plain model ------------------------------------------------------------------------------------


def test_op6(spark, small, texts, monkeypatch):
    kept = {}
    train = class_lm.train
    monkeypatch.setattr(class_lm, "train", lambda *a, **k: kept.setdefault("model", train(*a, **k)))
    rows = {r.doc_id: r for r in queries.op6_class_lm(spark, small).collect()}
    model, table = kept["model"]
    known = {r.hash: r for r in table.collect()}
    hot = {int(h): i for i, h in enumerate(model.hot_hash)}
    counts = Counter()
    for i, t in texts.items():
        if crc(i, 7) != 2:
            counts.update(words(lower(t)))
            counts["\n"] += 1
    total, types = sum(counts.values()), len(counts)
    tokens_of = Counter()
    for r in known.values():
        tokens_of[r.cls] += r.n
    single = Counter(r.cls for h, r in known.items() if r.n == 1 and h != class_lm.END)
    for i, t in texts.items():
        r = rows[i]
        tokens = words(lower(t))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (crc(i, 7) == 2, len(tokens) + 1, total)
        assert r.n_known == sum(counts[w] > 0 for w in [*tokens, "\n"])
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in [*tokens, "\n"]))
        h, g, _ = class_lm.words_of(*arrays(t))
        score, before = 0.0, 0
        for word, group, text in zip(h.tolist(), g.tolist(), tokens, strict=True):
            found = known.get(word)
            assert (found.n if found else 0) == counts[text]
            cls = found.cls if found else model.group_cls[group]
            score += model.log_step[before, cls]
            unseen = min((single[cls] + 0.5) / (tokens_of[cls] + 1), 0.9) if cls in model.group_cls else 0.0
            score += math.log10((1 - unseen) * found.n / tokens_of[cls]) if found else math.log10(unseen)
            before = model.hot_history[hot[word]] if word in hot else model.group_history[group]
        score += model.log_step[before, 0]
        assert r.score == pytest.approx(score, rel=1e-9) and r.perplexity == pytest.approx(10 ** (-score / r.n_tokens))


def test_transitions_are_those_of_the_texts(spark):
    """The table of history classes by classes, counted again word by word."""
    texts = ["a b a c a b", "c a b b a d e f", "a b c d a b", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, table = class_lm.train(df)
    known = {r.hash: r.cls for r in table.collect()}
    hot = {int(h): i for i, h in enumerate(model.hot_hash)}
    n = np.zeros((class_lm.CLASSES, class_lm.CLASSES))
    for t in texts:
        before = 0
        for word in class_lm.words_of(*arrays(t))[0].tolist():
            n[before, known[word]] += 1
            before = model.hot_history[hot[word]]
        n[before, 0] += 1
    size = n.sum(0)
    unigram = (size + 0.5) / (size.sum() + 0.5 * len(size))
    assert np.allclose(10**model.log_step, (n + 50 * unigram) / (n.sum(1, keepdims=True) + 50))


def test_an_item_goes_to_the_likeliest_class():
    rng = np.random.default_rng(2)
    like = lambda t: float(np.sum(t * np.log(np.maximum(t, 1))) - np.sum(t.sum(0) * np.log(np.maximum(t.sum(0), 1))))
    for _ in range(20):
        table = rng.integers(0, 30, (6, 6)).astype(float)
        own, history = int(rng.integers(1, 6)), rng.choice(6, 3, replace=False)
        counts = rng.integers(1, 9, 3)
        table[history, own] += counts
        value = []
        for c in range(6):
            moved = table.copy()
            moved[history, own] -= counts
            moved[history, c] += counts
            value.append(like(moved) if c else -np.inf)
        best = class_lm.choose(table, np.array([0, 3]), history, counts, np.array([own]))[0]
        assert value[best] == pytest.approx(max(value))


def test_words_of_equal_count_are_cut_exactly(spark):
    rows = spark.range(70_000).select(F.xxhash64("id").alias("hash"), F.lit(0).alias("grp"), F.lit(3).cast("long").alias("n"))
    more = rows.unionByName(spark.range(500).select(F.xxhash64("id", F.lit(1)).alias("hash"), F.lit(0).alias("grp"), F.lit(9).cast("long").alias("n")))
    a, b = class_lm.hottest(more), class_lm.hottest(more.repartition(7))
    assert a == b and len(a) == class_lm.HOT and [n for _, _, n in a[:501]] == [9] * 500 + [3]
    assert len(class_lm.hottest(rows.limit(10))) == 10 and class_lm.hottest(rows.where("1 = 0")) == []


def test_every_word_of_two_occurrences_has_its_own_class(spark):
    """Words of two kinds that stand in different places, none of them among the seeds' frequent words."""
    rng = np.random.default_rng(4)
    texts = []
    for _ in range(3000):
        texts.append(f"the noun{rng.integers(2000)} will verb{rng.integers(2000)} a noun{rng.integers(2000)} now")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, table = class_lm.train(df)
    own = {r.hash: r.cls for r in table.where(F.col("n") >= class_lm.FLOOR).collect()}
    classes = defaultdict(Counter)
    for kind in ("noun", "verb"):
        for k in range(2000):
            h = int(class_lm.words_of(*arrays(f"{kind}{k}"))[0][0])
            if h in own:
                classes[own[h]][kind] += 1
    right = sum(max(c.values()) for c in classes.values())
    assert right >= 0.9 * sum(sum(c.values()) for c in classes.values())


# ---- 8: the cutoffs by a plain model ----------------------------------------------------------------------------------


def plain_cutoffs(rows, share, delta):
    """rows: (stratum, fingerprint, rates) of distinct good texts."""
    import xxhash

    first = lambda f: xxhash.xxh64(int(f).to_bytes(8, "little", signed=True), seed=42).intdigest() % 2 == 0
    out, strata = {}, {s for s, f, _ in rows if first(f)}
    for s in strata:
        a, b = [r for t, f, r in rows if t == s and first(f)], [r for t, f, r in rows if t == s and not first(f)]
        if not b:
            continue
        place = {rule: sum(sum(r[rule] > c for r in a) <= math.floor(len(a) * share / len(quality_rules.GRIDS) / 4) for c in grid) for rule, grid in quality_rules.GRIDS.items()}
        cut = lambda rule, step, place=place: None if not (k := math.ceil(place[rule] * step / quality_rules.STEPS)) else sorted(quality_rules.GRIDS[rule], reverse=True)[k - 1]
        cdf, allowed = 0.0, -1
        for k in range(math.floor(len(b) * share) + 1):
            cdf += math.comb(len(b), k) * share**k * (1 - share) ** (len(b) - k)
            if cdf <= delta / len(strata):
                allowed = k
        passed = 0
        for step in range(1, quality_rules.STEPS + 1):
            if sum(any(cut(rule, step) is not None and r[rule] > cut(rule, step) for rule in quality_rules.GRIDS) for r in b) > allowed:
                break
            passed = step
        out[s] = {rule: cut(rule, passed) if passed else None for rule in quality_rules.GRIDS}
    return out


def test_op8(spark, small, texts):
    rows = queries.op8_quality_rules(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = plain_measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n) and not (r.base_failed and r.kept)


def test_cutoffs_are_those_of_a_plain_model(spark):
    rng = np.random.default_rng(8)
    docs, labels = [], []
    for i in range(2400):
        marks = "!" if rng.random() < 0.01 else ""
        text = " ".join(f"w{rng.integers(5000)}{'***' if rng.random() < (0.02 if i % 3 else 0.001) else marks}" for _ in range(30))
        docs.append((i, text, "en" if i % 2 else "de"))
        if i % 4 == 0:
            docs.append((10_000 + i, text, "en" if i % 2 else "de"))
            labels.append((10_000 + i, 1, 0))
        labels.append((i, 1, 0))
    docs += [(50_000 + k, " ".join(f"z{j}***" for j in range(40)), "en") for k in range(5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    rated = quality_rules.rates(quality_rules.measures(df, stratum=F.col("lang")))
    good = labels_of(spark, labels)
    got = {r.stratum: {rule: r[f"max_{rule}"] for rule in quality_rules.GRIDS} for r in quality_rules.cutoffs(rated, good, 0.05, 0.05).collect()}
    ids = {i for i, _, _ in labels}
    distinct = {(r.stratum, r.fingerprint): {rule: r[rule] for rule in quality_rules.GRIDS} for r in rated.collect() if r.doc_id in ids}
    assert len(distinct) < len(ids)
    assert got == plain_cutoffs([(s, f, r) for (s, f), r in distinct.items()], 0.05, 0.05)
    assert any(v is not None for c in got.values() for v in c.values())


# ---- 2, 5 and the rest on awkward rows --------------------------------------------------------------------------------


def test_secrets_of_awkward_rows(spark, awkward):
    from tidebook.llm import secret_scan

    from test_llm import plain_secrets

    long = "x " * 400_000 + "token = abcdefghij"
    rows = awkward.select("doc_id", "text", "source", "spans").unionByName(spark.createDataFrame([(20, long, None, "clash")], "doc_id long, text string, source string, spans string"))
    got = secret_scan.scan_secrets(rows, F.col("source"), F.col("source")).collect()
    want = Counter((i, tuple(plain_secrets(t))) for i, t in [*AWKWARD, (20, long)])
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.spans if s.kind in secret_scan.BASE_KINDS)) for r in got) == want
    kept = secret_scan.scan_secrets(rows, F.col("source"), F.col("source"), keep=["text", "spans", "doc_id"], out="found")
    assert kept.columns == ["text", "spans", "doc_id", "found"] and {r.text for r in kept.collect()} == {t for _, t in AWKWARD} | {long}


def test_secret_verdict_counts_repositories_and_owners(spark):
    rows = []
    for value, places in {"onlyowner": ["a/1", "a/2", "a/3", "a/4"], "twocopies": ["a/1", "b/1"], "spreadout": ["a/1", "a/2", "b/1"], "byeveryone": [f"{o}/1" for o in "abcdef"] * 50}.items():
        rows += [(len(rows) + k, f"password={value}", p, p[0]) for k, p in enumerate(places)]
    from tidebook.llm import secret_scan

    df = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    seen = {(r.text[9:], s.repos, s.owners, s.live) for r in secret_scan.scan_secrets(df, F.col("repo"), F.col("owner"), keep=["text"]).collect() for s in r.spans}
    assert seen == {("onlyowner", 4, 1, True), ("twocopies", 2, 2, True), ("spreadout", 3, 2, False), ("byeveryone", 6, 6, False)}


def test_quality_rules_of_awkward_rows(spark, awkward):
    labels = labels_of(spark, [(i, 1, 0) for i in range(1, 14)] + [(None, 1, 0)])
    rows = quality_rules.judge_quality(awkward, labels, stratum=F.when(F.col("doc_id") > 5, F.col("lang"))).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in AWKWARD) and all(r.kept == (not r.base_failed) for r in rows)


# ---- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages_on_awkward_rows(spark, small):
    import corpus_pipeline

    prose = " ".join(f"calm{k}" for k in range(40))
    rows = [(i, t, "en", "s", len(t or ""), "clash") for i, t in AWKWARD] + [(None, None, None, None, None, None), (3, prose, "en", "s", 1, "x"), (3, prose, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns, name
        left = Counter((r.doc_id, r.text) for r in out.collect())
        if name == "near_duplicates":
            assert left[3, prose] == 1 and left[10, AWKWARD[10][1]] == 0 and left[9, AWKWARD[8][1]] == 1 and left[None, None] == 1
        elif name == "decontamination":
            assert sum(left.values()) == len(rows)
        elif name == "secrets":
            assert left[13, AWKWARD[-1][1]] == 0 and sum(left.values()) == len(rows)
        assert stage(spark, docs.where("1 = 0"), small).count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs, small).select("doc_id").distinct().count() > 10


def test_pipeline_run(spark, small):
    """run() against its stages one by one; what each stage keeps is compared with plain versions in test_llm."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
    kept = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_packing(corpus_pipeline.run(spark, small).collect(), kept)


def test_packing_ranks_over_salts(spark, monkeypatch):
    """Few pieces a salt, so that ranks go across salts; and ids of another type."""
    from tidebook.llm import packing

    monkeypatch.setattr(packing, "RANKED", 7)
    texts = [(i, "word " * int(n)) for i, n in enumerate(np.random.default_rng(5).integers(1, 40, 200))] + [(900, "long text " * 600), (901, "long text " * 900)]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in texts], "doc_id string, text string")
    rows = packing.pack(df, 64).collect()
    check_packing(rows, [(f"k{i}", t) for i, t in texts], 64)
    full = [r.sequence_id for r in rows if r.length == 64]
    assert len(full) == len(set(full)) > 20 and not set(full) & {r.sequence_id for r in rows if r.length < 64}
