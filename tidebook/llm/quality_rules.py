"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Measures of a text (rates of symbols, capitals, repeated lines, repeated word windows and exclamation marks) reject it above
a cutoff.  In each stratum the labelled good texts fall into two halves by the hash of their text:

* the first half proposes: for each rule the strictest cutoff of a fixed grid that rejects at most a quarter of the rule's
  share of the allowed false rejections there, and from it a path of ``STEPS`` sets of cutoffs, each a step stricter;
* the second half proves: along the path, loosest set first, the exact binomial (Clopper-Pearson) bound has to show that the
  rules of a set together reject at most ``max_false_rejection`` of the stratum's good texts.  The last set before the first
  failure holds.  As the order is fixed beforehand, testing along a path needs no correction for its length; the error
  probability ``delta`` is divided by the number of strata (Bonferroni).

So with probability 1 - delta every stratum loses at most the stated share of its good texts.  A stratum with too few labels
proves nothing and loses nothing.  Texts that occur more than once in a stratum are one trial, since copies would not be
independent ones.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is one of its own; repeated rows
are judged alike; with no labels only the base rule rejects; a doc_id with a label of 1 counts as good, also where it has
another label; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.shared import staged

# Fixed values of the contract: white space, symbols, window and base limits.
SPACE = "[ \\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30

#: Grids of cutoffs; a text is rejected above the cutoff.
GRIDS = {
    "symbol_rate": (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.75, 1.0),
    "upper_rate": (0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "dup_line_rate": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7),
    "repeat_rate": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3),
    "bang_rate": (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 1.5),
}
STEPS = 4  # sets of cutoffs on a path


def measures(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: Column | None = None) -> DataFrame:
    """doc_id, stratum, fingerprint, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_bang."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce((stratum if stratum is not None else F.lit("")).cast("string"), F.lit("")).alias("stratum"), t.alias("t"))
    rows = rows.select(
        "doc_id",
        "stratum",
        F.xxhash64("t").alias("fingerprint"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit("[A-Z\\u00C0-\\u00DE]")).cast("long").alias("n_upper"),
        F.regexp_count("t", F.lit("!")).cast("long").alias("n_bang"),
        F.filter(F.split("t", SPACE + "+"), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")).alias("lines"),
    )
    rows = rows.select(
        "doc_id",
        "stratum",
        "fingerprint",
        "n_symbols",
        "n_upper",
        "n_bang",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    # only a text with a repeated window needs the positions of its repeated windows
    pairs = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    rows = rows.withColumn("pairs", pairs).drop("windows")
    same = lambda x, at: F.coalesce(F.get(F.col("pairs"), at)["h"] == x["h"], F.lit(False))
    at = F.array_sort(F.transform(F.filter("pairs", lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
    rows = rows.withColumn("at", at).drop("pairs")
    covered = F.aggregate(
        "at",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"],
    )
    return rows.withColumn("n_repeat_words", covered).drop("at")


def rates(rows: DataFrame) -> DataFrame:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return rows.withColumns({
        "symbol_rate": per("n_symbols", "n_words"),
        "upper_rate": per("n_upper", "word_chars"),
        "dup_line_rate": per("n_dup_lines", "n_lines"),
        "repeat_rate": per("n_repeat_words", "n_words"),
        "bang_rate": per("n_bang", "n_words"),
    })


def most_rejections(n: Column, share: float, delta: Column) -> Column:
    """Largest k with P(Binomial(n, share) <= k) <= delta, or -1: k rejections of n still prove the share at that level."""
    import math

    odds, none = math.log(share / (1 - share)), math.log(1 - share)
    zero = F.struct((n * none).alias("log"), F.lit(0.0).alias("cdf"), F.lit(-1).cast("long").alias("best"))

    def step(s: Column, k: Column) -> Column:
        cdf = s["cdf"] + F.exp(s["log"])
        return F.struct((s["log"] + F.log((n - k) / (k + 1)) + odds).alias("log"), cdf.alias("cdf"), F.when(cdf <= delta, k).otherwise(s["best"]).alias("best"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.floor(n * share)), zero, step, lambda s: s["best"])


def cutoffs(rows: DataFrame, good: DataFrame, max_false_rejection: float, delta: float) -> DataFrame:
    """stratum, then for each rule its cutoff or null; ``good`` has the doc_id of each labelled good text."""
    held = rows.join(good.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
    held = staged(held.select("stratum", "fingerprint", *GRIDS).dropDuplicates(["stratum", "fingerprint"]), "good-texts")
    first = F.pmod(F.xxhash64("fingerprint"), F.lit(2)) == 0
    # first half: place of each rule's cutoff in its grid, counted from the loosest (0: none)
    loose_first = {rule: sorted(grid, reverse=True) for rule, grid in GRIDS.items()}
    counts = held.where(first).groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(F.col(rule) > c).alias(f"{rule}_{k}") for rule, grid in loose_first.items() for k, c in enumerate(grid)])
    few = F.floor(F.col("n") * max_false_rejection / len(GRIDS) / 4)
    places = {rule: sum(((F.col(f"{rule}_{k}") <= few).cast("int") for k in range(len(grid))), F.lit(0)) for rule, grid in loose_first.items()}
    paths = counts.select("stratum", *[p.alias(f"place_{rule}") for rule, p in places.items()])

    def cutoff(rule: str, step: int) -> Column:
        grid = F.array(*[F.lit(c) for c in loose_first[rule]])
        return F.try_element_at(grid, F.nullif(F.ceil(F.col(f"place_{rule}") * step / STEPS).cast("int"), F.lit(0)))

    paths = staged(paths.select("stratum", *[cutoff(rule, step).alias(f"{rule}_{step}") for rule in GRIDS for step in range(1, STEPS + 1)]), "paths")  # a row a stratum
    # second half: what each set of the path rejects
    rejected = lambda step: _any([F.coalesce(F.col(rule) > F.col(f"{rule}_{step}"), F.lit(False)) for rule in GRIDS])
    proof = held.where(~first).join(paths, "stratum").groupBy("stratum").agg(F.count("*").alias("n"), *[F.count_if(rejected(step)).alias(f"rejected_{step}") for step in range(1, STEPS + 1)])
    allowed = most_rejections(F.col("n"), max_false_rejection, F.lit(delta / max(1, paths.count())))
    proof = proof.withColumn("allowed", allowed)
    passed, fine = F.lit(0), F.lit(True)
    for step in range(1, STEPS + 1):
        fine = fine & (F.col(f"rejected_{step}") <= F.col("allowed"))
        passed = F.when(fine, step).otherwise(passed)
    chosen = proof.select("stratum", passed.alias("step")).join(paths, "stratum")
    return chosen.select("stratum", *[F.try_element_at(F.array(*[F.col(f"{rule}_{step}") for step in range(1, STEPS + 1)]), F.nullif("step", F.lit(0))).alias(f"max_{rule}") for rule in GRIDS])


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def judge_quality(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: Column | None = None, max_false_rejection: float = 0.02, delta: float = 0.05) -> DataFrame:
    """One row for each document: its measures, base_failed, method_failed, kept.  ``labels``: doc_id, quality (1 good)."""
    rows = rates(staged(measures(documents, doc_id, text, stratum), "measures"))
    limits = staged(cutoffs(rows, labels.where("quality = 1"), max_false_rejection, delta), "cutoffs")
    rows = rows.join(limits, "stratum", "left")
    failed = F.lit(False)
    for rule in GRIDS:
        failed = failed | F.coalesce(F.col(rule) > F.col(f"max_{rule}"), F.lit(False))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumns({"base_failed": base, "method_failed": failed}).withColumn("kept", ~F.col("base_failed") & ~F.col("method_failed"))
