"""The registered queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import class_lm, decontaminate, near_dup, packing, periodic_runs, pii, prefix_trie, quality_model, quality_rules, secret_scan, substring_dedup, toxicity, url_filter
from tidebook.llm.shared import table

# Fixed values of the contract.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"),
    url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"),
    url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def _base(spans: Column, kinds: tuple[str, ...]) -> Column:
    return F.sha2(_span_text(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256)


def shouting_urls(pages: DataFrame) -> DataFrame:
    """The listed keys: host and path of each page whose title shouts (two words or more that end in ``!!``)."""
    shouts = F.regexp_extract(F.coalesce("html", F.lit("")), "<title>([^<]*)</title>", 1).like("%!! %!!%")
    host = url_filter.url_host(F.col("url"))
    return pages.where(shouts & (host != "")).select(F.concat(host, url_filter.url_path(F.col("url"))).alias("key"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_filter.judge_urls(pages.select("page_id", "url"), shouting_urls(pages), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_pii(table(spark, sf_dir, "documents"))
    s = F.col("spans")
    least = F.array_min(F.transform(s, lambda x: x["score"])).alias("least_score")
    sure = F.filter(s, lambda x: x["confirmed"])
    more = (F.size(sure).cast("long").alias("n_confirmed"), F.array_join(F.transform(s, lambda x: F.format_string("%.2f", x["score"])), ",").alias("scores"), _span_text(sure).alias("confirmed_spans"))
    return found.select("doc_id", *[_count(s, k).alias(f"n_{k}") for k in pii.BASE_KINDS], _base(s, pii.BASE_KINDS).alias("base_sha256"), _span_text(s).alias("spans"), least, *more)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = quality_model.train(documents, labels.where(~class_lm.held_out(F.col("doc_id"), 5, 0)), "quality")
    scored = quality_model.score(documents, weights)
    return scored.select("doc_id", class_lm.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = secret_scan.scan_secrets(documents, F.concat_ws("/", "source", "lang"), F.col("source"))
    s = F.col("spans")
    live = F.size(F.filter(s, lambda x: x["live"])).cast("long")
    return found.select("doc_id", *[_count(s, k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS], _base(s, secret_scan.BASE_KINDS).alias("base_sha256"), _span_text(s).alias("spans"), live.alias("n_live"))


def op6_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = class_lm.held_out(F.col("doc_id"), 7, 2)
    model, words = class_lm.train(documents.where(~held))
    scored = class_lm.score(documents, model, words)
    return scored.select("doc_id", held.alias("held_out"), F.col("n_tokens").cast("long").alias("n_tokens"), F.col("n_known").cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    weights = toxicity.train(documents, labels.where(~class_lm.held_out(F.col("doc_id"), 3, 1)), "toxic")
    scored = toxicity.score(documents, weights)
    return scored.select("doc_id", class_lm.held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), stratum=F.col("lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), 1024)


def cycled(h: int, n: int):
    """For a tenth of the seeds, a text's words from one place on, said again and again; None for the others."""
    if h % 10:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % period
    return places


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.detect_runs(table(spark, sf_dir, "documents"), 6, 4, cycled, F.crc32(F.col("doc_id").cast("string")))
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.signum(y["length"] - x["length"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int"))
    rows = found.withColumn("best", F.try_element_at(longest, F.lit(1)))
    best = F.col("best")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns of each conversation c: the first h original turns of c - c % 20, then c's own after its first h."""
    own = prefix_trie.conversation_turns(conversations)
    lead = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("lead_id"), F.slice("turns", 1, 3).alias("lead"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    rows = own.withColumns({"lead_id": F.col("conv_id") - F.col("conv_id") % 20, "h": h}).join(lead, "lead_id", "left")
    first = F.slice(F.coalesce("lead", F.array().cast(own.schema["turns"].dataType)), F.lit(1), F.col("h"))
    return rows.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), 20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_filter, op2_pii, op3_minhash, op4_quality_model, op5_secrets, op6_class_lm, op7_toxicity, op8_quality_rules, op9_decontamination, op10_packing, op11_periodic_runs, op12_prefix_trie, op13_substring_dedup)}


_OP1 = """
WITH u AS (
  SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
listed AS (
  SELECT DISTINCT host || path AS key FROM u
  WHERE host <> '' AND regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1) LIKE '%!! %!!%'),
r AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
      WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
      WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/'
    END AS rule
  FROM u)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block'
       WHEN host <> '' AND host || path IN (SELECT key FROM listed) THEN 'block'
       ELSE 'allow' END AS verdict
FROM r
"""


#: crc32 of the decimal text of ``{0}``, bit by bit.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({0}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"""

_OP11 = """
WITH w AS (
  SELECT doc_id, {crc} AS h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS original FROM documents),
m AS (SELECT *, len(original) AS n, h // 10 AS g FROM w),
x AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: CASE WHEN i < g % n THEN original[i + 1] ELSE original[g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) + 1] END)
    ELSE original END AS ws
  FROM m),
fives AS (SELECT doc_id, n, i, array_to_string(ws[i + 1 : i + 5], ' ') AS gram, CASE WHEN i > 0 THEN ws[i] END AS before FROM x, unnest(range(n - 4)) AS u(i)),
pairs AS (
  SELECT a.doc_id, a.i AS s, b.i - a.i AS q FROM fives AS a JOIN fives AS b ON a.doc_id = b.doc_id AND a.gram = b.gram AND b.i > a.i
  WHERE a.i + 4 * (b.i - a.i) <= a.n AND (a.i = 0 OR a.before <> b.before)),
near AS (SELECT pairs.*, n, ws FROM pairs JOIN x USING (doc_id) WHERE ws[s + 3 * q] = ws[s + 4 * q] AND ws[s + 2 * q] = ws[s + 3 * q]),
same AS (
  SELECT doc_id, s, q, coalesce(list_position(list_transform(range(s, n - q), lambda i: ws[i + 1] = ws[i + q + 1]), false) - 1, n - q - s) AS l FROM near),
runs AS (SELECT doc_id, s, l + q AS len, min(q) AS q FROM same WHERE l >= 3 * q AND l + q >= 6 GROUP BY doc_id, s, l + q),
said AS (SELECT DISTINCT doc_id, s + q + k AS i FROM runs, unnest(range(len - q)) AS u(k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS txt
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(n)) AS i FROM x) ANTI JOIN said USING (doc_id, i) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines,
    first({{'s': s, 'len': len, 'q': q}} ORDER BY len DESC, s, q) AS best
  FROM runs GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period, 1000 * best.len // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(txt, '')) AS collapsed_sha256
FROM x LEFT JOIN found USING (doc_id) LEFT JOIN kept USING (doc_id)
""".format(crc=_CRC.format("doc_id"))

_OP12 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, {crc} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
own AS (
  SELECT c.conv_id, t.k, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 WHERE t.k <= c.h
  UNION ALL
  SELECT c.conv_id, t.k + 1000000, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE t.k > c.h),
s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words, sha256(length(role) || ':' || role || text) AS turn
  FROM own),
p AS (
  SELECT conv_id, d, words, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY d) AS node FROM s
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM c),
nodes AS (SELECT node, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own FROM p GROUP BY node),
kids AS (SELECT left(node, length(node) - 64) AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
below AS (SELECT DISTINCT a.node AS top, b.node FROM p AS a JOIN p AS b ON a.conv_id = b.conv_id AND b.d >= a.d),
sums AS (
  SELECT top AS node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (kids.node IS NULL) AS n_leaves
  FROM below JOIN nodes USING (node) LEFT JOIN kids USING (node) GROUP BY top),
ends AS (SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(node, d) AS node FROM p GROUP BY conv_id) GROUP BY node)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM nodes AS n JOIN sums USING (node) LEFT JOIN kids USING (node) LEFT JOIN ends USING (node) LEFT JOIN nodes AS up ON n.depth > 0 AND up.node = left(n.node, length(n.node) - 64)
""".format(crc=_CRC.format("conv_id"))

_OP13 = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i AS start, array_to_string(ws[i + 1 : i + 20], ' ') AS words FROM w, unnest(range(len(ws) - 19)) AS u(i)),
again AS (SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY words ORDER BY doc_id, start) > 1),
gone AS (SELECT DISTINCT doc_id, start + k AS i FROM again, unnest(range(20)) AS u(k)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS txt, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": _OP1, "op11_periodic_runs": _OP11, "op12_prefix_trie": _OP12, "op13_substring_dedup": _OP13}
