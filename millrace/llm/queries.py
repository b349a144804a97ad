"""One query for each operator, over its whole table with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, exact_dedup, hard_negatives, jaccard_join, lexical_rank, line_dedup, quality, scratch, secret_scan, span_dedup, suffix_dedup, token_files, url_filter

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.remove_repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def decontaminate_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, bench)
    digests = scratch.stage(found.item_sets.select("item_set", F.size("items").cast("long").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha")), "item-digests")
    few = digests.limit(decontaminate.BROADCAST_ROWS + 1).count() <= decontaminate.BROADCAST_ROWS
    rows = found.documents.join(F.broadcast(digests) if few else digests, "item_set", "left")
    return rows.select("doc_id", "n_words", "n_hit", F.coalesce("n", F.lit(0).cast("long")).alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), "contaminated")


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality", "keep")


def url_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def exact_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def suffix_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def jaccard_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_texts", "kept")


def token_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "tokens")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.index(token_files.read_tokens(spark, path))


def bpe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), vocab, public_tokenizers.PATTERN).select("doc_id", "ids")
    both = bpe.decode(ids, vocab, public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_sha256(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def line_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def negatives_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings").select("vec_id", hard_negatives.relabelled().alias("label"), "embedding"))


def rank_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.rank(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def secret_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [secret_scan.count(k).alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed(secret_scan.BASE_KINDS), 256).alias("base_sha256"), secret_scan.listed().alias("spans"))


QUERIES = {
    "op1_substring_dedup": span_query,
    "op2_decontamination": decontaminate_query,
    "op3_quality_classifier": quality_query,
    "op4_url_filters": url_query,
    "op5_exact_dedup": exact_query,
    "op6_suffix_array_dedup": suffix_query,
    "op7_jaccard_join": jaccard_query,
    "op8_token_files": token_query,
    "op9_byte_bpe": bpe_query,
    "op10_line_dedup": line_query,
    "op11_hard_negatives": negatives_query,
    "op12_secret_scans": secret_query,
    "op13_lexical_search": rank_query,
    # names of the first round for the rule that both now have
    "op10_line_dedup_extended": line_query,
    "op1_substring_dedup_extended": span_query,
}

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
sizes AS (SELECT DISTINCT n FROM bl),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, cast(len(d.w) AS BIGINT) AS n_words, cast(coalesce(n_hit, 0) AS BIGINT) AS n_hit, cast(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_OP4 = r"""
WITH u AS (SELECT page_id,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT page_id, host, path, CASE
  WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
  WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
  WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
  WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
  WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM u)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

_OP5 = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

#: Every accepted run of consecutive units (of up to {most}) that occurs earlier; {units} makes a text's units, {ok} accepts t of them.
_RUNS = r"""
WITH d AS (SELECT doc_id, text, {units} AS ls FROM documents),
u AS (SELECT doc_id, list_transform(ls, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS us, len(ls) AS n FROM d),
s AS (SELECT doc_id, us, n, list_transform(us, lambda x: length(x)) AS size, unnest(range(1, n + 1)) AS i FROM u),
e AS (SELECT doc_id, us, i, unnest(list_filter(range(1, {most} + 1), lambda t: i + t <= n + 1 AND ({ok}))) AS e FROM s),
w AS (SELECT doc_id, i, e, array_to_string(us[i : i + e - 1], chr(1)) AS c FROM e WHERE e IS NOT NULL),
later AS (SELECT doc_id, i, e FROM w QUALIFY doc_id > min(doc_id) OVER (PARTITION BY c) OR row_number() OVER (PARTITION BY c, doc_id ORDER BY i) > 1),
gone AS (SELECT doc_id, list(DISTINCT k) AS ks FROM (SELECT doc_id, unnest(range(i, i + e)) AS k FROM later) GROUP BY 1)
SELECT d.doc_id, CASE WHEN ks IS NULL THEN text ELSE array_to_string(list_filter(ls, lambda x, k: NOT list_contains(ks, k)), {glue}) END AS text,
       cast(len(ls) AS BIGINT) AS {name}, cast(coalesce(len(ks), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN gone USING (doc_id)
"""

_SUM = "list_sum(size[i : i + t - 1])"
_OP1 = _RUNS.format(units=r"regexp_extract_all(coalesce(text, ''), '[^.!?\n]+[.!?\n]*\s*|[.!?\n]+\s*')", most=12, ok=f"(t >= 3 AND {_SUM} >= 100) OR {_SUM} >= 200 OR t = 12", glue="''", name="n_sentences")
_OP10 = _RUNS.format(units="string_split(coalesce(text, ''), chr(10))", most=8, ok=f"{_SUM} >= 160 OR t = 8", glue="chr(10)", name="n_lines")

_OP6 = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, i, md5(substr(x, 2 * i - 1, 400)) AS m FROM (SELECT doc_id, x, unnest(range(1, length(x) // 2 - 198)) AS i FROM h WHERE length(x) >= 400)),
st AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN i - p > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM st)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 199 AS b FROM g GROUP BY doc_id, run),
q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT q.doc_id, string_agg(substr(x, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept, count(*) AS n_spans, sum(b - a + 1) AS n_removed FROM q JOIN h USING (doc_id) GROUP BY 1)
SELECT h.doc_id, cast(length(x) // 2 AS BIGINT) AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, cast(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM h LEFT JOIN k USING (doc_id)
"""

_OP11 = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same, cast(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM e a JOIN e r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""

_TERMS = r"unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
_OP13 = f"""
WITH c AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, {_TERMS} AS term FROM documents) GROUP BY ALL),
n AS (SELECT doc_id, cast(sum(tf) AS BIGINT) AS n FROM c GROUP BY 1),
t AS (SELECT count(*) AS total, cast(sum(n) AS BIGINT) AS terms FROM n),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * total) // terms) AS m FROM n, t),
w AS (SELECT term, cast(floor(1000 * ln((2 * cast(total AS DOUBLE) + 2) / (2 * cast(df AS DOUBLE) + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM c GROUP BY 1), t),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, {_TERMS} AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, cast(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN c USING (term) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

SQL = {"op11_hard_negatives": _OP11, "op13_lexical_search": _OP13, "op1_substring_dedup": _OP1, "op2_decontamination": _OP2, "op4_url_filters": _OP4, "op5_exact_dedup": _OP5, "op6_suffix_array_dedup": _OP6, "op10_line_dedup": _OP10, "op10_line_dedup_extended": _OP10, "op1_substring_dedup_extended": _OP1}
