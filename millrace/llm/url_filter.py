"""URL filters by a trie over reversed host labels and path segments.

A rule is host + path, like `example.com/en/7`. The trie's edges are the host's labels from the last one on, then
the path's complete segments; at the node they lead to, the rest of the path (after its last slash) is kept as a
prefix of the next segment. A rule fits its host and every subdomain if the URL's path starts with the rule's
path. Of the rules that fit, the one with most host labels wins, then the one with the longest path, allow before
block if both have the very same host and path. Without a rule the verdict is the default.

Rules are a list, or a table of verdict and rule (a null rule is left out). Up to MAX_RULES are broadcast as a trie.
More stay a table: each distinct host and path is joined with the rules of its host's suffixes, by the beginnings of the
path that have the length of one of them, so nothing but equal keys meet and the verdicts are the same. Null URLs and URLs without `://`
have an empty host and path and get the default. Repeated rows get equal results. Extra columns pass through;
host, path, rule and verdict replace columns of those names. An empty rule list leaves the default for all.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import stage

#: Rules that are broadcast; more are joined.
MAX_RULES = 1_000_000
_HOST, _PATH, _TAILS = "host", "path", "tails"


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build_trie(rules: list[tuple[str, str]]) -> dict:
    """rules: (verdict, host + path). A node: host labels, path segments, and tails of rules that end in it."""
    root: dict = {_HOST: {}}
    for verdict, rule in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"a rule must allow or block: {verdict}")
        host, slash, path = rule.partition("/")
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(_HOST, {}).setdefault(label, {})
        *segments, tail = (slash + path).split("/")
        for segment in segments:
            node = node.setdefault(_PATH, {}).setdefault(segment, {})
        known = node.setdefault(_TAILS, {}).get(tail)
        if known is None or verdict == "allow":
            node[_TAILS][tail] = (verdict, rule)
    return root


def find_rule(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """The rule that wins, as (verdict, rule)."""
    best, node = None, trie
    segments = path.split("/")
    for label in reversed(host.split(".")):
        node = node.get(_HOST, {}).get(label)
        if node is None:
            break
        best = _in_path(node, segments) or best
    return best


def _in_path(node: dict, segments: list[str]) -> tuple[str, str] | None:
    best = None
    for segment in segments:
        tails = node.get(_TAILS)
        if tails:  # the longest tail that the segment starts with
            best = next((tails[segment[:n]] for n in range(len(segment), -1, -1) if segment[:n] in tails), best)
        node = node.get(_PATH, {}).get(segment)
        if node is None:
            break
    return best


def _table(rules: DataFrame) -> DataFrame:
    """Distinct rules as rule_host, rule_path, rule and verdict; allow before block."""
    known = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("a rule must allow or block: "), F.coalesce("verdict", F.lit("null")))))
    one = rules.filter("rule is not null").groupBy("rule").agg(F.min(known).alias("verdict"))
    host = F.substring_index("rule", "/", 1)
    return one.select(host.alias("rule_host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"), "rule", "verdict")


def _by_joins(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule that wins for each of the distinct (host, path) that one fits: host, path, rule, verdict."""
    table = stage(_table(rules), "url-rules")
    labels = F.split("host", r"\.", -1)
    most = table.agg(F.max(F.size(F.split("rule_host", r"\.", -1)))).first()[0] or 1
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most))), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    # of a host the lengths that its rules' paths have, however many rules there are
    lengths = table.groupBy("rule_host").agg(F.collect_set(F.length("rule_path")).alias("lengths"))
    tried = urls.select("host", "path", F.posexplode(suffixes).alias("labels", "rule_host")).join(lengths, "rule_host")
    tried = tried.withColumn("n", F.explode(F.filter("lengths", lambda n: n <= F.length("path")))).withColumn("rule_path", F.expr("substring(path, 1, n)"))
    fits = tried.join(table, ["rule_host", "rule_path"])
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.struct("labels", "n")).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict."""
    rows = pages.select(F.struct(*pages.columns).alias("row"), F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).alias("parts"))
    few = rules.limit(MAX_RULES + 1).count() <= MAX_RULES if isinstance(rules, DataFrame) else len(rules) <= MAX_RULES
    if few:
        listed = [tuple(r) for r in rules.filter("rule is not null").select("verdict", "rule").collect()] if isinstance(rules, DataFrame) else rules
        rows = rows.withColumn("found", _in_trie(pages, listed, default)("parts.host", "parts.path"))
    else:
        table = rules if isinstance(rules, DataFrame) else pages.sparkSession.createDataFrame(rules, "verdict string, rule string")
        best = _by_joins(rows.select("parts.host", "parts.path").distinct(), table)
        best = best.select(F.struct("host", "path").alias("parts"), F.struct("verdict", "rule").alias("found"))
        rows = rows.join(best, "parts", "left").withColumn("found", F.coalesce("found", F.struct(F.lit(default).alias("verdict"), F.lit(None).cast("string").alias("rule"))))
    new = {"host": "parts.host", "path": "parts.path", "rule": "found.rule", "verdict": "found.verdict"}
    return rows.select(*[F.col("row")[c].alias(c) for c in pages.columns if c not in new], *[F.col(v).alias(k) for k, v in new.items()])


def _in_trie(pages: DataFrame, rules: list[tuple[str, str]], default: str):
    """A function of host and path: verdict and rule."""
    shared = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("verdict string, rule string")
    def run(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        trie = shared.value
        found = [find_rule(trie, h, p) or (default, None) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["verdict", "rule"])

    return run
