"""Operator 10: allow and block lists of URLs.

Rules stand in a trie over reversed host labels, then path segments; the trie is
broadcast and the longest rule that fits decides between allow and block.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ALLOW, BLOCK = "allow", "block"
#: Bound of the rules in a broadcast trie, about 200 MB in a worker; more are joined.
MAX_RULES = 500_000


@dataclass
class Node:
    labels: dict[str, Node] = field(default_factory=dict)
    segments: dict[str, Node] = field(default_factory=dict)
    #: Rules that end here: what the next segment starts with -> (rule, verdict).
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    #: The lengths of what the next segment may start with, longest first.
    lengths: list[int] = field(default_factory=list)


def split_rule(rule: str) -> tuple[str, str]:
    """(host, path) of a rule such as ``example.org/en/``; the path starts with /."""
    host, _, path = rule.partition("/")
    return host.lower(), "/" + path


def build_trie(rules: Iterable[tuple[str, str]]) -> Node:
    """The trie of ``(rule, verdict)``.  Of the same rule with both verdicts, block counts."""
    root, ended = Node(), {}
    for rule, verdict in rules:
        host, path = split_rule(rule)
        node = root
        for label in reversed([x for x in host.split(".") if x]):
            node = node.labels.setdefault(label, Node())
        *whole, last = path[1:].split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if node.ends.get(last, ("", ""))[1] != BLOCK:
            node.ends[last] = (rule, verdict)
            ended[id(node)] = node
    for node in ended.values():
        node.lengths = sorted({len(end) for end in node.ends}, reverse=True)
    return root


def match(root: Node, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits: most host labels, then the longest path."""
    if not host or not path.startswith("/"):
        return None
    hosts = [root]
    for label in reversed(host.split(".")):
        if label not in hosts[-1].labels:
            break
        hosts.append(hosts[-1].labels[label])
    for at in reversed(hosts):
        best, node = None, at
        for segment in path[1:].split("/"):
            best = next((node.ends[segment[:n]] for n in node.lengths if segment[:n] in node.ends), best)
            node = node.segments.get(segment)
            if node is None:
                break
        if best:
            return best
    return None


def host_of(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id", url_column: str = "url", default: str = ALLOW) -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    A URL without a rule gets ``default`` and a null rule; so does one that is null,
    empty or has no ``://``, whose host and path are empty.  Repeated rows get equal
    results; an empty table gives an empty one; other columns are not read.  No shuffle;
    beyond :data:`MAX_RULES` rules :func:`filter_by_join` gives the same rows.
    """
    if len(rules) > MAX_RULES:
        return filter_by_join(pages, pages.sparkSession.createDataFrame(rules, "rule string, verdict string"), id_column, url_column, default)
    trie = pages.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf(StructType([StructField("rule", StringType()), StructField("verdict", StringType())]))
    def judge(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        found = [match(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
        return pd.DataFrame(found, columns=["rule", "verdict"])

    split = pages.select(F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    return split.withColumn("_judged", judge("host", "path")).select(id_column, "host", "path", "_judged.rule", "_judged.verdict")


def filter_by_join(pages: DataFrame, rules: DataFrame, id_column: str = "page_id", url_column: str = "url", default: str = ALLOW) -> DataFrame:
    """What :func:`filter_urls` returns, for rule tables (rule, verdict) of any size.

    Each distinct URL is cut to the lengths that rule paths of its host, and of the domains
    above it, have; equal joins find the rules among those cuts, so that many rules of one
    host make no pairs.  The best fit is aggregated before it goes back to the pages.
    """
    rule_host = F.lower(F.substring_index("rule", "/", 1))
    own = rules.select("rule", "verdict", rule_host.alias("_host"), F.concat(F.lit("/"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 2)")).alias("_path"))
    split = pages.select(F.col(id_column), host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    urls = split.where("host != ''").select("host", "path").distinct()
    lengths = own.groupBy("_host").agg(F.collect_set(F.length("_path")).alias("_lengths"))
    near = urls.withColumn("_host", F.explode(above)).join(lengths, "_host")
    cut = near.withColumn("_n", F.explode(F.filter("_lengths", lambda n: n <= F.length("path")))).withColumn("_path", F.expr("substring(path, 1, _n)"))
    rank = F.struct(F.size(F.split("_host", r"\.")), F.length("_path"), (F.col("verdict") == BLOCK), F.col("rule"), F.col("verdict"))
    best = cut.join(own, ["_host", "_path"]).groupBy("host", "path").agg(F.max(rank).alias("_best"))
    return split.join(best, ["host", "path"], "left").select(id_column, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


#: The rules of the registered query.
QUERY_RULES = [("org/", ALLOW), ("example.org/es/", BLOCK), ("example.org/en/1", BLOCK), ("com/fr/", ALLOW), ("com/de/", BLOCK)]

ORACLE_SQL = """
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path from pages),
r as (select *, case
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
      when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
      when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
      when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/' end as rule from u)
select page_id, host, path, rule, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict from r
"""
