"""URL allow and block lists by longest match (operator 9).

The rules form a trie: host labels from the right, then path segments.  A
rule fits its host and every subdomain, where the path starts with the
rule's path; of all that fit the longest (characters of host and path, then
number of host labels) decides.  The trie is broadcast only up to
``max_broadcast_rules`` rules; longer lists are joined on (host suffix,
leading path segments) instead, which gives the same rows.

Null urls and urls without ``://`` have an empty host and path, which only a
rule with an empty host would fit; there are none, so they get the default
verdict and a null rule.  Very long urls are walked whole, repeated ones are
judged alike, an empty table gives an empty table, and other columns pass
unchanged unless named host, path, rule or verdict: those are replaced.
The name _barwright_rule is reserved.  Of equally long rules the one with
more host labels wins, of equal ones block.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

RULES_SCHEMA = "rule string, verdict string"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def parse_rule(verdict: str, text: str) -> Rule:
    """``example.com/en/7`` -> host and path; host letters A-Z are lowered."""
    if verdict not in ("allow", "block"):
        raise ValueError(f"verdict is allow or block, not {verdict!r}")
    host, slash, rest = text.partition("/")
    if not host:
        raise ValueError("a rule needs a host")
    return Rule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + rest)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _better(a: Rule | None, b: Rule | None) -> Rule | None:
    """The longer rule; of two equal texts block wins."""
    if a is None or b is None:
        return a or b
    rank = lambda r: (len(r.text), r.host.count("."), r.verdict == "block")
    return a if rank(a) >= rank(b) else b


class UrlTrie:
    """Host labels from the right; at each host a trie of path segments.

    A rule's last segment may be cut inside a segment of the url, so it is
    kept at its node as a beginning, by length.
    """

    def __init__(self, rules: list[Rule]):
        self.root: dict = {"labels": {}}
        for r in rules:
            node = self.root
            for label in reversed(r.host.split(".")):
                node = node["labels"].setdefault(label, {"labels": {}})
            if not r.path:
                node["whole"] = _better(node.get("whole"), r)
                continue
            *full, begun = r.path[1:].split("/")
            at = node.setdefault("paths", {"segments": {}, "begun": {}})
            for s in full:
                at = at["segments"].setdefault(s, {"segments": {}, "begun": {}})
            same = at["begun"].setdefault(len(begun), {})
            same[begun] = _better(same.get(begun), r)

    def longest(self, host: str, path: str) -> Rule | None:
        best, node = None, self.root
        segments = path[1:].split("/") if path else []
        for label in reversed(host.split(".")):
            node = node["labels"].get(label)
            if node is None:
                break
            best = _better(best, node.get("whole"))
            at = node.get("paths")
            for s in segments:
                if at is None:
                    break
                for n, begun in at["begun"].items():
                    best = _better(best, begun.get(s[:n]) if len(s) >= n else None)
                at = at["segments"].get(s)
        return best


def _by_trie(df: DataFrame, rules: list[Rule]) -> DataFrame:
    trie = df.sparkSession.sparkContext.broadcast(UrlTrie(rules))

    @F.pandas_udf(RULES_SCHEMA)
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        t = trie.value
        for hosts, paths in batches:
            found = [t.longest(h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame(
                {"rule": [r.text if r else None for r in found], "verdict": [r.verdict if r else None for r in found]},
                dtype=object,
            )

    return df.withColumn("_barwright_rule", judge("host", "path"))


def _by_join(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Every (host suffix, leading segments) of each distinct host and path meets the rules by equality."""
    rows = [(r.text, r.verdict, r.host, "/".join(r.path.split("/")[:-1]), r.path) for r in rules]
    listed = df.sparkSession.createDataFrame(rows, "rule string, verdict string, _h string, _lead string, _p string")
    urls = df.where("host <> ''").select("host", "path").distinct()
    labels, segments = F.split("host", r"\."), F.split("path", "/")
    keys = urls.select(
        "host", "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("_h"),
    ).select(
        "host", "path", "_h",
        F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(segments) - 1, F.lit(0))), lambda i: F.array_join(F.slice(segments, F.lit(1), i), "/")))).alias("_lead"),
    )
    rank = F.struct(F.length("rule"), F.size(F.split("_h", r"\.")), F.col("verdict") == "block")
    found = (
        keys.join(listed, ["_h", "_lead"])
        .where(F.expr("startswith(path, _p)"))
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_barwright_rule"))
    )
    # Urls without a host have no rule to meet, and may be very many.
    none = df.where("host = ''").withColumn("_barwright_rule", F.lit(None).cast("struct<rule: string, verdict: string>"))
    return df.where("host <> ''").join(found, ["host", "path"], "left").select(*none.columns).unionByName(none)


def filter_urls(
    pages: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow", max_broadcast_rules: int = 200_000
) -> DataFrame:
    """Adds host, path, rule (null: none fits) and verdict to every row."""
    df = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    df = _by_trie(df, rules) if len(rules) <= max_broadcast_rules else _by_join(df, rules)
    return df.withColumns(
        {"rule": F.col("_barwright_rule.rule"), "verdict": F.coalesce(F.col("_barwright_rule.verdict"), F.lit(default))}
    ).drop("_barwright_rule")
