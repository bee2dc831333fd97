"""URL filters: allow and block rules in a trie over reversed host labels, then path text; the longest match decides."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULE_BYTES = 64 << 20  # the largest rule set that is broadcast; a larger one is refused


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str  # allow or block

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of query op2.
RULES = (Rule("com", "/en/", "block"), Rule("example.com", "/en/7", "allow"), Rule("net", "/de/", "allow"), Rule("example.net", "/de/8", "block"), Rule("org", "/es/", "block"))


class Trie:
    """Host labels from the right, then whole path segments, then what a rule has of its last, open segment.

    A rule fits its host and every subdomain if the path starts with the rule's. Among rules that fit, more
    host labels win, then the longer path; of two equal rules block wins.
    """

    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        for rule in sorted(rules, key=lambda r: r.verdict == "block"):
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.setdefault("hosts", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *closed, rest = rule.path.split("/")
            for segment in closed:
                node = node.setdefault("next", {}).setdefault(segment, {})
            node.setdefault("open", {})[rest] = rule

    @staticmethod
    def _on_path(node: dict, segments: Sequence[str]) -> Rule | None:
        best = None
        for i, segment in enumerate(segments):
            for rest in sorted(node.get("open", ()), key=len, reverse=True):
                if segment.startswith(rest):
                    best = node["open"][rest]
                    break
            node = node.get("next", {}).get(segment) if i + 1 < len(segments) else None
            if node is None:
                return best
        return best

    def match(self, host: str, path: str) -> Rule | None:
        segments, best, node = path.split("/"), None, self.root
        for label in (None, *reversed(host.split("."))):
            if label is not None:
                node = node.get("hosts", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                best = self._on_path(node["paths"], segments) or best
        return best


def host_and_path(url: str = "url") -> tuple:
    """Columns host and path. Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end."""
    u = F.col(url)
    found = F.instr(u, "://")
    rest = F.when(found > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row: the verdict of the longest rule that fits, else default.

    A url that is null or has no :// has an empty host and path, and so the default unless a rule is as empty.
    Empty tables, repeated rows and null keys give rows as they come; other columns are not read.
    """
    spark = pages.sparkSession
    if sum(len(r.name.encode()) + 64 for r in rules) > RULE_BYTES:
        raise ValueError(f"more than {RULE_BYTES} bytes of rules")
    trie = spark.sparkContext.broadcast(Trie(rules))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [trie.value.match(h, p) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in (key, "host", "path")), pa.array([r and r.name for r in found], pa.string()), pa.array([r.verdict if r else default for r in found], pa.string())],
                [key, "host", "path", "rule", "verdict"],
            )

    parts = pages.select(key, *host_and_path(url))
    return parts.mapInArrow(judge, f"{key} {dict(pages.dtypes)[key]}, host string, path string, rule string, verdict string")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC NULLS LAST) AS rn
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rhost || rpath AS rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""
