"""URL filters: a trie over reversed host labels and path segments, broadcast, with longest-match precedence.

A rule is (verdict, host, path). It fits its host and all subdomains, if the url's path starts with the rule's path. Of the
rules that fit, the one with the most host labels wins, then the one with the longest path; of equal rules, block wins.

Cases: a null url, or one without `://`, has an empty host and path. Empty host labels count as labels. Urls that no rule
fits get the default verdict. Repeated rows are judged each for itself, an empty table gives an empty result, and other
columns pass through untouched (the operator appends its own last, dropping input columns of the same names).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: The broadcast trie is as large as the rules, so their number is bounded.
MAX_RULES = 1_000_000

Rule = tuple[str, str, str]


@dataclass
class _Node:
    labels: dict[str, _Node] = field(default_factory=dict)
    paths: _Path | None = None


@dataclass
class _Path:
    """segments: rules go on after a whole segment. ends: (start of the next segment, verdict, rule)."""

    segments: dict[str, _Path] = field(default_factory=dict)
    ends: list[tuple[str, str, str]] = field(default_factory=list)


class RuleTrie:
    def __init__(self, rules: list[Rule]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are broadcast")
        self.root = _Node()
        for verdict, host, path in sorted(rules):  # allow before block: a later equal rule replaces
            node = self.root
            for label in reversed(host.lower().split(".")):
                node = node.labels.setdefault(label, _Node())
            node.paths = at = node.paths or _Path()
            *whole, rest = path.split("/")
            for segment in whole:
                at = at.segments.setdefault(segment, _Path())
            at.ends = sorted([e for e in at.ends if e[0] != rest] + [(rest, verdict, host + path)], key=lambda e: len(e[0]))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        best, node = None, self.root
        for label in reversed(host.split(".")):
            node = node.labels.get(label)
            if node is None:
                break
            if node.paths is not None:
                best = self._path(node.paths, path) or best
        return best

    @staticmethod
    def _path(at: _Path, path: str) -> tuple[str, str] | None:
        best, segments = None, path.split("/")
        for i, segment in enumerate(segments):
            for rest, verdict, rule in at.ends:
                if segment.startswith(rest):
                    best = verdict, rule
            if i + 1 == len(segments) or (at := at.segments.get(segment)) is None:
                break
        return best


def url_parts(url):
    """Host (A-Z lower-cased) and path as columns."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def judge_urls(df: DataFrame, rules: list[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict. Nothing is shuffled; each task walks the broadcast trie."""
    trie = df.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judge(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple[str, str] | None] = {}
        out = []
        for key in zip(host, path, strict=True):
            if key not in known:
                known[key] = trie.value.find(*key)
            verdict, rule = known[key] or (default, None)
            out.append((rule, verdict))
        return pd.DataFrame(out, columns=["rule", "verdict"])

    host, path = url_parts(F.col(url))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parts = df.withColumns({"__host": host, "__path": path}).withColumn("__judged", judge("__host", "__path"))
    return parts.select(*(F.col(c) for c in kept), F.col("__host").alias("host"), F.col("__path").alias("path"), "__judged.rule", "__judged.verdict")


#: Rules of the query: (verdict, host, path).
RULES: list[Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
)
SELECT page_id, host, path,
       CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
            WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
            WHEN ('.' || host) LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/'
            WHEN ('.' || host) LIKE '%.com' AND path LIKE '/%' THEN 'com/' END AS rule,
       CASE WHEN ('.' || host) LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'allow'
            WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/en/%' THEN 'block'
            WHEN ('.' || host) LIKE '%.net' AND (path LIKE '/es/%' OR path LIKE '/fr/%') THEN 'block'
            ELSE 'allow' END AS verdict
FROM cut
"""
