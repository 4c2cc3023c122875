"""URL allow and block lists as a trie over reversed host labels and path segments.

A rule (action, host, path) fits a url whose host is the rule's or a subdomain of it and whose path starts with the
rule's path. The trie is walked from the top-level label down, then along whole path segments; the last, perhaps
partial, segment of a rule is a key of its node, looked up by each length that such keys have there. The deepest fit
wins: more host labels first, then the longer path; allow and block of the very same host and path: block wins. Rules
are configuration, so the broadcast trie's size doesn't follow the data; `MAX_RULES` and `MAX_LETTERS` check it, and
larger lists raise ValueError.

Defined cases: a null url, or one without `://`, has an empty host and path and no rule; repeated urls are judged
row by row; very long urls are split and walked whole, in time of their length; an empty table gives an empty result;
extra columns, whatever their names, are left out by url_verdicts; a key that is named like a result raises ValueError.
"""

from __future__ import annotations

from bisect import insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataline.llm.common import map_batches

#: The contract's rules: action, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MAX_RULES = 1_000_000
MAX_LETTERS = 64_000_000
RESULTS = ("host", "path", "rule", "verdict")
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Node:
    """labels: child nodes by host label. segments: child nodes by whole path segment.

    ends: (rule, action) by the start of the next segment. lengths: of these starts, the longest first.
    """

    __slots__ = ("ends", "labels", "lengths", "segments")

    def __init__(self) -> None:
        self.labels: dict[str, Node] = {}
        self.segments: dict[str, Node] = {}
        self.ends: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []

    def longest(self, text: str) -> tuple[str, str] | None:
        """(rule, action) of the longest start of text that ends here."""
        for length in self.lengths:
            if length <= len(text) and (found := self.ends.get(text[:length])):
                return found
        return None


def build_trie(rules) -> Node:
    """The trie of (action, host, path) rules; a path is '' or begins with '/'."""
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES}")
    if sum(len(host) + len(path) for _, host, path in rules) > MAX_LETTERS:
        raise ValueError(f"the rules have more than {MAX_LETTERS} letters")
    root = Node()
    for action, host, path in rules:
        if action not in ("allow", "block") or (path and not path.startswith("/")):
            raise ValueError(f"bad rule: {action} {host}{path}")
        node = root
        for label in reversed(host.translate(ASCII_LOWER).split(".")):
            node = node.labels.setdefault(label, Node())
        *whole, last = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Node())
        if node.ends.get(last, ("", ""))[1] != "block":
            node.ends[last] = (host.translate(ASCII_LOWER) + path, action)
        if len(last) not in node.lengths:
            insort(node.lengths, len(last), key=lambda n: -n)
    return root


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((i for i in (rest.find("/"), rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, path = rest[:cut].translate(ASCII_LOWER), rest[cut:]
    cut = min((i for i in (path.find("?"), path.find("#")) if i >= 0), default=len(path))
    return host, path[:cut]


def _in_paths(node: Node, path: str) -> tuple[str, str] | None:
    """The rule with the longest path under this host node."""
    trail, at = [(node, path)], 0
    while node.segments and (end := path.find("/", at)) >= 0:
        node = node.segments.get(path[at:end])
        if node is None:
            break
        at = end + 1
        trail.append((node, path[at:]))
    for node, rest in reversed(trail):
        if found := node.longest(rest):
            return found
    return None


def longest_match(root: Node, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, action) of the deepest fit, or (None, None)."""
    if not host:
        return None, None
    node, trail = root, []
    for label in reversed(host.split(".")):
        node = node.labels.get(label)
        if node is None:
            break
        trail.append(node)
    for node in reversed(trail):
        if (node.ends or node.segments) and (found := _in_paths(node, path)):
            return found
    return None, None


def url_verdicts(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, default: str = "allow") -> DataFrame:
    """key, host, path, rule (null without a fit) and verdict (the rule's action, else default) of every row."""
    if key in RESULTS:
        raise ValueError(f"the key can't be named {key}")
    root = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths, found, verdicts = [], [], [], []
        for value in batch.column(1).to_pylist():
            host, path = split_url(value)
            rule, action = longest_match(root.value, host, path)
            hosts.append(host)
            paths.append(path)
            found.append(rule)
            verdicts.append(action or default)
        columns = [batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, found, verdicts))]
        return pa.RecordBatch.from_arrays(columns, names=["key", "host", "path", "rule", "verdict"])

    pairs = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"))
    return map_batches(pairs, judge, "key long, host string, path string, rule string, verdict string").withColumnRenamed("key", key)


#: DuckDB SQL of url_verdicts over pages with the contract's rules.
ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
r(host, path, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT h.page_id, arg_max(r.host || r.path, length(r.host) * 1000 + length(r.path)) AS rule, arg_max(r.action, length(r.host) * 1000 + length(r.path)) AS action
  FROM h JOIN r ON (h.host = r.host OR ends_with(h.host, '.' || r.host)) AND starts_with(h.path, r.path) GROUP BY h.page_id)
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)
"""
