"""URL rules in a trie over reversed host labels and then path segments; the longest rule that fits wins."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import free_name

RULES_PER_BLOCK = 500_000


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str
    path: str = "/"


def parse_rule(verdict: str, text: str) -> Rule:
    """``net/es/`` -> host ``net``, path ``/es/``."""
    host, slash, path = text.partition("/")
    return Rule(verdict, host.translate(_LOWER), slash + path)


_AUTHORITY = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty for null or where ``://`` is missing."""
    found = _AUTHORITY.search(url) if url else None
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


class _PathNode:
    __slots__ = ("segments", "tails")

    def __init__(self):
        self.segments: dict[str, _PathNode] = {}
        self.tails: dict[str, tuple[str, str]] = {}  # start of the next segment -> verdict, rule


class _HostNode:
    __slots__ = ("labels", "paths")

    def __init__(self):
        self.labels: dict[str, _HostNode] = {}
        self.paths: _PathNode | None = None


class Trie:
    """Rules under reversed host labels, below each host under whole path segments and the start of one more.

    A deeper host wins over a shallower one, then a longer path over a shorter one; of equal rules block wins.
    """

    def __init__(self, rules: Sequence[Rule]):
        self.root = _HostNode()
        for rule in rules:
            self.add(rule)

    def add(self, rule: Rule) -> None:
        host = self.root
        for label in reversed(rule.host.split(".")) if rule.host else ():
            host = host.labels.setdefault(label, _HostNode())
        if host.paths is None:
            host.paths = _PathNode()
        *whole, tail = rule.path.split("/")
        at = host.paths
        for segment in whole:
            at = at.segments.setdefault(segment, _PathNode())
        if at.tails.get(tail, ("allow", ""))[0] != "block":
            at.tails[tail] = (rule.verdict, rule.host + rule.path)

    def find(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """Host labels, path length, verdict and text of the longest rule that fits."""
        best, at, depth = None, self.root, 0
        segments = path.split("/")
        labels = reversed(host.split(".")) if host else iter(())
        while at is not None:
            if at.paths is not None and (found := self._longest(at.paths, segments)):
                best = (depth, *found)
            at, depth = at.labels.get(next(labels, None)), depth + 1
        return best

    @staticmethod
    def _longest(node: _PathNode, segments: list[str]) -> tuple[int, str, str] | None:
        best, used = None, 0
        for segment in segments:
            for tail, (verdict, rule) in node.tails.items():
                if segment.startswith(tail) and (best is None or used + len(tail) >= best[0]):
                    best = (used + len(tail), verdict, rule)
            node = node.segments.get(segment)
            if node is None:
                break
            used += len(segment) + 1
        return best


_SCHEMA = "host string, path string, labels int, length int, verdict string, rule string"


def judge(
    pages: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow",
    rules_per_block: int = RULES_PER_BLOCK,
) -> DataFrame:
    """``pages`` plus host, path, rule (null if none fits) and verdict (the rule's, else ``default``).

    - A rule fits its host and all subdomains where the url's path starts with the rule's path.
    - A null url, or one without ``://``, has an empty host and path; only a rule without host and path fits it.
    - Very long urls are read whole. Repeated rows are judged alike; an empty table gives no rows.
    - Result columns whose names ``pages`` has already get leading underscores.

    A broadcast trie holds at most ``rules_per_block`` rules. Longer lists are judged block by block in one pass over the
    pages, and the longest of the blocks' answers counts.
    """
    context = pages.sparkSession.sparkContext
    blocks = [rules[i:i + rules_per_block] for i in range(0, len(rules), rules_per_block)] or [[]]

    def judge_block(block: Sequence[Rule]) -> Column:
        sent = context.broadcast(Trie(block))

        @F.pandas_udf(_SCHEMA)
        def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            trie = sent.value
            for urls in batches:
                rows = []
                for value in urls:
                    host, path = split_url(value)
                    labels, length, verdict, rule = trie.find(host, path) or (-1, -1, None, None)
                    rows.append((host, path, labels, length, verdict, rule))
                yield pd.DataFrame(rows, columns=["host", "path", "labels", "length", "verdict", "rule"])

        return judged(F.col(url))

    held = [free_name(pages.columns, f"judged_{i}") for i in range(len(blocks))]
    judged = pages.withColumns({name: judge_block(block) for name, block in zip(held, blocks)})
    # Structs compare field by field: deeper host, longer path, then block over allow.
    answers = [
        F.struct(*[F.col(name)[c].alias(c) for c in ("labels", "length", "verdict", "rule", "host", "path")]) for name in held
    ]
    best = F.greatest(*answers) if len(answers) > 1 else answers[0]
    names = {n: free_name(pages.columns, n) for n in ("host", "path", "rule", "verdict")}
    answer = free_name(pages.columns, "answer")
    field = lambda name: F.col(answer)[name]
    return judged.withColumn(answer, best).select(
        *[F.col(f"`{c}`") for c in pages.columns], *[field(n).alias(names[n]) for n in ("host", "path", "rule")],
        F.coalesce(field("verdict"), F.lit(default)).alias(names["verdict"]),
    )
