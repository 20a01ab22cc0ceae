"""URL filters: pattern rules found by their rarest literal token.

A rule is a regular expression over ``host`` + ``path`` and the literal
tokens that every match contains.  The rules are indexed by the token that
is rarest among all rules.  A URL's tokens fetch the rules filed under them,
and only these are run.  Rules without a token are tried on every URL.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, stored, with_fields

_TOKEN = re.compile(r"[^./\-_~%&=+,;:@!$'()*\[\]|]+")
#: So many are broadcast at once; of more, each part takes a pass of its own.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int  # of the rules that fit, the greatest wins; then the first


def domain_rule(rule: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains and paths that start with the rule's."""
    host, _, path = rule.partition("/")
    pattern = rf"(?:[^/]*\.)?{re.escape(host)}{re.escape('/' + path)}"
    # a path may go on after the rule's last token, so only closed tokens are certain
    closed = _TOKEN.findall(path[: path.rfind("/") + 1])
    return Rule(rule, verdict, pattern, (*_TOKEN.findall(host), *closed), len(rule))


class RuleIndex:
    """Rules by their rarest token; ``first`` is the number of the first one."""

    def __init__(self, rules: list[Rule], default: str = "allow", first: int = 0):
        self.default = default
        counts = Counter(t for r in rules for t in set(r.tokens))
        self._by_token: dict[str, list] = {}
        self._always: list = []
        for k, r in enumerate(rules, first):
            entry = (r.weight, -k, re.compile(r.pattern), r)
            if r.tokens:
                self._by_token.setdefault(min(r.tokens, key=lambda t: (counts[t], t)), []).append(entry)
            else:
                self._always.append(entry)

    def best(self, host: str, path: str) -> tuple[int, int, Rule] | None:
        """Weight, number and rule of the winner."""
        url = host + path
        candidates = [*self._always, *(e for t in {*_TOKEN.findall(url)} if t in self._by_token for e in self._by_token[t])]
        fits = [e for e in candidates if e[2].match(url)] if host else []
        weight, number, _, rule = max(fits, key=lambda e: e[:2], default=(0, 0, None, None))
        return (weight, -number, rule) if rule else None

    def judge(self, host: str, path: str) -> tuple[str | None, str]:
        """The winning rule's name (or None) and the verdict."""
        found = self.best(host, path)
        return (found[2].name, found[2].verdict) if found else (None, self.default)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _judge(batches: Iterator[pa.RecordBatch], task: int, index) -> Iterator[pa.RecordBatch]:
    """Puts the winner of these rules where it is better than that so far."""
    best = index.value.best
    kinds = {"rule": pa.string(), "verdict": pa.string(), "_weight": pa.int64(), "_number": pa.int64()}
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in kinds), strict=True))
        for n, (host, path) in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True)):
            if found := best(host, path):
                weight, number, rule = found
                if rows[n][2] is None or (weight, -number) > (rows[n][2], -rows[n][3]):
                    rows[n] = (rule.name, rule.verdict, weight, number)
        new = dict(zip(kinds, zip(*rows, strict=True), strict=True)) if rows else {c: [] for c in kinds}
        yield pa.record_batch([pa.array(new[c], kinds[c]) if c in kinds else batch.column(c) for c in batch.schema.names], names=batch.schema.names)


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", url: str = "url", max_rules: int = MAX_RULES) -> DataFrame:
    """The rows with host, path, rule and verdict, judged without a shuffle.

    Null URLs and those without :// have an empty host and path, no rule and
    the default verdict.  Of the rules that fit, the one of greatest weight
    wins, then the earlier.  Repeated rows are judged each; columns of the
    four names are replaced.  Of more than ``max_rules`` rules, so many are
    broadcast at a time, and the rows are stored between.
    """
    context = pages.sparkSession.sparkContext
    split = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))}).drop("rule", "verdict", "_weight", "_number")
    nothing = {"rule": "string", "verdict": "string", "_weight": "long", "_number": "long"}
    out = split.withColumns({c: F.lit(None).cast(kind) for c, kind in nothing.items()})
    for first in range(0, max(1, len(rules)), max_rules):
        index = context.broadcast(RuleIndex(rules[first : first + max_rules], default, first))
        out = map_batches(out, partial(_judge, index=index), with_fields(split.schema, **nothing))
        if first + max_rules < len(rules):
            out = stored(out, "judged")
            index.unpersist()
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default))).drop("_weight", "_number")
