"""Allow and block rules for URLs, indexed by their rarest literal token.

A rule names a host and the beginning of a path; it fits that host and all its subdomains. Every rule is filed under one
of its literal tokens, the one found in the fewest URLs of the table; a URL fetches the rules filed under its own tokens,
and only those run as regular expressions, the longest first. Rules without a whole token are candidates of every URL.

The rules are cut into blocks of bounded size in the order in which they win. A block is broadcast, and a later block only
looks at the URLs that no earlier one decided, so a rule list of any size is applied without ever being in one task whole.

URLs that are null or without ``://`` have an empty host and path, which no rule with a host fits. Repeated rows are judged
each on their own; an empty table gives an empty table; columns named like an output are replaced, others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm import common
from quarry.session import materialize

#: Characters of rules in one broadcast block, all tokens and patterns included about 20 times as many bytes in a task.
BLOCK_CHARS = 1 << 21

_HOST_PATH = re.compile(r"([^/?#]*)([^?#]*)")
_PATH_TOKEN = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """``action`` for the URLs of ``host`` and its subdomains whose path starts with ``path``.

    The host is in lower case; an empty one stands for every host. With ``wildcards`` a ``*`` in the path is any run of
    characters and a ``$`` at its end is the end of the path.
    """

    action: str
    host: str
    path: str
    wildcards: bool = False

    @property
    def text(self) -> str:
        return self.host + self.path

    def pattern(self) -> re.Pattern:
        """The expression that host and path, written together, must match from the beginning."""
        host = rf"(?:[^/]*\.)?{re.escape(self.host)}(?=/|\Z)" if self.host else "[^/]*"
        path = re.escape(self.path)
        if self.wildcards:
            path = ".*".join(re.escape(part) for part in self.path.removesuffix("$").split("*"))
            path += r"\Z" if self.path.endswith("$") else ""
        return re.compile(host + path, re.DOTALL)

    def tokens(self) -> set[str]:
        """Tokens that every URL which the rule fits has: labels of the host, and words of the path that the rule itself
        ends on both sides."""
        found = {"." + label for label in self.host.split(".") if label}
        path = self.path
        for m in _PATH_TOKEN.finditer(path):
            before, after = path[m.start() - 1:m.start()], path[m.end():m.end() + 1]
            closed = bool(after) and not (self.wildcards and (after == "*" or before == "*"))
            if closed:
                found.add(m.group())
        return found


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host with A-Z in lower case, and path; both empty without ``://``."""
    rest = (url or "").partition("://")
    if not rest[1]:
        return "", ""
    host, path = _HOST_PATH.match(rest[2]).groups()
    return host.lower() if host.isascii() else host.translate(_LOWER), path


def url_tokens(host: str, path: str) -> set[str]:
    return {"." + label for label in host.split(".") if label}.union(_PATH_TOKEN.findall(path))


def token_counts(urls: DataFrame, tokens: Sequence[str], column: str = "url") -> dict[str, int]:
    """In how many rows of ``urls`` each of the given tokens occurs; all rows are counted, one sum per task is sent."""
    spark = urls.sparkSession
    place = spark.sparkContext.broadcast({t: i for i, t in enumerate(tokens)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = place.value, None
        for batch in batches:
            sums = np.zeros(len(index), np.int64) if sums is None else sums
            for url in batch.column(0).to_pylist():
                for token in url_tokens(*host_and_path(url)):
                    at = index.get(token)
                    if at is not None:
                        sums[at] += 1
        if sums is not None:
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["token", "n"])

    counted = urls.select(F.col(f"`{column}`").cast("string").alias("url")).mapInArrow(count, "token long, n long")
    out = dict.fromkeys(tokens, 0)
    for row in counted.groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator():
        out[tokens[row["token"]]] = row["n"]
    place.unpersist()
    return out


def in_order(rules: Sequence[Rule]) -> list[Rule]:
    """The order in which rules win: longest host and path together, then longest host, then block, then as given."""
    return sorted(dict.fromkeys(rules), key=lambda r: (-len(r.text), -len(r.host), r.action != "block"))


def blocks(rules: Sequence[Rule], limit: int = BLOCK_CHARS) -> Iterator[list[Rule]]:
    """Runs of rules with at most ``limit`` characters, or one longer rule."""
    block: list[Rule] = []
    size = 0
    for rule in rules:
        if block and size + len(rule.text) > limit:
            yield block
            block, size = [], 0
        block.append(rule)
        size += len(rule.text)
    if block:
        yield block


def index_by_rarest(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by the rarest token of each rule, and the numbers of rules without one."""
    filed: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        tokens = rule.tokens()
        if tokens:
            filed.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return filed, always


class Judge:
    """The rules of one block with their index; patterns are compiled when a URL first fetches them."""

    def __init__(self, rules: Sequence[Rule], counts: dict[str, int]):
        self.rules = list(rules)
        self.filed, self.always = index_by_rarest(self.rules, counts)
        self.compiled: dict[int, re.Pattern] = {}

    def candidates(self, host: str, path: str) -> list[int]:
        found = list(self.always)
        for token in url_tokens(host, path):
            found += self.filed.get(token, ())
        return sorted(found)

    def find(self, host: str, path: str) -> Rule | None:
        """The first rule in order that fits."""
        address = host + path
        for i in self.candidates(host, path):
            if i not in self.compiled:
                self.compiled[i] = self.rules[i].pattern()
            if self.compiled[i].match(address):
                return self.rules[i]
        return None


_FIELDS = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]


def judge(urls: DataFrame, rules: Sequence[Rule], column: str = "url", otherwise: str = "allow", limit: int = BLOCK_CHARS) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule`` (text of the rule that decides, or null) and ``verdict`` (its action, or
    ``otherwise``: without a rule nothing speaks against a URL)."""
    spark = urls.sparkSession
    runs = list(blocks(in_order(rules), limit)) or [[]]
    out = urls
    for number, block in enumerate(runs):
        tokens = sorted(set().union(*[r.tokens() for r in block]))
        counts = token_counts(urls, tokens, column) if tokens else {}
        shared = spark.sparkContext.broadcast(Judge(block, counts))

        def work(batch: pa.RecordBatch, shared=shared, first=number == 0):
            names = batch.schema.names
            places = [host_and_path(url) for url in batch.column(names.index(column)).to_pylist()]
            rows = [(None, otherwise)] * len(places) if first else list(zip(*[batch.column(names.index(c)).to_pylist() for c in ("rule", "verdict")]))
            judged = shared.value
            for i, (host, path) in enumerate(places):
                if rows[i][0] is None:
                    rule = judged.find(host, path)
                    if rule:
                        rows[i] = (rule.text, rule.action)
            both = [*zip(*places)] + [*zip(*rows)]
            return [pa.array(values, pa.string()) for values in both]

        decided = ["rule", "verdict"] if number else []
        out = common.append(out, column, _FIELDS, work, using=decided)
        if number < len(runs) - 1:
            out = materialize(out, "judged")
    return out
