"""URL rules as a sort-merge range join: reversed-host keys, and one sweep with a stack of nested rules."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRuleParams:
    default: str = "allow"
    #: Rules that one sweep holds; more are swept in several blocks.
    block: int = 200_000


def url_parts(url) -> tuple:
    """(host, path) columns: host is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def reversed_key(host) -> object:
    """``a.b.com`` as ``com.b.a.``: a host and its subdomains are one interval of keys."""
    return F.concat_ws(".", F.reverse(F.split(host, r"\.", -1)), F.lit(""))


class Sweep:
    """Ascending keys against rules sorted by key; the stack holds the rule hosts that enclose the current key."""

    def __init__(self, rules: list[tuple[str, str, str, str]]):
        """rules: (key, path, rule text, verdict)."""
        by: dict[bytes, list[tuple[str, str, str]]] = {}
        for key, path, text, verdict in rules:
            by.setdefault(key.encode(), []).append((path, text, verdict))
        self._keys = sorted(by)
        # Of rules with equal texts' length the first in order of (text, verdict) counts.
        self._rules = [sorted(by[k], key=lambda r: (-len(r[1]), r[1], r[2])) for k in self._keys]
        self._next, self._stack, self._at = 0, [], b""

    def enter(self, key: bytes) -> None:
        """Start in the middle: push the rule hosts that enclose ``key``."""
        self._stack = []
        for end in [i + 1 for i, c in enumerate(key) if c == 46]:
            j = bisect_right(self._keys, key[:end]) - 1
            if j >= 0 and self._keys[j] == key[:end]:
                self._stack.append(j)
        self._next, self._at = bisect_right(self._keys, key), key

    def match(self, key: bytes, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits."""
        if key < self._at or not self._at:
            self.enter(key)
        self._at = key
        while self._next < len(self._keys) and self._keys[self._next] <= key:
            new = self._keys[self._next]
            while self._stack and not new.startswith(self._keys[self._stack[-1]]):
                self._stack.pop()
            self._stack.append(self._next)
            self._next += 1
        while self._stack and not key.startswith(self._keys[self._stack[-1]]):
            self._stack.pop()
        best = None
        for j in reversed(self._stack):
            for start, text, verdict in self._rules[j]:
                if best and len(text) <= len(best[0]):
                    break
                if path.startswith(start):
                    best = (text, verdict)
                    break
        return best


def _swept(rules: list[tuple[str, str, str, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(rules)
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            old = zip(columns["rule"].to_pylist(), columns["verdict"].to_pylist(), strict=True)
            found = []
            for key, path, (rule, verdict) in zip(columns["key"].to_pylist(), columns["path"].to_pylist(), old, strict=True):
                hit = sweep.match(key.encode(), path)
                if hit and (rule is None or (-len(hit[0]), *hit) < (-len(rule), rule, verdict)):
                    rule, verdict = hit
                found.append((rule, verdict))
            columns["rule"] = pa.array([r for r, _ in found], pa.string())
            columns["verdict"] = pa.array([v for _, v in found], pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, params: UrlRuleParams = UrlRuleParams()) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of ``pages`` (page_id, url).

    ``rules`` has host, path, verdict.  A rule fits its host and all subdomains where
    the url's path starts with the rule's; the longest rule text (host + path) wins, of
    equal ones the first by text, then verdict.  Pages are range-partitioned by reversed
    host, path and id, so a hot host is spread over tasks, and swept in key order; each
    task enters the sorted rules at its first key.  Rules beyond ``block`` are swept in
    further passes and the longer rule kept, so no task or driver step holds more.

    A null url, or one without ``://``, has an empty host and path, fits no rule and gets
    the default.  Rules with a null host, path or verdict are left out; an empty rule
    host fits no page.  Repeated rows and rules are judged alike.  Other columns are not
    read.  No pages give an empty result, no rules the default.
    """
    host, path = url_parts(F.col("url"))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    page = page.select("page_id", "host", "path", F.when(F.col("host") != "", reversed_key(F.col("host"))).otherwise("").alias("key"))
    kept = rules.select(F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"), F.col("path").cast("string").alias("path"), F.col("verdict").cast("string").alias("verdict"))
    kept = kept.dropna().filter("host <> ''").distinct()
    kept = kept.select(reversed_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("text"), "verdict")
    blocks = max(1, -(-kept.count() // params.block))
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "path", "page_id"]
    out = page.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(None).cast("string")})
    out = out.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    if blocks > 1:
        kept = materialize(kept.withColumn("block", F.pmod(F.xxhash64("key", "path"), F.lit(blocks))), "url-rules")
    for b in range(blocks):
        own = kept if blocks == 1 else kept.filter(F.col("block") == b).drop("block")
        held = [tuple(r) for r in own.orderBy("key", "path", "verdict").collect()]  # about ``block`` rules
        out = out.mapInArrow(_swept(held), out.schema)
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(params.default)).alias("verdict"))
