"""URL filtering by pattern rules that are indexed by their rarest literal token (built-in functions only).

A rule names an action, a host (with all its subdomains) and a path prefix.  Its complete tokens are the
labels of its host and the segments of its path that a slash ends; the token that fewest rules have is its
key in the index.  A url's tokens fetch candidate rules, and only those run their regular expression.

Rules are configuration, a list on the driver, so the index is a literal in the plan and no join or shuffle is needed.
It is dealt into as many slots as there are keys by the CRC-32 of the token, so what a url costs depends on its own
tokens and candidates and not on the number of rules.

Defined cases: a null url or one without "://" has empty host and path and no rule; very long urls are read whole;
repeated rows give repeated results; ties of length go to the rule that is listed first; a rule without a slash fits its
host with any path; an empty table gives no rows; other columns of the input are kept, but those with the names of the results.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import free


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        """For host and path in one; a host has no slash, and a path that is not empty begins with one."""
        return rf"\A(?:[^/]*\.)?{re.escape(self.host)}" + (re.escape(self.path) if self.path else r"(?:/|\z)")

    def tokens(self) -> list[str]:
        return ["h:" + x for x in self.host.split(".")] + ["p:" + x for x in self.path.split("/")[1:-1]]


def parse_rule(line: str) -> Rule:
    """`action host/path`."""
    action, _, pattern = line.partition(" ")
    host, slash, path = pattern.partition("/")
    return Rule(action, host.lower(), slash + path)


def rarest_tokens(rules: list[Rule]) -> dict[str, list[int]]:
    """Index: token to the numbers of the rules that it stands for."""
    seen = Counter(t for r in rules for t in set(r.tokens()))
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens(), key=lambda t: (seen[t], -len(t), t)), []).append(i)
    return index


def url_parts(url: Column) -> tuple[Column, Column]:
    """host (A-Z lower-cased) and path; both empty without '://'."""
    ok = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(ok, host).otherwise(""), F.when(ok, path).otherwise("")


def filter_urls(df: DataFrame, rules: list[Rule], url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, n_candidates (rules whose expression ran), rule (of the longest match) and verdict."""
    host, path = url_parts(F.col(url_col))
    out = df.withColumns({"host": host, "path": path})
    if not rules:
        return out.withColumns({"n_candidates": F.lit(0), "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    index = rarest_tokens(rules)
    # Rules in order of length and then of listing; a slot of the index maps tokens to places in that order.
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].text), i))
    place = {i: k for k, i in enumerate(order)}
    slots: list[dict[str, list[int]]] = [{} for _ in index]
    for t, own in index.items():
        slots[zlib.crc32(t.encode()) % len(slots)][t] = [place[i] for i in own]
    table = F.from_json(F.lit(json.dumps(slots)), "array<map<string,array<int>>>")
    specs = F.from_json(F.lit(json.dumps([{"rule": rules[i].text, "action": rules[i].action, "pattern": rules[i].pattern} for i in order])), "array<struct<rule:string,action:string,pattern:string>>")
    tokens = F.array_union(
        F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x)), F.transform(F.split("path", "/"), lambda x: F.concat(F.lit("p:"), x))
    )
    found = F.array_compact(F.transform(tokens, lambda t: F.try_element_at(F.get(table, F.pmod(F.crc32(t), F.lit(len(slots))).cast("int")), t)))
    at, hit = free("_at", out), free("_hit", out)
    out = out.withColumn(at, F.array_sort(F.flatten(found)))
    subject = F.concat("host", "path")
    out = out.withColumn(hit, F.get(F.filter(F.transform(F.col(at), lambda i: F.get(specs, i)), lambda r: F.regexp_like(subject, r["pattern"])), F.lit(0)))
    return out.withColumns({"n_candidates": F.size(at), "rule": F.col(hit)["rule"], "verdict": F.coalesce(F.col(hit)["action"], F.lit(default))}).drop(at, hit)
