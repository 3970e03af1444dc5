"""Allow and block rules for urls: a trie over reversed host labels, then path segments.

A rule is ``host/path``, as ``example.net/en/``. It fits its host and all subdomains if the path of the
url starts with the rule's path. Of all rules that fit, the one with the most characters wins; an equal
rule in both lists blocks; urls without a rule get ``default``.

Defined cases: null urls and urls without ``://`` have an empty host and path and no rule. A rule needs a
path that starts with its own, so ``net/`` does not fit ``http://a.net``. Repeated rows are judged one
by one. Columns of the input that clash with added ones are replaced.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes a pickled trie may have to be broadcast. More rules are judged in several tries, one after another.
TRIE_BYTES = 32 * 2**20
RULES_PER_TRIE = 100_000

_CAPS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEGMENT = re.compile(r"[^/]*/")


def host_of(url: Column) -> Column:
    rest = _after_scheme(url)
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _CAPS, _SMALL)


def path_of(url: Column) -> Column:
    rest = _after_scheme(url)
    tail = F.substr(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + F.lit(1))
    return F.regexp_extract(tail, r"^[^?#]*", 0)


def _after_scheme(url: Column) -> Column:
    full = F.coalesce(url, F.lit(""))
    at = F.instr(full, "://")
    return F.when(at > 0, F.substr(full, at + F.lit(3))).otherwise(F.lit(""))


def build_trie(rules: Sequence[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the right, then below "/" the segments of the path.

    ``rules`` holds (host, path, verdict). A path is cut after each slash; what follows its last slash is
    kept as a beginning that the rest of a url's path must have. An empty path fits every path.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.translate(str.maketrans(_CAPS, _SMALL)).split(".")):
            node = node.setdefault("labels", {}).setdefault(label, {})
        node = node.setdefault("path", {})
        segments = _SEGMENT.findall(path)
        for segment in segments:
            node = node.setdefault("segments", {}).setdefault(segment, {})
        begin = path[sum(map(len, segments)) :]
        ends = node.setdefault("ends", {})
        if ends.get(begin, (None, "allow"))[1] == "allow":
            ends[begin] = (host + path, verdict)
    return root


def look_up(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    best: tuple[str | None, str | None] = (None, None)
    node = trie
    for label in reversed(host.split(".")):
        node = node.get("labels", {}).get(label)
        if node is None:
            break
        below, at = node.get("path"), 0
        while below is not None:
            for begin, (rule, verdict) in below.get("ends", {}).items():
                if path.startswith(begin, at) and (best[0] is None or len(rule) >= len(best[0])):
                    best = (rule, verdict)
            segment = _SEGMENT.match(path, at)
            if segment is None:
                break
            below, at = below.get("segments", {}).get(segment[0]), segment.end()
    return best


def judge(df: DataFrame, url: str, block: Sequence[tuple[str, str]], allow: Sequence[tuple[str, str]], default: str = "allow") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` to each row."""
    rules = [(h, p, "block") for h, p in block] + [(h, p, "allow") for h, p in allow]
    blocks = [rules[i : i + RULES_PER_TRIE] for i in range(0, len(rules), RULES_PER_TRIE)] or [[]]
    out = df.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    found = []
    for some in blocks:
        found += _parts(out, some)
    # Of one longest rule per trie, the longest; block before allow when equal.
    best = found[0]
    if len(found) > 1:
        ranked = [F.struct(F.length(x["rule"]).alias("n"), (x["verdict"] == "block").alias("b"), x["rule"].alias("rule"), x["verdict"].alias("verdict")) for x in found]
        best = F.get(F.sort_array(F.filter(F.array(*ranked), lambda x: x["n"].isNotNull()), asc=False), F.lit(0))
    out = out.withColumn("_hit", best)
    return out.withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce("_hit.verdict", F.lit(default))}).drop("_hit")


def _parts(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> list[Column]:
    """Look-up columns for ``rules``; a trie too large to broadcast is halved."""
    trie = build_trie(rules)
    if len(pickle.dumps(trie)) > TRIE_BYTES and len(rules) > 1:
        half = len(rules) // 2
        return _parts(df, rules[:half]) + _parts(df, rules[half:])
    shared = df.sparkSession.sparkContext.broadcast(trie)

    @F.pandas_udf("rule string, verdict string")
    def hit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        rules_trie = shared.value
        for hosts, paths in batches:
            yield pd.DataFrame([look_up(rules_trie, h, p) for h, p in zip(hosts, paths)], columns=["rule", "verdict"], dtype=object)

    return [hit(F.col("host"), F.col("path"))]
