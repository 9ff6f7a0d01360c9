"""URL filter: one trie over reversed host labels, then path segments.

``compile_rules`` turns allow and block entries into nested dictionaries. Host
labels are inserted from the top-level domain inwards, so an entry covers its
host and every subdomain; below a host stand the path segments of its entries,
the last one as a prefix. A lookup walks a url's labels once and its segments
once per host that has entries, whatever the number of entries. The longest
entry wins: the one with more host labels, then the one with the longer path;
of two equal entries the blocking one.

A scan with no shuffle. The trie is broadcast; ``MAX_RULE_BYTES`` bounds it.

Null urls and urls without ``://`` have an empty host and path and get the
default verdict. Repeated rows and null ids each get their own row. Urls of any length are read
whole. Other columns, whatever their names, are not read; an empty table gives no rows,
no rules allow everything.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .text import short_batches

MAX_RULE_BYTES = 64 << 20
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Keys of a trie node that no label or segment can equal.
ANY, PREFIX, PATHS = ("any",), ("prefix",), ("paths",)
#: In a table of prefixes: the length of the longest, so that a long segment is cut no further.
LONGEST = ("longest",)


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): after the first ``://`` up to ``/?#``; then up to ``?#``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    for i, c in enumerate(rest):
        if c in "/?#":
            break
    else:
        return rest.translate(LOWER), ""
    tail = rest[i:]
    cut = min((k for k in (tail.find("?"), tail.find("#")) if k >= 0), default=len(tail))
    return rest[:i].translate(LOWER), tail[:cut]


def compile_rules(rules) -> dict:
    """rules: (verdict, host, path) with verdict ``allow`` or ``block``; path empty or from ``/``."""
    root: dict = {}
    total = 0
    for verdict, host, path in rules:
        if verdict not in ("allow", "block") or not host or (path and path[0] != "/"):
            raise ValueError(f"not a rule: {(verdict, host, path)}")
        total += len(host) + len(path)
        if total > MAX_RULE_BYTES:
            raise ValueError(f"the rules exceed {MAX_RULE_BYTES} characters, the bound of what is broadcast")
        host = host.translate(LOWER)
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(PATHS, {})
        slot, key = node, ANY
        if path:
            *inner, last = path[1:].split("/")
            for segment in inner:
                node = node.setdefault(segment, {})
            slot, key = node.setdefault(PREFIX, {}), last
            slot[LONGEST] = max(slot.get(LONGEST, 0), len(last))
        if key not in slot or verdict == "block":
            slot[key] = (host + path, verdict)
    return root


def match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest entry that fits, or None."""
    found = None
    node = trie
    segments = path[1:].split("/") if path else []
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        here = node.get(PATHS)
        if here is None:
            continue
        best = here.get(ANY)
        for i, segment in enumerate(segments):
            ends = here.get(PREFIX)
            if ends:
                best = next((ends[segment[:n]] for n in range(min(len(segment), ends[LONGEST]), -1, -1) if segment[:n] in ends), best)
            here = here.get(segment) if i + 1 < len(segments) else None
            if here is None:
                break
        found = best or found
    return found


def filter_urls(pages: DataFrame, rules, id_col: str = "page_id", url_col: str = "url",
                default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every url; ``rule`` is null where none fits."""
    spark = pages.sparkSession
    short_batches(spark)
    trie = spark.sparkContext.broadcast(compile_rules(rules))

    def judge(batches):
        known = trie.value
        for batch in batches:
            hosts, paths, names, verdicts = [], [], [], []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule, verdict = match(known, host, path) or (None, default)
                hosts.append(host)
                paths.append(path)
                names.append(rule)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.string()) for x in (hosts, paths, names, verdicts))],
                names=["page_id", "host", "path", "rule", "verdict"])

    src = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"))
    return src.mapInArrow(judge, "page_id bigint, host string, path string, rule string, verdict string")
