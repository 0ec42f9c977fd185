"""URL filter: host and path rules, then a weighted vocabulary.

Rules name a host and a path prefix; a rule fits its host and every subdomain of
it when the url's path starts with the rule's path, and the longest rule that
fits decides. All other urls are judged by the vocabulary: one Aho-Corasick pass
over the lower-cased url counts strict and soft terms that stand between
boundaries (no ASCII letter or digit next to them). One strict term, or
soft_limit distinct soft terms, block the url.

A null url, or one without "://", has an empty host and path; the vocabulary
still reads it (a null as empty). Repeated rows are judged alike, an empty table
gives an empty result, and columns besides the id and the url are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, map_batches

STRICT_TERMS = ("porn", "xxx", "hentai", "malware", "phishing", "warez", "keygen", "escort", "gore")
SOFT_TERMS = (
    "adult", "bet", "casino", "cheap", "crack", "dating", "free", "gambling", "loan", "nude",
    "pills", "poker", "sex", "slots", "torrent", "viagra", "webcam", "win",
)
SCHEMA = (
    "id long, host string, path string, rule string, verdict string, "
    "strict_hits int, soft_hits int, soft_distinct int, weight double"
)
_TYPES = {
    "id": pa.int64(), "host": pa.string(), "path": pa.string(), "rule": pa.string(), "verdict": pa.string(),
    "strict_hits": pa.int32(), "soft_hits": pa.int32(), "soft_distinct": pa.int32(), "weight": pa.float64(),
}
_PARTS = re.compile(r"://([^/?#]*)([^?#]*)", re.DOTALL)
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@dataclass(frozen=True)
class UrlPolicy:
    """rules: (verdict, host, path). Weights only rank blocked urls; the counts decide."""

    rules: tuple[tuple[str, str, str], ...] = ()
    strict: tuple[str, ...] = STRICT_TERMS
    soft: tuple[str, ...] = SOFT_TERMS
    soft_limit: int = 2
    strict_weight: float = 10.0
    soft_weight: float = 1.0


def _automaton(policy: UrlPolicy) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term in policy.soft:
        found.add_word(term, (term, False))
    for term in policy.strict:
        found.add_word(term, (term, True))
    found.make_automaton()
    return found


def _rule_table(policy: UrlPolicy) -> dict[str, list[tuple[str, str, str]]]:
    """By host: (path, rule, verdict), longest path first."""
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, host, path in policy.rules:
        by_host.setdefault(host, []).append((path, host + path, verdict))
    for paths in by_host.values():
        paths.sort(key=lambda p: -len(p[0]))
    return by_host


def _longest_rule(by_host: dict, host: str, path: str) -> tuple[str | None, str | None]:
    best: tuple[str | None, str | None] = (None, None)
    suffix = host
    while suffix:
        for rule_path, rule, verdict in by_host.get(suffix, ()):
            if path.startswith(rule_path):
                if best[0] is None or len(rule) > len(best[0]):
                    best = (rule, verdict)
                break
        suffix = suffix.partition(".")[2]
    return best


def judge_urls(df: DataFrame, id_col: str, url_col: str, policy: UrlPolicy) -> DataFrame:
    """One row per row of df: id, host, path, rule, verdict and the counts of terms."""

    def process(batch: pa.RecordBatch):
        terms, by_host = _automaton(policy), _rule_table(policy)
        rows = []
        for url in batch.column(1).to_pylist():
            url = url or ""
            m = _PARTS.search(url)
            host, path = (m[1].translate(_LOWER), m[2]) if m else ("", "")
            rule, verdict = _longest_rule(by_host, host, path)
            low = url.translate(_LOWER)
            strict = soft = 0
            distinct = set()
            for end, (term, is_strict) in terms.iter(low):
                start = end + 1 - len(term)
                if (start and low[start - 1] in _ALNUM) or (end + 1 < len(low) and low[end + 1] in _ALNUM):
                    continue
                if is_strict:
                    strict += 1
                else:
                    soft += 1
                    distinct.add(term)
            if verdict is None:
                verdict = "block" if strict or len(distinct) >= policy.soft_limit else "allow"
            rows.append((host, path, rule, verdict, strict, soft, len(distinct),
                         strict * policy.strict_weight + len(distinct) * policy.soft_weight))
        columns = list(zip(*rows)) or [[]] * (len(_TYPES) - 1)
        yield batch_of(dict(zip(_TYPES, [batch.column(0), *columns])), _TYPES)

    from pyspark.sql import functions as F

    return map_batches(df, [F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")], process, SCHEMA)
