"""URL filters: host and path rules, found through the rarest literal token of each rule."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.DOTALL)


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host directly followed by a path: it fits the host and its subdomains
    where the URL's path starts with the rule's path. An empty host fits every host."""

    action: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0].translate(_LOWER)

    @property
    def path(self) -> str:
        return self.pattern[len(self.host):]

    def regex(self) -> re.Pattern:
        host = rf"(?:[^/]*\.)?{re.escape(self.host)}" if self.host else "[^/]*"
        return re.compile(rf"\A{host}(?=/|\Z){re.escape(self.path)}")

    def tokens(self) -> list[str]:
        """Literals that every fitting URL holds as whole host labels or whole path segments.

        The text after the last slash is left out: a URL may continue it."""
        labels = [f"h:{x}" for x in self.host.split(".") if x]
        return labels + [f"p:{x}" for x in self.path.split("/")[1:-1] if x]


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and for text without ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


def url_tokens(host: str, path: str) -> set[str]:
    return {f"h:{x}" for x in host.split(".") if x} | {f"p:{x}" for x in path.split("/") if x}


def token_counts(df: DataFrame, rules: Sequence[Rule], url: str) -> dict[str, int]:
    """In how many URLs of the whole table each rule token occurs.

    Every task returns one row per token it met; the result has at most one entry per rule token.
    """
    wanted = {t for rule in rules for t in rule.tokens()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for u in batch.column(0).to_pylist():
                seen.update(wanted & url_tokens(*split_url(u)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    rows = df.select(url).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()
    return {r["token"]: r["n"] for r in rows}


def rule_index(rules: Sequence[Rule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by their rarest token, and the rules without any token, which every URL must try."""
    by_token: dict[str, list[int]] = {}
    always = []
    for number, rule in enumerate(rules):
        tokens = rule.tokens()
        if tokens:
            by_token.setdefault(min(tokens, key=lambda t: (counts.get(t, 0), t)), []).append(number)
        else:
            always.append(number)
    return by_token, always


def filter_urls(df: DataFrame, rules: Sequence[Rule], url: str = "url", default: str = "allow") -> DataFrame:
    """Adds ``host``, ``path``, ``rule`` and ``verdict`` to every row.

    The longest fitting rule decides (equal lengths: the smaller pattern, then the earlier rule);
    without one, ``rule`` is null and ``verdict`` is ``default``. The rule list is a driver-side
    parameter and travels with the task; the rows are never shuffled. Null, empty and scheme-less
    URLs have an empty host and path. Repeated rows are judged alike, an empty table stays empty,
    and input columns named like the added ones are replaced.
    """
    rules = list(rules)
    by_token, always = rule_index(rules, token_counts(df, rules, url))
    rank = sorted(range(len(rules)), key=lambda i: (-len(rules[i].pattern), rules[i].pattern, i))
    place = {number: r for r, number in enumerate(rank)}
    result = pa.struct([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    @F.arrow_udf("host string, path string, rule string, verdict string")
    def judge(urls: pa.Array) -> pa.Array:
        regexes = [rule.regex() for rule in rules]
        out = []
        for u in urls.to_pylist():
            host, path = split_url(u)
            candidates = [n for t in url_tokens(host, path) & by_token.keys() for n in by_token[t]] + always
            fit = next((n for n in sorted(candidates, key=place.__getitem__) if regexes[n].match(host + path)), None)
            out.append({
                "host": host, "path": path, "rule": None if fit is None else rules[fit].pattern,
                "verdict": default if fit is None else rules[fit].action,
            })
        return pa.array(out, result)

    judged = df.withColumn("__judged", judge(F.col(url)))
    return judged.withColumns({c: F.col(f"__judged.{c}") for c in ("host", "path", "rule", "verdict")}).drop("__judged")
