"""URL filters: host rules by suffix, and pattern rules indexed by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlens.llm import common as C

#: (verdict, host, path): a host and its subdomains, if the path starts so; the longest rule wins.
HOST_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the A-Z-lower-cased url. Each literal is a whole token (a run of a-z, 0-9) of every url that it fits."""

    verdict: str
    pattern: str
    literals: tuple[str, ...]


#: Fixed values. An allowing rule that fits stands above the blocking ones.
PATTERN_RULES = (
    PatternRule("block", r"^https?://([^/?#]*\.)?spam-farm\.", ("spam", "farm")),
    PatternRule("block", r"^https?://([^/?#]*\.)?(?:[^/?#.]*-)?casino(?:-[^/?#.]*)?\.", ("casino",)),
    PatternRule("block", r"^https?://[^?#]*/(?:wp-login|wp-admin)(?:[./?#]|$)", ("wp",)),
    PatternRule("block", r"^https?://[^?#]*/cart(?:[./?#]|$)", ("cart",)),
    PatternRule("block", r"^https?://[^?#]*/doubleclick(?:[./?#]|$)", ("doubleclick",)),
    PatternRule("block", r"[?&]sessionid=[0-9a-f]{16,}", ("sessionid",)),
    PatternRule("block", r"[?&]action=login(?:[&#]|$)", ("action", "login")),
    PatternRule("allow", r"^https?://[^?#]*/robots\.txt$", ("robots", "txt")),
)
DEFAULT = "allow"


def rarest_literals(pages: DataFrame, rules: tuple[PatternRule, ...]) -> dict[str, list[int]]:
    """token -> rules: each rule under the literal that the fewest urls of all `pages` have (ties: the first by name)."""
    known = sorted({t for r in rules for t in r.literals})
    tokens = F.array_distinct(F.regexp_extract_all(F.translate("url", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("([a-z0-9]+)")))
    seen = pages.select(F.explode(F.array_intersect(tokens, F.array(*map(F.lit, known)))).alias("t")).groupBy("t").count()
    often = {r.t: r["count"] for r in seen.collect()}  # no more rows than rules have literals
    index: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.literals, key=lambda t: (often.get(t, 0), t)), []).append(i)
    return index


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): see judge_urls."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host, cut = url[at + 3 :], [i for i in (url.find(c, at + 3) for c in "/?#") if i >= 0]
    end = min(cut, default=len(url))
    host, rest = url[at + 3 : end], url[end:]
    stop = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    return host.translate(LOWER), rest[:stop]


LOWER = {c: c + 32 for c in range(65, 91)}


class HostTrie:
    """Host rules by host suffix: a url looks up the suffixes of its host only."""

    def __init__(self, rules):
        self.by_host: dict[str, list] = {}
        for verdict, host, path in rules:
            self.by_host.setdefault(host, []).append((len(host + path), host + path, path, verdict))
        for own in self.by_host.values():
            own.sort(reverse=True)

    def fit(self, host: str, path: str) -> tuple[str | None, str | None]:
        best, at = (0, None, None, None), 0
        while at >= 0:
            for rule in self.by_host.get(host[at:], ()):
                if rule[0] > best[0] and path.startswith(rule[2]):
                    best = rule
            at = host.find(".", at) + 1 or -1
        return best[1], best[3]


JUDGED = "page_id long, host string, path string, rule string, verdict string, pattern_rule int"


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, rules: tuple[PatternRule, ...] = PATTERN_RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, pattern_rule) of every row of `pages` (page_id, url).

    host: behind the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #. A url that is null or has no
    :// has neither, and no host rule fits it. `rule` is the longest host rule that fits, else null, and gives the verdict. Without one, the url's tokens fetch the pattern rules under them, and only those run their regular expressions:
    an allowing one stands above blocking ones, the first by number is in pattern_rule; none: allow. Repeated rows are
    judged alike; an empty table gives an empty result.
    """
    C.limit_batches(pages.sparkSession)
    index = rarest_literals(pages, rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hosts, compiled = HostTrie(host_rules), [re.compile(r.pattern, re.ASCII) for r in rules]
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in JUDGED.split(", ")}
            for page_id, url in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), strict=True):
                host, path = split_url(url)
                rule, verdict = hosts.fit(host, path)
                hit = None
                if rule is None:
                    low = (url or "").translate(LOWER)
                    fits = [i for i in sorted({i for t in set(TOKEN.findall(low)) for i in index.get(t, ())}) if compiled[i].search(low)]
                    hit = min(fits, key=lambda i: (rules[i].verdict != "allow", i), default=None)
                    verdict = DEFAULT if hit is None else rules[hit].verdict
                for c, v in zip(out.values(), (page_id, host, path, rule, verdict, hit), strict=True):
                    c.append(v)
            yield C.record(JUDGED, **out)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(judge, JUDGED)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; nulls, ties, repeats and empty tables as in judge_urls."""
    return judge_urls(C.table(spark, sf_dir, "pages"))


def _sql() -> str:
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host_cases = "\n".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2])))
    hits = "\n".join(f"WHEN regexp_matches(low, '{r.pattern}') THEN {i}" for i, r in sorted(enumerate(PATTERN_RULES), key=lambda x: (x[1].verdict != "allow", x[0])))
    verdicts = " ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for v, h, p in HOST_RULES)
    blocks = ", ".join(str(i) for i, r in enumerate(PATTERN_RULES) if r.verdict == "block")
    return f"""
WITH a AS (SELECT page_id, coalesce({fold.format('url')}, '') AS low, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
     b AS (SELECT page_id, low, {fold.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
     c AS (SELECT *, CASE {host_cases} END AS rule FROM b),
     d AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {hits} END END AS pattern_rule FROM c)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN pattern_rule IN ({blocks}) THEN 'block' ELSE 'allow' END AS verdict, CAST(pattern_rule AS INTEGER) AS pattern_rule FROM d
"""


OP10_SQL = _sql()
