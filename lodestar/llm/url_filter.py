"""URL filters: host and path rules first, then pattern rules indexed by their rarest literal token.

A pattern rule names literal tokens (runs of a-z and 0-9) that any URL it matches must hold, one at least; a
pattern of alternatives is a rule for each. The rules are indexed by the one of their tokens that is rarest in the URLs
at hand; a URL's own tokens fetch candidate rules, and only those run their regular expressions, each compiled once by
a worker. Host rules are looked up by the host and its parent domains. So a URL costs what it holds, whatever the
number of rules. What the plan carries is the rule list, whose size the caller sets; nothing is shuffled.

A null URL, or one without ``://``, has an empty host and path, fits no host rule and is judged by its tokens. Rows
are judged each by itself, repeated ones alike, and URLs of any length as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    host: str
    path: str
    verdict: str

    @property
    def label(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """``pattern`` is looked for in the URL with A-Z lower-cased, with ``ends`` at its end only.

    It can only match where all ``tokens`` occur.
    """

    name: str
    pattern: str
    tokens: tuple[str, ...]
    ends: bool = False

    def __post_init__(self):
        if not self.tokens or not all(re.fullmatch("[a-z0-9]+", t) for t in self.tokens):
            raise ValueError(f"the rule {self.name!r} must name a literal token")


HOST_RULES = (
    HostRule("org", "/", "allow"),
    HostRule("example.org", "/es/", "block"),
    HostRule("example.org", "/en/1", "block"),
    HostRule("com", "/fr/", "allow"),
    HostRule("com", "/de/", "block"),
)
PATTERN_RULES = (
    PatternRule("spam farm", r"://[^/?#]*\bspam-farm\.", ("spam", "farm")),
    PatternRule("adult host", r"://([^/?#]*\.)?adult-[a-z0-9]+\.", ("adult",)),
    PatternRule("casino host", r"://([^/?#]*\.)?casino-(win|bet|play)\.", ("casino",)),
    PatternRule("betting host", r"://([^/?#]*\.)?free-bets\.", ("free", "bets")),
    PatternRule("pills", r"[/.-]cheap-pills?\b", ("cheap",)),
    PatternRule("session id of php", r"[?&]phpsessid=[a-z0-9]{16,}", ("phpsessid",)),
    PatternRule("session id of java", r"[?&]jsessionid=[a-z0-9]{16,}", ("jsessionid",)),
    PatternRule("tracker pixel gif", r"/pixel\.gif", ("pixel", "gif"), ends=True),
    PatternRule("tracker pixel png", r"/pixel\.png", ("pixel", "png"), ends=True),
    PatternRule("tracker beacon gif", r"/beacon\.gif", ("beacon", "gif"), ends=True),
    PatternRule("tracker beacon png", r"/beacon\.png", ("beacon", "png"), ends=True),
    PatternRule("login forms", r"/wp-login\.php\b", ("wp", "login", "php")),
)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(url, UPPER, LOWER), F.lit("([a-z0-9]+)"), 1))


def index_tokens(urls: DataFrame, rules: tuple[PatternRule, ...], url_col: str = "url") -> dict[str, str]:
    """For each rule the rarest of its tokens in the URLs."""
    literals = sorted({t for r in rules for t in r.tokens})
    if not literals:
        return {}
    tokens = urls.select(F.explode(url_tokens(F.col(url_col))).alias("token")).where(F.col("token").isin(literals))
    count = {r["token"]: r["count"] for r in tokens.groupBy("token").count().collect()}  # a row for each literal at most
    return {r.name: min(r.tokens, key=lambda t: (count.get(t, 0), t)) for r in rules}


class UrlJudge:
    """The rules, indexed: hosts by name, patterns by their rarest token."""

    def __init__(self, host_rules: tuple[HostRule, ...], pattern_rules: tuple[PatternRule, ...], chosen: dict[str, str]):
        self._parts = re.compile(r"://([^/?#]*)([^?#]*)")
        self._token = re.compile("[a-z0-9]+")
        self._lower = str.maketrans(UPPER, LOWER)
        self._hosts: dict[str, list[HostRule]] = {}
        for rule in sorted(host_rules, key=lambda r: -len(r.label)):
            self._hosts.setdefault(rule.host, []).append(rule)
        self._rules: dict[str, list[tuple[int, str, re.Pattern]]] = {}
        for i, rule in enumerate(pattern_rules):
            found = re.compile(rule.pattern + r"\Z" * rule.ends, re.ASCII)
            self._rules.setdefault(chosen[rule.name], []).append((i, rule.name, found))

    def host_rule(self, host: str, path: str) -> HostRule | None:
        """The longest rule that fits."""
        best, at = None, 0
        while at >= 0:
            for rule in self._hosts.get(host[at:], ()):
                if path.startswith(rule.path):
                    best = rule if best is None or len(rule.label) > len(best.label) else best
                    break
            at = host.find(".", at) + 1 or -1
        return best

    def __call__(self, url: str | None) -> tuple[str, str, list[str], str | None, str]:
        """(host, path, names of patterns that match, label of the host rule, verdict)"""
        parts = self._parts.search(url) if url is not None else None
        host, path = (parts[1].translate(self._lower), parts[2]) if parts else ("", "")
        low = (url or "").translate(self._lower)
        candidates = sorted(x for t in set(self._token.findall(low)) for x in self._rules.get(t, ()))  # numbers differ
        names = [name for _, name, found in candidates if found.search(low)]
        rule = self.host_rule(host, path)
        return host, path, names, rule.label if rule else None, rule.verdict if rule else "block" if names else "allow"


ADDED = "host string, path string, pattern_rules array<string>, rule string, verdict string"


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    host_rules: tuple[HostRule, ...] = HOST_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
) -> DataFrame:
    """The rows of ``pages`` with host, path, pattern_rules (names that match), rule and verdict.

    The longest host rule that fits decides; else a URL is blocked if any pattern rule matches it. Columns of
    ``pages`` with these names are replaced.
    """
    chosen = index_tokens(pages, pattern_rules, url_col)
    added = [x.split()[0] for x in ADDED.split(", ")]
    pages = pages.drop(*added)
    at = pages.columns.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = UrlJudge(host_rules, pattern_rules, chosen)
        for batch in batches:
            found = list(zip(*map(judge, batch.column(at).to_pylist()), strict=True)) or [[]] * len(added)
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(found, kinds, strict=True))], [*batch.schema.names, *added])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInArrow(run, f"{kept}, {ADDED}")


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _oracle() -> str:
    fits = lambda r: f"(host = {_sql_text(r.host)} OR ends_with(host, {_sql_text('.' + r.host)})) AND starts_with(path, {_sql_text(r.path)})"
    longest = sorted(HOST_RULES, key=lambda r: -len(r.label))
    rule = " ".join(f"WHEN {fits(r)} THEN {_sql_text(r.label)}" for r in longest)
    verdict = " ".join(f"WHEN {fits(r)} THEN {_sql_text(r.verdict)}" for r in longest)
    blocked = " OR ".join(f"regexp_matches(u, {_sql_text(r.pattern + '$' * r.ends)})" for r in PATTERN_RULES)
    return f"""
WITH p AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN {blocked} THEN 'block' ELSE 'allow' END AS verdict FROM p
"""


#: The same in DuckDB SQL, with every pattern run on every URL.
ORACLE_SQL = _oracle()
