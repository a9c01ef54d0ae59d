"""URL filters: host rules by suffix, pattern rules by their rarest literal token.

Every pattern rule names the literal tokens (maximal runs of a-z and 0-9 in the lower-cased URL) that each of its
matches contains. The rule is filed under the one of them that fewest URLs hold, counted over the whole table. A
URL's own tokens fetch the rules filed under them, and only those run their regular expression.

Defined results: a null URL, or one without "://", has an empty host and path and is allowed; repeated rows are
judged alike; columns beyond those named are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, ascii_lower


@dataclass(frozen=True)
class HostRule:
    """Fits `host` and all its subdomains where the URL's path starts with `path`; the longest host and path wins."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """A regular expression over the lower-cased URL; each match contains all `tokens` as whole tokens."""

    verdict: str
    tokens: tuple[str, ...]
    pattern: str


#: Rules of the registered query.
HOST_RULES = (
    HostRule("allow", "com", "/"),
    HostRule("block", "example.com", "/en/"),
    HostRule("allow", "www.example.com", "/en/"),
    HostRule("block", "net", "/es/"),
    HostRule("block", "net", "/fr/"),
)
PATTERN_RULES = (
    PatternRule("block", ("casino", "win"), r"(?:^|[^a-z0-9])casino[-_.]win(?:[^a-z0-9]|$)"),
    PatternRule("block", ("free", "bets"), r"(?:^|[^a-z0-9])free[-_.]bets(?:[^a-z0-9]|$)"),
    PatternRule("block", ("spam", "farm"), r"(?:^|[^a-z0-9])spam[-_.]farm(?:[^a-z0-9]|$)"),
    PatternRule("block", ("ads", "track"), r"(?:^|[^a-z0-9])ads[-_.]track(?:[^a-z0-9]|$)"),
    PatternRule("block", ("adult", "x"), r"(?:^|[^a-z0-9])adult[-_.]x(?:[^a-z0-9]|$)"),
    PatternRule("block", ("payday", "loans"), r"(?:^|[^a-z0-9])payday[-_.]loans(?:[^a-z0-9]|$)"),
    PatternRule("block", ("cheap", "pills"), r"(?:^|[^a-z0-9])cheap[-_.]pills(?:[^a-z0-9]|$)"),
    PatternRule("block", ("xxx",), r"(?:^|[^a-z0-9])xxx(?:[^a-z0-9]|$)"),
    PatternRule("block", ("adult", "cams"), r"(?:^|[^a-z0-9])adult[-_.]cams(?:[^a-z0-9]|$)"),
)
TOKEN = re.compile("[a-z0-9]+")
UPPER_TO_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(raw), F.lit("")), F.coalesce(path, F.lit(""))


def token_counts(urls: DataFrame, column: str, tokens: Iterable[str]) -> dict[str, int]:
    """In how many rows each of the given tokens occurs; at most one row for each token of the rules reaches the driver."""
    found = (
        urls.select(F.explode(F.array_distinct(F.split(ascii_lower(F.col(column)), "[^a-z0-9]+"))).alias("token"))
        .where(F.col("token").isin(sorted(set(tokens))))
        .groupBy("token")
        .count()
    )
    return {r["token"]: r["count"] for r in found.collect()}


def index_rules(rules: Sequence[PatternRule], counts: dict[str, int]) -> dict[str, list[int]]:
    """Rule numbers by the rarest token of each (ties: the first named)."""
    index = defaultdict(list)
    for i, rule in enumerate(rules):
        index[min(rule.tokens, key=lambda t: counts.get(t, 0))].append(i)
    return dict(index)


def judge_urls(
    urls: DataFrame,
    *,
    key: str = "page_id",
    column: str = "url",
    host_rules: Sequence[HostRule] = HOST_RULES,
    pattern_rules: Sequence[PatternRule] = PATTERN_RULES,
    default: str = "allow",
) -> DataFrame:
    """One row a URL: key, host, path, the name of the winning host rule, the number of the pattern rule, the verdict.

    Host rules come first; a URL that none fits is judged by the first pattern rule, by number, that matches, and
    else by `default`.
    """
    counts = token_counts(urls, column, (t for r in pattern_rules for t in r.tokens)) if pattern_rules else {}
    index = index_rules(pattern_rules, counts)
    by_host = defaultdict(list)
    for rule in sorted(host_rules, key=lambda r: -len(r.name)):
        by_host[rule.host].append(rule)
    by_host = dict(by_host)
    host, path = split_url(F.col(column))
    source = urls.select(F.col(key).alias("key"), F.col(column).alias("url"), host.alias("host"), path.alias("path"))
    schema = f"key {source.schema['key'].dataType.simpleString()}, host string, path string, rule string, pattern_rule int, verdict string"
    shape = arrow_schema(schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [re.compile(r.pattern) for r in pattern_rules]
        for batch in batches:
            rules, numbers, verdicts = [], [], []
            for url, name, path in zip(*(batch.column(c).to_pylist() for c in ("url", "host", "path")), strict=True):
                labels = name.split(".")
                fits = [r for i in range(len(labels)) for r in by_host.get(".".join(labels[i:]), ()) if path.startswith(r.path)]
                best = max(fits, key=lambda r: len(r.name), default=None)
                number = None
                if best is None and url:
                    low = url.translate(UPPER_TO_LOWER)
                    candidates = sorted({i for t in set(TOKEN.findall(low)) for i in index.get(t, ())})
                    number = next((i for i in candidates if patterns[i].search(low)), None)
                rules.append(best.name if best else None)
                numbers.append(number)
                verdicts.append(best.verdict if best else default if number is None else pattern_rules[number].verdict)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("host"), batch.column("path"), pa.array(rules, pa.string()), pa.array(numbers, pa.int32()), pa.array(verdicts, pa.string())],
                schema=shape,
            )

    return source.mapInArrow(judge, schema).withColumnRenamed("key", key)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the fixed host rules, and else by the pattern rules."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _like(rule: HostRule) -> str:
    return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


_BY_LENGTH = sorted(HOST_RULES, key=lambda r: -len(r.name))
ORACLE_SQL = f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM cut
), ruled AS (
  SELECT *, CASE {" ".join(f"WHEN {_like(r)} THEN '{r.name}'" for r in _BY_LENGTH)} END AS rule,
         CASE {" ".join(f"WHEN {_like(r)} THEN '{r.verdict}'" for r in _BY_LENGTH)} END AS by_rule
  FROM parts
)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(by_rule, CASE WHEN {" OR ".join(f"regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{r.pattern}')" for r in PATTERN_RULES)} THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
