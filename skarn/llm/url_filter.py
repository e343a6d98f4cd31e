"""URL filters: host and path rules, and pattern rules indexed by their rarest literal token.

A pattern rule names literal tokens (runs of a-z and 0-9) that every URL it can match contains whole. The rule
is filed under the one of them that the fewest URLs contain. A URL's tokens fetch the rules filed under them,
and only those rules' regular expressions are run. DataFrame functions only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm.common import free_name

#: More pattern rules than this are joined as a table instead of being held in the plan as a map.
MAP_RULES = 512

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class PathRule:
    """Fits its host and all subdomains where the path starts with the rule's path."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class PatternRule:
    """Blocks URLs (A-Z lower-cased) in which ``regex`` is found; ``literals`` occur in each as whole tokens."""

    name: str
    regex: str
    literals: tuple[str, ...]


def host_phrase(name: str, phrase: str) -> PatternRule:
    """A rule for hosts that hold ``phrase`` (A-Z lower-cased) between separators; its literals follow from the phrase."""
    low = phrase.translate(str.maketrans(_UPPER, _LOWER))
    return PatternRule(name, rf"://([^/?#]*[.-])?{re.escape(low)}([.:/?#-]|$)", tuple(t for t in re.split("[^a-z0-9]+", low) if t))


#: Fixed values of the query's contract.
PATH_RULES = (
    PathRule("net", "/", "block"),
    PathRule("example.net", "/en/", "allow"),
    PathRule("example.com", "/de/", "block"),
    PathRule("org", "/fr/", "allow"),
)

PATTERN_RULES = (
    PatternRule("adult", r"://([^/?#]*[.-])?adult-[a-z0-9-]+\.", ("adult",)),
    PatternRule("ad-tracking", r"://([^/?#]*\.)?ads-track(er|ing)?\.", ("ads",)),
    PatternRule("casino", r"://([^/?#]*[.-])?casino([.-][^/?#]*)?\.", ("casino",)),
    PatternRule("pharmacy", r"://([^/?#]*[.-])?cheap-pills([.-]|$)", ("cheap", "pills")),
    PatternRule("betting", r"://([^/?#]*[.-])?free-bets([.-]|$)", ("free", "bets")),
    PatternRule("link-farm", r"://([^/?#]*[.-])?spam-farm([.-]|$)", ("spam", "farm")),
    PatternRule("affiliate", r"/affiliate/click([/?#]|$)", ("affiliate", "click")),
    PatternRule("doorway", r"[?&]redirect=https?(%3a|:)", ("redirect",)),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; none for null."""
    return F.coalesce(F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda t: t != "")), F.array().cast("array<string>"))


def path_rule_of(host: Column, path: Column, rules: tuple[PathRule, ...]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting path rule, else nulls; of equally long ones the first."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the last that fits, outermost, is the longest
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def rarest_literals(pages: DataFrame, url_col: str, rules: tuple[PatternRule, ...]) -> dict[str, str]:
    """Rule name to the literal that the fewest URLs contain (ties: the first by name). Counts come from all
    rows; what is collected is a number for each literal of the rules."""
    literals = sorted({t for r in rules for t in r.literals})
    if not literals:
        return {}
    seen = pages.select(F.explode(F.array_intersect(tokens_of(F.col(url_col)), F.array(*map(F.lit, literals)))).alias("t"))
    counts = {r.t: r["count"] for r in seen.groupBy("t").count().collect()}
    return {r.name: min(r.literals, key=lambda t: (counts.get(t, 0), t)) for r in rules}


def _by_map(url: Column, tokens: Column, rules: tuple[PatternRule, ...], index: dict[str, str]) -> Column:
    filed: dict[str, list[PatternRule]] = {}
    for r in rules:
        filed.setdefault(index[r.name], []).append(r)
    entries = []
    for t, own in sorted(filed.items()):
        entries += [F.lit(t), F.array(*[F.struct(F.lit(r.name).alias("name"), F.lit(r.regex).alias("regex")) for r in own])]
    fetched = F.flatten(F.transform(F.array_intersect(tokens, F.array(*[F.lit(t) for t in sorted(filed)])), lambda t: F.try_element_at(F.create_map(*entries), t)))
    hit = F.filter(fetched, lambda r: F.regexp(url, r["regex"]))
    return F.array_sort(F.transform(hit, lambda r: r["name"]))


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    path_rules: tuple[PathRule, ...] = PATH_RULES,
    pattern_rules: tuple[PatternRule, ...] = PATTERN_RULES,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest fitting path rule or null), ``patterns`` (names of
    the pattern rules found, sorted) and ``verdict``: the path rule's, else block if a pattern was found, else
    allow.

    A null URL or one without ``://`` has empty host and path; a null one has no tokens and is allowed. Columns
    of ``pages`` named like an output column give way to it. Repeated rows give repeated results, an empty table
    an empty one. One narrow counting pass and one scan without shuffle; more than MAP_RULES pattern rules are
    joined by token instead (broadcast only while small, by Spark's own size check) and their hits grouped by row.
    """
    if len({r.name for r in pattern_rules}) < len(pattern_rules) or not all(r.literals for r in pattern_rules):
        raise ValueError("pattern rules need distinct names and at least one literal")
    new = ("host", "path", "rule", "patterns", "verdict")
    kept = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in new]
    index = rarest_literals(pages, url_col, pattern_rules)
    url = F.col(url_col)
    low = ascii_lower(F.coalesce(url, F.lit("")))
    if not pattern_rules:
        found, source = F.array().cast("array<string>"), pages
    elif len(pattern_rules) <= MAP_RULES:
        found, source = _by_map(low, tokens_of(url), pattern_rules, index), pages
    else:
        rid, hits = free_name(pages, "row_no"), free_name(pages, "row_hits")
        numbered = pages.withColumn(rid, F.struct(F.xxhash64(low), low))  # rows of one URL share their hits
        table = pages.sparkSession.createDataFrame([(index[r.name], r.name, r.regex) for r in pattern_rules], "token string, name string, regex string")
        urls = numbered.select(rid).distinct()
        fetched = urls.select(rid, F.explode(tokens_of(F.col(rid)["col2"])).alias("token")).join(table, "token")
        matched = fetched.where(F.regexp(F.col(rid)["col2"], F.col("regex"))).groupBy(rid).agg(F.array_sort(F.collect_set("name")).alias(hits))
        source, found = numbered.join(matched, rid, "left"), F.coalesce(F.col(hits), F.array().cast("array<string>"))
    rule, verdict = path_rule_of(F.col("host"), F.col("path"), path_rules)
    own = F.struct(*kept).alias("row") if kept else F.lit(0).alias("row")
    judged = source.select(own, host_of(url).alias("host"), path_of(url).alias("path"), found.alias("patterns"))
    method = F.when(F.size("patterns") > 0, F.lit("block")).otherwise(F.lit("allow"))
    names = [c for c in pages.columns if c.lower() not in new]
    return judged.select(*[F.col("row").getField(c).alias(c) for c in names], "host", "path", rule.alias("rule"), "patterns", F.coalesce(verdict, method).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def _op6_sql() -> str:
    lower = f"translate({{}}, '{_UPPER}', '{_LOWER}')"
    cases = {"rule": "", "verdict": ""}
    for r in sorted(PATH_RULES, key=lambda r: -len(r.text)):
        fits = f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))"
        cases["rule"] += f" WHEN {fits} THEN '{r.text}'"
        cases["verdict"] += f" WHEN {fits} THEN '{r.verdict}'"
    found = " OR ".join(f"regexp_matches({lower.format('url')}, '{r.regex}')" for r in PATTERN_RULES)
    return f"""
WITH p AS (
    SELECT page_id, coalesce(url, '') AS url,
           {lower.format("coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')")} AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages
)
SELECT page_id, host, path, CASE{cases["rule"]} END AS rule,
       CASE{cases["verdict"]} WHEN {found} THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""


OP6_SQL = _op6_sql()
