"""URL filters: host and path rules, then a Bloom filter cascade over the corpus's pages, by SQL functions only.

A page's key is its host and path.  The complete key universe (every distinct key of the pages) is known, so a cascade
is exact for a given list of keys: level 1 holds the listed keys, level 2
the unlisted keys that level 1 lets through, level 3 the listed keys that level 2 lets through, and so on until nothing
is let through.  A key is listed if the number of levels that accept it in a row is odd.  Pages are then judged in one
scan without a join or a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values: (verdict, host, path) rules, and words of host names that put a page on the query's block list.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCKED_WORDS = ("adult", "ads", "bet", "bets", "cams", "casino", "gambling", "loans", "pills", "poker", "porn", "spam", "viagra", "xxx")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does.  Equally long: the one listed first."""
    rule = verdict = None
    for what, domain, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(prefix)
        name = F.lit(domain + prefix)
        rule = F.when(fits, name) if rule is None else rule.when(fits, name)
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return rule, verdict


@dataclass
class Level:
    bits: int
    hashes: int
    words: list[int]

    def accepts(self, key: Column, level: int) -> Column:
        """The words are one constant of the plan; each hash reads one of them."""
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        hit = F.lit(True)
        for at in _positions(key, level, self.bits, self.hashes):
            word = F.element_at(table, (F.floor(at / 64) + 1).cast("int"))
            hit = hit & (F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1)
        return hit


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level), F.lit(j), key), F.lit(bits)) for j in range(hashes)]


def build_level(keys: DataFrame, level: int, n: int, bits_per_key: int, hashes: int) -> Level:
    """``keys``: one column ``key``.  Bits are set in 64-bit words, which are or-ed before the shuffle."""
    bits = max(64, -(-n * bits_per_key // 64) * 64)
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("at", F.lit(64)).cast("int"))).alias("bits"))
    table = [0] * (bits // 64)
    for row in words.collect():
        table[row["word"]] = row["bits"]
    return Level(bits, hashes, table)


def build_cascade(universe: DataFrame, first_bits: int = 8, next_bits: int = 3, max_bits: int = 1 << 25) -> list[Level] | None:
    """``universe``: distinct non-null ``key`` and boolean ``listed`` (null: false).

    None if the listed keys need more than ``max_bits`` bits: beyond that bound nothing is collected, and ``listed_flag``
    joins instead.  Every level shrinks by a factor, so the whole cascade stays within about twice the first level.
    """
    held, other = universe.filter("listed").select("key"), universe.filter("not coalesce(listed, false)").select("key")
    levels: list[Level] = []
    n = held.count()
    while n:
        if n * first_bits > max_bits:
            return None
        level = build_level(held, len(levels), n, next_bits if levels else first_bits, 2 if levels else 5)
        passed = other.filter(level.accepts(F.col("key"), len(levels)))
        levels.append(level)
        passed = shared.materialise(passed, "false-positives")
        held, other, n = passed, held, passed.count()
    return levels


def member(key: Column, levels: list[Level]) -> Column:
    """Exact for keys of the universe; other keys may be taken for listed."""
    listed = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        listed = F.when(levels[i].accepts(key, i), listed).otherwise(F.lit(i % 2 == 1))
    return listed


def listed_flag(rows: DataFrame, key: str, universe: DataFrame, max_bits: int = 1 << 25) -> DataFrame:
    """``rows`` with a boolean column ``listed`` (replaced if there), by the cascade, beyond its bound by a join."""
    levels = build_cascade(universe, max_bits=max_bits)
    if levels is not None:
        return rows.withColumn("listed", member(F.col(key), levels))
    own = shared.fresh("listed_key", rows.columns)
    listed = universe.filter("listed").select(F.col("key").alias(own))
    return rows.drop("listed").join(listed, F.col(key) == F.col(own), "left").withColumn("listed", F.col(own).isNotNull()).drop(own)


def blocked_hosts(host: Column, words=BLOCKED_WORDS) -> Column:
    """Whether a host name has a blocked word between its dots and hyphens."""
    return F.arrays_overlap(F.split(host, "[.-]"), F.array(*(F.lit(x) for x in words))) if words else F.lit(False)


def block_list(pages: DataFrame, words=BLOCKED_WORDS) -> DataFrame:
    """A list of keys for want of a given one: the distinct host and path of pages on hosts with a blocked word."""
    url = F.col("url").cast("string")
    return pages.select(host_of(url).alias("host"), path_of(url).alias("path")).filter(blocked_hosts(F.col("host"), words)).select(F.concat("host", "path").alias("key")).distinct()


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, max_bits: int = 1 << 25) -> DataFrame:
    """page_id, host, path, rule, verdict.  ``listed``: the block list, one column ``key`` (host and path); nulls and
    repeats in it don't matter, nor do keys of no page.

    Pages that no rule fits are blocked if their key is listed.  A page without host fits no rule and has an empty key,
    which is on no list: allowed.  Rows are judged one by one, so repeated urls get equal verdicts; an empty table gives
    an empty result.
    """
    url = F.col("url").cast("string")
    seen = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path")).withColumn("key", F.concat("host", "path"))
    keys = listed.select(F.col("key").cast("string").alias("key")).filter("key <> ''").distinct().withColumn("listed", F.lit(True))
    universe = shared.materialise(seen.select("key").distinct().join(keys, "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed")), "url-keys")
    flagged = listed_flag(seen, "key", universe, max_bits)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return flagged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op10_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = shared.read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, shared.materialise(block_list(pages), "block-list"))


OP10_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN list_has_any(string_split(replace(host, '-', '.'), '.'), [{", ".join(f"'{w}'" for w in BLOCKED_WORDS)}]) THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
