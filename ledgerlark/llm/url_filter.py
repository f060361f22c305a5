"""URL filters: a few rules by host and path, and a list of any size by a cascade of Bloom filters.

The first level encodes the listed keys, the second the keys of the corpus that pass the first though they are not listed,
the third the listed keys that pass the second, and so on until none is left. For every key that the corpus asks about,
the level at which it first fails tells exactly whether it is listed. Pages are judged by looking at bits of the levels,
so neither pages nor their keys are joined with the list. DataFrame functions only.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): a rule fits its host and all subdomains where the url's path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
MOST_RULES = 1000

#: Domains of the given pages that advertise, gamble, sell pills or show adult content, under each of their endings.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{name}.example.{ending}" for name in LISTED_NAMES for ending in ("com", "net", "org"))

#: Bits of one level at most; a longer list is dealt by hash over several cascades, which judge the pages in turn.
MOST_BITS = 1 << 25


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash; empty for null and without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null for none. Of rules of one length, the longer host wins,
    then a block. Rules are configuration: more than ``MOST_RULES`` belong into the list."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; pass them as listed keys")
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    first = lambda values: F.coalesce(*(F.when(fit, F.lit(v)) for fit, v in zip(fits, values, strict=True)), F.lit(None).cast("string"))
    return first([h + p for _, h, p in order]), first([v for v, _, _ in order])


def list_keys(listed: DataFrame, entry_col: str = "entry") -> DataFrame:
    """``key, labels`` of the entries of a list, once each: a name (with or without a slash at its end) stands for a domain
    and its subdomains, a name with a path for that page. Null and empty entries are none."""
    entry = F.translate(F.regexp_replace(F.col(entry_col), "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), UPPER, LOWER)
    host = F.regexp_extract(entry, "^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(F.col(entry_col), "^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), "^[^/?#]*([^?#]*)", 1)
    rows = listed.select(host.alias("host"), path.alias("path")).filter(F.col("host") != "")
    domain = F.col("path").isin("", "/")
    key = F.when(domain, F.concat(F.lit("d:"), F.col("host"))).otherwise(F.concat(F.lit("p:"), F.col("host"), F.col("path")))
    return rows.select(key.alias("key"), F.when(domain, F.size(F.split("host", r"\."))).otherwise(F.lit(0)).alias("labels")).distinct()


def url_keys(host: Column, path: Column, labels: int) -> list[Column]:
    """The keys under which a list can hold a url: its page, and its last 1 to ``labels`` labels where it has as many. No
    key in the list has more, so a host of many labels has no other keys to ask about. Null where there is no host."""
    some = host != ""
    count = F.size(F.split(host, r"\."))
    domains = [F.when(some & (count >= n), F.concat(F.lit("d:"), F.substring_index(host, ".", -n))) for n in range(1, labels + 1)]
    return [F.when(some, F.concat(F.lit("p:"), host, path)), *domains]


def _marks(key: Column, salt: int, words: int, bits: int) -> list[tuple[Column, Column]]:
    """The words of a level in which a key sets bits, and which: up to four in each, from one hash. The salt goes into the
    hash before the key, so keys that collide in one level part in another."""
    found = []
    for group in range(-(-bits // 4)):
        h = F.xxhash64(F.lit(salt).cast("long"), F.lit(group), key)
        ones = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * j).bitwiseAND(F.lit(63).cast("long")).cast("int")) for j in range(min(4, bits - 4 * group))]
        found.append((F.pmod(F.shiftright(h, 24), F.lit(words).cast("long")).cast("int"), reduce(Column.bitwiseOR, ones)))
    return found


class Level:
    """One Bloom filter: a written table of one row with its words, which plans read as a scalar subquery."""

    def __init__(self, keys: DataFrame, n: int, rate: float, salt: int):
        self.salt, self.bits = salt, max(1, round(-math.log2(rate)))
        self.size = max(1, math.ceil(n * self.bits / math.log(2) / 64))
        ones = keys.select(F.inline(F.array(*(F.struct(i.alias("i"), w.alias("w")) for i, w in _marks(F.col("key"), salt, self.size, self.bits)))))
        zeros = keys.sparkSession.range(self.size).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("w"))
        words = ones.unionAll(zeros).groupBy("i").agg(F.bit_or("w").alias("w"))
        # One row of at most MOST_BITS / 64 words or so, whatever the corpus.
        self.words = materialize(words.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"]).alias("words")), "bloom")

    def passes(self, key: Column) -> Column:
        words = self.words.scalar()
        return reduce(and_, (F.get(words, i).bitwiseAND(w) == w for i, w in _marks(key, self.salt, self.size, self.bits)))


class Cascade:
    """Exact membership of a corpus's keys in a list, by levels of Bloom filters.

    ``listed`` and ``asked`` have a column ``key``; ``asked`` may repeat keys and hold nulls, and is scanned once for its
    number of keys and once for those that pass the first level: only those are told apart and compared with the list. Later
    levels see the few keys that the level before let through. The first level's rate balances both sides, r / (s sqrt 2)
    for r listed keys among s others; later ones pass one key in ``1 / later``."""

    def __init__(self, listed: DataFrame, n_listed: int, asked: DataFrame, salt: int = 0, later: float = 1 / 16):
        self.levels: list[Level] = []
        self.empty = n_listed == 0
        if self.empty:
            return
        others = asked.agg(F.approx_count_distinct("key")).first()[0] or 0
        rate = min(0.5, max(2.0**-20, n_listed / (math.sqrt(2) * max(1, others))))
        self.levels.append(first := Level(listed, n_listed, rate, salt))
        let_through = asked.filter(F.col("key").isNotNull()).filter(first.passes(F.col("key"))).distinct()
        both = materialize(let_through.join(listed.withColumn("in_list", F.lit(True)), "key", "left"), "passed")
        inside, wrong = both.filter("in_list").select("key"), both.filter("in_list IS NULL").select("key")
        while n := wrong.count():
            self.levels.append(level := Level(wrong, n, later, salt + len(self.levels)))
            # What belongs to the other side and passes here has to be told apart by the next level.
            inside, wrong = wrong, materialize(inside.filter(level.passes(F.col("key"))), "wrong")

    def holds(self, key: Column) -> Column:
        if self.empty:
            return F.lit(False)
        found = self.levels[-1].passes(key)
        for level in self.levels[-2::-1]:
            found = level.passes(key) & ~found
        return F.coalesce(found, F.lit(False))


def filter_urls(
    pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, id_col: str = "page_id", url_col: str = "url", entry_col: str = "entry", most_bits: int = MOST_BITS
) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed`` of each page.

    The longest rule that fits decides; where none does, a page is blocked if the list holds its domain, a parent of it or
    the page itself. Only ids and urls are read; null urls and those without ``://`` have an empty host and path and no key,
    and are allowed. Repeated rows are judged alike, each gives a row; an empty table gives none, and an empty list blocks
    nothing. A list whose first level would be larger than ``most_bits`` is dealt by hash over several cascades; pages then
    pass them in turn, with what was found written in between, so a task holds one cascade at a time.
    """
    keys = materialize(list_keys(listed, entry_col), "listed")
    n, labels = keys.agg(F.count("*"), F.coalesce(F.max("labels"), F.lit(0))).first()
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    asked_of = url_keys(F.col("host"), F.col("path"), labels)
    # 20 hashes at most for a listed key.
    parts = max(1, math.ceil(n * 20 / math.log(2) / most_bits))
    rows = parsed.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.lit(False).alias("listed"))
    if parts > 1:
        rows = materialize(rows, "urls")
    part = lambda key: F.pmod(F.xxhash64(F.lit(-1).cast("long"), key), F.lit(parts))
    for i in range(parts):
        own = keys if parts == 1 else materialize(keys.filter(part(F.col("key")) == i), "listed")
        asked = rows.select(F.explode(F.array(*asked_of)).alias("key"))
        cascade = Cascade(own.select("key"), n if parts == 1 else own.count(), asked if parts == 1 else asked.filter(part(F.col("key")) == i), 1000 * i)
        hits = [cascade.holds(k) if parts == 1 else F.coalesce(part(k) == i, F.lit(False)) & cascade.holds(k) for k in asked_of]
        rows = rows.withColumn("listed", reduce(or_, hits, F.col("listed")))
        if i < parts - 1:
            rows = materialize(rows, "urls")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed")


def filter_pages(pages: DataFrame) -> DataFrame:
    """``filter_urls`` with the standing rules and list; cases as there."""
    return filter_urls(pages, pages.sparkSession.createDataFrame([(name,) for name in LISTED], "entry string"))


URL_SQL = """
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r(rule, verdict, host, path) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
    ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), l AS (
  SELECT name || '.example.' || ending AS domain
  FROM unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) n(name), unnest(['com', 'net', 'org']) e(ending)
), m AS (
  SELECT u.*, (SELECT max_by(struct_pack(rule := r.rule, verdict := r.verdict), length(r.rule)) FROM r
      WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS fit,
    EXISTS (SELECT 1 FROM l WHERE u.host = l.domain OR ends_with(u.host, '.' || l.domain)) AS listed
  FROM u
)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM m
"""
