"""URL filters: exact membership of listed keys by a cascade of Bloom filters.

A key is a host (or a parent domain of it) followed by a prefix of the path.
The first filter encodes the listed keys, the second those keys of the corpus
that pass the first by chance, the third the listed keys that pass the second,
and so on until nothing passes by chance.  Over the corpus's complete key
universe the answer is then exact, and no join is needed to look keys up.

All filters together take a few bytes a listed key and level (the first is sized
so that about as many keys pass by chance as are listed), so what is sent with
the plan is bounded by the list, not by the corpus.  A list of more than
``MAX_LISTED`` keys is not sent at all: its keys are joined.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import materialize, release

#: (action, host, path) of the contract's rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
MAX_LISTED = 4_000_000


@dataclass
class Bloom:
    """``bits`` holds ``m`` bits, lowest bit of a byte first."""

    m: int
    k: int
    seed: int
    bits: bytes

    def positions(self, key: Column) -> list[Column]:
        h1, h2 = F.xxhash64(F.lit(2 * self.seed), key), F.xxhash64(F.lit(2 * self.seed + 1), key)
        # 62 bits and 56 bits times at most 63: the sum fits a long
        start, step = F.shiftrightunsigned(h1, 2), F.shiftrightunsigned(h2, 8)
        return [F.pmod(start + step * F.lit(j), F.lit(self.m)) for j in range(self.k)]

    def passes(self, key: Column) -> Column:
        data, every = F.lit(bytearray(self.bits)), F.lit(True)
        for at in self.positions(key):
            one = F.substring(data, (F.floor(at / 8) + 1).cast("int"), F.lit(1))
            byte = F.ascii(F.decode(one, "ISO-8859-1"))
            every = every & (F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
        return every


def build_bloom(keys: DataFrame, n: int, rate: float, seed: int) -> Bloom:
    """A filter of the ``key`` column's ``n`` values with false-positive ``rate``.

    The bits are set by an aggregation over bytes; only the filter comes to the
    driver.
    """
    k = min(63, max(1, round(-math.log2(rate))))
    m = max(64, math.ceil(n * k / math.log(2) / 8) * 8)
    empty = Bloom(m, k, seed, b"")
    at = keys.select(F.explode(F.array(*[p + 1 for p in empty.positions(F.col("key"))])).alias("at"))  # Spark counts bits from 1
    rows = at.groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    bits = bytearray(m // 8 + (1 << 12))
    for r in rows:
        begin = (r["part"] - 1) * len(r["bits"])
        bits[begin : begin + len(r["bits"])] = r["bits"]
    return Bloom(m, k, seed, bytes(bits[: m // 8]))


@dataclass
class Cascade:
    levels: list[Bloom] = field(default_factory=list)

    def contains(self, key: Column) -> Column:
        """The first filter that a key fails tells: odd, not listed; even, listed."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            answer = F.when(self.levels[i - 1].passes(key), answer).otherwise(F.lit(i % 2 == 0))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """``listed`` and ``universe`` have a string column ``key``; listed keys need
    not occur in the universe, and the universe may repeat keys."""
    listed = listed.select("key").distinct()
    n = listed.count()
    if n == 0:
        return Cascade()
    total = universe.agg(F.approx_count_distinct("key")).first()[0]
    out = Cascade([build_bloom(listed, n, min(0.5, n / max(1, 2 * total)), 0)])
    # what passes by chance, alternately of the universe and of the list
    inside = listed
    wrong = universe.filter(out.levels[0].passes(F.col("key"))).select("key").distinct()
    wrong = wrong.join(listed, "key", "left_anti")
    while True:
        now = materialize(wrong, "url-keys")
        left = now.count()
        if left == 0:
            release(now, inside)
            return out
        level = build_bloom(now, left, 0.25, len(out.levels))
        out.levels.append(level)
        wrong, inside = inside.filter(level.passes(F.col("key"))), now


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def key_universe(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys of a URL that a listed key of one of these shapes (labels of the
    host, length of the path) could be: as many as there are shapes, at most."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    keys = [
        F.when((labels >= n) & (F.length(path) >= size), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, size)))
        for n, size in shapes
    ]
    return F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<string>")


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = [F.struct(F.lit(a).alias("action"), F.lit(h.lower() + p).alias("key"), F.lit(len(p)).alias("path_length")) for a, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    max_listed: int = MAX_LISTED,
) -> DataFrame:
    """id, host, path, rule, verdict for every row of ``pages``.

    ``rules``: action, key (lower-case host, then path), path_length.  The longest
    rule that fits wins (of equal lengths the greater string; of two actions for
    one key, block); ``default`` is the verdict where none fits.  A null url, or
    one without ``://``, has empty host and path and fits no rule with a host.
    Repeated rows are judged one by one; other columns are not read.  A url makes
    one key for each shape of the listed keys, however long it is.
    """
    hosts = F.expr("substring(key, 1, length(key) - path_length)")
    rules = rules.withColumn("labels", F.length(hosts) - F.length(F.replace(hosts, F.lit("."), F.lit(""))) + 1)
    shapes = sorted((r[0], r[1]) for r in rules.select("labels", "path_length").distinct().collect())
    parts = pages.select(
        F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path")
    )
    keyed = parts.withColumn("keys", key_universe(F.col("host"), F.col("path"), shapes))
    if rules.count() > max_listed:
        return _joined(keyed, rules, default)
    universe = keyed.select(F.explode("keys").alias("key"))
    any_rule = build_cascade(rules.select("key"), universe)
    block = build_cascade(rules.filter("action = 'block'").select("key"), rules.select("key"))
    fits = F.filter("keys", lambda k: any_rule.contains(k))
    longest = F.array_max(F.transform(fits, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    found = keyed.select("page_id", "host", "path", longest.alias("rule"))
    verdict = F.when(F.col("rule").isNull(), default).when(block.contains(F.col("rule")), "block").otherwise("allow")
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def _joined(keyed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a join on the keys."""
    stored = materialize(keyed.withColumn("_rid", F.monotonically_increasing_id()), "url-pages")
    actions = rules.groupBy("key").agg(F.max(F.col("action") == "block").alias("blocked"))
    keys = stored.select("_rid", F.explode("keys").alias("key")).join(actions, "key")
    best = keys.groupBy("_rid").agg(F.max(F.struct(F.length("key").alias("n"), F.col("key").alias("k"), "blocked")).alias("best"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.blocked"), "block").otherwise("allow")
    return stored.join(best, "_rid", "left").select("page_id", "host", "path", F.col("best.k").alias("rule"), verdict.alias("verdict"))


def op8_url_filters(pages: DataFrame) -> DataFrame:
    return judge_urls(pages, rules_frame(pages.sparkSession))


OP8_SQL = r"""
with r(verdict, host, path) as (values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), p as (
  select row_number() over () rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) path from pages
), m as (
  select p.rid, r.verdict, r.host || r.path rule, row_number() over (partition by rid order by length(r.host || r.path) desc, r.host || r.path desc) n
  from p join r on (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
)
select page_id, p.host, p.path, m.rule, coalesce(m.verdict, 'allow') verdict from p left join m on p.rid = m.rid and m.n = 1"""
