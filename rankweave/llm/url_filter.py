"""URL filtering: path rules first, then exact membership in a block list by a cascade of Bloom filters.

A cascade answers membership without a join and without false positives for every key of a known universe.
Level 1 encodes the listed keys; level 2 the universe's keys that level 1 takes wrongly; level 3 the listed
keys that level 2 takes wrongly, and so on until nothing is taken wrongly. A key's verdict is the parity of
the first level that doesn't have it. The universe is every key of the corpus, so the answer is exact for
every row.

Size: level 1's false positive rate is chosen as sqrt(1/2) * listed / universe, each further level's as 1/2,
so each level holds about as many keys as the list at most: the cascade grows with the list (times the log of
the universe), not with the corpus. The universe is a written table; a pass over it for each cascade gives level 1's
false positives, less the listed keys by an anti join. What comes to the driver is bounded by ``max_listed``: a longer
list is split by the key's hash into shards, each a cascade of its own that is built, applied to the rows and
forgotten before the next, and a level 1 that takes more wrongly than its rate allows is built anew at a lower rate.

The list is a parameter: host names, or a table with a column ``host`` for lists of any length.

Keys are host names and all their parents (``m.a.example.org``, ``a.example.org``, ``example.org``): a URL is
listed if one of them is. Defined cases: a null URL or one without ``://`` has empty host and path, fits no
rule and no key, and is allowed; an empty table or list works; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankweave.runtime import materialize, small_batches

#: (action, host, path) of the rules; the longest that fits wins.
RULES: tuple[tuple[str, str, str], ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The block list: hosts, their subdomains included.
LISTED: tuple[str, ...] = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))
#: Listed keys that one cascade holds at most.
MAX_LISTED = 500_000


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(the longest fitting rule, its action), null where none fits."""
    name = action = F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # the longest last: it stands outermost
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return name, action


def keys_of(host: str) -> list[str]:
    """The host and its parents of two labels or more."""
    labels = host.split(".") if host else []
    return [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] if labels else []


class Bloom:
    """A Bloom filter over bytes; ``salt`` makes the hashes of each level independent."""

    def __init__(self, keys: Sequence[bytes], rate: float, salt: int):
        n = max(1, len(keys))
        rate = min(max(rate, 1e-12), 0.5)
        self.size = max(64, int(np.ceil(-n * np.log(rate) / np.log(2) ** 2)))
        self.turns = max(1, round(-np.log2(rate)))
        self.salt = salt
        self.bits = np.zeros((self.size + 7) // 8, dtype=np.uint8)
        for key in keys:
            for at in self._places(key):
                self.bits[at >> 3] |= 1 << (at & 7)

    def _places(self, key: bytes) -> list[int]:
        both = xxhash.xxh128_intdigest(key, self.salt)
        one, two = both & 0xFFFFFFFFFFFFFFFF, (both >> 64) | 1
        return [(one + i * two) % self.size for i in range(self.turns)]

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[at >> 3] >> (at & 7) & 1 for at in self._places(key))


class Cascade:
    """Levels of Bloom filters; exact for every key of the universe it was built over."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    @staticmethod
    def rate(listed: int, universe: int) -> float:
        """Level 1's: about as many keys of the universe are taken wrongly as half to all of the list."""
        return float(np.sqrt(0.5) * max(1, listed) / max(1, universe))

    @classmethod
    def build(cls, listed: Sequence[bytes], first: Bloom, wrong: Sequence[bytes]) -> Cascade:
        """``wrong``: the unlisted keys of the universe that ``first`` takes."""
        levels, inside, outside = [first], list(wrong), list(listed)
        while inside:
            levels.append(Bloom(inside, 0.5, len(levels) + 1))
            inside, outside = [k for k in outside if k in levels[-1]], inside
        return cls(levels)

    def __contains__(self, key: bytes) -> bool:
        for n, level in enumerate(self.levels):
            if key not in level:
                return n % 2 == 1
        return len(self.levels) % 2 == 1


def _list_table(spark: SparkSession, listed: Sequence[str] | DataFrame) -> DataFrame:
    """The different listed keys (key), lower-cased, as a written table."""
    rows = listed.select(F.col("host").cast("string").alias("key")) if isinstance(listed, DataFrame) else spark.createDataFrame([(h,) for h in listed], "key string")
    lower = F.translate("key", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return materialize(rows.select(lower.alias("key")).filter("key <> ''").distinct(), "listed")


def _universe(hosts: DataFrame) -> DataFrame:
    """Every key of the column ``host``, once, as a written table."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": pa.array([k for h in batch.column(0).to_pylist() for k in keys_of(h)], pa.string())})

    small_batches(hosts.sparkSession, 8192)
    return materialize(hosts.select("host").filter("host <> ''").distinct().mapInArrow(spread, "key string").distinct(), "url-keys")


def cascades(urls: DataFrame, listed: Sequence[str] | DataFrame, max_listed: int = MAX_LISTED) -> Iterator[Cascade]:
    """Cascades over the hosts of ``urls`` (a column ``host``), one for each shard of the list, built one at a time."""
    spark = urls.sparkSession
    every, universe = _list_table(spark, listed), _universe(urls)
    total, n = universe.count(), -(-every.count() // max_listed) or 1
    for number in range(n):
        shard = every.filter(F.pmod(F.xxhash64("key"), F.lit(n)) == number)
        keys = sorted(r.key.encode() for r in shard.collect())  # about max_listed by the hash
        rate = Cascade.rate(len(keys), total)
        while True:
            first = Bloom(keys, rate, 1)
            wrong = _taken_wrongly(universe, shard, first, 4 * max_listed)
            if wrong is not None:
                break
            rate /= 16
        yield Cascade.build(keys, first, wrong)


def _taken_wrongly(universe: DataFrame, shard: DataFrame, first: Bloom, most: int) -> list[bytes] | None:
    """The unlisted keys of the universe that ``first`` takes, or None if they are more than ``most``."""
    sent = universe.sparkSession.sparkContext.broadcast(first)

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"key": pa.array([k for k in batch.column(0).to_pylist() if k.encode() in sent.value], pa.string())})

    small_batches(universe.sparkSession, 8192)
    found = universe.mapInArrow(taken, "key string").join(shard, "key", "left_anti").limit(most + 1).collect()
    return None if len(found) > most else sorted(r.key.encode() for r in found)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: Sequence[str] | DataFrame = LISTED, max_listed: int = MAX_LISTED) -> DataFrame:
    """page_id, host, path, rule, verdict of every row: the rule's verdict, else block for listed hosts and allow for others."""
    url = F.col("url").cast("string")
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rows = parts.withColumn("hit", F.lit(False))
    for number, cascade in enumerate(cascades(parts, listed, max_listed)):
        sent = pages.sparkSession.sparkContext.broadcast(cascade)

        @F.pandas_udf("boolean")
        def is_listed(hosts, sent=sent):
            memo = {host: any(k.encode() in sent.value for k in keys_of(host)) for host in hosts.unique()}
            return hosts.map(memo).astype(bool)

        if number:  # one cascade in memory at a time
            rows = materialize(rows, "judged")
        rows = rows.withColumn("hit", F.col("hit") | is_listed("host"))
    name, action = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(action, F.when(F.col("hit"), "block").otherwise("allow")).alias("verdict"))


def oracle() -> str:
    """The same rows in DuckDB's SQL."""
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    order = sorted(RULES, key=lambda r: -(len(r[1]) + len(r[2])))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in order) + " END"
    act = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for a, h, p in order) + " END"
    listed = " OR ".join(f"host = '{h}' OR ends_with(host, '.{h}')" for h in LISTED)
    return f"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, {rule} AS rule, coalesce({act}, CASE WHEN {listed} THEN 'block' ELSE 'allow' END) AS verdict FROM p
"""
