"""URL filter: ordered rules by longest match, then exact membership in a list of hosts by a Bloom filter cascade.

The cascade knows two finite sets: the listed keys and every other key that the corpus holds. Level 0 is a Bloom filter of the
listed keys; the other keys that pass it by accident are put in level 1, the listed keys that pass that one in level 2, and so
on until none passes. A key of that universe is then judged by the first level that refuses it: by an even level as other, by
an odd one as listed. So the answers are exact for the corpus, and judging a row takes a few bit tests: no join and no shuffle of
rows. Level 0 is sized for a share sqrt(1/2) * listed / others of false positives (half at most), all later ones for half, which is
where the bits of all levels together are fewest: some 1.4 for a key of each level. Once few keys are left they get more bits, as a
level costs a pass over the keys.

A filter is a table of one row, and reaches the tasks as the value of a scalar subquery. It is of bounded size: the keys are dealt by
hash to passes of at most PASS_KEYS listed keys, each with a cascade of its own, and a row is judged in the pass of each of its keys.

Cases: a null url, or one without `://`, has the empty host and path and fits no rule; it is allowed. Ports and user names stay
part of the host, as the contract cuts it. A rule wins over the list. Hosts are compared with A-Z lower-cased, paths exactly.
Urls of any length are taken whole. Repeated rows are judged alike, one row each; an empty table gives an empty result, an empty list
blocks nothing; other columns pass unchanged, of columns named like a result the result stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.session import ascii_lower, cut, free_name

#: Listed keys of a pass, whose first filter takes 1.4 to 29 bits each.
PASS_KEYS = 1 << 22
LEAST_SHARE = 1e-6
#: Up to so many keys a later level gets this share of false positives.
FEW_KEYS, FEW_SHARE = 1 << 16, 2**-10


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return f"{self.host}{self.path}"


@dataclass(frozen=True)
class Level:
    seed: int
    n_bits: int
    hashes: int
    words: DataFrame  # one row, one array of 64-bit words


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domain(host: Column, labels: int) -> Column:
    """The last labels of a host; the whole of one that has no more."""
    return F.substring_index(host, ".", -labels)


def _positions(key: Column, seed: int, n_bits: int, hashes: int) -> list[Column]:
    one, two = (F.xxhash64(F.lit(2 * seed + k), key).bitwiseAND(F.lit(0x7FFFFFFF)) for k in (0, 1))  # short of an overflow
    return [F.pmod(one + F.lit(i) * two, F.lit(n_bits).cast("long")) for i in range(hashes)]


def _passes(key: Column, level: Level) -> Column:
    words = level.words.scalar()
    tests = (F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in _positions(key, level.seed, level.n_bits, level.hashes))
    return reduce(lambda a, b: a & b, tests)


def _level(keys: DataFrame, n: int, seed: int, share: float) -> Level:
    """A Bloom filter of the n keys (column `key`) with this share of false positives. Its words are set in parallel."""
    size = 64 * math.ceil(n * math.log2(1 / share) / math.log(2) / 64)
    hashes = max(1, round(math.log2(1 / share)))
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, size, hashes))).alias("p"))
    put = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    every = keys.sparkSession.range(size // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits"))
    words = put.unionByName(every).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    row = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words"))  # PASS_KEYS bounds it
    return Level(seed, size, hashes, cut(row))


def build_cascade(listed: DataFrame, others: DataFrame) -> list[Level]:
    """Levels for the listed keys against the other keys of the corpus, both different ones in a column `key`."""
    n, m = listed.count(), others.count()
    if not n or not m:
        return [] if not n else [_level(listed, n, 0, 0.5)]
    levels = [_level(listed, n, 0, min(0.5, max(LEAST_SHARE, math.sqrt(0.5) * n / m)))]
    inside, outside = listed, cut(others.where(_passes(F.col("key"), levels[0])))
    while (n := outside.count()) > 0:
        levels.append(_level(outside, n, len(levels), 0.5 if n > FEW_KEYS else FEW_SHARE))
        inside, outside = outside, cut(inside.where(_passes(F.col("key"), levels[-1])))
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Exact for keys of the universe the cascade was built over."""
    out = F.lit(len(levels) % 2 == 1)
    for k in range(len(levels) - 1, -1, -1):
        out = F.when(_passes(key, levels[k]), out).otherwise(F.lit(k % 2 == 1))
    return out


def cascades(listed: DataFrame, hosts: DataFrame) -> Iterator[Column]:
    """For each pass the condition that a row's `host`, or a domain above it, is one of the pass's listed keys."""
    listed = cut(listed.where("key <> ''").distinct())
    sizes = sorted(r[0] for r in listed.select(F.size(F.split("key", r"\."))).distinct().collect())  # a host has 127 labels at most
    n_passes = max(1, math.ceil(listed.count() / PASS_KEYS))
    turn = lambda key: F.pmod(F.xxhash64(key, F.lit(77)), F.lit(n_passes))
    if not sizes:
        return
    keys = hosts.select(F.explode(F.array(*[domain(F.col("host"), k) for k in sizes])).alias("key")).distinct()
    others = cut(keys.join(listed, "key", "left_anti"))
    for k in range(n_passes):
        levels = build_cascade(listed.where(turn(F.col("key")) == k), others.where(turn(F.col("key")) == k))
        if levels:
            one = lambda c: (turn(c) == k) & is_listed(c, levels) if n_passes > 1 else is_listed(c, levels)  # noqa: E731, B023
            yield reduce(lambda a, b: a | b, (one(domain(F.col("host"), d)) for d in sizes))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as its text; null if none does."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        out = F.when(((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path), F.lit(r.text)).otherwise(out)
    return out


def judge(pages: DataFrame, rules: list[Rule], listed: DataFrame, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict: the rule's, else block where the host or a domain above it is listed."""
    named = {"host": url_host(F.col(url)), "path": url_path(F.col(url))}
    out = pages.drop(*(c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url)).withColumns(named)
    out = out.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules))
    hit = free_name(out, "_hit")
    listed = listed.select(ascii_lower(F.col("key")).alias("key"))
    out, n = out.withColumn(hit, F.lit(False)), 0
    for listed_here in cascades(listed, out.select("host").distinct()):
        out, n = (cut(out) if n else out).withColumn(hit, F.col(hit) | listed_here), n + 1
    told = reduce(lambda a, r: F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(a), rules, F.lit(None).cast("string"))
    out = out.withColumn("verdict", F.coalesce(told, F.when(F.col(hit), F.lit("block")).otherwise(F.lit("allow"))))
    return out.select(*(c for c in pages.columns if c in out.columns and c not in named), "host", "path", "rule", "verdict")
