"""Exact URL rules from a cascade of Bloom filters, without joining pages to rules.

A rule is a host and a path prefix ("example.net/en/"). It fits its host and all subdomains where the URL's path starts
with the rule's; the longest rule wins (of equally long ones the one that sorts last). The keys a page could be listed
under are few: one per number of host labels and path length that rules have. Over the distinct keys of the whole
corpus (the universe) a cascade is built per verdict: level 0 holds the listed keys, level 1 those of the universe
that pass level 0 but aren't listed, level 2 the listed ones that pass level 1, and so on until none is left. Walking
the levels then tells listed from unlisted keys exactly, for every key of the universe.

Level 0 is sized so that about as many unlisted keys pass as are listed: the filters' size is bounded by the list, not
by the corpus, and checked (`MAX_BITS`). Only filter words reach the driver.

A null URL or one without "://" has empty host and path; such pages, and pages without a fitting rule, are allowed.
Repeated rows are judged alike; other columns are kept; no rows give no rows.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.llm.tables import stored

MAX_BITS = 1 << 26  # 8 MB in an expression, for lists of up to about a million rules


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its words as a comma-separated text, its size in bits and its hash functions."""

    words: str
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        found = F.lit(True)
        for place in _places(key, self):
            # get() of 64-bit words; the bit is tested by shifting it down.
            word = F.get(words, F.floor(place / 64).cast("int"))
            found = found & (F.expr("1L") == _shifted(word, F.pmod(place, F.lit(64))).bitwiseAND(F.lit(1)))
        return found


def _shifted(word: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", word, by.cast("int"))


def _places(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * level.seed + j)), F.lit(level.bits)) for j in range(level.hashes)]


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A filter that holds `keys` (one column, key) and passes other keys at about `rate`."""
    per_key = max(1.0, -math.log(rate) / math.log(2) ** 2)
    bits = 64 * math.ceil(max(64, count * per_key) / 64)
    if bits > MAX_BITS:
        raise ValueError(f"{count} rules need filters of {bits} bits; split the list, up to {MAX_BITS} bits each")
    level = Level("", bits, max(1, round(per_key * math.log(2))), seed)
    place = F.explode(F.array(*_places(F.col("key"), level))).alias("place")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("place", F.lit(64)).cast("int"))
    rows = keys.select(place).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(one).alias("mask")).collect()
    masks = {r["word"]: r["mask"] for r in rows}
    return Level(",".join(str(masks.get(i, 0)) for i in range(bits // 64)), bits, level.hashes, seed)


def cascade(listed: Sequence[str], universe: DataFrame, size: int) -> list[Level]:
    """Levels that tell the listed keys from all others of the universe (a column key of `size` distinct keys)."""
    if not listed:
        return []
    spark = universe.sparkSession
    inside = spark.createDataFrame([(k,) for k in listed], "key string")
    n_in, n_out = len(listed), max(1, size)
    rate = min(0.5, n_in / (math.sqrt(2) * n_out))
    levels = [_level(inside, n_in, rate, 0)]
    outside = universe.filter(levels[0].passes(F.col("key"))).join(inside, "key", "left_anti")
    outside = stored(outside, "bloom")
    sides = [outside, inside]
    while n := sides[0].count():
        level = _level(sides[0], n, 0.5, len(levels))
        levels.append(level)
        # The next level holds what wrongly passes this one on the other side.
        sides = [stored(sides[1].filter(level.passes(F.col("key"))), "bloom"), sides[0]]
    return levels


def member(levels: Sequence[Level], key: Column) -> Column:
    """Whether a key of the universe is listed."""
    inside = F.lit(False)
    for level in reversed(levels):
        inside = level.passes(key) & ~inside
    return inside


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, rules: Sequence[str]) -> Column:
    """The keys under which a page could be listed: host suffixes and path prefixes of the lengths that rules have."""
    found = []
    for labels, length in sorted({(r.partition("/")[0].count(".") + 1, len(r) - len(r.partition("/")[0])) for r in rules}):
        key = F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length))
        fits = (F.length(path) >= length) & (F.length(host) > 0)
        found.append(F.when(fits, key))
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to pages (with a column url).

    `rules` are (rule, verdict) with the verdicts allow and block. The columns host, path, rule and verdict of the
    input, if any, are replaced.
    """
    verdicts = {}
    for rule, verdict in rules:
        name, slash, rest = rule.partition("/")
        rule = name.lower() + slash + rest
        if verdict not in ("allow", "block") or verdicts.setdefault(rule, verdict) != verdict:
            raise ValueError(f"the verdict of {rule!r} must be allow or block, and one of them")
    host, path = parts(F.col("url").cast("string"))
    parsed = pages.withColumns({"host": host, "path": path}).withColumn("_keys", keys(F.col("host"), F.col("path"), list(verdicts)))
    universe = stored(parsed.select(F.explode("_keys").alias("key")).distinct(), "universe")
    size = universe.count()
    levels = {v: cascade([r for r in verdicts if verdicts[r] == v], universe, size) for v in ("allow", "block")}
    listed = F.filter("_keys", lambda k: member(levels["allow"], k) | member(levels["block"], k))
    best = F.array_max(F.transform(listed, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))
    judged = parsed.withColumn("rule", best["key"])
    verdict = F.when(F.col("rule").isNull(), default).when(member(levels["block"], F.col("rule")), "block").otherwise("allow")
    return judged.withColumn("verdict", verdict).drop("_keys")
