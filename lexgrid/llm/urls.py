"""URL rules looked up in Bloom filter cascades, with DataFrame functions only.

A rule is a host (with all its subdomains) and the beginning of a path, to block or to allow. The keys that a URL
could be listed under are the ends of its host joined to the beginnings of its path, of the shapes that rules have.
The keys of all URLs are the universe. Level 1 of a cascade encodes the listed keys, level 2 the keys of the
universe that level 1 wrongly lets pass, level 3 the listed keys that level 2 lets pass, and so on until nothing
passes wrongly: then membership is exact for every key of the universe, without a join. One cascade holds all rules,
a second one, over the rules as universe, tells those that block. The longest listed key decides.

A level's bits are sums over keys made by the executors; only the words of the finished filter come to the driver.
Their number follows the rule list, not the corpus, and is checked against `MOST_BITS`: a longer list is dealt over
several cascades by a hash of the key, which are looked up one after another. A cascade's words stand once in a plan.

Edge cases: a null URL, or one without `://`, has an empty host and path and fits no rule. Without a rule that fits,
or without any rules, the verdict is allow. Of equal rules that disagree, block wins. Between keys of one length the
longer host wins. Rules with a null or empty host are ignored; a null path is empty. Repeated rows get repeated
results. Other columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.runtime import materialise

MOST_BITS = 1 << 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0), F.lit(""))
    return F.translate(host, UPPER, LOWER), path


@dataclass
class Level:
    seed: int
    bits: int
    hashes: int
    words: list[int]

    def passes(self, key: Column, words: Column) -> Column:
        """Whether a key is in the filter; words: this level's words, bound once by bound()."""
        tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in positions(key, self)]
        return reduce(lambda a, b: a & b, tests)


def bound(levels: list[Level], use: Callable[[list[Column]], Column]) -> Column:
    """use(words of each level): the words of all levels are one literal, to which everything that `use` makes refers."""
    words = F.from_json(F.lit(json.dumps([x.words for x in levels])), "array<array<bigint>>")
    return F.get(F.transform(F.array(words), lambda w: use([F.get(w, F.lit(i)) for i in range(len(levels))])), F.lit(0))


def positions(key: Column, level: Level) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level.seed), F.lit(i), key), F.lit(level.bits)) for i in range(level.hashes)]


def build(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of n keys (column key) with a false-positive rate of about `rate`."""
    per_key = max(1.0, -math.log(rate) / math.log(2) ** 2)
    level = Level(seed, 64 * max(1, math.ceil(n * per_key / 64)), max(1, round(per_key * math.log(2))), [])
    at = keys.select(F.explode(F.array(*positions(F.col("key"), level))).alias("p"))
    found = at.groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect()
    level.words = [0] * (level.bits // 64)
    for r in found:
        level.words[r["word"]] = r["bits"]
    return level


def cascade(universe: DataFrame, n_listed: int, n_others: int) -> list[Level]:
    """Levels that tell the listed keys of the universe (columns key, listed) from its others."""
    rate = min(0.5, n_listed * math.sqrt(0.5) / max(1, n_others))
    levels: list[Level] = []
    mine, others, n = universe.filter("listed"), universe.filter(~F.col("listed")), n_listed
    while n:
        levels.append(build(mine, n, rate if not levels else 0.5, len(levels) + 1))
        # what passes wrongly is the next level's list
        wrong = materialise(others.filter(bound(levels[-1:], lambda w: levels[-1].passes(F.col("key"), w[0]))).select("key"), "wrong")
        mine, others, n = wrong, mine, wrong.count()
    return levels


def member(key: Column, levels: list[Level], words: list[Column]) -> Column:
    """Whether a key of the universe is listed: the first level that it does not pass decides."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[i].passes(key, words[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def listed_among(keys: Column, levels: list[Level]) -> Column:
    """Those of an array of keys that a cascade lists."""
    return bound(levels, lambda words: F.filter(keys, lambda k: member(k, levels, words))) if levels else F.filter(keys, lambda k: F.lit(False))


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """(length, host length, key) of all keys of the given shapes (labels of the host, characters of the path), longest first."""
    ends = {n: F.substring_index(host, ".", -n) for n, _ in shapes}
    labels = F.size(F.split(host, r"\."))
    made = [
        F.when((labels >= n) & (F.length(path) >= m), F.struct(-(F.length(ends[n]) + m), -F.length(ends[n]), F.concat(ends[n], F.substring(path, 1, m)).alias("key")))
        for n, m in shapes
    ]
    return F.transform(F.sort_array(F.filter(F.array(*made), lambda x: x.isNotNull())), lambda x: x["key"])


def judge(urls: DataFrame, rules: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for rows of page_id and url. rules: host, path, action (block or allow)."""
    host, path = host_and_path(F.col("url"))
    pages = urls.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.filter("host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), (F.col("action") == "block").alias("blocks"))
    keyed = rules.groupBy(F.concat("host", "path").alias("key")).agg(F.max("blocks").alias("blocks"))
    shapes = [(r[0], r[1]) for r in rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).distinct().orderBy("n", "m").collect()]
    if not shapes:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    listed = materialise(keyed, "rules")
    n = listed.count()
    with_keys = pages.withColumn("keys", candidates(F.col("host"), F.col("path"), shapes))
    keys = with_keys.select(F.explode("keys").alias("key"), F.lit(False).alias("listed")).union(listed.select("key", F.lit(True)))
    universe = materialise(keys.groupBy("key").agg(F.max("listed").alias("listed")), "universe")
    total = universe.count()
    parts = max(1, math.ceil(n * 1.45 * (math.log2(max(2, total / n)) + 2) / most_bits))
    part = lambda key: F.pmod(F.xxhash64(F.lit(-1), key), F.lit(parts))
    out = with_keys.withColumns({"rules": F.array().cast("array<string>"), "blocks": F.array().cast("array<string>")})
    for p in range(parts):
        mine = listed.filter(part(F.col("key")) == p)
        others = universe.filter(part(F.col("key")) == p)
        n, n_blocks = mine.agg(F.count("*"), F.count_if("blocks")).first()
        all_rules = cascade(others, n, others.count() - n)
        blocking = cascade(mine.select("key", F.col("blocks").alias("listed")), n_blocks, n - n_blocks)
        here = F.lit(p)
        hits = listed_among(F.filter("keys", lambda k: part(k) == here), all_rules)  # noqa: B023  made at once
        out = out.withColumn("hits", hits).withColumns({"rules": F.concat("rules", "hits"), "blocks": F.concat("blocks", listed_among(F.col("hits"), blocking))}).drop("hits")
        if parts > 1:
            out = materialise(out, "judged")
    rule = F.get(F.filter("keys", lambda k: F.array_contains("rules", k)), F.lit(0))
    verdict = F.when(F.array_contains("blocks", F.col("rule")), "block").otherwise("allow")
    return out.withColumn("rule", rule).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), verdict).otherwise("allow").alias("verdict"))
