"""URL rules by a cascade of Bloom filters.

Level 1 encodes the listed keys, level 2 the keys of the corpus that are not listed but pass level 1, level 3 the listed
keys that pass level 2, and so on until a level has no false positive. Every key that the corpus can ask about took
part in building, so the answer is exact, and it takes a few bit tests in the projection: no join.

A key is a host and the beginning of a path. For each shape that occurs in the rules (number of host labels, length of the
path's beginning) a url has at most one key, so its questions are as many as the rules' shapes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASHES, BITS_PER_KEY = 5, 10
#: A level's bits travel in the plan; beyond this size (16 MB) building refuses.
MOST_BITS = 1 << 27
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str = ""  # with its first slash

    @property
    def key(self) -> str:
        return self.host + self.path

    @property
    def shape(self) -> tuple[int, int]:
        return self.host.count(".") + 1, len(self.path)


def parse_rule(action: str, key: str) -> Rule:
    host, slash, path = key.partition("/")
    return Rule(action, host, slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end. Without ://, empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, _UPPER, _LOWER), path


def _bits(key: Column, level: int, m: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * level + k)), F.lit(m)) for k in range(HASHES)]


class BloomCascade:
    """levels: (bits as 64-bit words, number of bits), in order."""

    def __init__(self, levels: list[tuple[list[int], int]]):
        self.levels = levels

    @staticmethod
    def _level(keys: DataFrame, n: int, level: int) -> tuple[list[int], int]:
        m = max(64, 1 << math.ceil(math.log2(max(1, n * BITS_PER_KEY))))
        if m > MOST_BITS:
            raise ValueError(f"{n} keys need {m} bits, over {MOST_BITS}; split the list by a hash of the key")
        at = keys.select(F.explode(F.array(*_bits(F.col("key"), level, m))).alias("at"))
        words = at.groupBy((F.col("at") / 64).cast("long").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
        got = {r.word: r.bits for r in words.collect()}  # at most m / 64 rows
        return [got.get(k, 0) for k in range(m // 64)], m

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> BloomCascade:
        """listed, universe: frames with a column key; the universe holds every key that will be asked about.

        Null keys are left out and never members. An empty list gives a cascade without members. Only bit words go to the
        driver, never keys.
        """
        inside = listed.where("key is not null").select("key").distinct()
        outside = universe.where("key is not null").select("key").distinct().join(inside, "key", "left_anti")
        levels: list[tuple[list[int], int]] = []
        keys, others = inside, outside
        while n := keys.count():
            levels.append(cls._level(keys, n, len(levels)))
            bits = cls(levels)._passes(F.col("key"), len(levels) - 1)
            keys, others = others.where(bits), keys
        return cls(levels)

    def _passes(self, key: Column, level: int) -> Column:
        words, m = self.levels[level]
        table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")  # folded to one literal
        return reduce(Column.__and__, [F.getbit(F.get(table, (at / 64).cast("int")), (at % 64).cast("int")) == 1 for at in _bits(key, level, m)])

    def contains(self, key: Column) -> Column:
        """Whether a key of the universe or the list is listed; null is not."""
        answer: Column = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            answer = F.when(self._passes(key, level), answer).otherwise(F.lit(level % 2 == 1))
        return F.coalesce(key.isNotNull() & answer, F.lit(False))


def _keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> list[Column]:
    """For each shape, the url's key of that shape, null if its host has fewer labels or its path is shorter."""
    labels = F.size(F.split(host, "[.]"))
    return [F.when((host != "") & (labels >= n) & (F.length(path) >= m), F.concat(F.substring_index(host, ".", -n), F.substring(path, 1, m))) for n, m in shapes]


def url_filter(pages: DataFrame, rules: list[Rule], default: str = "allow", *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict), one row for each input row.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest key wins, of equal ones the one
    with the longer host, of equal rules block. Where none fits, rule is null and verdict the default. Null urls and those without ://
    have an empty host and path and fit no rule. Repeated rows stay; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    shapes = sorted({r.shape for r in rules})
    universe = rows.select("host", "path").distinct().select(F.explode(F.array(*_keys(F.col("host"), F.col("path"), shapes)) if shapes else F.array(F.lit(None).cast("string"))).alias("key")).distinct()
    lists = {a: sorted({r.key for r in rules if r.action == a}) for a in ("allow", "block")}
    cascades = {a: BloomCascade.build(spark.createDataFrame([(k,) for k in keys], "key string"), universe) for a, keys in lists.items() if keys}
    fits = []
    for (n, _), key in zip(shapes, _keys(F.col("host"), F.col("path"), shapes), strict=True):
        for action, cascade in cascades.items():
            fits.append(F.when(cascade.contains(key), F.struct(F.length(key).alias("n"), F.length(F.substring_index(F.substring_index(key, "/", 1), ".", -n)).alias("h"), F.lit(action).alias("action"), key.alias("key"))))
    best = F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<n:int,h:int,action:string,key:string>")
    out = rows.withColumn("best", best)
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
