"""URL filtering with a Bloom filter cascade.

Rules name a host and the beginning of a path. A rule fits its host and all
subdomains of it where the url's path starts with the rule's path. Of the rules
that fit, the longest text wins (ties: the longer host). No fitting rule: allow.

A url can only be fitted by keys of the form host ending + path beginning with as
many labels and characters as some rule has, so it has few candidate keys. For each
verdict, a cascade answers which candidates are listed, exactly for every key that
occurs in the corpus:

* The universe is every candidate key of every url, with the listed keys marked by
  one aggregation.
* Level 0 is a Bloom filter of the listed keys. Level 1 is one of the corpus keys
  that level 0 wrongly lets through, level 2 of the listed keys that level 1 lets
  through, and so on until a level lets nothing through wrongly.
* A key is listed if the first level that does not hold it is an odd one.

Each url is then judged by lookups in the filters, without a join. A filter has
``BITS`` bits a key; that of level 0 has more if the corpus has many keys, so that about
as many of them pass as are listed. The others shrink with each level. What tasks
receive thus grows with the rule list, and with the fifth root of the corpus's keys a
rule; ``max_filter_bytes`` is checked when they are built.

Defined cases: a null url, or one without ``://``, has empty host and path and no
candidate; a key listed under both verdicts is blocked; repeated rows are judged
alike; an empty table gives an empty result; no rules at all allow everything;
further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlet.llm.common import mix, pick, saved

BITS, HASHES = 10, 5
MAX_FILTER_BYTES = 256 << 20
VERDICTS = ("allow", "block")


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str


@dataclass(frozen=True)
class Cascade:
    """Levels as packed bits; ``has`` works on whole arrays of key hashes."""

    levels: tuple[np.ndarray, ...]

    def has(self, keys: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(keys), bool)
        at = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = at[holds(bits, keys[at], k)]
            listed[at] = k % 2 == 0
        return listed


def places(keys: np.ndarray, size: int, level: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits, one row for each hash."""
    return np.stack([mix(keys, 50 + HASHES * level + i) % np.uint64(size) for i in range(HASHES)])


def holds(bits: np.ndarray, keys: np.ndarray, level: int) -> np.ndarray:
    at = places(keys, 8 * len(bits), level).astype(np.int64)
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Keys that could fit, the longest first."""
    shapes = sorted({(r.host.count(".") + 1, len(r.path)) for r in rules})
    keys = [
        F.when(
            (F.length(host) > 0) & (F.size(F.split(host, r"\.", -1)) >= labels) & (F.length(path) >= length),
            F.struct(
                (F.length(F.substring_index(host, ".", -labels)) + length).alias("n"),
                F.length(F.substring_index(host, ".", -labels)).alias("h"),
                F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)).alias("key"),
            ),
        )
        for labels, length in shapes
    ]
    if not keys:
        return F.array().cast("array<string>")
    by_length = F.reverse(F.array_sort(F.filter(F.array(*keys), lambda x: x.isNotNull())))
    return F.array_distinct(F.transform(by_length, lambda x: x["key"]))


def _bits(listed: int, others: int) -> int:
    """Bits a listed key with which no more than about ``listed`` of the other keys pass."""
    return max(BITS, math.ceil(HASHES * (others / listed) ** (1 / HASHES)))


def _filter(keys: DataFrame, count: int, level: int, max_bytes: int, bits_each: int = BITS) -> np.ndarray:
    """A filter of the ``count`` hashes in column ``h``, put together from parts of each partition."""
    size = max(8, -(-count * bits_each // 8))
    if size > max_bytes:
        raise ValueError(f"a filter of {size} bytes is over max_filter_bytes={max_bytes}")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(places(batch.column("h").to_numpy().view(np.uint64), 8 * size, level).ravel())
            yield pa.record_batch({"at": pa.array(at.astype(np.int64))})

    rows = keys.mapInArrow(part, "at long").select(F.shiftright("at", 3).alias("byte"), F.expr("1 << int(at & 7)").alias("bit"))
    bits = np.zeros(size, np.uint8)
    made = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits[made.column("byte").to_numpy()] = made.column("bits").to_numpy().astype(np.uint8)
    return bits


def build(universe: DataFrame, max_bytes: int = MAX_FILTER_BYTES) -> Cascade:
    """``universe``: one row for each key hash ``h`` with ``listed``."""

    def let_through(rows: DataFrame, bits: np.ndarray, level: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(holds(bits, batch.column("h").to_numpy().view(np.uint64), level)))

        return rows.mapInArrow(run, "h long")

    inside, outside = universe.where("listed").select("h"), universe.where("not listed").select("h")
    count, levels = inside.count(), []
    while count:
        level = len(levels)
        bits = _filter(inside, count, level, max_bytes, BITS if level else _bits(count, outside.count()))
        levels.append(bits)
        inside, outside = saved(let_through(outside, bits, level), f"level{level}"), inside
        count = inside.count()
    return Cascade(tuple(levels))


def judge(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    id_column: str = "page_id",
    url_column: str = "url",
    max_filter_bytes: int = MAX_FILTER_BYTES,
) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict."""
    bad = [r for r in rules if r.verdict not in VERDICTS or not r.host]
    if bad:
        raise ValueError(f"rules need a host and one of {VERDICTS}: {bad}")
    spark = pages.sparkSession
    urls = pick(pages, page_id=(id_column, "bigint"), url=(url_column, "string"))
    rows = urls.select(
        "page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path")
    )
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), rules))
    seen = rows.select(F.explode("keys").alias("key")).select(F.xxhash64("key").alias("h"), F.lit(0).alias("mark"))
    listed = spark.createDataFrame(
        [(r.host + r.path, 1 << VERDICTS.index(r.verdict)) for r in rules], "key string, mark int"
    ).select(F.xxhash64("key").alias("h"), "mark")
    marked = saved(seen.union(listed).groupBy("h").agg(F.bit_or("mark").alias("mark")), "universe")
    cascades = [
        build(marked.select("h", ((F.col("mark").bitwiseAND(1 << v)) > 0).alias("listed")), max_filter_bytes)
        for v in range(len(VERDICTS))
    ]
    shared = spark.sparkContext.broadcast([c.levels for c in cascades])

    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column("keys"), batch.column("h")
            values = hashes.flatten().to_numpy().view(np.uint64)
            owner = np.repeat(np.arange(len(batch)), hashes.value_lengths().to_numpy())
            allow, block = (Cascade(levels).has(values) for levels in shared.value)
            hit = np.flatnonzero(allow | block)
            rows_hit, first = np.unique(owner[hit], return_index=True)
            at = hit[first]
            rule = np.full(len(batch), -1, np.int64)
            rule[rows_hit] = at
            found = pa.array(rule, mask=rule < 0)
            verdict = np.full(len(batch), VERDICTS[0], object)
            verdict[rows_hit] = np.where(block[at], VERDICTS[1], VERDICTS[0])
            yield pa.record_batch(
                {
                    **{c: batch.column(c) for c in ("page_id", "host", "path")},
                    "rule": keys.flatten().take(found).cast(pa.string()),
                    "verdict": pa.array(verdict, pa.string()),
                }
            )

    return rows.withColumn("h", F.transform("keys", lambda k: F.xxhash64(k))).mapInArrow(
        lookup, "page_id long, host string, path string, rule string, verdict string"
    )
