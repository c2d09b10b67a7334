"""Operator 11, sharding by proportional stratified interleaving.

Within each source, rows are ranked by a seeded hash (a shuffle that any rerun repeats). Rank r of a source of n rows has
the fractional rank (r + u) / n, where u in [0, 1) is the source's own seeded offset, so that many sources of a row or
two don't meet in one place. Rows sorted by fractional rank are cut into shards of equal counts, so each shard holds each
source's share to within a few rows (where very many sources have fewer rows than there are shards, these spread as
random ones do, and the others' shares vary by about the root of their number).

Neither sort gathers a source in one task. Ranks run within ranges of the hash, on top of the counts of the ranges
before; places run within ranges of the fractional rank, in which rows are spread evenly by construction. A range holds
about ``max(RANGE_ROWS, sqrt(rows))`` rows whatever the sources' sizes. Rows that are equal in all columns given are
counted before any shuffle and take consecutive ranks, so a group of copies doesn't fill a range either.

``write_shards`` also writes the shards' files, each row in its slot's order.

Edge cases. Null or empty text: size 1, a row as any other. A null source is a source of its own, not the empty one; so
is a null doc_id an id. Ties: equal hashes are ordered by the other columns. Repeated rows each get a slot. Fewer rows
than shards: the first shards get one each, by place. An empty table gives an empty result. Extra columns of documents
are dropped by ``digests`` and kept by ``interleaved`` and ``write_shards``; of clashing names, those of ``interleaved``'s
results replace the given ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tracewell.llm.shared import Scratch, broadcast_if_small

SHARDS, SEED, RANGE_ROWS = 16, 11, 4096
#: Hexadecimal digits of an MD5 hash that make an exact double below 1.
_DIGITS = 13


def hashed_fraction(text: Column) -> Column:
    """A number of [0, 1) from a text: the first 52 bits of its MD5 hash."""
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("double") / float(16**_DIGITS)


def shuffle_key(id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> Column:
    """The seeded hash that rows are shuffled by."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def digests(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, key) of documents: what sharding needs to know of them."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), shuffle_key(seed=seed).alias("key"))


def _range_of(fraction: Column, ranges: int) -> Column:
    return F.least(F.floor(fraction * ranges), F.lit(ranges - 1))


def _before(counts: DataFrame, keys: tuple[str, ...], at: str, n: str, out: str) -> DataFrame:
    """``counts`` with the sum of ``n`` over the ranges before its own; a row a range, so a window is short."""
    w = W.partitionBy(*keys).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn(out, F.coalesce(F.sum(n).over(w), F.lit(0)))


def interleaved(rows: DataFrame, shards: int = SHARDS, stratum: str = "source", key: str = "key", seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``rows`` with shard and slot (gapless from 0 within the shard). ``key`` is 32 hexadecimal digits.

    Rows are grouped by all their columns, so these must be of types that can be grouped.
    """
    rows = rows.drop("shard", "slot")
    own = {c: "__" + c + "_" * sum(x.startswith("__" + c) for x in rows.columns) for c in ("hr", "n", "rank", "total", "fr", "at", "before")}
    hr, n, rank, total, fr, at, before = own.values()
    scratch = Scratch(rows.sparkSession, "sharding")
    counted = scratch.table(rows.groupBy(*rows.columns).agg(F.count("*").alias(n)))
    n_rows = counted.agg(F.sum(n)).first()[0] or 0
    ranges = max(1, math.ceil(n_rows / max(range_rows, math.isqrt(n_rows))))
    fraction = F.conv(F.substring(key, 1, _DIGITS), 16, 10).cast("double") / float(16**_DIGITS)
    counted = counted.withColumn(hr, _range_of(fraction, ranges))
    sums = counted.groupBy(stratum, hr).agg(F.sum(n).alias("c"))
    sums = _before(sums, (stratum,), hr, "c", before).withColumn(total, F.sum("c").over(W.partitionBy(stratum))).drop("c")
    sums = sums.select(F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("")).alias("__s"), F.col(hr).alias("__h"), before, total)  # null joins as a value of its own
    n_sums = sums.count()
    in_source = F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit(""))
    order = [key, *(c for c in rows.columns if c not in (key, stratum))]
    within = F.coalesce(F.sum(n).over(W.partitionBy(stratum, hr).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = counted.withColumn(rank, within).join(broadcast_if_small(sums, 128 * n_sums), (in_source == F.col("__s")) & (F.col(hr) == F.col("__h")))
    ranked = ranked.withColumn(rank, F.explode(F.sequence(F.col(before) + F.col(rank), F.col(before) + F.col(rank) + F.col(n) - 1))).drop(before, n, hr, "__s", "__h")
    offset = hashed_fraction(F.concat(F.lit(f"{seed}:"), in_source))
    placed = scratch.table(ranked.withColumn(fr, (F.col(rank) + offset) / F.col(total)).drop(total))
    in_range = _range_of(F.col(fr), ranges)
    starts = _before(placed.groupBy(in_range.alias("__h")).agg(F.count("*").alias("c")), (), "__h", "c", before).drop("c")
    number = F.row_number().over(W.partitionBy(at).orderBy(fr, F.asc_nulls_first(stratum), rank)) - 1
    place = placed.withColumn(at, in_range).withColumn(at + "n", number).join(broadcast_if_small(starts, 32 * ranges), F.col(at) == F.col("__h")).withColumn(at, F.col(before) + F.col(at + "n"))
    shard = F.expr(f"CAST(`{at}` AS BIGINT) * {shards} div {max(n_rows, 1)}")
    first = F.expr(f"(shard * {max(n_rows, 1)}L + {shards - 1}) div {shards}")  # the first place of the row's shard
    return place.withColumn("shard", shard.cast("int")).withColumn("slot", F.col(at) - first).select(*rows.columns, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED) -> None:
    """Writes ``docs`` with shard and slot to ``path``, a folder a shard, each file a run of slots in order.

    Placing moves hashes only; texts are moved once to meet their places and once to their files.
    """
    docs = docs.drop("shard", "slot")
    row = F.md5(F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"}))
    places = interleaved(docs.select("source", shuffle_key(seed=seed).alias("key"), row.alias("row")), shards, seed=seed).select("row", "shard", "slot")
    own = "__row" + "_" * sum(c.startswith("__row") for c in docs.columns)
    distinct = docs.withColumn(own, row).dropDuplicates([own])
    rows = distinct.join(places.withColumnRenamed("row", own), own).drop(own)
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
