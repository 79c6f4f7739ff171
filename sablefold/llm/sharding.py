"""Sharding by Hilbert-curve order, for files that prune on several metadata columns at once.

Size, source and language of a document (names by rank of the whole value) are quantised into equal-count cells, the cells' point on
a Hilbert curve is the sort key, and the sorted table is cut into runs of equal row counts (law
``rows``: counts at most one apart). Neighbours on the curve are close in every dimension, so each
shard covers a small box of all three and its minima and maxima prune on any of them.

Equal texts sort side by side: a group takes the cell of its member with the smallest doc_id, and
the text's digest follows the curve index in the sort key. A group is split only where one of the
cuts falls in it, so even a group with a third of all rows spreads over as many shards as its rows
need.

Scale: only keys move, never texts. Ranks come from a range-partitioned sort: the index of a row in
its sorted partition plus the sum of the counts of the partitions before it (one row a partition).
Range bounds fall inside a group too, since doc_id ends the key, so no task depends on one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, table, written

#: Bits of each dimension; a curve over three dimensions of 2**BITS cells.
BITS = 5
SHARDS = 16
#: Parts into which the copies of one text are dealt where they meet their group.
SALTS = 16


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points, one row each, coordinates below 2**bits
    (the transposition method of Skilling, 2004)."""
    x = [points[:, i].astype(np.int64).copy() for i in range(points.shape[1])]
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] = x[i] ^ t
        q >>= 1
    for i in range(1, n):
        x[i] = x[i] ^ x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | (((x[i] ^ t) >> b) & 1)
    return out


def ranks(df: DataFrame, column: str, parts: int) -> DataFrame:
    """(name, rank) of each distinct value of a string column, by whole values: how many rows hold a lesser one.

    Values are counted first; ``parts`` ranges of them are sorted and summed on their own, and one row a
    range says what lies before it.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    runs = written(counts.repartitionByRange(parts, "name").select(F.spark_partition_id().alias("part"), "name", "n"), "shard-names")
    own = Window.partitionBy("part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = runs.groupBy("part").agg(F.sum("n").alias("rows")).select("part", F.coalesce(F.sum("rows").over(upto), F.lit(0)).alias("base"))
    return runs.join(bases, "part").select("name", (F.col("base") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("rank"))


def curve(dims: list[Column], cuts: list[list[float]], bits: int = BITS) -> Column:
    """Hilbert index of numeric columns, each quantised by its ascending cut points."""
    bounds = [np.asarray(sorted(set(c)), dtype=np.float64) for c in cuts]

    @F.pandas_udf("long")
    def index(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for part in parts:
            # few distinct values spread over the whole range, so that the curve's coarse levels see them
            cells = [np.searchsorted(b, s.to_numpy(dtype=np.float64), side="right") * 2**bits // (len(b) + 1) for b, s in zip(bounds, part, strict=True)]
            yield pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return index(*dims)


def quantiles(df: DataFrame, dims: list[Column], bits: int = BITS) -> list[list[float]]:
    """At most 2**bits - 1 cut points of each column over all its rows, by an approximate quantile
    sketch; empty where the table is. The least value cuts nothing off and is left out, so two values
    fall into the two halves of the curve."""
    steps = [i / 2**bits for i in range(1, 2**bits)]
    row = df.select(*[F.struct(F.percentile_approx(d, steps, 10_000).alias("cuts"), F.min(d).alias("least")).alias(f"q{i}") for i, d in enumerate(dims)]).first()
    return [[float(v) for v in (q["cuts"] or []) if v > q["least"]] for q in row]


def shard_rows(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row of ``docs`` (doc_id, text, source, lang).

    Size is the text's UTF-8 bytes plus 1. A null text counts as empty (size 1, crc32 0), null
    sources and languages are the lowest cell, null ids sort first, and repeated rows keep a slot
    each. Fewer rows than shards leave the last shards empty; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.substring(F.unhex(F.md5(text.cast("binary"))), 1, 12).alias("digest"),
        "source",
        "lang",
    )
    narrow = written(narrow.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "shard-keys")
    for column in ("source", "lang"):
        found = written(ranks(narrow, column, shuffle_partitions(spark)), "shard-ranks").withColumnsRenamed({"name": column, "rank": f"{column}_rank"})
        narrow = narrow.join(found, column, "left").withColumn(column, F.coalesce(f"{column}_rank", F.lit(-1).cast("long"))).drop(f"{column}_rank")
    narrow = written(narrow, "shard-ranked")
    cuts = quantiles(narrow, [F.col("size"), F.col("source"), F.col("lang")], bits)
    # the copies of a text share the cell of the copy with the smallest id; texts that occur once don't enter the join
    some = narrow.groupBy("digest", "size", "salt").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "source", "lang")).alias("first"))
    groups = some.groupBy("digest", "size").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("mask")).filter("n > 1")
    # a group's row for each salt that it has, so the copies of a text meet it in several tasks
    groups = groups.select("digest", "size", "first", F.explode(F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit(F.col("mask"), i) == 1)).alias("salt"))
    keyed = narrow.join(groups, ["digest", "size", "salt"], "left")
    dims = [F.col("size"), F.coalesce("first.source", "source"), F.coalesce("first.lang", "lang")]
    keyed = keyed.select("doc_id", "size", "text_crc32", "digest", curve(dims, cuts, bits).alias("curve"))
    keyed = written(keyed, "shard-curve")
    key = ["curve", "digest", "doc_id"]
    runs = keyed.repartitionByRange(max(shards, shuffle_partitions(spark)), *key).sortWithinPartitions(*key)
    # the id of a row holds its partition and its index there
    runs = runs.select("doc_id", "size", "text_crc32", F.monotonically_increasing_id().alias("at"))
    runs = written(runs, "shard-runs")
    part, index = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = runs.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("rows"))
    ranked = runs.withColumn("part", part).join(counts, "part").withColumn("rank", F.col("base") + index)
    small, large = F.floor(F.col("rows") / shards), F.pmod(F.col("rows"), F.lit(shards))
    first = large * (small + 1)
    shard = F.when(F.col("rank") < first, F.floor(F.col("rank") / (small + 1))).otherwise(large + F.floor((F.col("rank") - first) / F.greatest(small, F.lit(1))))
    slot = F.when(F.col("rank") < first, F.pmod(F.col("rank"), small + 1)).otherwise(F.pmod(F.col("rank") - first, F.greatest(small, F.lit(1))))
    return ranked.select("doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` in one of 16 shards under the law ``rows``."""
    out = shard_rows(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
