"""Sharding by a two-pass external shuffle: records are scattered uniformly into memory-sized
buckets by seeded hashes, then every bucket is Fisher-Yates shuffled and written.

Pass one reads only what it needs to know the buckets: the sizes of the records and how many
fall into each bucket. Pass two moves each record once, to its bucket. The permutation of the
whole table is the concatenation of the shuffled buckets; shard s of n holds the positions
``ceil(s*rows/n)`` to ``ceil((s+1)*rows/n)``, so shard counts differ by at most one (the ``rows``
law). Equal texts have different keys and hashes and spread like any other rows.

Everything follows from the seed, the records' content and the table's size: a rerun, or a task
repeated after a lost executor, gives the same order whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.common import free_name, persisted

#: Buckets whose counts are summed within one window; the sums of these groups form the next.
_GROUP = 4096
#: Copies of a repeated record in one row of the deal.
COPIES = 65_536


def _record_hash(df: DataFrame, seed: int):
    """Hash of a record's whole content (any column type) and the seed."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [F.to_json(F.struct(c)) if "map" in f.dataType.simpleString() else c,
                  c.isNull()]
    return F.xxhash64(F.lit(seed), *parts)


def _offsets(counts: DataFrame) -> DataFrame:
    """``(b, off)``: rows in all smaller buckets, by windows over groups of buckets and then over
    the groups' sums (never one window over all buckets)."""
    grouped = counts.withColumn("g", F.expr(f"b DIV {_GROUP}"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("b")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = grouped.groupBy("g").agg(F.sum("n").alias("gn"))
    gbefore = F.coalesce(F.sum("gn").over(Window.orderBy("g")
                                          .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return grouped.select("b", "g", before.alias("o")) \
        .join(groups.select("g", gbefore.alias("go")), "g") \
        .select("b", (F.col("o") + F.col("go")).cast("bigint").alias("off"))


def shard(df: DataFrame, n_shards: int, seed: int = 7, size_col: str | None = None,
          bucket_bytes: int = 64 << 20, min_buckets: int = 64, hot_rows: int = 100_000
          ) -> DataFrame:
    """``df`` plus ``shard`` (0 to ``n_shards - 1``) and ``slot`` (gapless from 0 in each shard).

    ``size_col`` names a column with a record's bytes (default: the length of its JSON); their
    sum over ``bucket_bytes`` gives the number of buckets, at least ``min_buckets``. Records that
    are equal in every column have one hash; when over ``hot_rows`` of them exist, they are
    counted and dealt over all buckets by their copy's number (they are interchangeable). Null columns
    hash like a value of their own; an empty table gives no rows; columns named ``shard`` or
    ``slot`` are replaced."""
    names = [c for c in df.columns if c not in ("shard", "slot")]
    df = df.select(*[F.col(f"`{c}`") for c in names])
    h, b, off, size = (free_name(df, x) for x in ("_h", "_b", "_off", "_size"))
    weight = F.col(f"`{size_col}`") if size_col else F.length(
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in names])))
    keyed = df.withColumn(h, _record_hash(df, seed))
    # pass one: records per hash prefix, bytes, and the hashes of records repeated very often
    stats = persisted(keyed.select(h, weight.cast("bigint").alias(size)).groupBy(h)
                      .agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")))
    rows, total = stats.agg(F.sum("n"), F.sum("bytes")).first()
    rows, total = rows or 0, total or 0
    buckets = max(min_buckets, -(-total // bucket_bytes))
    hot = [r[0] for r in stats.where(F.col("n") > max(hot_rows, rows // 1000))
           .select(h).collect()]  # at most 1000 hashes
    deal = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(h)), F.lit(buckets))
    dealt = keyed.withColumn(b, deal)
    counted = stats.withColumn(b, deal).groupBy(b).agg(F.sum("n").alias("count"))
    if hot:
        # a repeated record is counted, and its copies, numbered from 0, are dealt by number:
        # the same deal in every job, and no task ever holds them all
        cold = dealt.where(~F.col(h).isin(hot))
        copies = keyed.where(F.col(h).isin(hot)) \
            .withColumn(off, _record_hash(df, seed + 99)).groupBy(h, off) \
            .agg(F.any_value(F.struct(*[F.col(f"`{c}`") for c in names])).alias(size),
                 F.count(F.lit(1)).alias(b))
        blocks = copies.select(h, size, b, F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.floor((F.col(b) - 1) / COPIES))).alias(off)) \
            .repartition(h, off)
        number = F.explode(F.sequence(F.col(off) * COPIES, F.least(
            (F.col(off) + 1) * COPIES, F.col(b)) - 1))
        spread = blocks.select(h, size, number.alias(off)).select(
            *[F.col(size).getField(c).alias(c) for c in names], h,
            F.pmod(F.xxhash64(F.lit(seed + 1), F.col(h), F.col(off)), F.lit(buckets)).alias(b))
        dealt = cold.unionByName(spread)
        counted = dealt.groupBy(b).count()
    offsets = _offsets(counted.select(F.col(b).alias("b"), F.col("count").alias("n")))

    out = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()),
                        T.StructField("slot", T.LongType())])
    ends = np.array([-(-s * rows // n_shards) for s in range(n_shards + 1)], np.int64)

    def shuffled(left: pa.Table, right: pa.Table) -> pa.Table:
        key = left.column(b)[0].as_py()
        # equal order whatever the order of arrival; equal hashes fall back on the content
        order = np.argsort(left.column(h).to_numpy(), kind="stable")
        hashes = left.column(h).to_numpy()[order]
        if (hashes[1:] == hashes[:-1]).any():
            text = [repr(r) for r in left.select(names).to_pylist()]
            raw = left.column(h).to_pylist()
            order = np.array(sorted(range(len(text)), key=lambda i: (raw[i], text[i])))
        # Fisher-Yates with a generator of the bucket's own
        perm = np.random.Generator(np.random.PCG64([seed & 0xFFFFFFFF, key])).permutation(order)
        pos = np.arange(left.num_rows, dtype=np.int64) + right.column("off")[0].as_py()
        s = np.searchsorted(ends, pos, side="right") - 1
        got = left.select(names).take(pa.array(perm))
        return got.append_column("shard", pa.array(s, pa.int32())) \
            .append_column("slot", pa.array(pos - ends[s], pa.int64()))

    # the records move once; the offsets (one row per bucket) meet them in their bucket
    return dealt.groupBy(b).cogroup(
        offsets.select(F.col("b").alias(b), "off").groupBy(b)).applyInArrow(shuffled, out)
