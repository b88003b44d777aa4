"""Ordering operators: seeded shuffle (O1), first k in a given order (O2), list order (O3),
and dense numbering (O4) that never funnels a group, or the whole table, through one task.

Numbering scheme (O4 and the per-group variant): rows are cut into buckets by a column that is
monotone in the sort order (an md5 prefix, an hour of a timestamp, a block of frame numbers).
Rows are numbered inside each ``(group, bucket)`` with a window, bucket sizes are counted with
a partial aggregate, and a running sum over the small count table gives each bucket's offset.
A hot group is spread over all of its buckets, and every step is deterministic, so a recomputed
task after an executor loss yields the same numbers (range partitioning's sampled bounds would
not).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.constants import SHUFFLE_SEED
from labelflow.session import ensure_checkpoint_dir


def _cols(xs) -> list[Column]:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        xs = [xs]
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def _running_total(col: str, part: list, order: list) -> Column:
    """Sum of ``col`` over the rows strictly before this one (0 for the first)."""
    w = (Window.partitionBy(*part) if part else Window).orderBy(*order) \
        .rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(col).over(w), F.lit(0)).cast("bigint")


def _join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL equals NULL; the keys come from ``left``."""
    named = right.select(*[F.col(c).alias(f"_r{c}") if c in keys else F.col(c)
                           for c in right.columns])
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r{k}"))
        cond = c if cond is None else cond & c
    return left.join(named, cond, "inner").drop(*[f"_r{k}" for k in keys])


def index_within_group(df: DataFrame, order, bucket: Column, group=None, out: str = "idx",
                       base: int = 0, fine: Column | None = None) -> DataFrame:
    """Dense position of each row in ``order`` (a total order) within ``group`` (or the whole
    table when ``group`` is None), starting at ``base``.

    ``bucket`` must be non-decreasing along ``order`` inside a group. A NULL group is a group of
    its own; a NULL bucket is one that comes first, as NULLs do in ``order``.

    ``fine`` (optional) refines ``bucket`` and is also non-decreasing along ``order`` (an hour
    and its second, say). Rows are then ranked per ``(group, bucket, fine)``; the fine counts
    get their offsets inside their ``(group, bucket)`` and the buckets theirs inside the group,
    so no step sees more than one bucket's fine counts or one group's bucket counts, and a row
    set concentrated in one bucket is still spread over its fine buckets.
    """
    gcols = _cols(group)
    gnames = [f"_g{i}" for i in range(len(gcols))]
    extra = [fine.alias("_fb")] if fine is not None else []
    b = df.select("*", *[c.alias(n) for c, n in zip(gcols, gnames)], bucket.alias("_bk"),
                  *extra)
    keys = gnames + ["_bk"]
    if fine is None:
        counts = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        offsets = counts.select(*keys, _running_total("_n", gnames, ["_bk"]).alias("_off"))
    else:
        fcounts = b.groupBy(*keys, "_fb").agg(F.count(F.lit(1)).alias("_n"))
        # one window pass gives each fine bucket its offset and its coarse bucket's size; the
        # per-bucket sizes then group without a new shuffle (already clustered by the keys)
        foff = fcounts.select(*keys, "_fb", _running_total("_n", keys, ["_fb"]).alias("_offf"),
                              F.sum("_n").over(Window.partitionBy(*keys)).alias("_nc"))
        ccounts = foff.groupBy(*keys).agg(F.max("_nc").alias("_nc"))
        coff = ccounts.select(*keys, _running_total("_nc", gnames, ["_bk"]).alias("_offc"))
        offsets = _join_null_safe(foff, coff, keys) \
            .select(*keys, "_fb", (F.col("_offc") + F.col("_offf")).alias("_off"))
        keys = keys + ["_fb"]
    inner = Window.partitionBy(*keys).orderBy(*_cols(order))
    ranked = b.withColumn("_r", F.row_number().over(inner))
    res = _join_null_safe(ranked, offsets, keys)
    return res.withColumn(out, (F.col("_off") + F.col("_r") - 1 + F.lit(base)).cast("bigint")) \
              .drop(*keys, "_n", "_off", "_r")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared ``spark.checkpoint.dir`` (never a machine-local
    one, never ``localCheckpoint``): survives executor loss without recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_key(id_col="id", seed: int = SHUFFLE_SEED) -> Column:
    """md5 of ``seed:id``: a seeded, partitioning-independent permutation key; a NULL id has the
    key of ``seed#``, which no id text can have."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.md5(F.coalesce(F.concat(F.lit(f"{seed}:"), c.cast("string")), F.lit(f"{seed}#")))


def content_hash(cols: list[str], schema: T.StructType) -> Column:
    """md5 over the texts of ``cols`` in order, separated by U+001F, NULL as U+001E (maps as
    JSON)."""
    text = [F.to_json(F.col(f"`{c}`")) if _has_map(schema[c].dataType)
            else F.col(f"`{c}`").cast("string") for c in cols]
    return F.md5(F.concat_ws("\u001f", *[F.coalesce(t, F.lit("\u001e")) for t in text]))


def _has_map(dt: T.DataType) -> bool:
    if isinstance(dt, T.MapType):
        return True
    if isinstance(dt, T.ArrayType):
        return _has_map(dt.elementType)
    if isinstance(dt, T.StructType):
        return any(_has_map(f.dataType) for f in dt.fields)
    return False


def seeded_shuffle(df: DataFrame, id_col: str = "id", seed: int = SHUFFLE_SEED,
                   out: str = "pos", coarse_len: int = 4, fine_len: int = 8,
                   hot_min_rows: int = 1_000_000, max_hot: int = 100_000,
                   chunk: int = 1 << 16) -> DataFrame:
    """O1 + O4: give every row its position in a seeded permutation, ordered by
    ``md5(seed:id)``, then by the row's :func:`content_hash` (so rows sharing an id get a fixed
    order too; rows equal in both are copies). A NULL id is an id like any other. Not
    ``rand(seed)``: that depends on the partitioning. Every step is deterministic, so a task
    recomputed after an executor loss yields the same positions, and the order is the same on
    both sides of the size limit below.

    Buckets are prefixes of the key: *fine* ones (``fine_len`` hex digits, ~4·10⁹) inside
    *coarse* ones (``coarse_len`` digits, 65,536). Fine bucket sizes are a partial aggregate
    over the key alone; their offsets are running sums inside each coarse bucket (≤ 16⁴ fine
    buckets each) plus the coarse offsets (≤ 16⁴ rows in all: one small window). So a window
    over rows never spans more than one fine bucket — a few hundred rows at 10¹² rows.

    A fine bucket is *hot* when it holds more than ``max(hot_min_rows, total / max_hot)``
    rows: with a uniform hash that only happens when one id carries many rows. The rule
    bounds the hot list by ``max_hot`` entries, so it is broadcast to tag rows map-side.
    The offset table (one row per non-empty fine bucket) is checkpointed once — the one eager
    job of this operator — since all branches below read it.

    * cold buckets: rows join their bucket's offset on the fine key (a shuffle on that key,
      which the window below reuses) and are numbered by a window per fine bucket.
    * hot buckets: identical rows are interchangeable, so they are counted first
      (``groupBy`` on the whole row: partial aggregation before the shuffle, so a row copied
      a billion times costs one row per map task). Distinct rows sharing an id are spread
      over ``16**3`` sub-buckets by the first digits of the content hash; sub-bucket sizes give
      offsets; each distinct row then expands to its copies' positions — in chunks of
      ``chunk`` rows that are repartitioned before the final expansion, so a hot copy group is
      written by many tasks.
    """
    cols = df.columns
    keyed = df.withColumn("_sk", shuffle_key(id_col, seed)) \
              .withColumn("_b2", F.substring("_sk", 1, fine_len))

    # bucket sizes and offsets: over the key only, never over rows
    fine = keyed.groupBy("_b2").agg(F.count(F.lit(1)).alias("_n")) \
                .withColumn("_b1", F.substring("_b2", 1, coarse_len))
    # one window pass per coarse bucket: each fine bucket's offset and the coarse bucket's size
    fine_off = fine.select("_b1", "_b2", "_n",
                           _running_total("_n", ["_b1"], ["_b2"]).alias("_offf"),
                           F.sum("_n").over(Window.partitionBy("_b1")).alias("_nc"))
    coarse = fine_off.groupBy("_b1").agg(F.max("_nc").alias("_nc"))  # ≤ 16**coarse_len rows
    total = F.sum("_nc").over(Window.partitionBy())
    coarse_off = coarse.select(
        "_b1", _running_total("_nc", [], ["_b1"]).alias("_offc"),
        F.greatest(F.lit(float(hot_min_rows)), total / F.lit(float(max_hot))).alias("_limit"))
    offsets = fine_off.join(F.broadcast(coarse_off), "_b1", "inner") \
                      .select("_b2", (F.col("_offc") + F.col("_offf")).alias("_off"),
                              (F.col("_n") > F.col("_limit")).alias("_hot"))
    # the table feeds the hot tags, the cold offsets and the hot offsets: compute it once
    # (a reliable checkpoint in the shared folder, not a recomputation per branch)
    offsets = checkpointed(offsets)
    hot_list = F.broadcast(offsets.filter(F.col("_hot")).select("_b2", "_off"))  # ≤ max_hot
    tagged = keyed.withColumn("_tb", content_hash(cols, df.schema)) \
        .join(hot_list.select("_b2", F.lit(True).alias("_is_hot")), "_b2", "left")

    # cold buckets: join the offset on the fine key, one window per fine bucket
    cold = tagged.filter(F.col("_is_hot").isNull()) \
        .join(offsets.filter(~F.col("_hot")).select("_b2", "_off"), "_b2", "inner")
    w = Window.partitionBy("_b2").orderBy("_sk", "_tb")
    cold_pos = cold.select(*cols, (F.col("_off") + F.row_number().over(w) - 1)
                           .cast("bigint").alias(out))

    # hot buckets: count identical rows, offsets per content-hash sub-bucket, expand
    hot = tagged.filter(F.col("_is_hot").isNotNull())
    maps = [c for c in cols if _has_map(df.schema[c].dataType)]
    group_cols = [F.to_json(F.col(c)).alias(f"_j_{c}") if c in maps else F.col(c) for c in cols]
    keep_maps = [F.any_value(c).alias(c) for c in maps]
    grouped = hot.groupBy(*group_cols, "_sk", "_b2", "_tb").agg(
        F.count(F.lit(1)).alias("_c"), *keep_maps).join(hot_list, "_b2", "inner")
    grouped = grouped.withColumn("_f", F.substring("_tb", 1, 3))
    sub = ["_b2", "_sk", "_f"]
    subs = grouped.groupBy(*sub).agg(F.sum("_c").alias("_ns"))
    sub_off = subs.select(*sub, _running_total("_ns", ["_b2"], ["_sk", "_f"]).alias("_offs"))
    starts = grouped.join(sub_off, sub, "inner").withColumn(
        "_s", F.col("_off") + F.col("_offs") + _running_total("_c", sub, [F.col("_tb")]))
    last = F.col("_s") + F.col("_c") - 1
    small = starts.filter(F.col("_c") <= chunk) \
        .select(*cols, F.explode(F.sequence(F.col("_s"), last)).alias(out))
    big = starts.filter(F.col("_c") > chunk) \
        .select(*cols, "_s", "_c", "_tb",
                F.explode(F.sequence(F.lit(0).cast("bigint"),
                                     F.floor((F.col("_c") - 1) / chunk).cast("bigint")))
                .alias("_k")) \
        .repartition("_tb", "_k")
    lo = F.col("_s") + F.col("_k") * chunk
    hi = F.least(last, lo + chunk - 1)
    big = big.select(*cols, F.explode(F.sequence(lo, hi)).alias(out))
    return cold_pos.unionByName(small).unionByName(big)


def first_k(df: DataFrame, order, k: int) -> DataFrame:
    """O2: first ``k`` rows in an explicit order (a top-k report: Spark keeps k rows per task)."""
    return df.orderBy(*_cols(order)).limit(k)


def list_positions(spark, values: list, name: str = "id", pos: str = "pos") -> DataFrame:
    """O3: a fixed driver-side list (configuration, at most a few entries) as ``(pos, value)``."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)],
                                 f"{pos} int, {name} string")
