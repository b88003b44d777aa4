"""Few-shot exemplars: id lists (O3), lookup in list order (J1), the text block (A3, F3),
the multi-turn history (A4, F4, O2, P4) and attaching either to every scored row (J2).

The reference rebuilds the exemplar block for every scored row (and re-reads the description
file each time). Here it is built once per dataset — at most ``k`` rows per dataset, a proven
bound — and broadcast-joined on ``dataset`` to the scored rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelflow.constants import DEMO_CLOSING, EXEMPLAR_IDS, LABEL_NAMES
from labelflow.functions.chat import assistant_message, user_message
from labelflow.functions.labels import class_name_col
from labelflow.functions.prompts import demo_line_col, prompt_col


def exemplar_id_table(spark: SparkSession, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """O3: the fixed exemplar lists as ``(dataset, pos, id)`` (``pos`` from 0, list order)."""
    lists = lists or EXEMPLAR_IDS
    rows = [(d, i, x) for d, ids in lists.items() for i, x in enumerate(ids)]
    return spark.createDataFrame(rows, "dataset string, pos int, id string")


def top_k_per_dataset(df: DataFrame, order: list[Column], k: int,
                      datasets=tuple(LABEL_NAMES)) -> DataFrame:
    """O2: first ``k`` rows per dataset in an explicit order, from one scan: a rank filter, of
    which Spark keeps ``k`` rows per dataset and task before the shuffle (group limit), so the
    merge sees ``k × tasks`` rows whatever the skew. The dataset set is fixed (the class-name
    table)."""
    w = Window.partitionBy("dataset").orderBy(*order)
    return df.filter(F.col("dataset").isin(list(datasets))) \
        .withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def number_in_order(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """Positions inside each dataset of an already bounded frame (≤ k rows per dataset)."""
    w = Window.partitionBy("dataset").orderBy(*order)
    return df.withColumn(out, (F.row_number().over(w) - 1).cast("int"))


def check_k(k: int, lists: dict[str, list[str]] | None = None) -> int:
    """``k`` itself, if every exemplar list has that many ids."""
    short = {d: len(ids) for d, ids in (lists or EXEMPLAR_IDS).items() if len(ids) < k}
    if short or k < 0:
        raise ValueError(f"k = {k} exemplars asked for; the lists have {short or 'no negative k'}")
    return k


def exemplar_overlap(scored: DataFrame, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """Scored rows that are exemplars themselves, counted per dataset: ``dataset, n_overlap``."""
    hit = F.lit(False)
    for d, ids in (lists or EXEMPLAR_IDS).items():
        hit = hit | ((F.col("dataset") == d) & F.col("id").isin(ids))
    return scored.groupBy("dataset").agg(
        F.sum(F.when(hit, 1).otherwise(0)).cast("bigint").alias("n_overlap"))


def ordered_exemplars(ids: DataFrame, pool: DataFrame, k: int, strict: bool = True) -> DataFrame:
    """Look up the first ``k`` ids of each list (``pos < k``) in ``pool`` (keyed by
    ``dataset, id``), keeping list order; returns ``dataset, pos, id`` + pool columns. A
    missing id raises, and so does a list with fewer than ``k`` ids (:func:`check_k`).

    The id list is tiny, so it is broadcast into the scan of ``pool``; the few matches are
    then outer-joined back to the list to find holes."""
    want = ids.filter(F.col("pos") < k).select("dataset", "pos", "id")
    if strict:
        have = F.count(F.lit(1)).over(Window.partitionBy("dataset"))
        want = want.withColumn("_have", have).filter(
            F.when(F.col("_have") < k, F.raise_error(F.concat(
                F.lit(f"fewer than {k} exemplar ids in the list of "), F.col("dataset"))))
            .otherwise(F.lit(1)) == 1).drop("_have")
    pool_cols = [c for c in pool.columns if c not in ("dataset", "id", "pos")]
    marked = pool.select("dataset", "id", *pool_cols, F.lit(1).alias("_hit"))
    matched = marked.join(F.broadcast(want.select("dataset", "id")), ["dataset", "id"], "inner")
    res = F.broadcast(want).join(matched, ["dataset", "id"], "left")
    if strict:
        check = F.when(F.col("_hit").isNull(),
                       F.raise_error(F.concat(F.lit("exemplar id not found: "), F.col("dataset"),
                                              F.lit("/"), F.col("id")))).otherwise(F.lit(1))
        res = res.filter(check == 1)
    return res.drop("_hit")


def demo_block(exemplars: DataFrame, k: int, mode: str = "video") -> DataFrame:
    """A3 + F3: per dataset, the exemplar sentences in list order followed by the closing
    phrase; ``k = 0`` gives the empty string. Input: ``dataset, pos, description, text,
    label`` (``label`` is the class name, as in the description files)."""
    if k == 0:
        return exemplars.select("dataset").distinct().withColumn("demo", F.lit(""))
    lines = exemplars.filter(F.col("pos") < k).select(
        "dataset", "pos",
        demo_line_col("description", "text", "label", "dataset", mode).alias("line"))
    return lines.groupBy("dataset").agg(
        F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))),
                                          lambda x: x["line"]), ""),
                 F.lit(DEMO_CLOSING)).alias("demo"))


def attach_block(df: DataFrame, block: DataFrame, on: str = "dataset") -> DataFrame:
    """Give every scored row its dataset's block. ``block`` has one row per dataset (a
    fixed, tiny set), so it is broadcast; rows of a dataset without exemplars get NULL."""
    return df.join(F.broadcast(block), on, "left")


def fewshot_prompt_col(demo="demo", text="text", dataset="dataset", mode: str = "video") -> Column:
    """F2 with the block prefix: ``demo + Text: '...' ...``."""
    d = F.col(demo) if isinstance(demo, str) else demo
    return F.concat(F.coalesce(d, F.lit("")), prompt_col(text, dataset, mode))


def exemplar_messages(exemplars: DataFrame, media: str = "image") -> DataFrame:
    """F4 for exemplars: ``[user(image, prompt), assistant(class name)]`` per exemplar row."""
    return exemplars.withColumn(
        "msgs", F.array(user_message(F.col(media), prompt_col("text", "dataset", "image"), "image"),
                        assistant_message(class_name_col("dataset", "label"))))


def history(exemplars: DataFrame, k: int) -> DataFrame:
    """A4: per dataset, the exemplars' message pairs flattened into one history, in ``pos``
    order (≤ 2k messages per dataset)."""
    msgs = exemplar_messages(exemplars.filter(F.col("pos") < k))
    return msgs.groupBy("dataset").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "msgs"))),
                              lambda x: x["msgs"])).alias("history"))
