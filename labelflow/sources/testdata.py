"""Adapters from the shared test tables to the pipeline's inputs.

``items``  := documents ⋈ labels on doc_id (left: unlabelled documents keep a NULL label)
  id = doc_id as string, label = toxic,
  type = 'test' when h % 10 >= 8, NULL when h % 10 = 7, else 'train'
         with h = first 8 hex digits of md5('42:' || doc_id) as an integer,
  dataset = 'mhc' for even doc_id else 'hatemm', domain = 'video' for even doc_id else 'meme',
  image = 'media/<id>.png', frames = 'frames/<id>' for video items, video column absent.
``frames`` := events per user_id: item_id = 'frames/<user_id>',
  frame_idx = position by (ts, event_id) from 0, variance = value, readable.

Each adapter has its DuckDB twin (``*_SQL``) so the oracle reads the same derived tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.operators.ordering import index_within_group


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_hash(id_col) -> F.Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.conv(F.substring(F.md5(F.concat(F.lit("42:"), c.cast("string"))), 1, 8), 16, 10) \
        .cast("bigint")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = docs.join(labels, "doc_id", "left")
    h = split_hash("doc_id") % 10
    even = (F.col("doc_id") % 2) == 0
    sid = F.col("doc_id").cast("string")
    return j.select(
        sid.alias("id"),
        F.col("text"),
        F.col("toxic").cast("int").alias("label"),
        F.when(h >= 8, F.lit("test")).when(h == 7, F.lit(None).cast("string"))
         .otherwise(F.lit("train")).alias("type"),
        F.concat(F.lit("media/"), sid, F.lit(".png")).alias("image"),
        F.when(even, F.concat(F.lit("frames/"), sid)).alias("frames"),
        F.when(even, F.lit("mhc")).otherwise(F.lit("hatemm")).alias("dataset"),
        F.when(even, F.lit("video")).otherwise(F.lit("meme")).alias("domain"),
    )


ITEMS_SQL = """
SELECT CAST(d.doc_id AS VARCHAR) AS id,
       d.text AS text,
       CAST(l.toxic AS INTEGER) AS label,
       CASE WHEN ('0x' || substr(md5('42:' || CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 >= 8 THEN 'test'
            WHEN ('0x' || substr(md5('42:' || CAST(d.doc_id AS VARCHAR)), 1, 8))::BIGINT % 10 = 7 THEN NULL
            ELSE 'train' END AS type,
       'media/' || CAST(d.doc_id AS VARCHAR) || '.png' AS image,
       CASE WHEN d.doc_id % 2 = 0 THEN 'frames/' || CAST(d.doc_id AS VARCHAR) END AS frames,
       CASE WHEN d.doc_id % 2 = 0 THEN 'mhc' ELSE 'hatemm' END AS dataset,
       CASE WHEN d.doc_id % 2 = 0 THEN 'video' ELSE 'meme' END AS domain
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame table from ``events``. Numbering is split by (user, hour, second) so a user holding
    a third of all events, even within one hour, is still spread over many tasks."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    numbered = index_within_group(ev, order=["ts", "event_id"],
                                  bucket=F.date_trunc("hour", F.col("ts")),
                                  fine=F.date_trunc("second", F.col("ts")),
                                  group="user_id", out="frame_idx")
    return numbered.select(
        F.concat(F.lit("frames/"), F.col("user_id").cast("string")).alias("item_id"),
        F.col("frame_idx").cast("int").alias("frame_idx"),
        F.col("value").alias("variance"),
        F.lit(True).alias("readable"),
    )


def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames per item straight from ``events`` (one frame per event): the counts the uniform
    sample needs, without going through the frame numbering (the stand-in for
    :func:`labelflow.sources.frames.frame_counts` on image files)."""
    ev = table(spark, sf_dir, "events").select("user_id")
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.concat(F.lit("frames/"), F.col("user_id").cast("string")).alias("item_id"), "n")


FRAMES_SQL = """
SELECT 'frames/' || CAST(user_id AS VARCHAR) AS item_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_idx,
       value AS variance,
       TRUE AS readable
FROM events
"""


def with_items(sql: str) -> str:
    """Prefix an oracle query with the ``items`` CTE."""
    return f"WITH items AS ({ITEMS_SQL})\n{sql}"


def with_frames(sql: str) -> str:
    return f"WITH frames AS ({FRAMES_SQL})\n{sql}"


def with_items_frames(sql: str) -> str:
    return f"WITH items AS ({ITEMS_SQL}), frames AS ({FRAMES_SQL})\n{sql}"
