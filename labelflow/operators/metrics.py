"""Classification metrics as conditional sums (one partial aggregate, no shuffle of rows).

The reference saves ``(id, response, label)`` and computes no metric; these are ours:
accuracy, precision/recall/F1 per class, macro-F1. A NULL prediction (unparsable response)
counts as wrong for both classes and is reported as ``n_unparsed``. A metric whose denominator
is 0 is 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when((p + r) > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0))


def confusion(df: DataFrame, by=None, y: str = "label", pred: str = "pred") -> DataFrame:
    """Counts per group: ``n, n_unparsed, tp, fp, fn, tn`` (positive class = 1)."""
    yy, pp = F.col(y), F.col(pred)

    def cnt(cond):
        return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")

    aggs = [F.count(F.lit(1)).cast("bigint").alias("n"),
            cnt(pp.isNull()).alias("n_unparsed"),
            cnt((yy == 1) & (pp == 1)).alias("tp"),
            cnt((yy == 0) & (pp == 1)).alias("fp"),
            cnt((yy == 1) & (pp == 0)).alias("fn"),
            cnt((yy == 0) & (pp == 0)).alias("tn"),
            cnt(yy == 1).alias("n_pos"),
            cnt(yy == 0).alias("n_neg")]
    by = [by] if isinstance(by, str) else (by or [])
    return df.groupBy(*by).agg(*aggs)


def classification_report(df: DataFrame, by=None, y: str = "label", pred: str = "pred",
                          digits: int = 6) -> DataFrame:
    """Accuracy, per-class precision/recall/F1 and macro-F1, rounded to ``digits``."""
    c = confusion(df, by, y, pred)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    p1, r1 = _ratio(tp, tp + fp), _ratio(tp, F.col("n_pos"))
    p0, r0 = _ratio(tn, tn + fn), _ratio(tn, F.col("n_neg"))
    f1_1, f1_0 = _f1(p1, r1), _f1(p0, r0)
    by = [by] if isinstance(by, str) else (by or [])
    return c.select(
        *by, "n", "n_unparsed", "tp", "fp", "fn", "tn",
        F.round(_ratio(tp + tn, F.col("n")), digits).alias("accuracy"),
        F.round(p1, digits).alias("precision_pos"), F.round(r1, digits).alias("recall_pos"),
        F.round(f1_1, digits).alias("f1_pos"),
        F.round(p0, digits).alias("precision_neg"), F.round(r0, digits).alias("recall_neg"),
        F.round(f1_0, digits).alias("f1_neg"),
        F.round((f1_1 + f1_0) / 2.0, digits).alias("macro_f1"),
    )


def report_sql(source: str, by: str | None = None, y: str = "label", pred: str = "pred",
               digits: int = 6) -> str:
    """The DuckDB twin of :func:`classification_report` over a relation ``source``."""
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    def r(n, d):
        return f"CASE WHEN ({d}) > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END"
    p1, r1 = r("tp", "tp + fp"), r("tp", "n_pos")
    p0, r0 = r("tn", "tn + fn"), r("tn", "n_neg")
    def f1(p, q):
        return f"CASE WHEN ({p}) + ({q}) > 0 THEN 2.0 * ({p}) * ({q}) / (({p}) + ({q})) ELSE 0.0 END"
    return f"""
SELECT {g}n, n_unparsed, tp, fp, fn, tn,
       round({r('tp + tn', 'n')}, {digits}) AS accuracy,
       round({p1}, {digits}) AS precision_pos, round({r1}, {digits}) AS recall_pos,
       round({f1(p1, r1)}, {digits}) AS f1_pos,
       round({p0}, {digits}) AS precision_neg, round({r0}, {digits}) AS recall_neg,
       round({f1(p0, r0)}, {digits}) AS f1_neg,
       round(({f1(p1, r1)} + {f1(p0, r0)}) / 2.0, {digits}) AS macro_f1
FROM (
  SELECT {g}CAST(count(*) AS BIGINT) AS n,
         CAST(sum(CASE WHEN {pred} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unparsed,
         CAST(sum(CASE WHEN {y} = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
         CAST(sum(CASE WHEN {y} = 0 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
         CAST(sum(CASE WHEN {y} = 1 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
         CAST(sum(CASE WHEN {y} = 0 AND {pred} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
         CAST(sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
         CAST(sum(CASE WHEN {y} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg
  FROM {source} {group}
) c
"""
