"""Training regimes (U1, U2) and their comparison (M4).

Regimes as described in the reference's prose: no tuning, original memes, re-annotated memes,
video, video + re-annotated memes. The comparison fits one classifier per regime on its rows
and scores the target's test rows with each: as DataFrame aggregations for all regimes at once
(:func:`compare_regimes`), or with ``pyspark.ml`` pipelines (:func:`compare_regimes_ml`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelflow.operators import metrics as M
from labelflow.operators.bayes import (NUM_FEATURES, feature_cells, fit_from_counts,
                                        score_naive_bayes, word_features)
from labelflow.operators.classifier import classify, featurize, fit_on_features
from labelflow.session import ensure_checkpoint_dir
from labelflow.operators.ordering import checkpointed
from labelflow.operators.rows import labelled, test_split, train_split

REGIMES = ("no_ft", "om_ft", "rm_ft", "vid_ft", "vid_rm")


def augment(video: DataFrame, memes: DataFrame) -> DataFrame:
    """Bag union of video rows and (re-annotated) meme rows with a ``domain`` column; the
    training filter (P1) applies to both sides, as the reference filters its whole file."""
    v = train_split(video).withColumn("domain", F.lit("video"))
    m = train_split(memes).withColumn("domain", F.lit("meme"))
    return v.unionByName(m, allowMissingColumns=True)


def with_reannotated(items: DataFrame, final: DataFrame) -> DataFrame:
    """Meme rows take their voted label as ``rm_label``; ties (NULL) have none."""
    f = final.select("id", F.col("final_label").alias("rm_label"))
    return items.join(f, "id", "left")


# Each regime trains on parts of the training split: (domain, label column) pairs.
REGIME_PARTS: dict[str, tuple[tuple[str, str], ...]] = {
    "no_ft": (),                                            # the base model as is
    "om_ft": (("meme", "label"),),
    "rm_ft": (("meme", "rm_label"),),
    "vid_ft": (("video", "label"),),
    "vid_rm": (("video", "label"), ("meme", "rm_label")),
}


def regime_rows(items: DataFrame, regime: str) -> DataFrame:
    """The labelled training rows of one regime as ``(id, text, label, domain)``.

    ``items`` needs ``domain`` and, for the re-annotated regimes, ``rm_label``."""
    if regime not in REGIME_PARTS:
        raise ValueError(f"unknown regime {regime!r}")
    tr = train_split(items)
    extra = [c for c in ("_tf",) if c in items.columns]

    def pick(domain, col):
        return labelled(tr.filter(F.col("domain") == domain)
                        .select("id", "text", F.col(col).alias("label"), "domain", *extra))
    parts = [pick(d, c) for d, c in REGIME_PARTS[regime]]
    if not parts:
        return labelled(tr.select("id", "text", "label", "domain", *extra)).filter(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def regime_counts(items: DataFrame, regimes=REGIMES) -> DataFrame:
    """Rows and positives per regime, all regimes in one pass: conditional sums in one
    global partial aggregate over the training split, then one row per regime."""
    tr = train_split(items)
    aggs, out = [], []
    for i, r in enumerate(regimes):
        n, pos = F.lit(0).cast("bigint"), F.lit(0).cast("bigint")
        for d, c in REGIME_PARTS[r]:
            inside = (F.col("domain") == d) & F.col(c).isNotNull()
            n = n + F.sum(F.when(inside, 1).otherwise(0)).cast("bigint")
            pos = pos + F.coalesce(F.sum(F.when(inside, F.col(c))), F.lit(0)).cast("bigint")
        aggs += [n.alias(f"_n{i}"), pos.alias(f"_p{i}")]
        out.append(F.struct(F.lit(r).alias("regime"), F.col(f"_n{i}").alias("n_rows"),
                            F.col(f"_p{i}").alias("n_positive")))
    return tr.agg(*aggs).select(F.explode(F.array(*out)).alias("r")).select("r.*")


def regime_memberships(items: DataFrame, regimes=REGIMES, carry=("text",)) -> DataFrame:
    """Training rows with their regime and that regime's label: ``(regime, label, *carry)``,
    one row per (row, regime) it trains. One pass: an ``explode`` of the row's memberships;
    ``carry`` columns (computed once per row) ride along."""
    tr = train_split(items)
    carry = list(carry)
    members = [F.when((F.col("domain") == d) & F.col(c).isNotNull(),
                      F.struct(F.lit(r).alias("regime"), F.col(c).cast("int").alias("label")))
               for r in regimes for d, c in REGIME_PARTS[r]]
    if not members:
        return tr.select(F.lit(None).cast("string").alias("regime"),
                         F.lit(None).cast("int").alias("label"), *carry).filter(F.lit(False))
    m = tr.select(*carry, F.explode(F.array(*members)).alias("_m"))
    return m.filter(F.col("_m").isNotNull()).select("_m.regime", "_m.label", *carry)


def compare_regimes(items: DataFrame, base_predictor=None, regimes=REGIMES,
                    target_domain: str = "video",
                    num_features: int = NUM_FEATURES) -> DataFrame:
    """M4: one metrics row per regime, from the rows that :func:`score_regimes` gives."""
    return M.classification_report(score_regimes(items, base_predictor, regimes, target_domain,
                                                 num_features), by="regime")


def score_regimes(items: DataFrame, base_predictor=None, regimes=REGIMES,
                  target_domain: str = "video", num_features: int = NUM_FEATURES) -> DataFrame:
    """M4: ``(regime, id, label, pred)``: per regime, a naive Bayes text classifier (:mod:`labelflow.operators.bayes`) trained
    on the regime's rows; all are scored on the target's labelled test rows. ``no_ft`` uses ``base_predictor`` (DataFrame → ``pred``) or, if None, predicts
    the negative class.

    All regimes train in one pass: features are counted per cell of (domain, label, re-annotated
    label), a handful of cells with ``num_features`` features each, whatever the input; only this
    table is checkpointed, and cells add up to regimes. Scoring is one pass too (each distinct
    target text against the broadcast feature table of all regimes); the metrics are one
    aggregate by regime. No driver loop over fits, no iteration."""
    trained = [r for r in regimes if r != "no_ft"]
    target = labelled(test_split(items.filter(F.col("domain") == target_domain)))
    parts = []
    if trained:
        by = ["domain", "label", "rm_label"]
        if "rm_label" not in items.columns:
            items = items.withColumn("rm_label", F.lit(None).cast("int"))
        rows = train_split(items).filter(F.col("label").isNotNull() | F.col("rm_label").isNotNull())
        cells = checkpointed(feature_cells(
            rows.select(*by, word_features("text", num_features).alias("x")), by, "x"))
        counts = regime_memberships(cells.withColumn("type", F.lit(None).cast("string")), trained,
                                    carry=("_f", "_n", "_d")) \
            .groupBy(F.col("regime").alias("_g"), "_f").agg(
                F.sum(F.when(F.col("label") == 1, F.col("_n")).otherwise(0)).alias("_c1"),
                F.sum(F.when(F.col("label") == 0, F.col("_n")).otherwise(0)).alias("_c0"),
                F.sum("_d").alias("_df"))
        counts = checkpointed(counts)  # at most regimes x (num_features + 1) rows
        sizes = counts.filter(F.col("_f") == -1).select(
            "_g", (F.col("_c1") + F.col("_c0")).alias("_m"), F.col("_c1").alias("_p"))
        model = fit_from_counts(counts.filter(F.col("_f") >= 0), sizes, num_features)
        scored = score_naive_bayes(target.select("id", "label", "text"), model, trained,
                                   group="regime")
        parts.append(scored.select("regime", "id", "label", "pred"))
    if "no_ft" in regimes:
        base = base_predictor(target) if base_predictor else target.withColumn("pred", F.lit(0))
        parts.append(base.select(F.lit("no_ft").alias("regime"), "id", "label", "pred"))
    return reduce(DataFrame.unionByName, parts)


def compare_regimes_ml(items: DataFrame, base_predictor=None, regimes=REGIMES,
                    target_domain: str = "video", algorithm: str = "bayes") -> DataFrame:
    """M4 with ``pyspark.ml`` estimators: one fitted pipeline per regime (a driver loop of
    fits), all scored on the target's labelled test rows; one metrics row per regime. ``no_ft`` uses ``base_predictor`` (DataFrame → ``pred``) or, if
    None, predicts the negative class. ``algorithm`` is the classifier of
    :func:`labelflow.operators.classifier.fit_on_features`.

    Texts are featurized once and the result is checkpointed to the shared checkpoint folder,
    so the fits (each several passes) reread that instead of recomputing the lineage."""
    ensure_checkpoint_dir(items.sparkSession)
    cols = [c for c in ("id", "text", "label", "rm_label", "domain", "type", "dataset")
            if c in items.columns]
    # only rows with a label (original or voted) can train or be scored: featurize just those
    has_label = F.col("label").isNotNull()
    if "rm_label" in cols:
        has_label = has_label | F.col("rm_label").isNotNull()
    items = featurize(items.select(*cols).filter(has_label)).checkpoint()
    target = labelled(test_split(items.filter(F.col("domain") == target_domain)))
    reports = []
    for r in regimes:
        if r == "no_ft":
            scored = base_predictor(target) if base_predictor else target.withColumn("pred",
                                                                                      F.lit(0))
        else:
            model = fit_on_features(regime_rows(items, r), algorithm=algorithm)
            scored = classify(model, target)
        reports.append(M.classification_report(scored.select("label", "pred"))
                       .select(F.lit(r).alias("regime"), "*"))
    return reduce(DataFrame.unionByName, reports)
