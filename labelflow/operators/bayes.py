"""M3 / M4 as DataFrame aggregations: multinomial naive Bayes over hashed TF-IDF features,
fitted for many training sets (groups, e.g. regimes) in one pass.

Model, per group ``g``, class ``c`` in {0, 1} and feature ``j < D`` (``D = num_features``):

* ``m_g`` rows in ``g``; ``df_gj`` rows of ``g`` containing ``j``;
  ``idf_gj = ln((m_g + 1) / (df_gj + 1))``
* ``w_gc = m_g / (2 · max(n_gc, 1))`` the weight of a class-``c`` row (``n_gc`` rows of class
  ``c``); ``S_gcj = w_gc · (occurrences of j in rows of class c)``;
  ``N_gcj = idf_gj · S_gcj``; ``T_gc = Σ_j N_gcj + D·α``
* ``θ_gcj = ln(N_gcj + α) − ln(T_gc)``; ``π_gc = ln(W_gc + α) − ln(W_g + 2α)`` with
  ``W_gc = w_gc · n_gc`` the summed row weights.

A row whose features occur as ``f_1 … f_n`` gets
``margin = π_g1 − π_g0 + Σ_k idf_gf_k · (θ_g1f_k − θ_g0f_k)`` and ``pred = 1`` iff
``margin > 0``. A feature never seen in ``g`` has ``S = df = 0``.

Plan: the training occurrences are one ``explode`` and one partial aggregate on
``(group, feature)`` — a common word costs one row per map task, not one per occurrence. The
per-feature table has at most ``groups × D`` rows (a proven bound), so scoring broadcasts it:
each distinct text's feature occurrences hash-join it and are summed per (text, group).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUM_FEATURES = 1 << 16
ALPHA = 1.0
WORD_SPLIT = r"\W+"


def word_features(text, num_features: int = NUM_FEATURES) -> Column:
    """Text → hashed word features: split on non-word characters (word characters are ASCII
    letters, digits and ``_``: Java's and RE2's ``\\W``), lower-case each word, then
    ``int(first 7 hex digits of md5(word), 16) % num_features`` (the same md5 rule as the
    token ids, so the features are reproducible in any SQL engine)."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.coalesce(t, F.lit("")), WORD_SPLIT), lambda w: w != "")
    return F.transform(words, lambda w: F.conv(F.substring(F.md5(F.lower(w)), 1, 7), 16, 10)
                       .cast("bigint") % F.lit(num_features))


@dataclass
class NaiveBayesModel:
    """``features``: ``(_g, _f, _d)`` with ``_d = idf · (θ1 − θ0)``; ``groups``:
    ``(_g, _prior, _unseen)`` with the prior margin and the contribution of an unseen feature."""
    features: DataFrame
    groups: DataFrame
    num_features: int


def fit_naive_bayes(rows: DataFrame, group: str = "group", label: str = "label",
                    features: str = "features", num_features: int = NUM_FEATURES,
                    alpha: float = ALPHA) -> NaiveBayesModel:
    """Fit one model per ``group`` on ``(group, label 0/1, features array<bigint>)`` rows.
    Rows are weighted by inverse class frequency within their group (``n / (2 · n_class)``).

    A row's weight is constant per (group, class), so ``S_gcj = w_gc · (occurrences of j in
    class c)``: the training pass is one ``explode`` and one count aggregate on
    ``(group, feature)``, and the weights come from a second, row-level count per group. The
    per-feature table (≤ groups × D rows) is checkpointed — the fit's only eager job — and
    both model tables derive from it, so scoring never refits."""
    r = rows.select(F.col(group).alias("_g"), F.col(label).cast("int").alias("_y"),
                    F.col(features).alias("_x"))
    occ = r.select("_g", "_y", F.explode("_x").alias("_f")).select(
        "_g", "_f", F.when(F.col("_y") == 1, 1).otherwise(0).cast("bigint").alias("_c1"),
        F.when(F.col("_y") == 0, 1).otherwise(0).cast("bigint").alias("_c0"),
        F.lit(0).cast("bigint").alias("_d"))
    dist = r.select("_g", F.explode(F.array_distinct("_x")).alias("_f")).select(
        "_g", "_f", F.lit(0).cast("bigint").alias("_c1"), F.lit(0).cast("bigint").alias("_c0"),
        F.lit(1).cast("bigint").alias("_d"))
    stats = occ.unionByName(dist).groupBy("_g", "_f").agg(
        F.sum("_c1").alias("_c1"), F.sum("_c0").alias("_c0"), F.sum("_d").alias("_df"))

    sizes = r.groupBy("_g").agg(F.count(F.lit(1)).alias("_m"), F.sum("_y").alias("_p"))
    return fit_from_counts(stats, sizes, num_features, alpha)


def feature_cells(rows: DataFrame, by: list[str], features: str = "features") -> DataFrame:
    """``(*by, _f, _n, _d)``: occurrences and row counts of every feature per combination of the
    ``by`` columns, from one pass (a row's features, its distinct features and one marker are
    exploded together, with partial sums before the shuffle). ``_f = -1`` is the marker: its
    ``_n`` is the number of rows. With few combinations the table is small whatever the input."""
    kinds = F.array(F.struct(F.lit(0).alias("kind"), F.col(features).alias("fs")),
                    F.struct(F.lit(1).alias("kind"), F.array_distinct(features).alias("fs")),
                    F.struct(F.lit(0).alias("kind"),
                             F.array(F.lit(-1).cast("bigint")).alias("fs")))
    each = rows.select(*by, F.explode(kinds).alias("_k")) \
        .select(*by, F.col("_k.kind").alias("_kind"), F.explode("_k.fs").alias("_f"))
    return each.groupBy(*by, "_f").agg(
        F.sum(F.when(F.col("_kind") == 0, 1).otherwise(0)).cast("bigint").alias("_n"),
        F.sum("_kind").cast("bigint").alias("_d"))


def fit_from_counts(stats: DataFrame, sizes: DataFrame, num_features: int = NUM_FEATURES,
                    alpha: float = ALPHA) -> NaiveBayesModel:
    """The models of all groups from their counts: ``stats (_g, _f, _c1, _c0, _df)`` per group and
    feature, ``sizes (_g, _m, _p)`` rows and positive rows per group."""
    m, p = F.col("_m"), F.col("_p")
    sizes = sizes.select("_g", "_m", "_p", (m / (2.0 * F.greatest(p, F.lit(1)))).alias("_w1"),
                         (m / (2.0 * F.greatest(m - p, F.lit(1)))).alias("_w0"))
    idf = F.log((m + 1.0) / (F.col("_df") + 1.0))
    from labelflow.operators.ordering import checkpointed
    # ≤ groups × D rows; both model tables derive from it, so it is computed (and written) once
    t = checkpointed(stats.join(sizes, "_g", "inner").select(
        "_g", "_f", idf.alias("_idf"),
        (idf * (F.col("_w1") * F.col("_c1"))).alias("_n1"),
        (idf * (F.col("_w0") * F.col("_c0"))).alias("_n0")))
    totals = t.groupBy("_g").agg(
        (F.sum("_n1") + F.lit(num_features * alpha)).alias("_t1"),
        (F.sum("_n0") + F.lit(num_features * alpha)).alias("_t0"))
    theta1 = F.log(F.col("_n1") + alpha) - F.log("_t1")
    theta0 = F.log(F.col("_n0") + alpha) - F.log("_t0")
    feats = t.join(totals, "_g", "inner").select(
        "_g", "_f", (F.col("_idf") * (theta1 - theta0)).alias("_d"))
    w1, w0 = F.col("_w1") * p, F.col("_w0") * (m - p)
    # a group whose rows have no features at all has no totals row: its sums are 0
    empty = F.lit(num_features * alpha)
    t1, t0 = F.coalesce(F.col("_t1"), empty), F.coalesce(F.col("_t0"), empty)
    groups = sizes.join(totals, "_g", "left").select(
        "_g", (F.log(w1 + alpha) - F.log(w0 + alpha)).alias("_prior"),
        (F.log(m + 1.0) * (F.log(t0) - F.log(t1))).alias("_unseen"))
    return NaiveBayesModel(feats, groups, num_features)


def score_naive_bayes(df: DataFrame, model: NaiveBayesModel, groups: list[str],
                      text: str = "text", group: str = "group", margin: str = "margin",
                      pred: str = "pred") -> DataFrame:
    """Score every row of ``df`` with the model of every group in ``groups``: one output row
    per (row, group) with ``group``, ``margin`` and ``pred`` (a group without a model, i.e.
    without training rows, scores ``margin = 0``, ``pred = 0``).

    The score depends on the text only, so each distinct text (keyed by ``md5(text)``) is
    scored once: its features are exploded, hash-joined with the broadcast feature table and
    summed per ``(text, group)`` (a partial aggregate); features that miss add
    ``unseen × (features − hits)``. The margins are then joined back to the rows."""
    body = F.coalesce(F.col(text), F.lit(""))   # NULL text scores as the empty text
    keyed = df.withColumn("_k", F.md5(body))
    # distinct on (key, text): the text is a grouping key, not an aggregate buffer, so this is
    # a hash aggregate (a string min/first would need a sort-based one)
    uniq = keyed.select("_k", body.alias("_t")).distinct()
    feats = uniq.select("_k", word_features("_t", model.num_features).alias("_x"))
    occ = feats.select("_k", F.explode("_x").alias("_f"))
    hits = occ.join(F.broadcast(model.features), "_f", "inner")   # ≤ groups × D rows
    sums = hits.groupBy("_k", "_g").agg(F.sum("_d").alias("_sd"),
                                        F.count(F.lit(1)).alias("_nh"))
    per = feats.select("_k", F.size("_x").alias("_nt"),
                       F.explode(F.array(*[F.lit(g) for g in groups])).alias("_g"))
    per = per.join(sums, ["_k", "_g"], "left").join(F.broadcast(model.groups), "_g", "left")
    m = F.coalesce(F.col("_prior"), F.lit(0.0)) + F.coalesce(F.col("_sd"), F.lit(0.0)) \
        + F.coalesce(F.col("_unseen"), F.lit(0.0)) * (F.col("_nt") - F.coalesce(F.col("_nh"),
                                                                               F.lit(0)))
    margins = per.select("_k", F.col("_g").alias(group), m.alias(margin))
    out = keyed.join(margins, "_k", "inner").drop("_k")
    return out.withColumn(pred, F.when(F.col(margin) > 0, F.lit(1)).otherwise(F.lit(0)))
