"""M3: fit a text classifier on training rows (stand-in for adapter fine-tuning).

``RegexTokenizer → HashingTF → IDF → NaiveBayes`` (multinomial) from ``pyspark.ml`` by
default: hashing needs no vocabulary pass, and IDF and naive Bayes are each one aggregation of
per-partition partial sums, so a fit is two passes over the rows whatever their number.
``algorithm="logistic"`` swaps in ``LogisticRegression`` (one pass per optimizer iteration).
Classes are weighted by inverse frequency (``weightCol``) since positives are rare.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.constants import EPOCHS


def class_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """Add ``weight`` = n / (2 · n_class). The two counts are scalar subqueries (one global
    partial aggregate each, inlined as constants): no join, no shuffle of the rows."""
    n = train.select(F.count(F.lit(1)).cast("double")).scalar()
    p = train.select(F.sum(F.when(F.col(label) == 1, 1.0).otherwise(0.0))).scalar()
    w = F.when(F.col(label) == 1, n / (2.0 * F.greatest(p, F.lit(1.0)))) \
         .otherwise(n / (2.0 * F.greatest(n - p, F.lit(1.0))))
    return train.withColumn("weight", w)


def featurize(df: DataFrame, text: str = "text", num_features: int = 1 << 16) -> DataFrame:
    """Tokenize and hash ``text`` into term-frequency vectors ``_tf`` (pure transformers: no
    fitting, no vocabulary, one narrow pass)."""
    tok = RegexTokenizer(inputCol="_text", outputCol="_tok", pattern="\\W+", toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)
    d = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return tf.transform(tok.transform(d)).drop("_text", "_tok")


def fit_on_features(train: DataFrame, label: str = "label", max_iter: int = 4 * EPOCHS,
                    reg: float = 0.01, algorithm: str = "bayes") -> PipelineModel:
    """Fit ``IDF → NaiveBayes`` (or ``LogisticRegression``) on featurized rows (``_tf``,
    ``label``). ``max_iter`` and ``reg`` apply to the logistic model only; naive Bayes uses
    Laplace smoothing 1."""
    data = class_weights(train.select("_tf", F.col(label).cast("double").alias("label")), "label")
    if algorithm == "bayes":
        model = NaiveBayes(featuresCol="features", labelCol="label", weightCol="weight",
                           modelType="multinomial", smoothing=1.0)
    elif algorithm == "logistic":
        model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight",
                                   maxIter=max_iter, regParam=reg)
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    fitted = Pipeline(stages=[IDF(inputCol="_tf", outputCol="features"), model]).fit(data)
    return _without_summary(fitted) if algorithm == "logistic" else fitted


def _without_summary(model: PipelineModel) -> PipelineModel:
    """A logistic model keeps its training summary, which holds the session; once the session
    has registered an ``Observation`` that can no longer be serialized into tasks, so scoring
    fails. A save/load round trip through the shared checkpoint folder drops the summary."""
    import os
    import uuid
    from labelflow.session import ensure_checkpoint_dir
    spark = SparkSession.getActiveSession()
    path = os.path.join(ensure_checkpoint_dir(spark), "models", uuid.uuid4().hex)
    model.write().save(path)
    return PipelineModel.load(path)


def fit_classifier(train: DataFrame, text: str = "text", label: str = "label",
                   num_features: int = 1 << 16, max_iter: int = 4 * EPOCHS,
                   reg: float = 0.01, algorithm: str = "bayes") -> PipelineModel:
    """M3: fit on ``(text, label)`` rows; returns a ``PipelineModel`` over featurized rows
    (use :func:`classify`, which featurizes the same way)."""
    return fit_on_features(featurize(train, text, num_features), label, max_iter, reg,
                           algorithm)


def classify(model: PipelineModel, df: DataFrame, text: str = "text", out: str = "pred",
             num_features: int = 1 << 16) -> DataFrame:
    """Predict with a model from :func:`fit_classifier` (featurizes ``df`` unless it already
    has ``_tf``)."""
    d = df if "_tf" in df.columns else featurize(df, text, num_features)
    scored = model.transform(d)
    return scored.withColumn(out, F.col("prediction").cast("int")) \
                 .drop("_tf", "features", "rawPrediction", "probability", "prediction")
