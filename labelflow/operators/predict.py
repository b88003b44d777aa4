"""M1 / M2: score rows with a pluggable batch predictor.

The model is built once per Python worker by ``make_fn`` (Spark's ``predict_batch_udf`` caches
it) and called on Arrow batches, never row by row. ``make_fn`` is the caller's: an LLM, a
linear model, anything that maps a NumPy batch to a NumPy batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.session import bounded_batches


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system it names (the cluster's, not the driver's
    disk)."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def choose_model(model_path: str | None, load_fn: Callable[[str], Callable],
                 base_fn: Callable[[], Callable], spark: SparkSession | None = None
                 ) -> Callable[[], Callable]:
    """M2: a ``make_fn`` that loads the tuned model when ``model_path`` exists, else builds the
    base model (and says so when a path was given)."""
    if model_path is None:
        return base_fn
    session = spark or SparkSession.active()
    if path_exists(session, model_path):
        return lambda: load_fn(model_path)
    print(f"{model_path} not exist.")
    return base_fn


def predictor_udf(make_fn: Callable[[], Callable], return_type=T.DoubleType(),
                  batch_size: int = 256, input_tensor_shapes=None):
    """Wrap ``make_fn`` as a ``predict_batch_udf`` (Arrow batches, model cached per worker)."""
    from pyspark.ml.functions import predict_batch_udf
    return predict_batch_udf(make_fn, return_type=return_type, batch_size=batch_size,
                             input_tensor_shapes=input_tensor_shapes)


def predict(df: DataFrame, make_fn: Callable[[], Callable], input_col: str,
            out: str = "prediction", return_type=T.DoubleType(), batch_size: int = 256,
            input_tensor_shapes=None) -> DataFrame:
    """M1: add ``out`` = model(``input_col``) for every row."""
    udf = predictor_udf(make_fn, return_type, batch_size, input_tensor_shapes)
    return df.withColumn(out, udf(F.col(input_col)))


def text_predictor(make_fn: Callable[[], Callable[[list[str]], list[str]]],
                   batch_size: int = 64):
    """M1 for text in, text out (prompts → responses): an iterator ``pandas_udf`` that builds
    the model once per task and answers one Arrow batch at a time, of bounded bytes."""
    @F.pandas_udf(T.StringType())
    def _answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_fn()
        for s in batches:
            out = []
            for i in range(0, len(s), batch_size):
                out.extend(model(s.iloc[i:i + batch_size].tolist()))
            yield pd.Series(out, dtype="object")

    def apply(df: DataFrame, input_col: str = "prompt", out: str = "response") -> DataFrame:
        bounded_batches(df.sparkSession)
        return df.withColumn(out, _answer(F.col(input_col)))

    return apply


def strip_prompt_text(generated: Column, prompt: Column) -> Column:
    """F9 on texts: what a model appended to its prompt."""
    return F.substring(generated, F.char_length(prompt) + 1, F.char_length(generated))


def prompt_rule():
    """A ``make_fn`` for a text model that stands in for a language model: it reads the class
    names off the prompt's last question, picks an answer from the prompt's md5 digest and
    returns prompt and answer, as a generating model does."""
    import hashlib
    import re

    from labelflow import constants as K
    ask = re.compile(re.escape(K.PROMPT_RESPOND) + "([^']*)" + re.escape(K.PROMPT_OR) + "([^']*)'")

    def answer(prompt: str) -> str:
        positive, negative = ask.findall(prompt)[-1]
        digit = hashlib.md5(prompt.encode()).hexdigest()[0]
        for digits, text in (("012345", positive), ("6789a", negative), ("b", f" {negative}"),
                             ("c", positive.capitalize() + "."), ("d", f"I think {positive}")):
            if digit in digits:
                return prompt + text
        return prompt

    return lambda prompts: [answer(p) for p in prompts]


PROMPT_RULE_SQL = """CASE WHEN substr(md5({t}), 1, 1) IN ('0','1','2','3','4','5') THEN {pos}
     WHEN substr(md5({t}), 1, 1) IN ('6','7','8','9','a') THEN {neg}
     WHEN substr(md5({t}), 1, 1) = 'b' THEN ' ' || {neg}
     WHEN substr(md5({t}), 1, 1) = 'c' THEN upper(substr({pos}, 1, 1)) || substr({pos}, 2) || '.'
     WHEN substr(md5({t}), 1, 1) = 'd' THEN 'I think ' || {pos}
     ELSE '' END"""


def linear_rule(weights, bias: float = 0.0):
    """A ``make_fn`` for a fixed linear scorer over vectors (stand-in for a model)."""
    def make():
        import numpy as np
        w = np.asarray(weights, dtype=np.float64)

        def fn(x):
            return np.asarray(x, dtype=np.float64) @ w + bias
        return fn
    return make


def alternating_weights(n: int) -> list[float]:
    """``+1, -1, +1, ...``: the weights of the embedding stand-in predictor."""
    return [1.0 if i % 2 == 0 else -1.0 for i in range(n)]


def score_to_label(score: Column, threshold: float = 0.0) -> Column:
    return F.when(score > threshold, F.lit(1)).otherwise(F.lit(0))
