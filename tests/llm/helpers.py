"""Fixtures of the training-data tests: a small table with every awkward case."""

import random

from pyspark.sql import types as T

TOKENIZERS = "/opt/tokenizers"

#: The documents' columns, and more whose names clash with results or with internal names.
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
])
CLASHING = ["_t", "_b", "_h", "fp", "shard", "slot", "size", "taken", "kept", "score", "row", "_g",
            "_key", "n_tokens", "bucket"]

WORDS = "the quick brown fox jumps over a lazy dog while ñandú élan 日本 runs".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


def awkward_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows and shared passages."""
    rng = random.Random(seed)
    passage = prose(rng, 40)
    rows = [(i, prose(rng, rng.choice([1, 3, 20, 60])), rng.choice(["en", "de"]),
             f"s{i % 3}", 0) for i in range(30)]
    rows += [(40 + i, f"{prose(rng, 10)} {passage} {prose(rng, 5)}", "en", "s1", 0)
             for i in range(6)]
    rows += [(50 + i, rows[3][1], "en", "s2", 0) for i in range(4)]           # copies
    rows += [(60, None, None, None, None), (61, "", "en", "s0", 0), (62, " \n\t ", "en", None, 0),
             (None, passage, "en", "s1", None), (None, None, None, None, None)]
    rows += [(63, "x" * 5000 + " " + passage, "en", "s0", 0),
             (64, prose(rng, 3000), "en", "s1", 0)]                            # long
    rows += [rows[5], rows[5], rows[34]]                                        # repeated rows
    rows += [(70, "a\x00b " + "é" * 60, "fr", "s2", 0), (71, "é" * 60, "fr", "s2", 0)]
    return rows


def frame(spark, rows=None, parts: int = 3):
    rows = awkward_rows() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(parts) if rows \
        else spark.createDataFrame([], SCHEMA)


def with_clashes(df):
    """The same table with extra columns named like results and internals."""
    from pyspark.sql import functions as F
    for c in CLASHING:
        df = df.withColumn(c, F.lit("mine"))
    return df


def same(spark, make, parts=(1, 5)):
    """Rows of ``make(df)`` at several partitionings; they must agree."""
    got = [sorted(map(tuple, make(frame(spark, parts=p)).collect()), key=repr) for p in parts]
    assert all(g == got[0] for g in got)
    return got[0]
