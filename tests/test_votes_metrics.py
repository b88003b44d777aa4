"""A2, A7, A8, J6, M5, M6."""

from pyspark.sql import functions as F

from labelflow.operators import metrics as M
from labelflow.operators import votes as V


def test_parse_response(spark):
    resp = ["hateful", "Hateful.", " non-hateful", "", "It is hateful content", None, "NON-HATEFUL!"]
    df = spark.createDataFrame([(r,) for r in resp], "response string").withColumn("dataset", F.lit("hatemm"))
    got = [r.pred for r in V.parse_response(df).collect()]
    assert got == [1, 1, 0, None, None, None, 0]


def votes_df(spark):
    rows = [("a", "original", 1), ("a", "model", 1), ("a", "human", 1),      # 3-0
            ("b", "original", 1), ("b", "model", 0), ("b", "human", 1),      # 2-1
            ("c", "original", 1), ("c", "model", 0), ("c", "human", None),   # 1-1 tie
            ("d", "original", 0),                                            # single
            ("e", "original", None), ("e", "model", None)]                   # all null
    return spark.createDataFrame(rows, "id string, source string, vote int")


def test_majority_vote_ties_null(spark):
    got = {r.id: (r.final_label, r.needs_review, r.n_votes) for r in V.majority_vote(votes_df(spark)).collect()}
    assert got == {"a": (1, 0, 3), "b": (1, 0, 3), "c": (None, 1, 2), "d": (0, 0, 1), "e": (None, 1, 0)}


def test_majority_vote_tie_original(spark):
    got = {r.id: r.final_label for r in V.majority_vote(votes_df(spark), tie="original").collect()}
    assert got["c"] == 1 and got["e"] is None


def test_align_and_reannotate(spark):
    memes = spark.createDataFrame([("1", "t one", 1, "x.png"), ("2", "t two", 0, "y.png")],
                                  "id string, text string, label int, image string") \
        .withColumn("dataset", F.lit("mhc"))
    human = spark.createDataFrame([("1", 1), ("2", 1), ("9", 1)], "id string, vote int")

    def predictor(df):
        return df.withColumn("response", F.when(F.col("id") == "1", "Offensive.").otherwise("offensive"))
    got = {r.id: (r.original, r.model, r.human, r.final_label) for r in
           V.reannotate(memes, predictor, human).collect()}
    assert got == {"1": (1, 1, 1, 1), "2": (0, 1, 1, 1)}


def test_classification_report_values(spark):
    rows = [(1, 1), (1, 0), (1, None), (0, 0), (0, 1), (0, 0)]
    df = spark.createDataFrame(rows, "label int, pred int")
    r = M.classification_report(df).collect()[0]
    assert (r.tp, r.fp, r.fn, r.tn, r.n_unparsed) == (1, 1, 1, 2, 1)
    assert r.accuracy == round(3 / 6, 6)
    assert r.precision_pos == 0.5 and r.recall_pos == round(1 / 3, 6)
    assert r.recall_neg == round(2 / 3, 6) and r.precision_neg == round(2 / 3, 6)


def test_report_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0)], "label int, pred int")
    r = M.classification_report(df).collect()[0]
    assert r.precision_pos == 0.0 and r.f1_pos == 0.0 and r.f1_neg == 1.0


def test_label_transitions(spark):
    orig = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0)], "id string, label int")
    final = spark.createDataFrame([("a", 1), ("b", 1), ("c", None)], "id string, final_label int")
    got = {(r.orig_label, r.final_label): r.n for r in V.label_transitions(orig, final).collect()}
    assert got == {(1, 1): 1, (0, 1): 1, (0, None): 1}
