"""Re-annotation: response parsing (M6), vote alignment (J6), majority vote (A2),
label transitions (A8) and the end-to-end re-annotation (M5).

The reference describes re-annotation in prose only (original label + model prediction +
human annotation, majority vote); the tie rule and the parser are ours and documented here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.functions.labels import negative_name, positive_name

# characters stripped from both ends of a response before matching a class name
PUNCT = "[.,!?;:'\"]"


def normalize_response(resp) -> Column:
    c = F.col(resp) if isinstance(resp, str) else resp
    return F.regexp_replace(F.lower(F.trim(c)), f"^{PUNCT}+|{PUNCT}+$", "")


def parse_response_col(resp="response", dataset="dataset") -> Column:
    """M6: 1 for the positive class name, 0 for the negative one, NULL otherwise.

    Exact match after lower/trim/edge punctuation: ``contains('hateful')`` would also match
    ``non-hateful``."""
    r = normalize_response(resp)
    return F.when(r == positive_name(dataset), F.lit(1)) \
            .when(r == negative_name(dataset), F.lit(0)) \
            .otherwise(F.lit(None).cast("int"))


def parse_response(df: DataFrame, resp: str = "response", dataset: str = "dataset",
                   out: str = "pred") -> DataFrame:
    return df.withColumn(out, parse_response_col(resp, dataset))


def align_votes(**sources: DataFrame) -> DataFrame:
    """Per-source ``(id, vote)`` frames → one long table ``(id, source, vote)``.

    A bag union (no shuffle); a missing vote is simply an absent or NULL row."""
    out = None
    for name, df in sources.items():
        part = df.select(F.col("id").cast("string").alias("id"), F.lit(name).alias("source"),
                         F.col("vote").cast("int").alias("vote"))
        out = part if out is None else out.unionByName(part)
    return out


def votes_from_columns(df: DataFrame, columns: dict[str, str], id_col: str = "id") -> DataFrame:
    """J6 for sources that live on the same rows: one pass emits ``(id, source, vote)`` per
    named column (``explode`` of a small array; no union of two scans)."""
    arr = F.array(*[F.struct(F.lit(s).alias("source"), F.col(c).cast("int").alias("vote"))
                    for s, c in columns.items()])
    return df.select(F.col(id_col).cast("string").alias("id"), F.explode(arr).alias("v")) \
             .select("id", "v.source", "v.vote")


def majority_vote(votes: DataFrame, tie: str = "null", tie_source: str = "original",
                  sources: tuple[str, ...] = (), require_source: str | None = None) -> DataFrame:
    """A2: per id, 1 if more than half of the non-NULL votes are 1, 0 if fewer, else a tie.

    An id is one meme: rows that share an id are one vote list, however many sources they have, and
    rows without an id (NULL) are one more. Give memes ids of their own before they are voted on.

    ``tie='null'`` leaves ties NULL with ``needs_review = 1``; ``tie='original'`` takes the vote
    of ``tie_source``. ``groupBy(id)`` with count/sum is partially aggregated before the
    shuffle, so an id with a third of all votes costs one row per task. ``sources`` adds one
    column per named source with its vote (pivoted inside the same aggregate).
    ``require_source`` keeps only ids with a row from that source (e.g. restrict extra human
    votes to the items being re-annotated without a join)."""
    extra = []
    if require_source is not None:
        extra.append(F.max(F.when(F.col("source") == require_source, 1).otherwise(0))
                     .alias("_required"))
    g = votes.groupBy("id").agg(*extra,
        F.count("vote").alias("n_votes"),
        F.coalesce(F.sum("vote"), F.lit(0)).cast("bigint").alias("n_positive"),
        F.max(F.when(F.col("source") == tie_source, F.col("vote"))).alias("_tie_vote"),
        *[F.max(F.when(F.col("source") == s, F.col("vote"))).alias(s) for s in sources],
    )
    if require_source is not None:
        g = g.filter(F.col("_required") == 1)
    two_p = F.col("n_positive") * 2
    decided = F.when(F.col("n_votes") == 0, F.lit(None).cast("int")) \
               .when(two_p > F.col("n_votes"), F.lit(1)) \
               .when(two_p < F.col("n_votes"), F.lit(0))
    if tie == "original":
        final = F.coalesce(decided, F.col("_tie_vote"))
    elif tie == "null":
        final = decided
    else:
        raise ValueError(f"unknown tie rule {tie!r}")
    return g.select("id", *sources, F.col("n_votes").cast("bigint").alias("n_votes"), "n_positive",
                    final.cast("int").alias("final_label"),
                    F.when(final.isNull(), F.lit(1)).otherwise(F.lit(0)).alias("needs_review"))


def label_transitions(original: DataFrame, final: DataFrame) -> DataFrame:
    """``(orig_label, final_label) → count`` between the original labels and the voted ones."""
    j = original.select("id", F.col("label").alias("orig_label")) \
        .join(final.select("id", "final_label"), "id", "inner")
    return j.groupBy("orig_label", "final_label").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def agreement(a: Column, b: Column) -> Column:
    """Aggregate: share of rows on which two votes agree, over the rows that have both."""
    both = a.isNotNull() & b.isNotNull()
    return F.avg(F.when(both, F.when(a == b, 1.0).otherwise(0.0)))


def agreement_rates(reannotated: DataFrame) -> DataFrame:
    """One row of agreement rates between the sources and the final label of
    :func:`reannotate`'s output (NULL where no row has both)."""
    pairs = [("original", "model"), ("original", "human"), ("model", "human"),
             ("original", "final_label")]
    return reannotated.agg(*[agreement(F.col(x), F.col(y)).alias(f"{x}_{y}") for x, y in pairs])


def rule_response(text="text", dataset="dataset") -> Column:
    """A deterministic stand-in predictor (no model here): a response chosen from the first hex
    digit of ``md5(text)``, covering exact answers, capitalised answers with punctuation, a
    leading space, a sentence, an empty string and NULL."""
    t = F.col(text) if isinstance(text, str) else text
    h = F.substring(F.md5(F.coalesce(t, F.lit(""))), 1, 1)
    pos, neg = positive_name(dataset), negative_name(dataset)
    return F.when(h.isin("0", "1", "2", "3"), pos) \
            .when(h.isin("4", "5"), F.concat(F.initcap(pos), F.lit("."))) \
            .when(h.isin("6", "7", "8", "9", "a", "b"), neg) \
            .when(h == "c", F.concat(F.lit(" "), neg)) \
            .when(h == "d", F.concat(F.lit("I think it is "), pos)) \
            .when(h == "e", F.lit("")) \
            .otherwise(F.lit(None).cast("string"))


RULE_RESPONSE_SQL = """CASE WHEN substr(md5(coalesce({t}, '')), 1, 1) IN ('0','1','2','3') THEN {pos}
     WHEN substr(md5(coalesce({t}, '')), 1, 1) IN ('4','5') THEN upper(substr({pos}, 1, 1)) || substr({pos}, 2) || '.'
     WHEN substr(md5(coalesce({t}, '')), 1, 1) IN ('6','7','8','9','a','b') THEN {neg}
     WHEN substr(md5(coalesce({t}, '')), 1, 1) = 'c' THEN ' ' || {neg}
     WHEN substr(md5(coalesce({t}, '')), 1, 1) = 'd' THEN 'I think it is ' || {pos}
     WHEN substr(md5(coalesce({t}, '')), 1, 1) = 'e' THEN ''
     ELSE NULL END"""


def reannotate(memes: DataFrame, predictor, human: DataFrame | None = None,
               tie: str = "null", mode: str = "image", block: DataFrame | None = None
               ) -> DataFrame:
    """M5: re-annotation end to end. Each meme gets an unlabelled scoring prompt and message
    list (F2, F4); ``predictor`` (DataFrame → DataFrame adding ``response``; a model via
    :func:`labelflow.operators.predict.predict` or any rule) answers; the answer is parsed (M6)
    and voted (J6, A2) with the original label and the human annotation (``id, vote``). With
    ``block`` (``dataset, demo``: one few-shot block per dataset, a fixed tiny set) the prompts
    start with their dataset's exemplars (A3, J2), as few-shot re-annotation does.

    Output per id: ``original, model, human, n_votes, n_positive, final_label, needs_review``.
    """
    from labelflow.functions.chat import messages_col
    from labelflow.functions.prompts import prompt_col
    prompt = prompt_col("text", "dataset", mode)
    if block is not None:
        from labelflow.operators.exemplars import attach_block
        memes = attach_block(memes, block)
        prompt = F.concat(F.coalesce(F.col("demo"), F.lit("")), prompt)
    asked = memes.withColumn("prompt", prompt) \
                 .withColumn("messages", messages_col(F.col("image"), F.col("prompt"), None, mode))
    answered = parse_response(predictor(asked), "response", "dataset", "pred")
    votes = votes_from_columns(answered, {"original": "label", "model": "pred"})
    if human is not None:
        votes = votes.unionByName(align_votes(human=human))
    # human votes for ids outside ``memes`` are dropped after the aggregate, not by a join
    return majority_vote(votes, tie=tie, sources=("original", "model", "human"),
                         require_source="original")
