"""Registered queries: each a Spark plan over the shared test tables plus its DuckDB twin.

Every query reads whole tables (or data Spark derives from them); nothing is capped or sampled
except where a limit is the feature. Column names are aliased identically on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.functions.labels import class_name
from labelflow.functions.prompts import prompt_col
from labelflow.operators import frames as FR
from labelflow.operators import metrics as M
from labelflow.operators import rows as R
from labelflow.operators import votes as V
from labelflow.operators.ordering import index_within_group, seeded_shuffle
from labelflow.plans import sqlgen as S
from labelflow.sources import testdata as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- splits

def _split_stats(df: DataFrame) -> DataFrame:
    """The three lines of counts from conditional sums over one pass."""
    test = F.col("type").eqNullSafe("test")
    splits = {"train": ~test, "test": test, "train_labelled": ~test & F.col("label").isNotNull()}
    measures = {"n_rows": F.lit(True), "n_labelled": F.col("label").isNotNull(),
                "n_positive": F.coalesce(F.col("label") == 1, F.lit(False))}
    sums = df.agg(*[F.coalesce(F.sum(F.when(of & what, 1).otherwise(0)), F.lit(0)).cast("bigint")
                    .alias(f"{split}.{name}")
                    for split, of in splits.items() for name, what in measures.items()])
    lines = F.array(*[F.struct(F.lit(split).alias("split"),
                               *[F.col(f"`{split}.{name}`").alias(name) for name in measures])
                      for split in splits])
    return sums.select(F.inline(lines))


@query("split_counts", T.with_items("""
SELECT 'train' AS split, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(label) AS BIGINT) AS n_labelled,
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive
FROM items WHERE type IS DISTINCT FROM 'test'
UNION ALL
SELECT 'test', CAST(count(*) AS BIGINT), CAST(count(label) AS BIGINT),
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT)
FROM items WHERE type = 'test'
UNION ALL
SELECT 'train_labelled', CAST(count(*) AS BIGINT), CAST(count(label) AS BIGINT),
       CAST(sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT)
FROM items WHERE type IS DISTINCT FROM 'test' AND label IS NOT NULL
"""))
def split_counts(spark, sf):
    return _split_stats(T.items(spark, sf))


# ---------------------------------------------------------------- class names

@query("class_names", T.with_items(f"""
SELECT id, dataset, label, {S.class_name_sql()} AS label_name FROM items WHERE label IS NOT NULL
"""))
def class_names(spark, sf):
    it = R.labelled(T.items(spark, sf))
    return class_name(it).select("id", "dataset", "label", "label_name")


# ---------------------------------------------------------------- minimum slice

_RESP_SQL = V.RULE_RESPONSE_SQL.format(t="text", pos=S.pos_sql(), neg=S.neg_sql())


def minimum_slice_df(it: DataFrame) -> DataFrame:
    """Scoring path without the GPU: test rows with a label → class name → scoring prompt →
    rule predictor → parsed response → metrics per dataset."""
    scored = class_name(R.labelled(R.test_split(it))) \
        .withColumn("prompt", prompt_col("text", "dataset", "image")) \
        .withColumn("response", V.rule_response("text", "dataset"))
    parsed = V.parse_response(scored, "response", "dataset", "pred")
    return M.classification_report(parsed, by="dataset")


@query("minimum_slice", T.with_items(f"""
, scored AS (
  SELECT dataset, label, {_RESP_SQL} AS response FROM items WHERE type = 'test' AND label IS NOT NULL
), parsed AS (SELECT dataset, label, {S.parse_sql('response')} AS pred FROM scored)
""".replace("\n, scored", ", scored", 1) + M.report_sql("parsed", by="dataset")))
def minimum_slice(spark, sf):
    return minimum_slice_df(T.items(spark, sf))


# ---------------------------------------------------------------- prompts (F1 F2)

@query("train_prompts", T.with_items(f"""
SELECT id, dataset, {S.prompt_sql('text', 'dataset', "'image'")} AS prompt,
       {S.class_name_sql()} AS answer
FROM items WHERE type IS DISTINCT FROM 'test' AND label IS NOT NULL
"""))
def train_prompts(spark, sf):
    it = R.labelled(R.train_split(T.items(spark, sf)))
    return class_name(it, out="answer").select(
        "id", "dataset", prompt_col("text", "dataset", "image").alias("prompt"), "answer")


@query("score_prompts", T.with_items(f"""
SELECT id, dataset, {S.prompt_sql('text', 'dataset', "'video'")} AS prompt,
       {S.class_name_sql()} AS label_name
FROM items WHERE type = 'test' AND label IS NOT NULL
"""))
def score_prompts(spark, sf):
    it = R.labelled(R.test_split(T.items(spark, sf)))
    return class_name(it).select(
        "id", "dataset", prompt_col("text", "dataset", "video").alias("prompt"), "label_name")


# ---------------------------------------------------------------- frames

def gapped_frames(spark, sf) -> DataFrame:
    """Frames with gaps and unreadable files injected: a frame is absent when the first hex
    digit of md5(item_id:idx) is 0, unreadable when the first two are ff."""
    f = T.frames(spark, sf)
    h = F.md5(F.concat(F.col("item_id"), F.lit(":"), F.col("frame_idx").cast("string")))
    return f.filter(F.substring(h, 1, 1) != "0") \
            .withColumn("readable", F.substring(h, 1, 2) != "ff")


_GAPPED_SQL = """
gapped AS (
  SELECT item_id, frame_idx, variance,
         substr(md5(item_id || ':' || CAST(frame_idx AS VARCHAR)), 1, 2) <> 'ff' AS readable
  FROM frames WHERE substr(md5(item_id || ':' || CAST(frame_idx AS VARCHAR)), 1, 1) <> '0'
)"""


@query("first_informative_frame", T.with_frames(f"""
, {_GAPPED_SQL.strip()},
run AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY frame_idx) - 1 = frame_idx AS in_run
  FROM gapped
), pick AS (
  SELECT item_id,
         max(CASE WHEN frame_idx = 0 THEN 1 ELSE 0 END) AS has0,
         coalesce(min(frame_idx) FILTER (WHERE in_run AND readable AND variance > 100),
                  max(frame_idx) FILTER (WHERE in_run)) AS chosen,
         min(frame_idx) FILTER (WHERE NOT readable) AS first_bad
  FROM run GROUP BY item_id
)
SELECT item_id,
       CAST(CASE WHEN has0 = 1 THEN chosen END AS INTEGER) AS frame_idx,
       CASE WHEN has0 = 0 THEN 'frame 0 missing'
            WHEN first_bad IS NOT NULL AND first_bad <= chosen THEN 'unreadable frame at or before the choice'
            ELSE 'ok' END AS status
FROM pick
""".replace("\n, gapped", ", gapped", 1)))
def first_informative_frame(spark, sf):
    return FR.first_informative(gapped_frames(spark, sf), threshold=100.0)


@query("uniform_frames", T.with_frames("""
, sized AS (SELECT item_id, frame_idx, count(*) OVER (PARTITION BY item_id) AS n FROM frames),
picks AS (SELECT s.item_id, s.frame_idx, min(j) AS sample_pos
          FROM sized s JOIN range(16) r(j) ON s.frame_idx = (r.j * s.n) // 16
          GROUP BY s.item_id, s.frame_idx)
SELECT item_id, frame_idx, CAST(sample_pos AS INTEGER) AS sample_pos FROM picks
""".replace("\n, sized", ", sized", 1)))
def uniform_frames(spark, sf):
    return FR.uniform_sample(T.frames(spark, sf), k=16, counts=T.frame_counts(spark, sf)) \
        .select("item_id", "frame_idx", "sample_pos")


@query("vector_gate", """
SELECT vec_id, round(list_var_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 9) AS variance,
       CASE WHEN list_var_pop(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) > 0.0155 THEN 1 ELSE 0 END AS informative
FROM embeddings
""")
def vector_gate(spark, sf):
    e = T.table(spark, sf, "embeddings")
    v = FR.vector_variance("embedding")
    return e.select("vec_id", F.round(v, 9).alias("variance"),
                    F.when(FR.is_informative(v, 0.0155), 1).otherwise(0).alias("informative"))


# ---------------------------------------------------------------- ordering

@query("seeded_shuffle", """
SELECT CAST(doc_id AS VARCHAR) AS id,
       CAST(row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), CAST(doc_id AS VARCHAR)) - 1 AS BIGINT) AS pos
FROM documents
""")
def seeded_shuffle_q(spark, sf):
    d = T.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return seeded_shuffle(d, "id").select("id", "pos")


@query("shuffle_shared_ids", """
WITH e AS (SELECT CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS id,
                  event_id, event_type, props FROM events),
k AS (SELECT *, md5(CASE WHEN id IS NULL THEN '42#' ELSE '42:' || id END) AS sk,
             md5(coalesce(id, chr(30)) || chr(31) || coalesce(CAST(event_id AS VARCHAR), chr(30))
                 || chr(31) || coalesce(event_type, chr(30)) || chr(31)
                 || coalesce(props, chr(30))) AS rh FROM e)
SELECT id, event_id, CAST(row_number() OVER (ORDER BY sk, rh) - 1 AS BIGINT) AS pos FROM k
""")
def shuffle_shared_ids(spark, sf):
    """Seeded shuffle where many rows share an id and every seventh has none."""
    e = T.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 7 != 0, F.col("user_id").cast("string")).alias("id"),
        "event_id", "event_type", "props")
    return seeded_shuffle(e, "id").select("id", "event_id", "pos")


@query("null_groups", """
WITH e AS (SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE user_id END AS user_id,
                  CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS ts, event_id FROM events)
SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id) - 1
                      AS BIGINT) AS idx FROM e
""")
def null_groups(spark, sf):
    """Numbering within groups where group and order column hold NULLs."""
    e = T.table(spark, sf, "events").select(
        F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("ts"), "event_id")
    return index_within_group(e, order=["ts", "event_id"], bucket=F.date_trunc("hour", F.col("ts")),
                              fine=F.date_trunc("second", F.col("ts")), group="user_id") \
        .select("event_id", "idx")


# ---------------------------------------------------------------- exemplars

from labelflow.functions import chat as C  # noqa: E402
from labelflow.functions import tokens as TK  # noqa: E402
from labelflow.functions.labels import class_name_col  # noqa: E402
from labelflow.operators import batches as B  # noqa: E402
from labelflow.operators import exemplars as X  # noqa: E402

FEW_K = 4


def exemplar_ids(it: DataFrame) -> DataFrame:
    """Stand-in for the fixed exemplar lists: per dataset, the first 8 labelled training ids by
    ``md5('ex:' || id)`` (a top-k report), numbered 0..7 in that order."""
    pool = R.labelled(R.train_split(it)).withColumn("_k", F.md5(F.concat(F.lit("ex:"), "id")))
    top = X.top_k_per_dataset(pool.select("dataset", "id", "_k"), [F.col("_k"), F.col("id")], 8)
    return X.number_in_order(top, [F.col("_k"), F.col("id")]).select("dataset", "pos", "id")


def description_pool(it: DataFrame) -> DataFrame:
    """Stand-in for the description files: ``dataset, id, label (class name), description,
    text``."""
    return it.select("dataset", "id", class_name_col("dataset", "label").alias("label"),
                     F.concat(F.lit("frames of item "), F.col("id")).alias("description"), "text")


_EX_IDS_SQL = """ex_ids AS (
  SELECT dataset, id, CAST(row_number() OVER (PARTITION BY dataset ORDER BY md5('ex:' || id), id) - 1 AS INTEGER) AS pos
  FROM items WHERE type IS DISTINCT FROM 'test' AND label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY md5('ex:' || id), id) <= 8
)"""

_BLOCK_SQL = f"""block AS (
  SELECT e.dataset,
         string_agg({S.demo_line_sql("'frames of item ' || i.id", 'i.text', S.class_name_sql('i.dataset', 'i.label'), 'i.dataset', "'video'")}, '' ORDER BY e.pos)
           || {S.lit(__import__('labelflow.constants', fromlist=['x']).DEMO_CLOSING)} AS demo
  FROM ex_ids e JOIN items i ON i.id = e.id AND i.dataset = e.dataset
  WHERE e.pos < {FEW_K}
  GROUP BY e.dataset
)"""


def exemplar_block_df(it: DataFrame, k: int = FEW_K) -> DataFrame:
    ex = X.ordered_exemplars(exemplar_ids(it), description_pool(it), k)
    return X.demo_block(ex, k, mode="video")


@query("exemplar_block", T.with_items(f", {_EX_IDS_SQL}, {_BLOCK_SQL}\nSELECT dataset, demo FROM block"))
def exemplar_block(spark, sf):
    return exemplar_block_df(T.items(spark, sf))


@query("fewshot_prompts", T.with_items(f""", {_EX_IDS_SQL}, {_BLOCK_SQL}
SELECT t.id, t.dataset, coalesce(b.demo, '') || {S.prompt_sql('t.text', 't.dataset', "'video'")} AS prompt
FROM items t LEFT JOIN block b ON b.dataset = t.dataset
WHERE t.type = 'test' AND t.label IS NOT NULL
"""))
def fewshot_prompts(spark, sf):
    it = T.items(spark, sf)
    scored = R.labelled(R.test_split(it))
    j = X.attach_block(scored, exemplar_block_df(it))
    return j.select("id", "dataset", X.fewshot_prompt_col("demo", "text", "dataset", "video")
                    .alias("prompt"))


def fewshot_messages_df(it: DataFrame, k: int = FEW_K) -> DataFrame:
    """Multi-turn path: exemplar rows are the items whose id is in the list (P4), the first k in
    file order (O2; file order = numeric id here); their message pairs form a history (A4) put
    before each scored row's own user turn (F4)."""
    ids = exemplar_ids(it)
    rows = R.exemplar_rows(it, ids.select("id"))
    first = X.top_k_per_dataset(rows, [F.col("id").cast("bigint")], k)
    ex = X.number_in_order(first, [F.col("id").cast("bigint")])
    hist = X.history(ex, k)
    scored = R.labelled(R.test_split(it))
    own = C.user_message(F.col("image"), prompt_col("text", "dataset", "image"), "image")
    return X.attach_block(scored, hist).select(
        "id", F.concat(F.coalesce(F.col("history"), F.array().cast(
            "array<struct<role:string,content:array<struct<type:string,value:string>>>>")),
            F.array(own)).alias("messages"))


@query("fewshot_history", T.with_items(f""", {_EX_IDS_SQL},
ex AS (
  SELECT i.*, CAST(row_number() OVER (PARTITION BY i.dataset ORDER BY CAST(i.id AS BIGINT)) - 1 AS INTEGER) AS pos
  FROM items i WHERE i.id IN (SELECT id FROM ex_ids)
  QUALIFY row_number() OVER (PARTITION BY i.dataset ORDER BY CAST(i.id AS BIGINT)) <= {FEW_K}
), t AS (SELECT * FROM items WHERE type = 'test' AND label IS NOT NULL)
SELECT t.id, CAST(2 * e.pos AS INTEGER) AS msg_pos, 0 AS part_pos, 'user' AS role, 'image' AS type, md5(e.image) AS value_md5
FROM t JOIN ex e ON e.dataset = t.dataset
UNION ALL
SELECT t.id, CAST(2 * e.pos AS INTEGER), 1, 'user', 'text', md5({S.prompt_sql('e.text', 'e.dataset', "'image'")})
FROM t JOIN ex e ON e.dataset = t.dataset
UNION ALL
SELECT t.id, CAST(2 * e.pos + 1 AS INTEGER), 0, 'assistant', 'text', md5({S.class_name_sql('e.dataset', 'e.label')})
FROM t JOIN ex e ON e.dataset = t.dataset
UNION ALL
SELECT t.id, CAST(2 * (SELECT count(*) FROM ex e WHERE e.dataset = t.dataset) AS INTEGER), 0, 'user', 'image', md5(t.image) FROM t
UNION ALL
SELECT t.id, CAST(2 * (SELECT count(*) FROM ex e WHERE e.dataset = t.dataset) AS INTEGER), 1, 'user', 'text', md5({S.prompt_sql('t.text', 't.dataset', "'image'")}) FROM t
"""))
def fewshot_history(spark, sf):
    m = fewshot_messages_df(T.items(spark, sf))
    msgs = m.select("id", F.posexplode("messages").alias("msg_pos", "msg"))
    parts = msgs.select("id", "msg_pos", F.col("msg.role").alias("role"),
                        F.posexplode("msg.content").alias("part_pos", "p"))
    return parts.select("id", F.col("msg_pos").cast("int").alias("msg_pos"),
                        F.col("part_pos").cast("int").alias("part_pos"), "role",
                        F.col("p.type").alias("type"), F.md5(F.col("p.value")).alias("value_md5"))


# ---------------------------------------------------------------- chat rendering

@query("chat_render", """
SELECT conv_id, turn, role, '<|' || role || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS segment
FROM conversations
""")
def chat_render(spark, sf):
    c = T.table(spark, sf, "conversations")
    return c.select("conv_id", "turn", "role", C.render_turn("role", "text").alias("segment"))


# ---------------------------------------------------------------- tokens

def _ids_sql(text: str) -> str:
    spaced = f"regexp_replace(coalesce({text}, ''), '<\\|(image|video)\\|>', ' <|\\1|> ', 'g')"
    return (f"list_transform(list_filter(regexp_split_to_array({spaced}, '[ \\t\\n\\r]+'), "
            f"lambda w: w <> ''), lambda w: CASE WHEN w IN ('<|image|>', '<|video|>') THEN 1 "
            f"ELSE ((('0x' || substr(md5(w), 1, 7))::BIGINT % 32000) + 2) END)")


def _token_rows_sql(table: str, key: str, n: int) -> str:
    return f"""
WITH t AS (SELECT {key}, {_ids_sql('text')} AS ids FROM {table}),
p AS (SELECT {key}, ids, list_resize(ids, {n}, 0) AS input_ids FROM t)
SELECT {key}, CAST(len(ids) AS BIGINT) AS n_tokens,
       md5(array_to_string(input_ids, ' ')) AS input_ids_md5,
       md5(array_to_string(list_transform(input_ids, lambda i: CASE WHEN i IN (0, 1) THEN -100 ELSE i END), ' ')) AS labels_md5,
       CAST(list_sum(list_transform(input_ids, lambda i: CASE WHEN i = 0 THEN 0 ELSE 1 END)) AS BIGINT) AS n_attended
FROM p"""


def token_rows_df(df: DataFrame, key: str, n: int) -> DataFrame:
    split = df.select(key, TK.words("text").alias("words"))
    rows = split.select(key, F.size("words").cast("bigint").alias("n_tokens"),
                        TK.pad_truncate(TK.word_ids(F.slice("words", 1, n)), n)
                        .alias("input_ids"))
    return rows.select(key, "n_tokens",
                       F.md5(F.array_join("input_ids", " ")).alias("input_ids_md5"),
                       F.md5(F.array_join(TK.mask_labels("input_ids"), " ")).alias("labels_md5"),
                       TK.attended("input_ids").alias("n_attended"))


@query("token_rows", _token_rows_sql("benchmark", "item_id", 64))
def token_rows(spark, sf):
    return token_rows_df(T.table(spark, sf, "benchmark"), "item_id", 64)


@query("token_rows_documents", _token_rows_sql("documents", "doc_id", 512))
def token_rows_documents(spark, sf):
    return token_rows_df(T.table(spark, sf, "documents"), "doc_id", 512)


_BENCH_RESP_SQL = V.RULE_RESPONSE_SQL.format(t="text", pos="'hateful'", neg="'non-hateful'")


@query("strip_prompt", f"""
WITH g AS (
  SELECT item_id, {_ids_sql('text')} AS prompt_ids,
         {_ids_sql(_BENCH_RESP_SQL)} AS resp_ids
  FROM benchmark
), s AS (
  SELECT item_id, len(prompt_ids) AS n_prompt,
         list_concat(list_concat(prompt_ids, [1]), list_concat(resp_ids, [0, 0])) AS generated
  FROM g
)
SELECT item_id, CAST(n_prompt AS BIGINT) AS n_prompt,
       array_to_string(list_filter(generated[n_prompt + 1:], lambda i: i NOT IN (0, 1)), ' ') AS response_ids
FROM s
""")
def strip_prompt(spark, sf):
    b = T.table(spark, sf, "benchmark").withColumn("dataset", F.lit("hatemm"))
    g = b.select("item_id", TK.token_ids("text").alias("prompt_ids"),
                 TK.token_ids(V.rule_response("text", "dataset")).alias("resp_ids"))
    gen = F.concat("prompt_ids", F.array(F.lit(1).cast("bigint")), "resp_ids",
                   F.array(F.lit(0).cast("bigint"), F.lit(0).cast("bigint")))
    s = g.select("item_id", F.size("prompt_ids").cast("bigint").alias("n_prompt"),
                 gen.alias("generated"))
    return s.select("item_id", "n_prompt",
                    F.array_join(TK.strip_prompt("generated", F.col("n_prompt")), " ")
                    .alias("response_ids"))


# ---------------------------------------------------------------- batches

@query("batches", T.with_items("""
, r AS (
  SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS pos
  FROM items WHERE type IS DISTINCT FROM 'test' AND label IS NOT NULL
)
SELECT CAST(pos // 4 AS BIGINT) AS batch_id, CAST(pos // 32 AS BIGINT) AS step_id,
       CAST(count(*) AS INTEGER) AS n_rows, string_agg(id, ' ' ORDER BY pos) AS ids
FROM r GROUP BY pos // 4, pos // 32
"""))
def batches(spark, sf):
    tr = R.labelled(R.train_split(T.items(spark, sf)))
    b = B.collate(B.assign_batches(tr.select("id")), ["id"])
    return b.select("batch_id", "step_id", "n_rows", F.array_join("id", " ").alias("ids"))


# ---------------------------------------------------------------- votes

from labelflow.functions import augment as AU  # noqa: E402
from labelflow.operators import predict as P  # noqa: E402
from labelflow.operators import regimes as RG  # noqa: E402


def rule_predictor(df: DataFrame) -> DataFrame:
    """The stand-in model: adds ``response`` from :func:`votes.rule_response`."""
    return df.withColumn("response", V.rule_response("text", "dataset"))


def human_votes(spark, sf) -> DataFrame:
    """Second annotator: ``1 - quality`` from ``labels``."""
    return T.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"),
                                               (1 - F.col("quality")).alias("vote"))


_VOTES_SQL = f"""votes AS (
  SELECT id, 'original' AS source, label AS vote FROM items WHERE {{where}}
  UNION ALL SELECT id, 'model', {S.parse_sql('(' + _RESP_SQL + ')')} FROM items WHERE {{where}}
  UNION ALL SELECT CAST(l.doc_id AS VARCHAR), 'human', 1 - l.quality FROM labels l
    WHERE CAST(l.doc_id AS VARCHAR) IN (SELECT id FROM items WHERE {{where}})
), g AS (
  SELECT id, count(vote) AS n, coalesce(sum(vote), 0) AS p,
         max(vote) FILTER (WHERE source = 'original') AS original,
         max(vote) FILTER (WHERE source = 'model') AS model,
         max(vote) FILTER (WHERE source = 'human') AS human
  FROM votes GROUP BY id
), final AS (
  SELECT id, original, model, human, CAST(n AS BIGINT) AS n_votes, CAST(p AS BIGINT) AS n_positive,
         CASE WHEN n = 0 THEN NULL WHEN 2 * p > n THEN 1 WHEN 2 * p < n THEN 0 END AS final_label
  FROM g
)"""


def reannotated(spark, sf, where=None) -> DataFrame:
    it = T.items(spark, sf)
    if where is not None:
        it = it.filter(where)
    return V.reannotate(it, rule_predictor, human_votes(spark, sf))


@query("majority_vote", T.with_items(f", {_VOTES_SQL.format(where='TRUE')}" + """
SELECT id, n_votes, n_positive, final_label, CASE WHEN final_label IS NULL THEN 1 ELSE 0 END AS needs_review
FROM final"""))
def majority_vote(spark, sf):
    return reannotated(spark, sf).select("id", "n_votes", "n_positive", "final_label",
                                         "needs_review")


@query("reannotate", T.with_items(f", {_VOTES_SQL.format(where=chr(39) + 'meme' + chr(39) + ' = domain')}" + """
SELECT id, original, model, human, n_votes, n_positive, final_label,
       CASE WHEN final_label IS NULL THEN 1 ELSE 0 END AS needs_review
FROM final"""))
def reannotate_q(spark, sf):
    return reannotated(spark, sf, F.col("domain") == "meme")


@query("label_transitions", T.with_items(f", {_VOTES_SQL.format(where='TRUE')}" + """
SELECT i.label AS orig_label, f.final_label, CAST(count(*) AS BIGINT) AS n
FROM items i JOIN final f ON f.id = i.id GROUP BY i.label, f.final_label"""))
def label_transitions(spark, sf):
    return V.label_transitions(T.items(spark, sf), reannotated(spark, sf))


@query("parse_response", T.with_items(f"""
SELECT id, {_RESP_SQL} AS response, {S.parse_sql('(' + _RESP_SQL + ')')} AS pred FROM items"""))
def parse_response_q(spark, sf):
    r = rule_predictor(T.items(spark, sf))
    return V.parse_response(r).select("id", "response", "pred")


@query("classification_report", "WITH lab AS (SELECT toxic AS label, 1 - quality AS pred FROM labels)"
       + M.report_sql("lab"))
def classification_report(spark, sf):
    lab = T.table(spark, sf, "labels").select(F.col("toxic").alias("label"),
                                              (1 - F.col("quality")).alias("pred"))
    return M.classification_report(lab)


# ---------------------------------------------------------------- media

@query("media_route", """
SELECT page_id, url || CASE WHEN page_id % 3 = 0 THEN '.mp4' ELSE '.png' END AS path,
       CASE WHEN right(url || CASE WHEN page_id % 3 = 0 THEN '.mp4' ELSE '.png' END, 3) = 'mp4' THEN 'video' ELSE 'image' END AS kind,
       CASE WHEN right(url, 3) = 'mp4' THEN 1 ELSE 0 END AS url_is_mp4,
       CASE WHEN url LIKE '%mhc%' THEN 'mhc' WHEN url LIKE '%hatemm%' THEN 'hatemm' ELSE 'none' END AS profile
FROM pages""")
def media_route(spark, sf):
    pg = T.table(spark, sf, "pages")
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, F.lit(".mp4")).otherwise(F.lit(".png")))
    routed = R.media_kind(pg.select("page_id", "url", path.alias("video")), "video", "kind")
    # S6 per row; the strict resolver raises on no match, so route unmatched pages to 'none'
    prof = F.when(F.col("url").contains("mhc") | F.col("url").contains("hatemm"),
                  __import__("labelflow.functions.labels", fromlist=["x"]).resolve_profile("url")) \
            .otherwise(F.lit("none"))
    return routed.select("page_id", F.col("video").alias("path"), "kind",
                         F.when(R.is_mp4("url"), 1).otherwise(0).alias("url_is_mp4"),
                         prof.alias("profile"))


_W1_SQL = f"""{_GAPPED_SQL.strip()},
run AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY frame_idx) - 1 = frame_idx AS in_run
  FROM gapped
), pick AS (
  SELECT item_id,
         max(CASE WHEN frame_idx = 0 THEN 1 ELSE 0 END) AS has0,
         coalesce(min(frame_idx) FILTER (WHERE in_run AND readable AND variance > 100),
                  max(frame_idx) FILTER (WHERE in_run)) AS chosen,
         min(frame_idx) FILTER (WHERE NOT readable) AS first_bad
  FROM run GROUP BY item_id
), w1 AS (
  SELECT item_id,
         CAST(CASE WHEN has0 = 1 THEN chosen END AS INTEGER) AS frame_idx,
         CASE WHEN has0 = 0 THEN 'frame 0 missing'
              WHEN first_bad IS NOT NULL AND first_bad <= chosen THEN 'unreadable frame at or before the choice'
              ELSE 'ok' END AS status
  FROM pick
), resolved AS (
  SELECT i.id,
         CASE WHEN i.frames IS NOT NULL AND w.frame_idx IS NOT NULL
              THEN i.frames || '/' || CAST(w.frame_idx AS VARCHAR) || '.png' ELSE i.image END AS image,
         CASE WHEN i.frames IS NULL THEN 'ok' WHEN w.item_id IS NULL THEN 'frame 0 missing' ELSE w.status END AS status
  FROM items i LEFT JOIN w1 w ON w.item_id = i.frames
)"""


def resolved_items(spark, sf) -> DataFrame:
    chosen = FR.first_informative(gapped_frames(spark, sf), threshold=100.0)
    return R.resolve_media(T.items(spark, sf), chosen)


@query("media_fallback", T.with_items_frames(f", {_W1_SQL}" + """
SELECT id, image, image AS video, status,
       CASE WHEN right(image, 3) = 'mp4' THEN 'video' ELSE 'image' END AS kind
FROM resolved"""))
def media_fallback(spark, sf):
    r = R.media_kind(resolved_items(spark, sf), "video", "kind")
    return r.select("id", "image", "video", "status", "kind")


@query("quarantine", T.with_items_frames(f", {_W1_SQL}" + """
SELECT id, CASE WHEN status <> 'ok' THEN status
                WHEN substr(md5('img:' || id), 1, 1) = 'f' THEN 'unreadable image'
                ELSE 'good' END AS outcome
FROM resolved"""))
def quarantine_q(spark, sf):
    r = resolved_items(spark, sf)
    reason = F.when(F.col("status") != "ok", F.col("status")) \
              .when(F.substring(F.md5(F.concat(F.lit("img:"), "id")), 1, 1) == "f",
                    F.lit("unreadable image"))
    return R.tagged(r, reason).select("id", F.coalesce("reason", F.lit("good")).alias("outcome"))


# ---------------------------------------------------------------- augmentation plan

@query("augmentation_plan", AU.plan_sql("labels", "doc_id"))
def augmentation_plan(spark, sf):
    lab = T.table(spark, sf, "labels").select("doc_id")
    return AU.augmentation_plan(lab, "doc_id", digits=6).withColumn(
        "aug_k", F.col("aug_k").cast("int"))


# ---------------------------------------------------------------- regimes

@query("augment_union", T.with_items("""
SELECT id, domain, label FROM items WHERE type IS DISTINCT FROM 'test'"""))
def augment_union(spark, sf):
    it = T.items(spark, sf)
    u = RG.augment(it.filter(F.col("domain") == "video").drop("domain"),
                   it.filter(F.col("domain") == "meme").drop("domain"))
    return u.select("id", "domain", "label")


def regime_items(spark, sf) -> DataFrame:
    it = T.items(spark, sf)
    return RG.with_reannotated(it, reannotated(spark, sf, F.col("domain") == "meme"))


@query("augment_union_voted", T.with_items(f", {_VOTES_SQL.format(where=chr(39) + 'meme' + chr(39) + ' = domain')}" + """
SELECT i.id, i.domain, CAST(CASE WHEN i.domain = 'meme' THEN f.final_label ELSE i.label END AS INTEGER) AS label
FROM items i LEFT JOIN final f ON f.id = i.id WHERE i.type IS DISTINCT FROM 'test'"""))
def augment_union_voted(spark, sf):
    """Video rows united with re-annotated memes: the memes carry their voted labels."""
    it = regime_items(spark, sf)
    memes = it.filter(F.col("domain") == "meme").withColumn("label", F.col("rm_label"))
    u = RG.augment(it.filter(F.col("domain") == "video").drop("domain", "rm_label"),
                   memes.drop("domain", "rm_label"))
    return u.select("id", "domain", F.col("label").cast("int").alias("label"))


@query("regime_counts", T.with_items(f", {_VOTES_SQL.format(where=chr(39) + 'meme' + chr(39) + ' = domain')}" + """,
r AS (SELECT i.*, f.final_label AS rm_label FROM items i LEFT JOIN final f ON f.id = i.id
      WHERE i.type IS DISTINCT FROM 'test')
SELECT 'no_ft' AS regime, CAST(0 AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_positive
UNION ALL SELECT 'om_ft', count(*), CAST(coalesce(sum(label), 0) AS BIGINT) FROM r WHERE domain = 'meme' AND label IS NOT NULL
UNION ALL SELECT 'rm_ft', count(*), CAST(coalesce(sum(rm_label), 0) AS BIGINT) FROM r WHERE domain = 'meme' AND rm_label IS NOT NULL
UNION ALL SELECT 'vid_ft', count(*), CAST(coalesce(sum(label), 0) AS BIGINT) FROM r WHERE domain = 'video' AND label IS NOT NULL
UNION ALL SELECT 'vid_rm', count(*), CAST(coalesce(sum(l), 0) AS BIGINT) FROM (
  SELECT label AS l FROM r WHERE domain = 'video' AND label IS NOT NULL
  UNION ALL SELECT rm_label FROM r WHERE domain = 'meme' AND rm_label IS NOT NULL)"""))
def regime_counts(spark, sf):
    return RG.regime_counts(regime_items(spark, sf))


from labelflow.operators import bootstrap as BS  # noqa: E402


def _features_sql(text: str, d: int) -> str:
    return (f"list_transform(list_filter(regexp_split_to_array(coalesce({text}, ''), '\\W+'), "
            f"lambda w: w <> ''), lambda w: (('0x' || substr(md5(lower(w)), 1, 7))::BIGINT % {d}))")


def _scored_regimes_sql() -> str:
    from labelflow.operators.bayes import NUM_FEATURES as D
    trained = [r for r in RG.REGIMES if r != "no_ft"]
    mem = "\n  UNION ALL ".join(
        f"SELECT '{r}' AS g, {c} AS y, text FROM r WHERE type IS DISTINCT FROM 'test' "
        f"AND domain = '{d}' AND {c} IS NOT NULL"
        for r in trained for d, c in RG.REGIME_PARTS[r])
    regs = ", ".join(f"('{r}')" for r in trained)
    return T.with_items(f", {_VOTES_SQL.format(where=chr(39) + 'meme' + chr(39) + ' = domain')}" + f""",
r AS (SELECT i.*, f.final_label AS rm_label FROM items i LEFT JOIN final f ON f.id = i.id),
mem AS (
  {mem}
), sizes AS (
  SELECT g, m, p, CAST(m AS DOUBLE) / (2.0::DOUBLE * CAST(greatest(p, 1) AS DOUBLE)) AS w1,
         CAST(m AS DOUBLE) / (2.0::DOUBLE * CAST(greatest(m - p, 1) AS DOUBLE)) AS w0
  FROM (SELECT g, count(*) AS m, sum(y) AS p FROM mem GROUP BY g)
), rw AS (SELECT g, y, {_features_sql('text', D)} AS x FROM mem),
stats AS (
  SELECT g, f, sum(c1) AS c1, sum(c0) AS c0, sum(d) AS df FROM (
    SELECT g, unnest(x) AS f, CASE WHEN y = 1 THEN 1 ELSE 0 END AS c1,
           CASE WHEN y = 0 THEN 1 ELSE 0 END AS c0, 0 AS d FROM rw
    UNION ALL SELECT g, unnest(list_distinct(x)) AS f, 0, 0, 1 FROM rw
  ) GROUP BY g, f
), t AS (
  SELECT s.g, s.f, ln((CAST(z.m AS DOUBLE) + 1.0::DOUBLE) / (CAST(s.df AS DOUBLE) + 1.0::DOUBLE)) AS idf,
         z.w1 * CAST(s.c1 AS DOUBLE) AS s1, z.w0 * CAST(s.c0 AS DOUBLE) AS s0
  FROM stats s JOIN sizes z ON z.g = s.g
), t2 AS (SELECT g, f, idf, idf * s1 AS n1, idf * s0 AS n0 FROM t),
totals AS (SELECT g, sum(n1) + {float(D)}::DOUBLE AS t1, sum(n0) + {float(D)}::DOUBLE AS t0 FROM t2 GROUP BY g),
model AS (
  SELECT t2.g, t2.f, t2.idf * ((ln(t2.n1 + 1.0::DOUBLE) - ln(tt.t1)) - (ln(t2.n0 + 1.0::DOUBLE) - ln(tt.t0))) AS d
  FROM t2 JOIN totals tt ON tt.g = t2.g
), grp AS (
  SELECT z.g, ln(z.w1 * CAST(z.p AS DOUBLE) + 1.0::DOUBLE) - ln(z.w0 * CAST(z.m - z.p AS DOUBLE) + 1.0::DOUBLE) AS prior,
         ln(CAST(z.m AS DOUBLE) + 1.0::DOUBLE) * (ln(coalesce(tt.t0, {float(D)}::DOUBLE)) - ln(coalesce(tt.t1, {float(D)}::DOUBLE))) AS unseen
  FROM sizes z LEFT JOIN totals tt ON tt.g = z.g
), target AS (
  SELECT id, label, text, dataset, md5(coalesce(text, '')) AS k FROM r
  WHERE domain = 'video' AND type = 'test' AND label IS NOT NULL
), uniq AS (SELECT k, min(text) AS t FROM target GROUP BY k),
feats AS (SELECT k, {_features_sql('t', D)} AS x FROM uniq),
occ AS (SELECT k, unnest(x) AS f FROM feats),
sums AS (SELECT o.k, m.g, sum(m.d) AS sd, count(*) AS nh FROM occ o JOIN model m ON m.f = o.f GROUP BY o.k, m.g),
regs AS (SELECT * FROM (VALUES {regs}) v(g)),
per AS (SELECT fe.k, rg.g, len(fe.x) AS nt FROM feats fe, regs rg),
margins AS (
  SELECT per.k, per.g,
         coalesce(grp.prior, 0.0::DOUBLE) + coalesce(s.sd, 0.0::DOUBLE)
           + coalesce(grp.unseen, 0.0::DOUBLE) * (per.nt - coalesce(s.nh, 0)) AS margin
  FROM per LEFT JOIN sums s ON s.k = per.k AND s.g = per.g LEFT JOIN grp ON grp.g = per.g
), preds AS (
  SELECT m.g AS regime, tg.id, tg.label, CASE WHEN m.margin > 0 THEN 1 ELSE 0 END AS pred
  FROM target tg JOIN margins m ON m.k = tg.k
  UNION ALL
  SELECT 'no_ft', id, label, {S.parse_sql('(' + _RESP_SQL + ')')} FROM target
)""")


def _base_answers(df: DataFrame) -> DataFrame:
    return V.parse_response(rule_predictor(df), "response", "dataset", "pred")


@query("compare_regimes", _scored_regimes_sql() + M.report_sql("preds", by="regime"))
def compare_regimes(spark, sf):
    return RG.compare_regimes(regime_items(spark, sf), base_predictor=_base_answers)


@query("regime_significance", _scored_regimes_sql() + BS.compare_sql("preds"))
def regime_significance(spark, sf):
    """Differences in accuracy between the regimes, with bootstrap intervals."""
    return BS.compare(RG.score_regimes(regime_items(spark, sf), base_predictor=_base_answers))


# ---------------------------------------------------------------- prediction (M1 M2)

@query("predict_embeddings", """
SELECT vec_id,
       round(list_sum(list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS DOUBLE) ELSE -CAST(x AS DOUBLE) END)), 6) AS score,
       CASE WHEN list_sum(list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS DOUBLE) ELSE -CAST(x AS DOUBLE) END)) > 0 THEN 1 ELSE 0 END AS pred
FROM embeddings""")
def predict_embeddings(spark, sf):
    e = T.table(spark, sf, "embeddings").select("vec_id", "embedding")
    make = P.choose_model(None, load_fn=lambda p: None,
                          base_fn=P.linear_rule(P.alternating_weights(64)))
    scored = P.predict(e, make, "embedding", out="raw", input_tensor_shapes=[[64]])
    return scored.select("vec_id", F.round("raw", 6).alias("score"),
                         P.score_to_label(F.col("raw")).alias("pred"))


# ---------------------------------------------------------------- training rows

from labelflow.sources.sinks import prediction_rows  # noqa: E402


def training_rows_df(it: DataFrame, max_length: int = 512) -> DataFrame:
    """The fine-tuning collate path: labelled training items, numbered by the seeded shuffle
    while they are still narrow rows → user(image, prompt) + assistant(class name) messages →
    rendered text (no generation suffix) → token ids → truncate/pad to ``max_length`` → masked
    labels, with batch and step ids. Words beyond ``max_length`` are counted, not hashed."""
    tr = class_name(R.labelled(R.train_split(it)), out="answer") \
        .select("id", "text", "dataset", "image", "answer")
    msgs = B.assign_batches(tr).select(
        "id", "batch_id", "step_id",
        C.messages_col(F.col("image"), prompt_col("text", "dataset", "image"),
                       F.col("answer"), "image").alias("messages"))
    split = msgs.select("id", "batch_id", "step_id",
                        TK.words(C.render_chat("messages")).alias("words"))
    rows = split.select("id", "batch_id", "step_id",
                        F.size("words").cast("bigint").alias("n_tokens"),
                        TK.pad_truncate(TK.word_ids(F.slice("words", 1, max_length)), max_length)
                        .alias("input_ids"))
    return rows.select("id", "batch_id", "step_id", "n_tokens",
                       F.md5(F.array_join("input_ids", " ")).alias("input_ids_md5"),
                       F.md5(F.array_join(TK.mask_labels("input_ids"), " ")).alias("labels_md5"))


_RENDER_TRAIN_SQL = ("'<|user|>' || chr(10) || '<|image|>' || " + S.prompt_sql('text', 'dataset', "'image'")
                     + " || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || "
                     + S.class_name_sql() + " || '<|end|>' || chr(10)")


@query("training_rows", T.with_items(f"""
, t AS (
  SELECT id, {_ids_sql(_RENDER_TRAIN_SQL)} AS ids
  FROM items WHERE type IS DISTINCT FROM 'test' AND label IS NOT NULL
), p AS (
  SELECT id, ids, list_resize(ids, 512, 0) AS input_ids,
         row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS pos
  FROM t
)
SELECT id, CAST(pos // 4 AS BIGINT) AS batch_id, CAST(pos // 32 AS BIGINT) AS step_id,
       CAST(len(ids) AS BIGINT) AS n_tokens,
       md5(array_to_string(input_ids, ' ')) AS input_ids_md5,
       md5(array_to_string(list_transform(input_ids, lambda i: CASE WHEN i IN (0, 1) THEN -100 ELSE i END), ' ')) AS labels_md5
FROM p"""))
def training_rows(spark, sf):
    return training_rows_df(T.items(spark, sf))


@query("predictions", T.with_items(f"""
SELECT id, {_RESP_SQL} AS response, {S.class_name_sql()} AS label
FROM items WHERE type = 'test' AND label IS NOT NULL"""))
def predictions(spark, sf):
    scored = rule_predictor(class_name(R.labelled(R.test_split(T.items(spark, sf)))))
    return prediction_rows(scored)


# ---------------------------------------------------------------- scoring path

_TURN = "'<|user|>' || chr(10) || '<|image|>' || {p} || '<|end|>' || chr(10)"
_SCORED_SQL = f"""ex AS (
  SELECT i.*, CAST(row_number() OVER (PARTITION BY i.dataset ORDER BY CAST(i.id AS BIGINT)) - 1 AS INTEGER) AS pos
  FROM items i WHERE i.id IN (SELECT id FROM ex_ids)
  QUALIFY row_number() OVER (PARTITION BY i.dataset ORDER BY CAST(i.id AS BIGINT)) <= {FEW_K}
), hist AS (
  SELECT dataset, string_agg({_TURN.format(p=S.prompt_sql('text', 'dataset', "'image'"))}
           || '<|assistant|>' || chr(10) || {S.class_name_sql()} || '<|end|>' || chr(10), '' ORDER BY pos) AS h
  FROM ex GROUP BY dataset
), asked AS (
  SELECT t.id, t.dataset, t.label, coalesce(h.h, '')
           || {_TURN.format(p=S.prompt_sql('t.text', 't.dataset', "'image'"))}
           || '<|assistant|>' || chr(10) AS prompt
  FROM items t LEFT JOIN hist h ON h.dataset = t.dataset
  WHERE t.type = 'test' AND t.label IS NOT NULL
), answered AS (
  SELECT *, {P.PROMPT_RULE_SQL.format(t='prompt', pos=S.pos_sql(), neg=S.neg_sql())} AS response FROM asked
)"""


def scoring_rows_df(it: DataFrame) -> DataFrame:
    """The scoring path end to end: few-shot history and the row's own turn as messages,
    rendered with the generation suffix, answered by a text model on Arrow batches; the prompt
    is dropped from what it generated, the answer parsed, the row written as a prediction."""
    scored = class_name(R.labelled(R.test_split(it))).select("id", "dataset", "label_name")
    prompts = fewshot_messages_df(it).select(
        "id", C.render_chat("messages", generation_prompt=True).alias("prompt"))
    asked = scored.join(prompts, "id")
    generated = P.text_predictor(P.prompt_rule)(asked, "prompt", "generated")
    answered = generated.withColumn(
        "response", P.strip_prompt_text(F.col("generated"), F.col("prompt")))
    parsed = V.parse_response(answered, "response", "dataset", "pred")
    return parsed.select(F.col("id").cast("string").alias("id"), "response",
                         F.col("label_name").alias("label"), "pred")


@query("scoring_rows", T.with_items(f""", {_EX_IDS_SQL}, {_SCORED_SQL}
SELECT id, response, {S.class_name_sql()} AS label, {S.parse_sql('response')} AS pred FROM answered"""))
def scoring_rows(spark, sf):
    return scoring_rows_df(T.items(spark, sf))


_MEME_ANSWER_SQL = P.PROMPT_RULE_SQL.format(t="prompt", pos=S.pos_sql(), neg=S.neg_sql())


@query("reannotate_fewshot", T.with_items(f""", {_EX_IDS_SQL}, {_BLOCK_SQL}, asked AS (
  SELECT t.id, t.dataset, t.label, coalesce(b.demo, '') || {S.prompt_sql('t.text', 't.dataset', "'image'")} AS prompt
  FROM items t LEFT JOIN block b ON b.dataset = t.dataset WHERE t.domain = 'meme'
), answered AS (SELECT *, {_MEME_ANSWER_SQL} AS response FROM asked),
votes AS (
  SELECT id, 'original' AS source, label AS vote FROM asked
  UNION ALL SELECT id, 'model', {S.parse_sql('response')} FROM answered
  UNION ALL SELECT CAST(l.doc_id AS VARCHAR), 'human', 1 - l.quality FROM labels l
    WHERE CAST(l.doc_id AS VARCHAR) IN (SELECT id FROM asked)
), g AS (
  SELECT id, count(vote) AS n, coalesce(sum(vote), 0) AS p,
         max(vote) FILTER (WHERE source = 'original') AS original,
         max(vote) FILTER (WHERE source = 'model') AS model,
         max(vote) FILTER (WHERE source = 'human') AS human
  FROM votes GROUP BY id
), final AS (
  SELECT *, CASE WHEN n = 0 THEN NULL WHEN 2 * p > n THEN 1 WHEN 2 * p < n THEN 0 END AS final_label FROM g
)
SELECT id, original, model, human, CAST(n AS BIGINT) AS n_votes, CAST(p AS BIGINT) AS n_positive, final_label,
       CASE WHEN final_label IS NULL THEN 1 ELSE 0 END AS needs_review FROM final"""))
def reannotate_fewshot(spark, sf):
    """Memes re-annotated with the exemplar block in front of every prompt; the predictor reads
    the prompt."""
    it = T.items(spark, sf)

    def answer(asked):
        out = P.text_predictor(P.prompt_rule)(asked, "prompt", "generated")
        return out.withColumn("response", P.strip_prompt_text(F.col("generated"), F.col("prompt")))

    return V.reannotate(it.filter(F.col("domain") == "meme"), answer, human_votes(spark, sf),
                        block=exemplar_block_df(it))


# ---------------------------------------------------------------- pixels

from labelflow.constants import VARIANCE_THRESHOLD  # noqa: E402
from labelflow.functions import pixels as PX  # noqa: E402
from labelflow.functions import resample as RS  # noqa: E402
from labelflow.functions.png import encoded  # noqa: E402
from labelflow.session import ensure_checkpoint_dir  # noqa: E402
from labelflow.sources import frame_store as FS  # noqa: E402

IMAGE_SIDE = 8  # a vector of 64 components is a picture of 8 x 8 pixels


def vector_images(spark, sf) -> DataFrame:
    """Every embedding as an 8 x 8 picture in the image source's struct: the byte of component x is
    128 + floor(128 x), clipped; pixel i has the components i, i + 1 and i + 2 (modulo 64) as its
    blue, green and red."""
    e = T.table(spark, sf, "embeddings").select("vec_id", "embedding")
    raw = F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(
        F.lit(128) + F.floor(x.cast("double") * 128), F.lit(0)), F.lit(255)).cast("bigint")), 2, "0"))
    n = IMAGE_SIDE * IMAGE_SIDE
    data = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.concat(
        *[F.get(F.col("raw"), (i + c) % n) for c in range(3)]))
    return e.select("vec_id", raw.alias("raw")).select("vec_id", F.struct(
        F.lit("").alias("origin"), F.lit(IMAGE_SIDE).alias("height"),
        F.lit(IMAGE_SIDE).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"),
        F.unhex(F.array_join(data, "")).alias("data")).alias("image"))


_BYTES_SQL = """px AS (
  SELECT vec_id, list_transform(embedding, lambda x: greatest(0, least(255, 128 + CAST(floor(CAST(x AS DOUBLE) * 128) AS BIGINT)))) AS c
  FROM embeddings
)"""


@query("image_gate", f"""
WITH {_BYTES_SQL}, g AS (
  SELECT vec_id, list_transform(range(64), lambda i: round_even(
    (0.299::DOUBLE * c[(i + 2) % 64 + 1] + 0.587::DOUBLE * c[(i + 1) % 64 + 1]) + 0.114::DOUBLE * c[i + 1], 0)) AS gray
  FROM px
), v AS (SELECT vec_id, list_var_pop(gray) AS variance FROM g)
SELECT vec_id, round(variance, 6) AS variance, variance > {float(VARIANCE_THRESHOLD)} AS informative FROM v""")
def image_gate(spark, sf):
    """Grayscale variance and the content gate on pictures."""
    im = vector_images(spark, sf).select("vec_id", PX.pixel_variance("image").alias("variance"))
    return im.select("vec_id", F.round("variance", 6).alias("variance"),
                     (F.col("variance") > VARIANCE_THRESHOLD).alias("informative"))


@query("prepare_images", f"""
WITH {_BYTES_SQL}
SELECT vec_id, array_to_string(list_transform(range(48), lambda k: format('{{:02X}}', CAST(round_even((
    c[((k // 12) * 16 + (k // 3 % 4) * 2 + 2 - k % 3) % 64 + 1]
  + c[((k // 12) * 16 + (k // 3 % 4) * 2 + 1 + 2 - k % 3) % 64 + 1]
  + c[((k // 12) * 16 + 8 + (k // 3 % 4) * 2 + 2 - k % 3) % 64 + 1]
  + c[((k // 12) * 16 + 8 + (k // 3 % 4) * 2 + 1 + 2 - k % 3) % 64 + 1]) / 4.0, 0) AS BIGINT))), '') AS pixels
FROM px""")
def prepare_images(spark, sf):
    """Pictures resized to half their side: every pixel is the mean of a 2 x 2 block."""
    im = PX.prepare_images(vector_images(spark, sf), side=IMAGE_SIDE // 2)
    return im.select("vec_id", F.hex("pixels").alias("pixels"))


def _shrink_sql(size: int, out: int) -> str:
    """Both passes written out: the table's weights, rounded to a byte behind each pass."""
    k = RS.coefficients(size, out).tolist()

    def rounded(terms: str) -> str:
        return f"greatest(0, least(255, ({1 << RS.BITS - 1} + {terms}) >> {RS.BITS}))"
    rows = rounded(f"list_sum(list_transform(range({size}), lambda j: k[t // 3 % {out} + 1][j + 1] "
                   f"* c[((t // {3 * out}) * {size} + j + 2 - t % 3) % {size * size} + 1]))::BIGINT")
    cols = rounded(f"list_sum(list_transform(range({size}), lambda i: k[t // {3 * out} + 1][i + 1] "
                   f"* h[i * {3 * out} + t % {3 * out} + 1]))::BIGINT")
    return f"""
WITH {_BYTES_SQL}, w AS (SELECT vec_id, c, {k} AS k FROM px),
r AS (SELECT vec_id, k, list_transform(range({size * out * 3}), lambda t: {rows}) AS h FROM w)
SELECT vec_id, array_to_string(list_transform(range({out * out * 3}),
         lambda t: format('{{:02X}}', {cols})), '') AS pixels FROM r"""


@query("shrink_images", _shrink_sql(IMAGE_SIDE, 3))
def shrink_images(spark, sf):
    """Pictures of 8 x 8 shrunk to 3 x 3, smoothed."""
    im = RS.shrink_images(vector_images(spark, sf), side=3)
    return im.select("vec_id", F.hex("pixels").alias("pixels"))


@query("image_moments", f"""
WITH {_BYTES_SQL}, g AS (
  SELECT vec_id, unnest(list_transform(range(64), lambda i:
    ({RS.GRAY[0]} * c[(i + 2) % 64 + 1] + {RS.GRAY[1]} * c[(i + 1) % 64 + 1] + {RS.GRAY[2]} * c[i + 1] + {1 << RS.GRAY_BITS - 1}) >> {RS.GRAY_BITS})) AS v
  FROM px
)
SELECT vec_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS s1, CAST(sum(v * v) AS BIGINT) AS s2,
       count(*) * sum(v * v) - sum(v) * sum(v) > {int(VARIANCE_THRESHOLD)} * count(*) * count(*) AS informative
FROM g GROUP BY vec_id""")
def image_moments(spark, sf):
    """Exact grayscale moments, added up over bands of two rows, and the content gate on them."""
    m = RS.image_moments(vector_images(spark, sf), "vec_id", band_bytes=2 * 3 * IMAGE_SIDE)
    return m.select("vec_id", "n", "s1", "s2", RS.above_threshold(
        F.col("n"), F.col("s1"), F.col("s2")).alias("informative"))


@query("frame_store", f"""
WITH {_BYTES_SQL}, f AS (
  SELECT vec_id, c, vec_id % 7 AS item, vec_id // 7 AS idx, count(*) OVER (PARTITION BY vec_id % 7) AS n FROM px
), s AS (SELECT *, (16 * idx + n - 1) // n AS pos FROM f)
SELECT CAST(item AS VARCHAR) AS item_id, CAST(idx AS INTEGER) AS frame_idx, CAST(pos AS INTEGER) AS sample_pos,
       array_to_string(list_transform(range(192), lambda k: format('{{:02X}}', c[(k // 3 + k % 3) % 64 + 1])), '') AS pixels
FROM s WHERE pos < 16 AND (pos * n) // 16 = idx""")
def frame_store(spark, sf):
    """Every embedding as a frame of one of seven videos, written as a store; the uniform sample is
    read back, and it alone is decoded."""
    im = vector_images(spark, sf)
    frames = im.select((F.col("vec_id") % 7).cast("string").alias("item_id"),
                       F.expr("vec_id div 7").cast("int").alias("frame_idx"),
                       encoded("image").alias("content"))
    path = f"{ensure_checkpoint_dir(spark)}/frames-{uuid.uuid4().hex}"
    FS.write_store(frames, path)
    got = FS.fetch_sample(spark, path)
    return got.select("item_id", "frame_idx", "sample_pos", F.hex("image.data").alias("pixels"))


@query("store_informative", f"""
WITH {_BYTES_SQL}, g AS (
  SELECT vec_id, list_transform(range(64), lambda i: round_even(
    (0.299::DOUBLE * c[(i + 2) % 64 + 1] + 0.587::DOUBLE * c[(i + 1) % 64 + 1]) + 0.114::DOUBLE * c[i + 1], 0)) AS gray
  FROM px
), v AS (SELECT vec_id % 7 AS item, vec_id // 7 AS idx, list_var_pop(gray) AS var FROM g),
e AS (SELECT item, max(idx) AS last, min(CASE WHEN var > 350 THEN idx END) AS hit FROM v GROUP BY item)
SELECT CAST(item AS VARCHAR) AS item_id, CAST(coalesce(hit, last) AS INTEGER) AS frame_idx, 'ok' AS status FROM e""")
def store_informative(spark, sf):
    """The first informative frame of each of those videos, by an ordered scan of the store that
    decodes no further (threshold 350: some videos have it late)."""
    im = vector_images(spark, sf)
    frames = im.select((F.col("vec_id") % 7).cast("string").alias("item_id"),
                       F.expr("vec_id div 7").cast("int").alias("frame_idx"),
                       encoded("image").alias("content"))
    path = f"{ensure_checkpoint_dir(spark)}/frames-{uuid.uuid4().hex}"
    FS.write_store(frames, path)
    return FS.first_informative_in_store(spark, path, threshold=350.0)


# ---------------------------------------------------------------- media modes

_KIND = "(CASE WHEN right(media, 3) = 'mp4' THEN 'video' ELSE 'image' END)"


@query("media_modes", T.with_items(f"""
, m AS (
  SELECT id, text, dataset, label,
         coalesce(CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'media/' || id || '.mp4' END, image) AS media
  FROM items WHERE type IS DISTINCT FROM 'test' AND label IS NOT NULL
)
SELECT id, media, {_KIND} AS kind,
       md5('<|user|>' || chr(10) || '<|' || {_KIND} || '|>' || {S.prompt_sql('text', 'dataset', _KIND)}
           || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || {S.class_name_sql()}
           || '<|end|>' || chr(10)) AS rendered_md5
FROM m"""))
def media_modes(spark, sf):
    """Training rows whose media type is the row's own: an mp4 is a video turn, else an image
    turn; a row without a video falls back to its image."""
    it = class_name(R.labelled(R.train_split(T.items(spark, sf))), out="answer")
    mp4 = F.when(F.col("id").cast("bigint") % 3 == 0,
                 F.concat(F.lit("media/"), "id", F.lit(".mp4")))
    rows = it.withColumn("video", mp4).withColumn("media", R.media_col("video"))
    rows = R.media_kind(rows, "media", "kind")

    def turns(mode):
        return C.messages_col(F.col("media"), prompt_col("text", "dataset", mode),
                              F.col("answer"), mode)
    rendered = F.when(F.col("kind") == "video", C.render_chat(turns("video"))) \
        .otherwise(C.render_chat(turns("image")))
    return rows.select("id", "media", "kind", F.md5(rendered).alias("rendered_md5"))


@query("agreement", T.with_items(f", {_VOTES_SQL.format(where='TRUE')}" + """
SELECT avg(CASE WHEN original IS NOT NULL AND model IS NOT NULL THEN CAST(original = model AS DOUBLE) END) AS original_model,
       avg(CASE WHEN original IS NOT NULL AND human IS NOT NULL THEN CAST(original = human AS DOUBLE) END) AS original_human,
       avg(CASE WHEN model IS NOT NULL AND human IS NOT NULL THEN CAST(model = human AS DOUBLE) END) AS model_human,
       avg(CASE WHEN original IS NOT NULL AND final_label IS NOT NULL THEN CAST(original = final_label AS DOUBLE) END) AS original_final_label
FROM final"""))
def agreement(spark, sf):
    """Agreement rates between the vote sources and the final label."""
    return V.agreement_rates(reannotated(spark, sf))


# ---------------------------------------------------------------- CSV files

from labelflow.sources import sinks  # noqa: E402
from labelflow.sources.items import read_items  # noqa: E402


@query("item_files", T.with_items("""
SELECT id, text, label, type, dataset,
       CASE WHEN domain = 'meme' THEN image END AS image,
       CASE WHEN domain = 'video' THEN frames END AS frames,
       CASE WHEN domain = 'video' THEN 'media/' || id || '.mp4' END AS video
FROM items"""))
def item_files(spark, sf):
    """All items written as CSV files of two layouts (other columns, other order, labels as
    ``1.0``) into folders named by dataset in the shared checkpoint folder, and read back by
    their headers, the dataset from the path."""
    it = T.items(spark, sf).withColumn("video", F.concat(F.lit("media/"), "id", F.lit(".mp4"))) \
        .withColumn("label", F.col("label").cast("double").cast("string"))
    root = f"{ensure_checkpoint_dir(spark)}/items-{uuid.uuid4().hex}"
    sinks.write_csv(it.filter(F.col("domain") == "meme")
                    .select("id", "text", "label", "type", "image"), f"{root}/hatemm")
    sinks.write_csv(it.filter(F.col("domain") == "video")
                    .select("id", "label", "text", "type", "frames", "video"), f"{root}/mhc")
    return read_items(spark, [f"{root}/hatemm", f"{root}/mhc"])


@query("prediction_files", T.with_items(f"""
SELECT id, {_RESP_SQL} AS response, {S.class_name_sql()} AS label
FROM items WHERE type = 'test' AND label IS NOT NULL"""))
def prediction_files(spark, sf):
    """The predictions written as CSV and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/predictions-{uuid.uuid4().hex}"
    sinks.write_predictions(predictions(spark, sf), path)
    return sinks.read_predictions(spark, path)


@query("item_file_order", T.with_items("""
, r AS (
  SELECT dataset, id, text, label, row_number() OVER (PARTITION BY dataset, label ORDER BY CAST(id AS BIGINT) DESC) AS place
  FROM items WHERE label IS NOT NULL
)
SELECT dataset, label, id, text, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8"""))
def item_file_order(spark, sf):
    """The first eight rows per dataset and label in file order: the items are written as CSV files
    whose rows go from the largest id down (texts with newlines in quotes), and read back in
    byte ranges with their places."""
    from pyspark.sql import Window
    it = T.items(spark, sf).withColumn("label", F.col("label").cast("double").cast("string"))
    root = f"{ensure_checkpoint_dir(spark)}/ordered-{uuid.uuid4().hex}"
    for dataset in ("hatemm", "mhc"):
        sinks.write_csv(it.filter(F.col("dataset") == dataset)
                        .orderBy(F.col("id").cast("bigint").desc())
                        .select("id", "text", "label", "type", "image"), f"{root}/{dataset}")
    rows = R.labelled(read_items(spark, [f"{root}/hatemm", f"{root}/mhc"], positions=True))
    w = Window.partitionBy("dataset", "label").orderBy("file_pos")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= 8) \
        .select("dataset", "label", "id", "text", "place")


# ---------------------------------------------------------------- models in folders (M1 M2)

from labelflow.operators import model_store as MS  # noqa: E402


def _whole_linear(arrays: dict):
    """A predictor over integer vectors from a stored model's ``weights``."""
    import numpy as np
    w = np.asarray(arrays["weights"], np.float64)
    return lambda x: np.asarray(x, np.float64) @ w


@query("tuned_or_base", """
WITH q AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
), e AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM q),
w AS (SELECT list(s ORDER BY i) AS w FROM (SELECT i, CAST(sum(CASE WHEN label >= 5 THEN x ELSE -x END) AS BIGINT) AS s FROM e GROUP BY i))
SELECT vec_id, CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * w.w[i])) AS DOUBLE) AS tuned,
       CAST(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN i % 2 = 1 THEN v[i] ELSE -v[i] END)) AS DOUBLE) AS base
FROM q, w""")
def tuned_or_base(spark, sf):
    """A linear model fitted on the embeddings (sums by class), saved to the shared folder, shipped
    to the workers and scored with; and the base model where the folder holds none."""
    e = T.table(spark, sf, "embeddings").select("vec_id", "label", F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * 1024)).alias("v"))
    sign = F.when(F.col("label") >= 5, 1).otherwise(-1)
    sums = e.select(sign.alias("s"), F.posexplode("v")).groupBy("pos") \
        .agg(F.sum(F.col("s") * F.col("col")).alias("w")).orderBy("pos").collect()  # one a dimension
    root = f"{ensure_checkpoint_dir(spark)}/models-{uuid.uuid4().hex}"
    MS.save_model(spark, f"{root}/tuned", {"weights": [r["w"] for r in sums]})
    base = P.linear_rule(P.alternating_weights(len(sums)))
    x = e.select("vec_id", F.transform("v", lambda x: x.cast("double")).alias("x"))
    for name in ("tuned", "base"):
        fn = MS.tuned_or_base(spark, f"{root}/tuned" if name == "tuned" else f"{root}/absent",
                              _whole_linear, base)
        x = P.predict(x, fn, "x", out=name, input_tensor_shapes=[[len(sums)]])
    return x.select("vec_id", "tuned", "base")


# ---------------------------------------------------------------- scoring that resumes (K1)

from labelflow.sources.resume import score_resumable  # noqa: E402


@query("resumed_predictions", T.with_items(f"""
SELECT id, {_RESP_SQL} AS response, {S.class_name_sql()} AS label
FROM items WHERE type = 'test' AND label IS NOT NULL"""))
def resumed_predictions(spark, sf):
    """The predictions scored in four parts, stopped after two, then gone on with."""
    rows = class_name(R.labelled(R.test_split(T.items(spark, sf))))
    path = f"{ensure_checkpoint_dir(spark)}/resumed-{uuid.uuid4().hex}"

    def score(part):
        return prediction_rows(rule_predictor(part))
    score_resumable(rows, score, path, parts=4, at_most=2)
    return score_resumable(rows, score, path, parts=4)


# ---------------------------------------------------------------- training in steps (M3 A5)

from labelflow.operators import steps as ST  # noqa: E402
from labelflow.operators.bayes import word_features  # noqa: E402


@query("step_training")
def step_training(spark, sf):
    """A text classifier trained for five epochs of 32-row steps on the labelled training rows;
    its answers on the labelled test rows."""
    it = R.labelled(T.items(spark, sf))
    params = ST.StepParams()
    feats = word_features("text", params.features).alias("features")
    weights, bias = ST.train_in_steps(R.train_split(it).select("id", "label", feats), "id", params)
    scored = ST.margins(R.test_split(it).select("id", "label", feats), weights, bias)
    return scored.select("id", "label", F.round("margin", 9).alias("margin"),
                         (F.col("margin") > 0).cast("int").alias("pred"))


# ---------------------------------------------------------------- short videos

from labelflow.operators import media as MD  # noqa: E402


@query("short_videos", f"""
WITH {_BYTES_SQL}, f AS (
  SELECT vec_id, c, vec_id % 7 AS item, vec_id // 7 AS idx, count(*) OVER (PARTITION BY vec_id % 7) AS n FROM px
), s AS (SELECT *, (16 * idx + n - 1) // n AS pos FROM f)
SELECT 'v' || CAST(item AS VARCHAR) AS id, 'frame' AS source, CAST(pos AS INTEGER) AS pos, 192 AS n_bytes,
       md5(array_to_string(list_transform(range(192), lambda k: format('{{:02X}}', c[(k // 3 + 2 - k % 3) % 64 + 1])), '')) AS pixels
FROM s WHERE pos < 16 AND (pos * n) // 16 = idx
UNION ALL
SELECT 'p' || CAST(vec_id AS VARCHAR), 'copy', CAST(k AS INTEGER), 192, NULL FROM px, range(16) r(k)""")
def short_videos(spark, sf):
    """Seven videos (their sampled frames) and every embedding's picture (16 augmented copies) as
    one relation; the frames' pixels are compared, the copies' in the tests."""
    im = vector_images(spark, sf)
    video, idx = (F.col("vec_id") % 7).cast("string"), F.expr("vec_id div 7").cast("int")
    path = f"{ensure_checkpoint_dir(spark)}/frames-{uuid.uuid4().hex}"
    FS.write_store(im.select(video.alias("item_id"), idx.alias("frame_idx"),
                             encoded("image").alias("content")), path)
    pid = F.concat(F.lit("p"), F.col("vec_id").cast("string"))
    stills = im.select(pid.alias("id"), F.concat(pid, F.lit(".png")).alias("media"),
                       F.lit(None).cast("string").alias("frames"))
    videos = spark.range(7).select(F.concat(F.lit("v"), "id").alias("id"),
                                   F.concat(F.lit("v"), "id", F.lit(".mp4")).alias("media"),
                                   F.col("id").cast("string").alias("frames"))
    got = MD.short_videos(stills.unionByName(videos), FS.fetch_sample(spark, path),
                          im.select(pid.alias("id"), "image"))
    return got.select("id", "source", "pos", F.octet_length("data").alias("n_bytes"),
                      F.when(F.col("source") == "frame", F.md5(F.hex("data"))).alias("pixels"))


# ---------------------------------------------------------------- description files, size, strict mode

from labelflow.sources.descriptions import read_descriptions  # noqa: E402


@query("description_files", T.with_items(f"""
SELECT dataset, id, {S.class_name_sql()} AS label, 'frames of "item" ' || id AS description, text FROM items"""))
def description_files(spark, sf):
    """Descriptions with quotes and newlines written as CSV files, a folder a dataset, and read
    back by the profile in their path; of repeated ids the last row counts: both rows of an id
    stand in one file, the older first."""
    pool = T.items(spark, sf).select(
        "dataset", "id", class_name_col("dataset", "label").alias("label"),
        F.concat(F.lit('frames of "item" '), F.col("id")).alias("description"), "text")
    root = f"{ensure_checkpoint_dir(spark)}/descriptions-{uuid.uuid4().hex}"
    for dataset in ("hatemm", "mhc"):
        both = pool.filter(F.col("dataset") == dataset).drop("dataset") \
            .withColumn("version", F.explode(F.array(F.lit(0), F.lit(1)))) \
            .withColumn("description", F.when(F.col("version") == 1, F.col("description"))
                        .otherwise("an older, longer one,\nwith a newline"))
        sinks.write_csv(both.repartitionByRange("id").sortWithinPartitions("id", "version")
                        .drop("version"), f"{root}/{dataset}")
    got = read_descriptions(spark, [f"{root}/hatemm", f"{root}/mhc"])
    # an unlabelled item's label is an absent field, which Python's reader gives as an empty text
    return got.withColumn("label", F.when(F.col("label") != "", F.col("label")))


@query("training_size", T.with_items("""
SELECT CAST(count(*) AS BIGINT) AS n_rows FROM items WHERE type IS DISTINCT FROM 'test' AND label IS NOT NULL"""))
def training_size(spark, sf):
    """K2: the training set's size, observed while its rows are written."""
    rows, seen = sinks.observe_size(R.labelled(R.train_split(T.items(spark, sf))))
    path = f"{ensure_checkpoint_dir(spark)}/training-{uuid.uuid4().hex}"
    rows.select("id", "label").write.parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")) \
        .where(F.col("n_rows") == seen.get["rows"])


@query("strict_media", T.with_items("""
SELECT id, image FROM items WHERE frames IS NULL"""))
def strict_media(spark, sf):
    """P10: strict mode over items that need no frame: no row is bad, so none raises and all stay."""
    r = R.resolve_media(T.items(spark, sf).filter(F.col("frames").isNull()))
    good, _ = R.quarantine(r, F.when(F.col("status") != "ok", F.col("status")), strict=True)
    return good.select("id", "image")
