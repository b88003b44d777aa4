"""The registered queries: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm import (fingerprints, lexical_search, mixing, quality, robust_rules,
                           sentencepiece_codec, sharding, simhash, suffix_dedup,
                           token_counts, topk, vector_codes, wrappers)
from labelflow.llm.common import prepare, table, text_or_empty

#: Folder of public tokenizer files; the same path on every worker.
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str) -> str:
    """Where a tokenizer file lies: the installed package's own answer, else the folder."""
    try:
        import public_tokenizers
        return public_tokenizers.path(name)
    except ImportError:
        return f"{TOKENIZERS}/{name}"


def n_bytes(col: str = "text"):
    return F.octet_length(text_or_empty(col)).cast("bigint")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document into one of eight shards, in a shuffled order (``rows`` law)."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    dealt = sharding.shard(docs.withColumn("size", n_bytes() + 1), 8, size_col="size")
    return dealt.select(
        "doc_id", "size", F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text, counted by the compiled transducers."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", n_bytes().alias("n_bytes"), "text")
    counted = token_counts.add_token_counts(docs, tokenizer_path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > 512).alias("over_limit"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50-byte strings that documents share, removed from all but the smallest doc_id."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.remove_repeats(docs, length=50).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and groups at two or fewer differing bits."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = simhash.near_duplicate_groups(docs, shingle=3, radius=2, seed=42)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      "component_id")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    prepare(spark)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return wrappers.extract(pages).select(
        "page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text under the SentencePiece model, and whether decoding them gives
    the text back (a word mark in a text stands for a space)."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.translate(text_or_empty(), sentencepiece_codec.MARK, " ").alias("as_read"),
        "text")
    got = sentencepiece_codec.add_ids(docs, tokenizer_path("piece_bpe_32k.model"),
                                      decoded="decoded")
    return got.select("doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
                      (F.col("decoded") == F.col("as_read")).alias("decoded_equal"), "token_ids")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole text, learnt from rows that are not held out."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")) \
        .where(~quality.held_out())
    weights = quality.fit(docs, labels)
    return quality.score(docs, weights).select(
        "doc_id", quality.held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows of largest quantised inner product for every 20th vector."""
    prepare(spark)
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))) \
        .select("vec_id", topk.quantised(F.col("embedding")).alias("vector"))
    return topk.top_k(vectors.where("vec_id % 20 = 0"), vectors, 20)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 3, 1, 2, repeating, and share 150 % of all words."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    per_doc, *_ = mixing.mix(docs, [3, 1, 2], share=1.5)
    return per_doc.select("doc_id", "size", "source_size", "target", "taken")


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of every document and its edited text, and what peeling says they share."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.compare_versions(docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for every benchmark item, from all documents."""
    prepare(spark)
    return lexical_search.rank(table(spark, sf_dir, "benchmark").select("item_id", "text"),
                               table(spark, sf_dir, "documents").select("doc_id", "text"), 50)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector as eight codebook indexes, with the squared error of its code."""
    prepare(spark)
    vectors = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding"))) \
        .select("vec_id", "label", topk.quantised(F.col("embedding"), 4096.0).alias("vector"))
    coded, books = vector_codes.compress(vectors, parts=8, entries=16, rounds=6)
    return coded.select("vec_id", vector_codes.hex_code().alias("code"), "error", "label_error",
                        F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every document, and whether it is ordinary for its language and source."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return robust_rules.judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


QUERIES = {f.__name__: f for f in (
    op1_sharding, op2_token_counts, op3_suffix_dedup, op4_simhash, op5_html_text,
    op6_sentencepiece, op7_quality, op8_topk, op9_mixing, op10_fingerprints, op11_lexical_search,
    op12_vector_codes, op13_quality_rules)}


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Assignment and averaging written out round by round; every entry is measured."""
    nearest = """
        a{r} AS MATERIALIZED (SELECT vec_id, label, p, min((d, e)) AS best
              FROM (SELECT x.vec_id, x.label, x.p, c.e, CAST(sum((x.v - c.v) * (x.v - c.v)) AS BIGINT) AS d
                    FROM x JOIN c{r} c ON c.p = x.p AND c.j = x.j GROUP BY ALL) GROUP BY ALL)"""
    mean = """
        c{s} AS MATERIALIZED (SELECT c.p, c.e, c.j, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN
              (SELECT p, e, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v
               FROM (SELECT x.p, a.best[2] AS e, x.j, sum(x.v) AS s, count(*) AS n
                     FROM x JOIN a{r} a ON a.vec_id = x.vec_id AND a.p = x.p GROUP BY ALL)) m
              ON m.p = c.p AND m.e = c.e AND m.j = c.j)"""
    steps = ",".join(nearest.format(r=r) + "," + mean.format(r=r, s=r + 1) for r in range(rounds))
    return f"""
        WITH k AS MATERIALIZED (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
                AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0),
        x AS MATERIALIZED (SELECT vec_id, label, (i - 1) // (len(embedding) // {parts}) AS p,
                (i - 1) % (len(embedding) // {parts}) AS j,
                CAST(floor(4096 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
              FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM k)),
        f AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS e FROM k
              ORDER BY vec_id LIMIT {entries}),
        c0 AS MATERIALIZED (SELECT x.p, f.e, x.j, x.v FROM x JOIN f ON f.vec_id = x.vec_id),
        {steps},{nearest.format(r=rounds)},
        g AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code,
                     CAST(sum(best[1]) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL),
        h AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS digest FROM c{rounds})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               digest AS codebooks_sha256 FROM g, h"""


#: DuckDB twins where SQL can express the result; the others are tested against brute force.
ORACLE: dict[str, str] = {
    "op3_suffix_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, k, substr(h, CAST(1000 * k + 1 AS BIGINT), 1098) AS piece
              FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1000 + 1)) AS k FROM d)),
        w AS (SELECT doc_id, 500 * k + i AS s, substr(piece, CAST(2 * i + 1 AS BIGINT), 100) AS g
              FROM (SELECT doc_id, k, piece, unnest(range(0, least(500, length(piece) // 2 - 49))) AS i FROM c)),
        f AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
        dup AS (SELECT w.doc_id, w.s FROM w JOIN f ON f.g = w.g WHERE f.low < w.doc_id),
        edge AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS fresh FROM dup),
        isle AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM edge),
        run AS (SELECT doc_id, min(s) AS a, max(s) + 50 AS b FROM isle GROUP BY doc_id, k),
        gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM run),
        cut AS (SELECT g.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last,
                       string_agg(substr(d.h, CAST(2 * p + 1 AS BIGINT), CAST(2 * (a - p) AS BIGINT)), '' ORDER BY a) AS kept
                FROM gap g JOIN d ON d.doc_id = g.doc_id GROUP BY g.doc_id)
        SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes,
               CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
        FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id""",
    "op8_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                   FROM embeddings
                   WHERE embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
             s AS (SELECT a.vec_id AS query_id, b.vec_id,
                          CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
                   FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
                   FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op11_lexical_search": """
        WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
        l AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
        c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM l),
        tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
        i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
              FROM tf, c GROUP BY term),
        s AS (SELECT i.item_id, tf.doc_id,
                     CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * (100 - 50 + (50 * l.n * c.n_docs) // c.n_terms)))) AS BIGINT) AS score
              FROM i JOIN tf ON tf.term = i.term JOIN w ON w.term = i.term JOIN l ON l.doc_id = tf.doc_id, c
              GROUP BY i.item_id, tf.doc_id),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
              FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op12_vector_codes": _codes_sql(parts=8, entries=16, rounds=6),
}
