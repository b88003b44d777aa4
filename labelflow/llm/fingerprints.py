"""Document fingerprints as invertible Bloom lookup sketches, with DataFrame functions only.

A text's paragraphs are its lines, a long line in pieces of ``PIECE_WORDS`` words; each paragraph's
64-bit digest goes into one cell of each of three tables. A cell holds the number of its digests,
their exclusive or, and the exclusive or of their checksums. Subtracting the sketches of two
versions cancels the digests they share. A cell left with one digest gives it away; taking it out
of its other two cells (peeling) bares further ones, until all differing digests are recovered.
When cells are left over, the pair is sketched again four times larger. The likeness of two
versions is the share of their digests that do not differ, 2|A∩B| / (|A|+|B|).

Peeling is a chain of group-bys over (pair, cell): each round looks at one of the three tables, in
which a digest has one cell only, and replaces a bare cell by its digest's removals from the other
two. All rows of a pair lie in one partition, so a round moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.llm.common import text_or_empty, written

PIECE_WORDS = 24
TABLES = 3
#: Cells of a table of the published fingerprint; a retry has ``GROWTH`` times as many.
WIDTH, GROWTH = 8, 4
CYCLES = 3
_PARAGRAPH = rf"(?:\S++[^\S\n]*+){{1,{PIECE_WORDS}}}+"


def paragraph_digests(text: Column) -> Column:
    """Distinct digests of a text's paragraphs."""
    found = F.regexp_extract_all(text, F.lit(_PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(F.rtrim(p))))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest).bitwiseAND(F.lit(0xFFFFFFFF))


def _cell(digest: Column, tab: int, width: int) -> Column:
    """Number of a digest's cell in table ``tab`` (tables follow each other)."""
    return F.pmod(F.xxhash64(digest, F.lit(tab + 1)), F.lit(width)) + F.lit(tab * width)


def sketch(digests: Column, width: int = WIDTH) -> Column:
    """The sketch as text: of each cell the count (4 hex digits, modulo 65536), the digests (16)
    and the checksums (8)."""
    def cell(c: Column) -> Column:
        own = F.filter(digests, lambda d: (F.pmod(
            F.xxhash64(d, F.floor(c / width).cast("int") + 1), F.lit(width)) == c % width))
        xor = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, d: a.bitwiseXOR(d))
        check = F.aggregate(own, F.lit(0).cast("bigint"), lambda a, d: a.bitwiseXOR(_check(d)))
        return F.concat(F.lpad(F.hex((F.size(own) % 65536).cast("bigint")), 4, "0"),
                        F.lpad(F.hex(xor), 16, "0"), F.lpad(F.hex(check), 8, "0"))

    return F.lower(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(TABLES * width - 1)),
                                            cell), ""))


def _differences(pairs: DataFrame, width: int) -> DataFrame:
    """``(pair, kind, diff)`` of ``pairs (pair, kind, a, b)``: the differing digests recovered from
    the subtracted sketches, null where cells are left over. ``pairs`` is partitioned by
    ``pair``."""
    signed = F.concat(F.transform("a", lambda d: F.struct(d.alias("x"), F.lit(1).alias("s"))),
                      F.transform("b", lambda d: F.struct(d.alias("x"), F.lit(-1).alias("s"))))
    x = F.col("u.x")
    # a pair without any digest keeps one row: nothing recovered, nothing left
    put = pairs.select("pair", "kind", F.explode_outer(signed).alias("u")).select(
        "pair", "kind", F.coalesce("u.s", F.lit(0)).cast("bigint").alias("n"),
        F.coalesce(x, F.lit(0)).alias("x"), F.when(x.isNull(), 0).otherwise(_check(x)).alias("h"),
        F.explode(F.when(x.isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(
            F.array(*[_cell(x, t, width) for t in range(TABLES)]))).alias("cell"))

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("pair", "kind", "cell").agg(
            F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("h").alias("h"))

    cells = added(put)
    for step in range(CYCLES * TABLES):
        tab = step % TABLES
        bare = (F.col("cell") == _cell(F.col("x"), tab, width)) & (F.abs("n") == 1) \
            & (F.col("h") == _check(F.col("x")))
        entry = lambda cell, n: F.struct(cell.cast("bigint").alias("cell"),
                                         n.alias("n"), F.col("x"), F.col("h"))
        taken_out = F.array(*[entry(_cell(F.col("x"), t, width), -F.col("n"))
                              for t in range(TABLES) if t != tab],
                            entry(F.lit(-1), F.lit(1).cast("bigint")))  # -1: recovered digests
        spent = (F.col("cell") >= 0) & (F.col("n") == 0) & (F.col("x") == 0) & (F.col("h") == 0)
        kept = F.array(entry(F.col("cell"), F.col("n")))
        cells = added(cells.select("pair", "kind", F.explode(
            F.when(bare, taken_out).when(spent, F.array(
                entry(F.lit(-1), F.lit(0).cast("bigint")))).otherwise(kept)).alias("e"))
            .select("pair", "kind", "e.cell", "e.n", "e.x", "e.h"))
    left = (F.col("cell") >= 0) & ((F.col("n") != 0) | (F.col("x") != 0) | (F.col("h") != 0))
    return cells.groupBy("pair", "kind").agg(
        F.max(F.coalesce(left, F.lit(False))).alias("left"),
        F.sum(F.when(F.col("cell") == -1, F.col("n")).otherwise(0)).alias("diff")) \
        .select("pair", "kind", F.when(~F.col("left"), F.col("diff")).alias("diff"))


def _pairs(versions: DataFrame) -> DataFrame:
    """``(pair, kind, a, b)``: every row's ``own`` digests against each of its ``others``."""
    return versions.select("pair", F.col("own").alias("a"), F.posexplode("others")
                           .alias("kind", "b"))


def differences(versions: DataFrame) -> DataFrame:
    """``(pair, kind, diff)`` (digests that differ) for ``versions (pair, own, others)``: ``own`` digests against the
    k-th of ``others`` for every k. The sketches are subtracted and peeled, four times larger for
    the pairs that failed, until none does."""
    width, todo, solved = WIDTH, _pairs(versions.repartition("pair")), None
    for _ in range(20):
        got = written(_differences(todo, width), "peeled")
        done = got.where("diff IS NOT NULL")
        solved = done if solved is None else solved.unionByName(done)
        failed = got.where("diff IS NULL").select("pair", "kind")
        if failed.isEmpty():
            break
        # the digests are dealt by pair for the join, and stay so for the group-bys
        kinds = failed.groupBy("pair").agg(F.collect_set("kind").alias("kinds"))
        todo = _pairs(versions.join(kinds.hint("merge"), "pair").withColumn(
            "others", F.transform("others", lambda o, k: F.when(
                F.array_contains("kinds", k), o)))).where("b IS NOT NULL")
        width *= GROWTH
    else:
        raise RuntimeError("peeling failed at every size")
    return solved


def with_next(rows: DataFrame) -> DataFrame:
    """``(k, kh, th, n, next_kh, next_th)`` for every distinct (key, text) of ``rows (_k, _kh, _th,
    _text)``: key, hashes of key and text, the text's length, and the hashes of its successor by
    ascending key (nulls first; within a key by text hash), the first one after the last. Rows are
    ranged over partitions; a partition's last row needs only the next partition's first one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.groupBy(F.col("_k").alias("k"), F.col("_kh").alias("kh"), F.col("_th").alias("th")) \
        .agg(F.max(F.char_length("_text")).alias("n"))
    ranged = written(ids.repartitionByRange(parts, "k", "th")
                     .withColumn("pid", F.spark_partition_id()), "ranged")
    at = F.struct("k", "th", "kh")
    firsts = ranged.groupBy("pid").agg(F.min(at).alias("low"))  # one row per partition
    over = Window.orderBy("pid")
    after = firsts.select("pid", F.coalesce(
        F.lead("low").over(over),
        F.first("low").over(over.rowsBetween(Window.unboundedPreceding,
                                             Window.unboundedFollowing))).alias("after"))
    inside = F.lead(at).over(Window.partitionBy("pid").orderBy("k", "th"))
    return ranged.withColumn("inside", inside).join(F.broadcast(after), "pid") \
        .withColumn("nxt", F.coalesce("inside", "after")) \
        .select("k", "kh", "th", "n", F.col("nxt.kh").alias("next_kh"),
                F.col("nxt.th").alias("next_th"))


def compare_versions(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text"
                     ) -> DataFrame:
    """One row per input row: its columns but the text, ``n_chars`` (code points),
    ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited version replaces the last quarter of a text (rounded down) by as many first code
    points of the next document. Null texts are empty; two empty texts are alike (1). Rows equal
    in key and text are one document with several rows; one document alone is its own next. An
    empty table gives no rows."""
    names = [c for c in docs.columns if c not in (
        text_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        "near_edited", "near_next")]
    # own names only from here on: further columns travel in one struct
    extras = [c for c in names if c != key_col]
    packed = [F.struct(*[F.col(f"`{c}`") for c in extras]).alias("_row")] if extras else []
    key = F.col(f"`{key_col}`")
    rows = docs.select(key.alias("_k"), *packed, text_or_empty(text_col).alias("_text")) \
        .withColumn("_kh", F.xxhash64("_k", F.col("_k").isNull())) \
        .withColumn("_th", F.xxhash64("_text"))
    order = with_next(rows).select(
        F.col("k").alias("_of"), F.col("kh").alias("_of_kh"), F.col("th").alias("_of_th"),
        F.floor(F.col("n") / 4).cast("int").alias("_cut"),
        F.col("next_kh").alias("_next_kh"), F.col("next_th").alias("_next_th"))
    # the texts are dealt by the two hashes; without further columns (the key comes with the
    # order) both joins read the same three columns, and one exchange serves both
    heads = rows.select("_text", "_kh", "_th") \
        .join(order, (F.col("_next_kh") == F.col("_kh")) & (F.col("_next_th") == F.col("_th"))) \
        .select("_of", "_of_kh", "_of_th", "_cut",
                F.substring("_text", F.lit(1), F.col("_cut")).alias("_head"),
                paragraph_digests(F.col("_text")).alias("_next_digests")) \
        .groupBy("_of_kh", "_of_th").agg(*[F.first(c).alias(c) for c in (
            "_of", "_cut", "_head", "_next_digests")])
    both = rows.select("_text", "_kh", "_th", *(["_row"] if extras else [])).join(
        heads, (F.col("_kh") == F.col("_of_kh")) & (F.col("_th") == F.col("_of_th"))) \
        .withColumnRenamed("_of", "_k")
    n = F.char_length("_text")
    edited = F.concat(F.substring("_text", F.lit(1), n - F.col("_cut")), F.col("_head"))
    carried = ["_k", *(["_row"] if extras else [])]
    made = both.select(*carried, n.cast("bigint").alias("n_chars"), edited.alias("edited"),
                       paragraph_digests(F.col("_text")).alias("own"), "_next_digests") \
        .select(*carried, "n_chars",
                F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own",
                F.array(paragraph_digests(F.col("edited")), F.col("_next_digests"))
                .alias("others"), F.monotonically_increasing_id().alias("pair"))
    made = written(made, "versions")  # also fixes the row numbers
    diffs = differences(made.select("pair", "own", "others")).groupBy("pair").agg(
        F.max(F.when(F.col("kind") == 0, F.col("diff"))).alias("edited_diff"),
        F.max(F.when(F.col("kind") == 1, F.col("diff"))).alias("next_diff"))

    def near(k: int, diff: str) -> Column:
        both = F.size("own") + F.size(F.col("others")[k])
        return F.when(both == 0, F.lit(1.0)).otherwise((both - F.col(diff)) / both)

    return made.join(diffs, "pair").select(
        *[F.col("_k").alias(c) if c == key_col else F.col(f"_row.`{c}`").alias(c) for c in names],
        "n_chars", "edited_sha256", sketch(F.col("own")).alias("fingerprint"),
        sketch(F.col("others")[0]).alias("edited_fingerprint"),
        near(0, "edited_diff").alias("near_edited"), near(1, "next_diff").alias("near_next"))
