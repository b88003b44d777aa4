"""Mixing sources to target weights, with DataFrame functions only.

The words of a source's documents, one document behind the other in a seeded order, are packed
into blocks of a fixed length (the last may be shorter). Every output shard draws its source
counts from the multinomial distribution of the target weights; the draws of a source, numbered
through the shards, are its slots. A slot's number is mapped through the source's pseudorandom
permutation of block numbers, one permutation per pass over the source, and slots and blocks are
joined by that index.

The draws of all shards together hit a source's target only about; slots beyond the target are
left out and missing ones go to further shards, so every source gives its target to the word.
Everything follows from the seed and the rows' content: reruns and repeated tasks agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelflow.llm.common import free_name, persisted, text_or_empty

WORD_GAP = r"[\x20\x09-\x0D]+"
#: Rows of one source are ordered within this many hash buckets, never in one task.
BUCKETS = 4096
#: Sources are a configured list: their sizes and targets are kept on the driver.
MAX_SOURCES = 100_000


@dataclass(frozen=True)
class Source:
    """A source's words, its target and how its slots map to blocks."""
    name: str | None
    size: int
    target: float
    words: int         # the target in whole words
    full: int          # blocks of full length; a shorter one behind them has number ``full``
    slots: int
    steps: tuple       # (multiplier, start) of the block permutation of each pass


def words_of(col: Column) -> Column:
    """The words of a text as an array (white space at the ends gives no word)."""
    return F.filter(F.split(col, WORD_GAP), lambda w: w != "")


def word_count(col: Column) -> Column:
    """Their number, without building them twice: pieces of the split, less empty ends."""
    parts = F.split(col, WORD_GAP)
    return (F.size(parts) - (F.element_at(parts, 1) == "").cast("int")
            - ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")).cast("bigint")


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """Targets proportional to the weights that sum to ``share`` of all sizes, none above ``cap``
    times its size: what a capped source cannot take goes to the others by weight, again and
    again. That fills to one level: target = min(cap * size, level * weight)."""
    total = share * sum(sizes)
    rest_weight, rest, level = sum(weights), total, 0.0
    for i in sorted(range(len(sizes)), key=lambda i: (cap * sizes[i] / weights[i], i)):
        level = max(level, rest / rest_weight)
        rest -= cap * sizes[i]
        rest_weight -= weights[i]
    return [min(cap * s, level * w) for s, w in zip(sizes, weights)]


def _coprime(n: int, seed: int) -> int:
    """A multiplier below n without common divisor, small enough for 64-bit products."""
    top = max(1, min(n, (1 << 62) // max(1, n)))
    a = max(1, (0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1) % top)
    while gcd(a, n) != 1:
        a = a % top + 1
    return a


def plan_sources(named: list[tuple[str | None, int]], weights: list[float], share: float,
                 cap: float, block: int, seed: int) -> list[Source]:
    """Targets, slots and permutations. ``named`` is ordered by name, null last; the weights
    repeat along it."""
    sizes = [s for _, s in named]
    w = [weights[i % len(weights)] for i in range(len(named))]
    out = []
    for i, ((name, size), target) in enumerate(zip(named, targets(sizes, w, share, cap))):
        words = min(round(target), int(cap * size))
        per_pass = -(-size // block)
        passes, rest = divmod(words, size) if size else (0, 0)
        full = size // block
        steps = tuple((_coprime(full, seed + 31 * i + p), (seed + 7919 * i + 104729 * p) % full)
                      if full else (1, 0) for p in range(passes + 1))
        out.append(Source(name, size, target, words, full,
                          passes * per_pass + -(-rest // block), steps))
    return out


def _ranked(docs: DataFrame, source: str, size: Column, seed: int, names: dict) -> DataFrame:
    """``docs`` plus the row's number within its source's bucket and the word it starts at."""
    h, b, rn, st, sz = (names[k] for k in ("h", "b", "rn", "st", "size"))
    keyed = docs.withColumn(sz, size).withColumn(
        h, F.xxhash64(F.lit(seed), *[F.to_json(F.struct(F.col(f"`{f.name}`")))
                                     if "map" in f.dataType.simpleString()
                                     else F.col(f"`{f.name}`") for f in docs.schema.fields],
                      # which columns are null counts: else rows that differ in that alone tie
                      *[F.col(f"`{f.name}`").isNull() for f in docs.schema.fields])) \
        .withColumn(b, F.pmod(F.col(h), F.lit(BUCKETS)).cast("int"))
    src = F.col(f"`{source}`")
    w = Window.partitionBy(src, b).orderBy(h, sz)
    return keyed.withColumn(rn, F.row_number().over(w)).withColumn(
        st, F.coalesce(F.sum(sz).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def mix(docs: DataFrame, weights: list[float], share: float, cap: float = 2.0,
        source_col: str = "source", text_col: str = "text", block: int = 128,
        shard_slots: int = 16384, seed: int = 5
        ) -> tuple[DataFrame, DataFrame, DataFrame, list[Source]]:
    """Mix ``docs``. Gives four things:

    * one row per document: its columns but the text, ``size`` (words), ``source_size``,
      ``target`` and ``taken`` (words the mix takes of it, repeats counted);
    * the mixed pieces: ``shard``, ``slot`` (number among the source's slots), ``pass``, ``row``
      (the document), ``size`` (its words), ``first`` and ``n`` (the words taken, from 0);
    * the documents themselves: ``row`` and their columns, text included;
    * the sources.

    Null texts have no words and are never taken; a null source is a source of its own; repeated
    rows each count; an empty table gives empty results. Input columns named like a result are
    replaced."""
    results = {"size", "source_size", "target", "taken", "shard", "slot", "pass", "first", "n"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in results])
    names = {k: free_name(docs, f"_{k}") for k in ("h", "b", "rn", "st", "size", "src", "doc")}
    src, b, rn, st, sz = (names[k] for k in ("src", "b", "rn", "st", "size"))
    ranked = _ranked(docs, source_col, word_count(text_or_empty(text_col)), seed, names)
    plain = [c for c in docs.columns if c != text_col]
    # without the texts: where each document lies within its bucket
    rows = persisted(ranked.select(*[F.col(f"`{c}`") for c in plain], b, rn, sz, st))
    buckets = rows.groupBy(F.col(f"`{source_col}`").alias(src), b).agg(F.sum(sz).alias("n"))
    found = buckets.groupBy(src).agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    named = sorted(((r[0], int(r[1])) for r in found), key=lambda x: (x[0] is None, x[0] or ""))
    plan = plan_sources(named, weights, share, cap, block, seed)

    # documents cut at block borders
    spark = docs.sparkSession
    offsets = buckets.select(src, b, F.coalesce(F.sum("n").over(
        Window.partitionBy(src).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("off"))
    listed = spark.createDataFrame(
        [(i, s.name, s.size, s.target, s.words, s.full, s.slots,
          [list(p) for p in s.steps]) for i, s in enumerate(plan)],
        f"i int, {src} string, source_size bigint, target double, words bigint, full bigint, "
        "slots bigint, steps array<array<bigint>>")
    small = F.broadcast(listed)  # one row per source
    of_source = F.col(f"x.`{source_col}`").eqNullSafe(F.col(f"o.{src}"))
    placed = rows.alias("x").join(
        offsets.join(small, offsets[src].eqNullSafe(listed[src])).select(
            offsets[src], b, "off", "i", "source_size", "target").alias("o"),
        of_source & (F.col(f"x.{b}") == F.col(f"o.{b}"))) \
        .select(*[F.col(f"x.`{c}`") for c in plain], "i", F.col(f"x.{b}").alias(b), rn,
                F.col(sz).alias("size"), "source_size", "target",
                (F.col(st) + F.col("off")).alias(st))
    end = F.col(st) + F.col("size")
    cut = placed.withColumn("block", F.explode_outer(F.when(
        F.col("size") > 0, F.sequence(F.floor(F.col(st) / block).cast("bigint"),
                                      F.floor((end - 1) / block).cast("bigint"))))) \
        .withColumn("lo", F.greatest(F.col(st) - F.col("block") * block, F.lit(0))) \
        .withColumn("hi", F.least(end - F.col("block") * block, F.lit(block)))

    slots = _slots(spark, plan, small, shard_slots, block, seed)
    met = cut.alias("c").join(slots.alias("s"), (F.col("c.i") == F.col("s.i"))
                              & (F.col("c.block") == F.col("s.block")), "left") \
        .withColumn("n", F.when(F.col("take").isNotNull(),
                                F.greatest(F.least("hi", "take") - F.col("lo"), F.lit(0))))
    per_doc = met.groupBy("c.i", b, rn, *[F.col(f"`{c}`") for c in plain], "size", "source_size",
                          "target").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("taken")) \
        .drop("i", b, rn)
    pieces = met.where("n > 0").select(
        F.struct(F.col(f"c.`{source_col}`").alias("source"), F.col(b).alias("bucket"),
                 F.col(rn).alias("number")).alias("row"),
        "size", "shard", "slot", "pass",
        (F.col("lo") + F.col("c.block") * block - F.col(st)).alias("first"), "n")
    texts = ranked.select(
        F.struct(F.col(f"`{source_col}`").alias("source"), F.col(b).alias("bucket"),
                 F.col(rn).alias("number")).alias("row"),
        *[F.col(f"`{c}`") for c in docs.columns if c != "row"])
    return per_doc, pieces, texts, plan


def _slots(spark, plan: list[Source], small: DataFrame, shard_slots: int, block: int,
           seed: int) -> DataFrame:
    """``(i, shard, slot, pass, block, take)``: every slot, the block it is mapped to and how many
    words of it are taken (all, but for the last slot of a source)."""
    total = sum(s.slots for s in plan)
    draws = spark.range(-(-total // shard_slots) * shard_slots if total else 0)
    # multinomial draw of each slot's source: a seeded uniform number against the shares so far
    upto, sofar = [], 0
    for s in plan:
        sofar += s.slots
        upto.append(sofar / total if total else 0.0)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / F.lit(float(1 << 53)))
    bounds = F.array(*[F.lit(x) for x in upto[:-1]]).cast("array<double>")
    drawn = draws.select(F.expr(f"id DIV {shard_slots}").alias("shard"), u.alias("u")) \
        .select("shard", F.size(F.filter(bounds, lambda x: x <= F.col("u"))).alias("i")) \
        .groupBy("shard", "i").agg(F.count(F.lit(1)).alias("k"))
    start = F.coalesce(F.sum("k").over(Window.partitionBy("i").orderBy("shard")
                                       .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = drawn.withColumn("start", start)
    some = runs.select("i", "shard", "start", (F.col("start") + F.col("k")).alias("stop"))
    # what the draws leave open of a source's slots
    rest = small.join(runs.groupBy("i").agg(F.sum("k").alias("k")), "i", "left") \
        .select("i", F.lit(-(-total // shard_slots)).cast("bigint").alias("shard"),
                F.coalesce("k", F.lit(0)).alias("start"), F.col("slots").alias("stop"))
    every = some.unionByName(rest).join(small.select("i", "slots", "full", "steps", "words",
                                                     "source_size"), "i") \
        .withColumn("stop", F.least("stop", "slots")).where("start < stop") \
        .withColumn("slot", F.explode(F.sequence(F.col("start"), F.col("stop") - 1)))
    per_pass = F.ceil(F.col("source_size") / block).cast("bigint")
    every = every.withColumn("pass", F.floor(F.col("slot") / per_pass).cast("int")) \
        .withColumn("at", F.col("slot") - F.col("pass") * per_pass)
    step = F.element_at("steps", F.col("pass") + 1)
    moved = F.pmod(F.col("at") * step[0] + step[1], F.col("full"))
    rest_words = F.col("words") - F.col("pass") * F.col("source_size") - F.col("at") * block
    return every.select(
        "i", "shard", "slot", "pass",
        F.when(F.col("at") < F.col("full"), moved).otherwise(F.col("full")).alias("block"),
        F.least(F.lit(block).cast("bigint"), rest_words).alias("take"))


def mixed_documents(pieces: DataFrame, texts: DataFrame, text_col: str = "text",
                    size_col: str = "n_chars") -> DataFrame:
    """The mixed corpus in the documents' own columns: per document and pass one row with the
    words taken, in order (the text itself where all of it is taken), and ``size_col``, if
    there is one, set to the new length. A document's pieces are gathered before they meet its
    text, which is moved once whatever their number."""
    columns = [c for c in texts.columns if c != "row"]
    key = [F.col("row.source").alias("_s"), F.col("row.bucket").alias("_b"),
           F.col("row.number").alias("_n")]
    spans = pieces.select(*key, "size", F.struct("pass", "first", "n").alias("span")) \
        .groupBy("_s", "_b", "_n", "size").agg(
            F.sort_array(F.collect_list("span")).alias("_spans")) \
        .withColumnRenamed("size", "_size")
    # the documents' own columns travel in one struct: they may have any names
    body = texts.select(F.col("row.source").alias("_st"), F.col("row.bucket").alias("_bt"),
                        F.col("row.number").alias("_nt"),
                        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"))
    met = spans.join(body, F.col("_s").eqNullSafe(F.col("_st")) & (F.col("_b") == F.col("_bt"))
                     & (F.col("_n") == F.col("_nt")))
    text = F.col(f"_doc.`{text_col}`")
    got = met.withColumn("_pass", F.explode(F.array_distinct(F.col("_spans")["pass"]))) \
        .withColumn("_own", F.filter("_spans", lambda s: s["pass"] == F.col("_pass")))
    whole = F.aggregate("_own", F.lit(0).cast("bigint"), lambda a, s: a + s["n"]) == F.col("_size")
    got = got.withColumn("_whole", whole) \
        .withColumn("_words", F.when(~F.col("_whole"), words_of(text)))
    cut = F.array_join(F.flatten(F.transform(
        "_own", lambda s: F.slice(F.col("_words"), (s["first"] + 1).cast("int"),
                                  s["n"].cast("int")))), " ")
    out = got.withColumn("_made", F.when(F.col("_whole"), text).otherwise(cut))
    new = {text_col: F.col("_made")}
    if size_col in columns:
        new[size_col] = F.char_length("_made").cast(texts.schema[size_col].dataType)
    return out.select(*[new.get(c, F.col(f"_doc.`{c}`")).alias(c) for c in columns])
