"""SimHash near-duplicate groups through covering locality-sensitive hashing.

A text's fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. To find
all pairs within ``radius`` differing bits, every bit position gets a non-zero vector of
``radius + 1`` binary coordinates; each of the ``2**(radius+1) - 1`` non-zero vectors ``v`` gives a
mask holding the positions whose vector has odd inner product with ``v``. Any set of at most
``radius`` positions spans too little to leave no ``v`` orthogonal to all of it, so two
fingerprints within the radius agree on at least one whole masked value: no pair is lost.

Groups of equal fingerprints are reduced to one row (with the smallest key) before anything
else, so copies cost one row per map task. Colliding fingerprints are verified by their exact
bit distance. A bucket with many different fingerprints is not paired within: its members look up
the fingerprints of their radius-ball instead (``neighbour_limit``), which is exact too and linear
in the bucket's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.common import (free_name, join_counted, persisted, released, text_or_empty,
                                  written)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BITS = 64


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Fingerprint of one text (see :func:`fingerprints`)."""
    return int(_fingerprints([text], shingle, seed)[0])


def _fingerprints(texts: list[str], shingle: int, seed: int) -> np.ndarray:
    """uint64 fingerprints. One text is hashed at a time; a long one in slices, so memory is
    bounded by the text itself."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for r, t in enumerate(texts):
        words = t.encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            hashes = np.array([digest(joined, seed)], np.uint64)
        else:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate([[0], ends[:-1]])[:len(words) - shingle + 1].tolist()
            stops = (ends[shingle - 1:] - 1).tolist()
            hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops)),
                                 np.uint64, len(starts))
        votes = np.zeros(BITS, np.int64)
        for lo in range(0, len(hashes), 65536):
            part = hashes[lo:lo + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
            votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
        bits = (2 * votes > len(hashes)).astype(np.uint8)
        out[r] = np.packbits(bits, bitorder="little").view("<u8")[0]
    return out


def fingerprints(df: DataFrame, text_col: str = "text", shingle: int = 3, seed: int = 42,
                 out: str = "fp") -> DataFrame:
    """``df`` without ``text_col``, plus ``out``: the fingerprint as a signed 64-bit integer. A
    text is lower-cased in A-Z only; words are runs of bytes other than ASCII white space; with
    fewer words than a shingle the whole sequence is the one shingle; no words (empty or null
    text) give zero. Bit b is 1 when set in over half the shingle hashes, repeats included."""
    text = free_name(df, "_t")
    names = [c for c in df.columns if c not in (text_col, out)]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, T.LongType())])
    sent = df.select(*[F.col(f"`{c}`") for c in names], text_or_empty(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = _fingerprints(b.column(len(names)).to_pylist(), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(fp)],
                                             names=[*names, out])
        released(None)

    return sent.mapInArrow(run, schema)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """The ``2**(radius+1) - 1`` masks (signed 64-bit): position i carries the non-zero vector
    ``i mod (2**(radius+1) - 1) + 1``, mask v the positions whose vector meets v oddly."""
    width = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, width + 1):
        m = sum(1 << i for i in range(bits) if bin((i % width + 1) & v).count("1") & 1)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def links(fps: DataFrame, radius: int, neighbour_limit: int = 2000) -> DataFrame:
    """All links ``(a, b)``, a < b, between the distinct fingerprints in column ``fp`` at 1 to
    ``radius`` differing bits; each link once."""
    masks = covering_masks(radius)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m))
                                                    for m in masks])).alias("tab", "key"))
    # a bucket's size first (partial counts before the shuffle); singles drop out here
    sizes = keyed.groupBy("tab", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = persisted(keyed.join(sizes, ["tab", "key"]))
    small = met.where(F.col("n") <= neighbour_limit)
    close = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius
    pairs = small.alias("x").join(
        small.alias("y"), (F.col("x.tab") == F.col("y.tab")) & (F.col("x.key") == F.col("y.key"))
        & (F.col("x.fp") < F.col("y.fp")) & close) \
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    large = met.where(F.col("n") > neighbour_limit).select("fp").distinct()
    flips = [sum(1 << i for i in c) for r in range(1, radius + 1)
             for c in combinations(range(BITS), r)]
    flips = F.array(*[F.lit(f - (1 << 64) if f >> 63 else f) for f in flips])
    ball = large.select(F.col("fp").alias("a"), F.explode(flips).alias("flip")) \
        .select("a", F.col("a").bitwiseXOR(F.col("flip")).alias("fp")) \
        .join(fps.select("fp"), "fp") \
        .select(F.least("a", "fp").alias("a"), F.greatest("a", "fp").alias("b"))
    both = pairs.unionByName(ball) if not large.isEmpty() else pairs
    return both.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (a, b)``: root is the smallest node reachable.
    Alternating large-star and small-star steps (each a group-by over edges, with partial minima
    first) until nothing changes; the edge list is checkpointed each round. No node's neighbours
    are ever gathered: a step needs only their minimum."""
    cur = persisted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .where("u <> v").distinct())
    before, n = None, cur.count()
    for _ in range(max_rounds):
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # a node's number of neighbours tells a large component's root, whose edges stay in place
        low = persisted(both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
                        .select("u", F.least("u", "m").alias("m"), "n"))
        # large star: neighbours above u go to u's smallest neighbour (or u itself)
        large = persisted(join_counted(both.where("v > u"), low, "u", "n", n)
                          .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                          .distinct())
        # small star: neighbours below u, and u, go to the smallest of them
        least = persisted(large.groupBy("u").agg(F.min("v").alias("m"),
                                                 F.count(F.lit(1)).alias("n")))
        small = join_counted(large, least, "u", "n", n) \
            .select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        cur = persisted(small)
        state = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, n = state, state[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())


def near_duplicate_groups(df: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                          shingle: int = 3, radius: int = 2, seed: int = 42,
                          neighbour_limit: int = 2000) -> DataFrame:
    """One row per input row: every column but ``text_col``, ``fp`` (signed 64-bit), and
    ``component_id``: the smallest non-null key reachable over links of at most ``radius`` bits,
    the row's own included (null when no member has a key). Rows with equal fingerprints are
    linked; so are all empty and null texts, whose fingerprint is zero. An empty table gives no
    rows; repeated rows stay."""
    rows = persisted(fingerprints(df, text_col, shingle, seed))
    fps = rows.groupBy("fp").agg(F.min(key_col).alias("low"), F.count(F.lit(1)).alias("n"))
    found = components(links(fps.select("fp"), radius, neighbour_limit))
    # a class's smallest key: partial minima over its fingerprints, then back to each of them
    joined = persisted(found.join(fps, found["node"] == fps["fp"]).select("node", "root", "low"))
    roots = persisted(joined.groupBy("root").agg(F.min("low").alias("c"),
                                                 F.count(F.lit(1)).alias("n")))
    member = join_counted(joined, roots, "root", "n", joined.count()) \
        .select(F.col("node").alias("fp"), "c")
    of = written(fps.join(member, "fp", "left")
                 .select("fp", F.coalesce("c", "low").alias("component_id"), "n"), "groups")
    total = of.agg(F.sum("n")).first()[0] or 0
    names = [c for c in rows.columns if c not in ("fp", "component_id")]
    # rows under a fingerprint that very many share stay where they are
    packed = rows.select("fp", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in names])
                         .alias("row"))
    return join_counted(packed, of, "fp", "n", total) \
        .select(*[F.col("row").getField(c).alias(c) for c in names], "fp", "component_id")
