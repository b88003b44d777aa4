"""Ranked lexical search: exact best-k documents by sparse ball trees.

A document is a sparse vector of whole numbers: for each of its terms, what that term adds to the
score of a query that holds it. A query is the set of its terms, so a score is an inner product
with a vector of ones.

1. Every document is read once: its terms are counted, and the counts of the terms that some
   query may hold are written (a fixed-size bit filter of query terms tells which).
2. Document frequencies and lengths are summed over all documents; they give the weights.
3. Queries are dealt into blocks of bounded size. For a block, documents are packed where they
   lie, some thousands at a time, into ball trees: a node has the centroid of its documents and a
   radius around it, children are halves along the line between two far-apart documents, leaves
   hold a few documents. ``query . centroid + |query| * radius`` bounds every score in the node,
   and so does the centroid plus a radius of each term's own, added up over the query's terms
   (which is the term's largest value in the node); the lesser counts. Radii and bounds are
   rounded upwards by more than all floating-point error, so a bound is never too small.
4. A probe reads in each tree the leaf of the largest bound; the k-th best of all these exact scores
   is a floor under the k-th score of each query.
5. The search walks every tree best-first from that floor, drops subtrees whose bound is below the
   present k-th score, and scores leaves in 64-bit integers. The few left meet by query.

Nothing is shuffled but counts by term and the candidates found.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.common import text_or_empty, written

#: Bytes outside terms become spaces, A-Z become a-z; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32
              for c in range(256))
#: The filter of query terms has so many bits (a quarter of a megabyte).
FILTER_BITS = 1 << 21
#: (query, term) pairs and queries in a block, on average; a query is never cut.
BLOCK_PAIRS, BLOCK_QUERIES = 1 << 14, 512
#: Documents, (document, term) entries and centroid numbers in one tree.
TREE_DOCS, TREE_ENTRIES, TREE_CELLS = 8192, 1 << 20, 1 << 22
#: Documents in a leaf.
LEAF = 16
#: Documents of each tree and query that the probe reports.
PROBE = 4
_EPS = float(np.finfo(np.float64).eps)


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order: ASCII letters and digits and all other characters beyond
    ASCII, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def _bit(term: bytes) -> int:
    return zlib.crc32(term) % FILTER_BITS


def _split_queries(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(query_id, q, term)``: the distinct terms of each query; ``q`` tells queries apart (id
    and text), equal rows are one query."""
    q = F.sha2(F.concat_ws("\0", F.coalesce(F.col("i").cast("string"), F.lit("\1")),
                           F.coalesce("t", F.lit("\1"))), 256)
    one = queries.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")) \
        .distinct().select("i", q.alias("q"), text_or_empty("t").cast("binary").alias("t"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(terms(t))) for t in b.column(2).to_pylist()]
            take = pa.array(np.repeat(np.arange(b.num_rows), [len(o) for o in own]), pa.int64())
            flat = [t for o in own for t in o]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take),
                 pa.array(flat, pa.binary()).cast(pa.string()),
                 pa.array([_bit(t) for t in flat], pa.int32())],
                names=["query_id", "q", "term", "bit"])

    schema = T.StructType([T.StructField("query_id", queries.schema[id_col].dataType),
                           T.StructField("q", T.StringType()), T.StructField("term", T.StringType()),
                           T.StructField("bit", T.IntegerType())])
    return one.mapInArrow(split, schema)


class _Wanted(dict):
    """Term → whether its bit is set; remembered up to a bound."""

    LIMIT = 500_000

    def __init__(self, bits: np.ndarray):
        super().__init__()
        self.bits = bits

    def __missing__(self, term: bytes) -> bool:
        if len(self) >= self.LIMIT:
            self.clear()
        self[term] = got = bool(self.bits[_bit(term)])
        return got


def _counted(docs: DataFrame, id_col: str, text_col: str, bits: np.ndarray) -> DataFrame:
    """``(id, n, terms, tf)`` of every document: all its terms, and the counts of wanted ones."""
    packed = np.packbits(bits)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType),
                           T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.StringType())),
                           T.StructField("tf", T.ArrayType(T.LongType()))])
    sent = docs.select(F.col(f"`{id_col}`").alias("id"),
                       text_or_empty(f"`{text_col}`").cast("binary").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _Wanted(np.unpackbits(packed)[:FILTER_BITS])
        for b in batches:
            n, ends, flat, often = [], [0], [], []
            for value in b.column(1):  # one text at a time: a batch's words are never all there
                found = Counter(terms(value.as_py()))
                n.append(found.total())
                some = [t for t in found if wanted[t]]
                flat += some
                often += map(found.__getitem__, some)
                ends.append(len(flat))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(at, pa.array(flat, pa.binary()).cast(pa.string())),
                 pa.ListArray.from_arrays(at, pa.array(often, pa.int64()))],
                names=["id", "n", "terms", "tf"])

    return sent.mapInArrow(count, schema)


class Block:
    """A bounded set of queries: for each its terms, as numbers of the block's vocabulary, and
    every term's weight."""

    def __init__(self, rows: list[tuple]):
        """``rows``: (query's place, term, weight)."""
        self.vocabulary = sorted({t for _, t, _ in rows})
        number = {t: k for k, t in enumerate(self.vocabulary)}
        self.weight = np.zeros(len(number), np.int64)
        self.size = 1 + max((q for q, _, _ in rows), default=-1)
        own: list[list[int]] = [[] for _ in range(self.size)]
        for q, t, w in rows:
            self.weight[number[t]] = w
            own[q].append(number[t])
        self.terms = [np.array(sorted(o), np.int64) for o in own]

    def holds(self, own: np.ndarray) -> np.ndarray:
        """By term, 1 where it is one of a query's."""
        mask = np.zeros(len(self.weight), np.int64)
        mask[own] = 1
        return mask


class Tree:
    """Ball tree over sparse rows, in the layout of a heap: node i has children 2i+1 and 2i+2 and
    holds the rows ``first[i]`` to ``last[i]``. Rows are given by offsets, terms and values;
    ``order`` tells their old places."""

    def __init__(self, start: np.ndarray, term: np.ndarray, value: np.ndarray, width: int,
                 leaf: int = LEAF):
        n = len(start) - 1
        self.start, self.term, self.value, self.width = start, term, value, width
        depth = max(0, int(np.ceil(np.log2(n / leaf)))) if n > leaf else 0
        nodes = (2 << depth) - 1
        self.inner = nodes >> 1
        self.first, self.last = np.zeros(nodes, np.int64), np.full(nodes, n, np.int64)
        for i in range(self.inner):
            a, b = self.first[i], self.last[i]
            self.first[2 * i + 1], self.last[2 * i + 2] = a, b
            self.last[2 * i + 1] = self.first[2 * i + 2] = (a + b + 1) // 2
        self._measure()
        self.order = np.arange(n)
        for i in range(self.inner):
            self._halve(i)
        at = self._entries(self.order)
        self.start = np.concatenate([[0], np.cumsum(np.diff(start)[self.order])])
        self.term, self.value = term[at], value[at]
        self._measure()
        self.centre, self.peak = np.zeros((nodes, width)), np.zeros((nodes, width))
        for i in range(nodes - 1, -1, -1):
            if i < self.inner:
                self.centre[i] = self.centre[2 * i + 1] + self.centre[2 * i + 2]
                self.peak[i] = np.maximum(self.peak[2 * i + 1], self.peak[2 * i + 2])
            else:
                at = slice(self.start[self.first[i]], self.start[self.last[i]])
                self.centre[i] = np.bincount(self.term[at], self.real[at], width)
                np.maximum.at(self.peak[i], self.term[at], self.real[at])
        self.centre /= np.maximum(self.last - self.first, 1)[:, None]
        self.radius = np.array([self._radius(i) for i in range(nodes)])

    def _measure(self) -> None:
        self.real = self.value.astype(np.float64)
        self.square = np.bincount(np.repeat(np.arange(len(self.start) - 1), np.diff(self.start)),
                                  self.real * self.real, len(self.start) - 1)

    def _entries(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the entries of some rows."""
        size = self.start[rows + 1] - self.start[rows]
        ends = np.cumsum(size)
        return np.repeat(self.start[rows] - (ends - size), size) + np.arange(ends[-1] if len(ends)
                                                                             else 0)

    def _distances(self, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
        """Squared distances of rows to a dense point (rounded)."""
        at = self._entries(rows)
        size = self.start[rows + 1] - self.start[rows]
        dot = np.bincount(np.repeat(np.arange(len(rows)), size),
                          self.real[at] * point[self.term[at]], len(rows))
        return self.square[rows] - 2 * dot + float(point @ point)

    def _dense(self, row: int) -> np.ndarray:
        out = np.zeros(self.width)
        at = slice(self.start[row], self.start[row + 1])
        out[self.term[at]] = self.real[at]
        return out

    def _halve(self, i: int) -> None:
        """Sort a node's rows along the line between two far-apart ones; halves are children."""
        a, b = self.first[i], self.last[i]
        rows = self.order[a:b]
        if b - a < 2:
            return
        left = self._dense(rows[np.argmax(self._distances(rows, self._dense(rows[0])))])
        to_left = self._distances(rows, left)
        to_right = self._distances(rows, self._dense(rows[np.argmax(to_left)]))
        self.order[a:b] = rows[np.argsort(to_left - to_right, kind="stable")]

    def _radius(self, i: int) -> float:
        """At least the largest distance from the centroid as stored. A squared distance is a sum of
        products of total size at most (|row| + |centre|)^2, each rounded a few times and added in
        at most width + 8 steps."""
        rows = np.arange(self.first[i], self.last[i])
        if not len(rows):
            return 0.0
        centre = self.centre[i]
        size = 2 * (self.square[rows] + float(centre @ centre))
        error = 4 * (self.width + 8) * _EPS * size
        return float(np.sqrt((np.maximum(self._distances(rows, centre), 0) + error).max())
                     * (1 + 4 * _EPS))

    def bounds(self, block: Block) -> np.ndarray:
        """(node, query): no score in the node is larger, by the ball or by the terms' own reach,
        whichever is less. Each is a sum of at most width + 1 non-negative products."""
        ask = np.zeros((self.width, block.size))
        for q, own in enumerate(block.terms):
            ask[own, q] = 1
        norm = np.sqrt(ask.sum(0)) * (1 + 4 * _EPS)
        ball = self.centre @ ask + self.radius[:, None] * norm[None, :]
        rounded = np.minimum(ball, self.peak @ ask)
        return rounded * (1 + 4 * (self.width + 8) * _EPS) + 1

    def leaf_scores(self, i: int, holds: np.ndarray) -> np.ndarray:
        """Exact scores of a leaf's rows; ``holds`` tells by term whether the query has it."""
        lo, hi = self.start[self.first[i]], self.start[self.last[i]]
        total = np.concatenate([[0], np.cumsum(holds[self.term[lo:hi]] * self.value[lo:hi])])
        at = self.start[self.first[i]:self.last[i] + 1] - lo
        return total[at[1:]] - total[at[:-1]]

    def probe(self, block: Block, top: int) -> Iterator[tuple[int, int]]:
        """``(query, score)``: the largest scores in the leaf of the largest bound."""
        at = self.inner + self.bounds(block)[self.inner:].argmax(0)
        for q, own in enumerate(block.terms):
            got = np.sort(self.leaf_scores(int(at[q]), block.holds(own)))[::-1][:top]
            yield from ((q, int(s)) for s in got)

    def search(self, block: Block, ids: list, k: int, floor: np.ndarray
               ) -> Iterator[tuple[int, int, int]]:
        """``(query, row, score)`` of all that may be among the k best: best-first, dropping
        what is bound to lie below the floor or below the k-th score found."""
        bounds = self.bounds(block)
        for q in np.flatnonzero(bounds[0] >= np.maximum(floor, 1)):
            bound, holds, least = bounds[:, q].tolist(), block.holds(block.terms[q]), \
                max(1, int(floor[q]))
            queue, found = [(-bound[0], 0)], []
            while queue:
                high, i = heapq.heappop(queue)
                if -high < least:
                    break
                if i < self.inner:
                    for c in (2 * i + 1, 2 * i + 2):
                        if bound[c] >= least:
                            heapq.heappush(queue, (-bound[c], c))
                    continue
                got = self.leaf_scores(i, holds)
                fit = np.flatnonzero(got >= least)
                found += zip(got[fit].tolist(), (fit + self.first[i]).tolist())
                if len(found) >= 2 * k:  # equal scores: the smaller id first, none last
                    found.sort(key=lambda f: (-f[0], ids[f[1]] is None,
                                              0 if ids[f[1]] is None else ids[f[1]]))
                    found = found[:k]
                    least = max(least, found[-1][0])
            yield from ((int(q), r, s) for s, r in found)


def _trees(batches: Iterator[pa.RecordBatch], block: Block, n_docs: int, n_terms: int
           ) -> Iterator[tuple[pa.Array, Tree]]:
    """Ball trees over a task's counted documents, packed as they come: ids in tree order, and
    the tree. The dense centroids of a tree stay within ``TREE_CELLS`` numbers."""
    vocabulary, weight = pa.array(block.vocabulary, pa.string()), block.weight
    most = min(TREE_DOCS, LEAF * max(1, TREE_CELLS // (2 * len(weight))))
    held, docs, entries = [], 0, 0

    def tree() -> tuple[pa.Array, Tree]:
        size = np.concatenate([h[1] for h in held])
        t = Tree(np.concatenate([[0], np.cumsum(size)]), np.concatenate([h[2] for h in held]),
                 np.concatenate([h[3] for h in held]), len(weight))
        return pa.concat_arrays([h[0] for h in held]).take(pa.array(t.order)), t

    for batch in batches:
        for lo in range(0, batch.num_rows, most):
            b = batch.slice(lo, most)
            # a document's entries: its terms that the block knows, with what each adds to a score
            known = pc.index_in(b.column(2).flatten(), value_set=vocabulary)
            mine = known.is_valid().to_numpy(zero_copy_only=False)
            length = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(b.num_rows), length.astype(np.int64))[mine]
            term = known.drop_null().to_numpy().astype(np.int64)
            tf = b.column(3).flatten().to_numpy()[mine]
            m = 50 + (50 * b.column(1).to_numpy() * n_docs) // n_terms
            value = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[row]))
            some = value > 0
            size = np.bincount(row[some], minlength=b.num_rows)
            own = np.flatnonzero(size)  # a document without any entry scores 0
            held.append((b.column(0).take(pa.array(own)), size[own], term[some], value[some]))
            docs, entries = docs + len(own), entries + int(some.sum())
            if docs >= most or entries >= TREE_ENTRIES:
                yield tree()
                held, docs, entries = [], 0, 0
    if docs:
        yield tree()


def _search_block(counted: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """``(query, id, score)`` of candidates for every query of a block (its place in the block)."""
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tree in _trees(batches, block, n_docs, n_terms):
            got = list(tree.probe(block, PROBE))
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()),
                                              pa.array([g[1] for g in got], pa.int64())],
                                             names=["query", "s"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, block, n_docs, n_terms):
            got = list(tree.search(block, ids.to_pylist(), k, floor))
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g in got], pa.int32()),
                 ids.take(pa.array([g[1] for g in got], pa.int64())),
                 pa.array([g[2] for g in got], pa.int64())], names=["query", "id", "score"])

    w = Window.partitionBy("query").orderBy(F.col("s").desc())
    floors = counted.mapInArrow(probe, "query int, s bigint") \
        .withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select("query", "s")
    floor = np.zeros(block.size, np.int64)
    for f in floors.collect():  # at most one for each query of the block
        floor[f["query"]] = f["s"]
    schema = T.StructType([T.StructField("query", T.IntegerType()),
                           T.StructField("id", counted.schema["id"].dataType),
                           T.StructField("score", T.LongType())])
    return counted.mapInArrow(search, schema)


def rank(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "item_id",
         query_text: str = "text", id_col: str = "doc_id", text_col: str = "text",
         block_pairs: int = BLOCK_PAIRS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``(<query id>, rank, <document id>, score)``: the k documents of largest positive score for
    every query, ties to the smaller id (null ids last); fewer where fewer score above 0.

    Null and empty texts hold no terms: such documents are found by no query, such queries find
    nothing. Equal query rows (id and text) are one query; rows that share only their id are
    queries of their own. Repeated documents are ranked row by row. Whole texts count; further
    columns, whatever their names, are ignored; empty tables give no rows.

    Eager: term counts go to the shared folder; for each block one pass finds the floors, and the
    pass that searches is left to the caller's action."""
    spark = docs.sparkSession
    asked = written(_split_queries(queries, query_id, query_text), "queries")
    bits = np.zeros(FILTER_BITS, np.uint8)
    bits[[r[0] for r in asked.select("bit").distinct().collect()]] = 1  # at most FILTER_BITS
    counted = written(_counted(docs, id_col, text_col, bits), "counted")
    n_docs, n_terms = counted.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    met = counted.where(F.size("terms") > 0)
    kind = T.StructType([T.StructField(query_id, queries.schema[query_id].dataType),
                         T.StructField("rank", T.IntegerType()),
                         T.StructField(id_col, docs.schema[id_col].dataType),
                         T.StructField("score", T.LongType())])
    if not n_docs:
        return spark.createDataFrame([], kind)
    df = met.select(F.explode("terms").alias("term")) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(F.lit(1000) * F.log((F.lit(2.0) * n_docs + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weighed = asked.join(df, "term").select("query_id", "q", "term", weight.alias("w"))
    pairs, n_queries = asked.agg(F.count(F.lit(1)), F.count_distinct("q")).first()
    blocks = max(1, -(-pairs // block_pairs), -(-n_queries // block_queries))
    weighed = written(weighed.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks))), "weighed")
    found = None
    for b in range(blocks):
        own = weighed.where(F.col("block") == b).orderBy("q", "term").collect()
        if not own:
            continue
        place: dict = {}
        for r in own:
            place.setdefault(r["q"], (len(place), r["query_id"]))
        names = spark.createDataFrame(
            [(at, i) for at, i in place.values()],
            T.StructType([T.StructField("query", T.IntegerType()),
                          T.StructField("query_id", queries.schema[query_id].dataType)]))
        block = Block([(place[r["q"]][0], r["term"], r["w"]) for r in own])
        got = _search_block(met, block, n_docs, n_terms, k)
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        top = got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
            .join(F.broadcast(names), "query")  # names: the queries of one block
        top = top.select(F.col("query_id").alias(query_id), "rank", F.col("id").alias(id_col),
                         "score")
        found = top if found is None else found.unionByName(top)
    return spark.createDataFrame([], kind) if found is None else found
