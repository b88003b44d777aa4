"""Multi-line CSV files read in parallel byte ranges, with file order.

A newline ends a record only outside quotes, so a range of a file cannot be cut into records
without knowing whether it begins inside quotes. Two passes over Spark's splittable text source:

1. Every range yields its *transfer map*: the state behind it (outside or inside quotes) for
   either state before it, and the first range of a file its header too. Maps of neighbours
   compose; a running composition over the ranges of a file (constants and flips, so a running
   sum and a last value) gives the state at every range's start.
2. Every range cuts its lines into records from its known state. A record that crosses ranges
   leaves fragments: the end of one range, whole ranges inside quotes, the head of another. Only
   fragments are shuffled, and joined in file order.

A record's place is the struct ``(file, start, n)``: the range that it begins in and its number
there. Rules for quotes are those of Python's ``csv`` module: a quote opens a quoted field only at
the field's start, a doubled one inside stands for itself, text behind a closing quote is
kept as it is.
"""

from __future__ import annotations

import csv
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.operators.ordering import checkpointed

#: Ranges in one read: their starts and states (17 bytes each) are held by every task. At the
#: default range of 128 MB these are 512 TB; beyond it, larger ranges or fewer files at a time.
MAX_RANGES = 4_000_000
#: Different headers in one read.
MAX_LAYOUTS = 10_000
#: The number of a record that a range leaves open: behind all others of the range.
LAST = 1 << 40

PLACE = T.StructType([T.StructField("file", T.StringType()), T.StructField("start", T.LongType()),
                      T.StructField("n", T.LongType())])

_CLOSE = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
_RETURN = re.compile(r"[^\r]*\r(?!\n)|[^\r]+(?:\r\n)?|\r\n")


def _inside_after(line: str, inside: bool) -> bool:
    """Whether a line (with its newline) ends inside quotes, if it begins so or not."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if inside:
            end = _CLOSE.match(line, at)
            if end is None:
                return True
            at, inside = end.end(), False
        elif line.startswith('"', at):
            at, inside = at + 1, True
            continue
        # to the next field (or record, behind a carriage return)
        comma, back = line.find(",", at), line.find("\r", at)
        nxt = min((x for x in (comma, back) if x >= 0), default=-1)
        if nxt < 0:
            return False
        at = nxt + 1


def _parse(records: Iterable[list[str]], absent_null: bool = True) -> Iterator[list]:
    """Field lists of records, each given as its lines; absent (unquoted empty) fields are None
    with ``absent_null``, else empty texts; blank lines give nothing. A carriage return outside
    quotes ends a record, too."""
    csv.field_size_limit(sys.maxsize)

    def lines():
        for record in records:
            for line in record:
                if "\r" in line:
                    yield from _RETURN.findall(line)
                else:
                    yield line

    quoting = csv.QUOTE_NOTNULL if absent_null else csv.QUOTE_MINIMAL
    return (row for row in csv.reader(lines(), quoting=quoting) if row)


class _Cutter:
    """Lines of one range, in order, cut into records and fragments."""

    def __init__(self, inside: bool):
        self.inside, self.head = inside, [] if inside else None
        self.pending: list[str] = []

    def feed(self, lines: list[str]) -> Iterator[list[str]]:
        for line in lines:
            self.inside = _inside_after(line, self.inside)
            if self.head is not None:  # still in a record of an earlier range
                self.head.append(line)
                if not self.inside:
                    yield from self.close_head()
            elif self.inside or self.pending:
                self.pending.append(line)
                if not self.inside:
                    done, self.pending = self.pending, []
                    yield done
            else:
                yield [line]

    def close_head(self):
        self.closed, self.head = "".join(self.head), None
        return ()


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, file, h, start)``: text lines by the ranges that Spark's text source cuts."""
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.xxhash64("_metadata.file_path").alias("h"),
        F.col("_metadata.file_block_start").alias("start"))


def _by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``(file, h, start, lines)``: pieces of ranges, in order; a task holds one batch at a time."""
    before = None
    for b in batches:
        h, start = b.column(2).to_numpy(), b.column(3).to_numpy()
        change = np.flatnonzero((h[1:] != h[:-1]) | (start[1:] != start[:-1])) + 1
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), b.num_rows]):
            if hi > lo:
                lines = [f"{v}\n" for v in b.column(0).slice(lo, hi - lo).to_pylist()]
                at, now = (int(h[lo]), int(start[lo])), before
                before = at
                if at[1] == 0 and at != now:  # a byte order mark before the header
                    lines[0] = lines[0].removeprefix("\ufeff")
                yield b.column(1)[lo].as_py(), *at, lines


def _range_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range: its map, and the header where the range begins its file."""
    done: list[list] = []
    header: list[str] | None = None
    for file, h, start, lines in _by_range(batches):
        if not done or done[-1][1:3] != [h, start]:
            done.append([file, h, start, False, True, None])
            header = [] if start == 0 else None
        row = done[-1]
        for line in lines:
            if header is not None:
                header.append(line)
                if not _inside_after(line, row[3]):
                    first = next(_parse([header]), None)
                    # blank lines before the header are none
                    header = [] if first is None else None
                    row[5] = first
            same = row[3] == row[4]
            row[3] = _inside_after(line, row[3])
            row[4] = row[3] if same else _inside_after(line, row[4])
        if header and row[3]:
            row[5] = next(_parse([header]), None)  # a header whose quotes never close
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string())]
    yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t)
                                      for k, t in enumerate(kinds)],
                                     names=["file", "h", "start", "from_out", "from_in", "header"])


def range_states(maps: DataFrame) -> DataFrame:
    """``(h, start, inside)``: whether each range begins inside quotes, by composing the maps of
    the ranges before it: the last constant map's value, flipped by every later flip."""
    w = Window.partitionBy("h").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    flip = (F.col("from_out") & ~F.col("from_in")).cast("bigint")
    upto = maps.withColumn("flips", F.coalesce(F.sum(flip).over(
        Window.partitionBy("h").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)),
        F.lit(0)))
    fixed = F.when(F.col("from_out") == F.col("from_in"),
                   F.struct(F.col("from_out").cast("bigint").alias("v"), F.col("flips").alias("c")))
    last = F.last(fixed, ignorenulls=True).over(w)
    before = F.coalesce(F.last("flips").over(w), F.lit(0))
    turned = F.coalesce(last["v"], F.lit(0)) + before - F.coalesce(last["c"], F.lit(0))
    return upto.select("h", "start", (turned % 2 == 1).alias("inside"))


def _fields(values: list, places: list[int]) -> list:
    n = len(values)
    return [values[p] if 0 <= p < n else None for p in places]


def _places(headers: list[list[str]], columns: list[str]) -> list[list[int]]:
    """For every header the places of the columns; -1 where it has none."""
    return [[max((k for k, name in enumerate(hd) if name == c), default=-1) for c in columns]
            for hd in headers]


def _records(lines: DataFrame, columns: list[str], states, layouts, fragments: bool = False,
             multi_line: bool = True, absent_null: bool = True) -> DataFrame:
    """Rows ``(file, h, start, n, kind, values, text)``: records (kind 0), or fragments: the
    open end of a range (1), and the head (2) or the whole (3) of one that begins inside quotes.
    The header is number -1."""
    at_h, at_start, at_inside = states
    file_h, file_layout, headers = layouts
    places = _places(headers, columns)
    names = ["file", "h", "start", "n", "kind", "values", "text"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()),
             pa.string()]

    def look(h: int, start: int) -> tuple[bool, list[int]]:
        lo, hi = np.searchsorted(at_h, [h, h + 1]) if h < np.iinfo(np.int64).max else \
            (np.searchsorted(at_h, h), len(at_h))
        k = lo + np.searchsorted(at_start[lo:hi], start)
        if k >= hi or at_start[k] != start:
            raise RuntimeError("the ranges of a file changed between two passes; set "
                               "spark.sql.files.minPartitionNum to keep them")
        f = np.searchsorted(file_h, h)
        known = f < len(file_h) and file_h[f] == h
        return bool(at_inside[k]), places[file_layout[f]] if known else [-1] * len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cutter, place, n = None, None, None, 0

        def leave():
            """What an ended range leaves open."""
            if cutter is not None and fragments:
                if cutter.head is not None:
                    yield (*now, 0, 3, None, "".join(cutter.head))
                elif cutter.pending:
                    yield (*now, -1 if n < 0 else LAST, 1, None, "".join(cutter.pending))

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for file, h, start, some in _by_range(batches):
            out = []
            if now != (file, h, start):
                out += leave()
                now = (file, h, start)
                inside, place = look(h, start)
                cutter, n = _Cutter(inside), -1 if start == 0 else 0
            begun = cutter.head is not None
            if fragments:
                n += sum(1 for r in cutter.feed(some) if len(r) > 1 or r[0].strip("\r\n"))
            else:
                # without newlines in fields every line is parsed on its own
                for row in _parse(cutter.feed(some), absent_null) if multi_line else \
                        (r for line in some
                         for r in _parse([[line.removesuffix("\n")]], absent_null)):
                    if n >= 0:
                        out.append((*now, n, 0, _fields(row, place), None))
                    n += 1
            if begun and cutter.head is None and fragments:
                out.append((*now, 0, 2, None, cutter.closed))
            yield batch(out)
        yield batch(list(leave()))

    schema = ("file string, h bigint, start bigint, n bigint, kind int, values array<string>, "
              "text string")
    return lines.select("value", "file", "h", "start").mapInArrow(run, schema)


def _crossing(fragments: DataFrame, columns: list[str], layouts, absent_null: bool = True
              ) -> DataFrame:
    """Records that cross ranges: fragments from one open end to the next, joined in order."""
    file_h, file_layout, headers = layouts
    places = _places(headers, columns)
    # a range may give a head and an open end: the head comes first
    order = [F.col("start"), F.when(F.col("kind") == 1, 1).otherwise(0)]
    w = Window.partitionBy("h").orderBy(*order)
    owner = F.last(F.when(F.col("kind") == 1, F.struct("start", "n")), ignorenulls=True).over(w)
    pieces = fragments.withColumn("own", owner).groupBy("file", "h", "own").agg(
        F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)],
                                             "text"))).alias("p"))
    whole = pieces.select("file", "h", "own.start", "own.n",
                          F.array_join(F.col("p.text"), "").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file, h, start, n, text in zip(*[c.to_pylist() for c in b.columns]):
                place = places[file_layout[int(np.searchsorted(file_h, h))]]
                for k, row in enumerate(_parse([[text]], absent_null)):
                    if n + k >= 0:
                        out.append((file, start, n + k, _fields(row, place)))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)],
                names=["file", "start", "n", "values"])

    return whole.mapInArrow(run, "file string, start bigint, n bigint, values array<string>")


def read_csv(spark: SparkSession, path: str | list[str], columns: list[str],
             multi_line: bool = True, absent_null: bool = True) -> tuple[DataFrame, set[str]]:
    """``(rows, found)``: the files' records by their own headers as string columns ``columns``
    (absent ones NULL), plus ``file`` and ``file_pos`` (:data:`PLACE`, growing with file and
    row); and which of the columns some header has. With ``multi_line=False`` a newline always ends
    a record, quoted or not.

    A field is NULL where nothing stands between the commas, an empty text where quotes do; with
    ``absent_null=False`` both are empty texts, and NULL is only what a short row lacks.
    A header lies within the first range. Short rows end in NULLs, further fields are dropped, of equal column names the last counts;
    blank lines and empty files have no rows; a byte order mark before the header goes.
    ``path`` is what Spark's readers take: files, folders, patterns."""
    lines = _lines(spark, path)
    maps = checkpointed(lines.mapInArrow(
        _range_maps, "file string, h bigint, start bigint, from_out boolean, from_in boolean, "
                     "header array<string>"))
    ranges, files, hashes = maps.agg(F.count(F.lit(1)), F.count_distinct("file"),
                                     F.count_distinct("h")).first()
    if ranges > MAX_RANGES:
        raise ValueError(f"{ranges} ranges in one read; raise spark.sql.files.maxPartitionBytes or "
                         f"read fewer files at a time (at most {MAX_RANGES})")
    if files != hashes:
        raise ValueError("two file names share a hash; read them apart")
    states = range_states(maps) if multi_line else maps.select("h", "start",
                                                               F.lit(False).alias("inside"))
    got = states.orderBy("h", "start").toArrow()
    at = tuple(got.column(k).to_numpy() for k in range(3))
    headed = maps.where(F.col("header").isNotNull())
    headers = [r[0] for r in headed.select("header").distinct().orderBy("header")
               .limit(MAX_LAYOUTS + 1).collect()]
    if len(headers) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different headers in one read")
    numbered = spark.createDataFrame(list(enumerate(headers)), "layout int, header array<string>")
    of = headed.join(F.broadcast(numbered), "header").select("h", "layout").orderBy("h").toArrow()
    layouts = (of.column(0).to_numpy(), of.column(1).to_numpy(), headers)

    both = _records(lines, columns, at, layouts, multi_line=multi_line, absent_null=absent_null) \
        .select("file", "start", "n", "values")
    if multi_line:
        # files with a record that a range leaves open; lines of the others go no further. A filter
        # on their names would reach the listing of files, and fewer files are cut into other ranges
        left = maps.join(states, ["h", "start"]).where(
            F.when(F.col("inside"), F.col("from_in")).otherwise(F.col("from_out")))
        crossed = checkpointed(left.select("h").distinct())
        if crossed.first() is not None:
            some = lines.join(F.broadcast(crossed), "h", "left_semi")
            pieces = _records(some, columns, at, layouts, fragments=True)
            both = both.unionByName(_crossing(pieces, columns, layouts, absent_null))
    rows = both.select(*[F.col("values")[k].alias(c) for k, c in enumerate(columns)],
                       "file", F.struct("file", "start", "n").alias("file_pos"))
    return rows, {c for hd in headers for c in hd} & set(columns)
