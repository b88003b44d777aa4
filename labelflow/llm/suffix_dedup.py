"""Removal of repeated byte strings across documents by suffix arrays.

Every byte that is covered by a ``length``-byte string which also starts in a document with a
smaller key is removed. The corpus is far larger than a task, so suffixes are first brought
together with those they can be equal to:

* *Anchors.* Among the ``length - GRAM + 1`` GRAM-byte strings inside a window of ``length`` bytes
  the one with the smallest hash is the window's anchor. Equal windows have equal anchors, so only
  anchors that occur in more than one document matter.
* *Contexts.* Around such an anchor lie at most ``length - GRAM + 1`` windows whose smallest hash
  it holds; the bytes they span are its context. Equal contexts are reduced to one, with the
  smallest key, before they are moved; contexts with the same anchor meet in one task.
* *Suffix array.* A task's contexts are one string (with ends between them). Two-stage sorting:
  suffixes smaller than their successors are sorted directly, the others are induced from them by
  scanning the buckets of the first byte in ascending order. Neighbours in the array whose common
  prefix reaches ``length`` are equal windows; the smallest key of such a run is compared with
  each member's own. Equal windows have their anchor at the same place, so a window is sorted only
  if another context has the same bytes from the anchor to half a window before or behind it.

Documents are dealt into groups of bounded size by a hash of key and text; a group's task finds
its anchors, then its contexts, and at last marks the bytes. What travels between the steps is
packed: one row per pair of group and bucket. Anchors that very many documents share go by longer
keys (the anchor with the bytes before or behind it), whose contexts hold only the bytes of their
own windows. Longer keys that are still frequent go by whole windows: one row per window and group,
with its smallest key, dealt by all its bytes, so no frequent phrase or passage fills one task.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.common import free_name, persisted, released, text_or_empty

GRAM = 20
#: The lowest bits of a key's hash carry a count on the way.
_LOW = np.uint64(15)
_SLICE = 1 << 16
#: What a group is told, in the place of a bucket: its shared and frequent anchors, its shared and
#: frequent longer keys.
_SHARED, _FREQUENT, _LONGER, _FREQUENT_LONGER = -1, -2, -3, -4
_NO_KEY = np.iinfo(np.int64).max  # a null key: no document is smaller because of it
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _words_at(buffer: np.ndarray) -> np.ndarray:
    """Little-endian 64-bit words at every byte position (reading 7 bytes beyond)."""
    return np.ndarray((len(buffer) - 7,), "<u8", buffer, strides=(1,))


def _slide(a: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` neighbours."""
    size = 1
    while size * 2 <= width:
        a, size = pick(a[:-size], a[size:]), size * 2
    return pick(a[:len(a) - (width - size)], a[width - size:]) if size < width else a


class Group:
    """A group's documents as one byte string with the places where a window may start."""

    def __init__(self, texts: list[str], keys: np.ndarray, length: int):
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.length, self.keys = length, keys
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        self.total = int(self.size.sum())
        # room on both sides for contexts and word reads
        self.pad = length + 8
        self.bytes = np.zeros(self.total + 2 * self.pad, np.uint8)
        self.bytes[self.pad:self.pad + self.total] = np.frombuffer(b"".join(raw), np.uint8)
        edge = np.zeros(self.total + 1, np.int8)
        enough = self.size >= length
        np.add.at(edge, self.start[enough], 1)
        np.add.at(edge, self.start[enough] + self.size[enough] - length + 1, -1)
        self.window = np.cumsum(edge, dtype=np.int8)[:self.total].astype(bool)

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        """Documents of positions (ascending input is not needed); empty ones hold none."""
        return np.searchsorted(self.start + self.size, pos, side="right")

    def _slices(self):
        """For slices of the bytes, where they begin, the anchors' places in them, the GRAM-byte
        strings' hashes, the hashes' order and, from ``wide - 1`` windows before the slice, every
        real window's smallest (0: none). Slices overlap."""
        n, wide = self.total, self.length - GRAM + 1
        for lo in range(0, n, _SLICE):
            windows = self.window[lo:lo + _SLICE]
            if not windows.any():
                continue
            # GRAM-byte strings of every window that starts here
            grams = len(windows) + wide - 1
            b = self.bytes[self.pad + lo:self.pad + lo + grams + GRAM + 8]
            w = _words_at(b)
            h = w[:grams] * _M1
            h ^= h >> np.uint64(29)
            h += w[8:8 + grams]
            h *= _M2
            h ^= h >> np.uint64(32)
            h += w[GRAM - 8:GRAM - 8 + grams]
            h *= _M1
            h ^= h >> np.uint64(31)
            order = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
            low = np.zeros(grams + wide - 1, np.uint32)
            low[wide - 1:grams] = np.where(windows, _slide(order, wide, np.minimum), 0)
            yield lo, np.flatnonzero(_slide(low, wide, np.maximum) == order), h, order, low

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of all anchors."""
        at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for lo, found, h, _, _ in self._slices():
            at.append(found + lo)
            hashes.append(h[found])
        pos, h = np.concatenate(at), np.concatenate(hashes)
        pos, first = np.unique(pos, return_index=True)
        return pos, h[first]

    def _around(self, wanted: np.ndarray):
        """Places, hashes and documents of the wanted anchors, and the windows [first, last)
        around each that are real and have no smaller hash: in those that have one, another anchor
        stands for it."""
        wide = self.length - GRAM + 1
        got = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), *np.zeros((2, 0), np.int64))]
        for lo, found, h, order, low in self._slices():
            h = h[found] & ~_LOW
            keep = _member(h, wanted)
            found = found[keep]
            own = np.lib.stride_tricks.sliding_window_view(low, wide)[found] \
                == order[found][:, None]
            got.append((found + lo, h[keep], own.argmax(axis=1),
                        wide - own[:, ::-1].argmax(axis=1)))
        pos, h, first, last = map(np.concatenate, zip(*got))
        order = np.argsort(pos, kind="stable")
        pos = pos[order]
        begins = np.flatnonzero(np.concatenate([[True], pos[1:] != pos[:-1]])) if len(pos) \
            else np.zeros(0, np.int64)
        if len(begins):
            first = np.minimum.reduceat(first[order], begins)
            last = np.maximum.reduceat(last[order], begins)
        pos = pos[begins]
        return pos, h[order[begins]], self.doc_of(pos), first, last

    def _halved(self, pos, h, doc, first, last):
        """The same anchors with half their windows each, under longer keys: windows [0, half)
        hold the bytes before the anchor, the others those behind it."""
        length, wide = self.length, self.length - GRAM + 1
        half, n = wide // 2, len(pos)
        longer = []
        for which, lo, hi in ((1, half - 1, wide - 1), (2, wide - 1 + GRAM, half + length)):
            view = np.lib.stride_tricks.sliding_window_view(self.bytes, hi - lo)
            near = _row_hash(view[pos + self.pad - (wide - 1) + lo]) if n \
                else np.zeros(0, np.uint64)
            longer.append(((h ^ near ^ np.uint64(which)) * _M2) & ~_LOW)
        out = (np.tile(pos, 2), np.concatenate(longer), np.tile(doc, 2),
               np.concatenate([first, np.maximum(first, half)]),
               np.concatenate([np.minimum(last, half), last]))
        real = out[3] < out[4]
        return tuple(x[real] for x in out)

    def longer_keys(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longer keys of the frequent anchors and their documents."""
        _, h, doc, *_ = self._halved(*self._around(frequent))
        return h, doc

    def contexts(self, shared: np.ndarray, frequent: np.ndarray, shared_longer: np.ndarray,
                 frequent_longer: np.ndarray):
        """Contexts of the shared anchors, equal ones once. Gives ``(rows, low, first, last, key,
        of, pos, doc)``: context bytes, the smallest document key, the windows [first, last) that
        are real, the key hash they are dealt by, and for every occurrence its context and place;
        and what :meth:`windows` gives for the windows under frequent longer keys. A frequent
        anchor's context becomes two, each with half its windows."""
        length, wide = self.length, self.length - GRAM + 1
        found = self._around(np.sort(np.concatenate([shared, frequent])))
        often = _member(found[1], frequent)
        halves = self._halved(*(x[often] for x in found))
        alone = _member(halves[1], frequent_longer)
        some = _member(halves[1], shared_longer) & ~alone
        pos, h, doc, first, last = (np.concatenate([x[~often], y[some]])
                                    for x, y in zip(found, halves))
        n, span = len(pos), wide - 1 + length
        view = np.lib.stride_tricks.sliding_window_view(self.bytes, span)
        rows = view[pos + self.pad - (wide - 1)].copy() if n else np.zeros((0, span), np.uint8)
        # bytes outside the own windows are blanked: equal surroundings are then equal rows
        column = np.arange(span)
        cut = np.flatnonzero((first > 0) | (last < wide))
        rows[cut] = np.where((column >= first[cut, None])
                             & (column < (last + length - 1)[cut, None]), rows[cut], 0)
        key = self.keys[doc]
        mixed = _row_hash(rows) ^ (first.astype(np.uint64) << np.uint64(8)) \
            ^ (last.astype(np.uint64) * _M1) ^ h
        order = np.argsort(mixed, kind="stable")
        same = np.zeros(len(order), bool)
        maybe = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
        a, b = order[maybe + 1], order[maybe]
        same[maybe + 1] = (first[a] == first[b]) & (last[a] == last[b]) & (h[a] == h[b]) \
            & (rows[a] == rows[b]).all(axis=1)
        of, one, low = _classes(order, same, key)
        return (rows[one], low, first[one], last[one], h[one], of, pos, doc), \
            self.windows(halves[0][alone], halves[3][alone], halves[4][alone])

    def windows(self, pos: np.ndarray, first: np.ndarray, last: np.ndarray):
        """The windows [first, last) around the places, equal ones once: ``(rows, low, key, of,
        at, doc)``; ``key`` is a hash of the whole window, ``at`` where an occurrence starts."""
        length, wide = self.length, self.length - GRAM + 1
        many = last - first
        at = np.unique(np.repeat(pos - (wide - 1) + last - np.cumsum(many), many)
                       + np.arange(many.sum()))
        doc = self.doc_of(at)
        view = np.lib.stride_tricks.sliding_window_view(self.bytes, length)
        h = np.zeros(len(at), np.uint64)
        for lo in range(0, len(at), 1 << 17):
            h[lo:lo + (1 << 17)] = _row_hash(view[at[lo:lo + (1 << 17)] + self.pad])
        order = np.argsort(h, kind="stable")
        same = np.zeros(len(order), bool)
        same[1:] = h[order[1:]] == h[order[:-1]]
        maybe = np.flatnonzero(same)
        for lo in range(0, len(maybe), 1 << 17):
            m = maybe[lo:lo + (1 << 17)]
            same[m] = (view[at[order[m]] + self.pad]
                       == view[at[order[m - 1]] + self.pad]).all(axis=1)
        of, one, low = _classes(order, same, self.keys[doc])
        return view[at[one] + self.pad], low, h[one], of, at, doc


def _classes(order: np.ndarray, same: np.ndarray, key: np.ndarray):
    """Classes of an order where ``same`` tells equal neighbours: each member's class, one member
    of each class, the smallest key of each class."""
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(~same) - 1
    begins = np.flatnonzero(~same)
    low = np.minimum.reduceat(key[order], begins) if len(begins) else np.zeros(0, np.int64)
    return of, order[begins], low


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _row_hash(rows: np.ndarray) -> np.ndarray:
    width = -(-max(1, rows.shape[1]) // 8) * 8
    full = np.zeros((len(rows), width), np.uint8)
    full[:, :rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for w in full.view("<u8").T:
        h = (h ^ w) * _M1
        h ^= h >> np.uint64(31)
    return h


# -- suffix array ----------------------------------------------------------------------------------


def _by_words(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """An order of the places ``at`` by the first ``depth`` bytes there: by the first eight, then
    only those that are still equal to a neighbour by the bytes that follow."""
    order = np.argsort(words[at].byteswap())
    key = words[at[order]]
    done, here = 8, np.arange(len(at))
    while len(key) > 1 and done < depth:
        same = np.concatenate([[False], key[1:] == key[:-1], [False]])
        tied = same[1:] | same[:-1]
        here, run = here[tied], np.cumsum(~same[:-1])[tied]
        if not len(here):
            break
        # a run's number and as many bytes as it leaves room for
        run = np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))
        room = (64 - int(run[-1]).bit_length()) // 8
        some = order[here]
        key = words[at[some] + done].byteswap() >> np.uint64(64 - 8 * room)
        if room < 8:
            key |= run.astype(np.uint64) << np.uint64(8 * room)
        again = np.argsort(key)
        order[here], key = some[again], key[again]
        done += room
    return order


def two_stage_order(rows: np.ndarray, depth: int, upto: int, first: np.ndarray | None = None,
                    last: np.ndarray | None = None) -> np.ndarray:
    """Suffixes (row * (width + 1) + column) of the rows, each row ended by a symbol below all
    bytes, that start at columns up to ``upto`` (if given, at a row's columns [first, last) of
    these), in lexicographic order of their first ``depth`` bytes."""
    n, width = rows.shape
    stride = width + 1
    symbol = np.zeros((n, stride), np.uint16)
    symbol[:, :width] = rows
    symbol[:, :width] += 1
    flat = symbol.ravel()
    # smaller than its successor? As the first neighbours from there on that differ
    differ = np.flatnonzero(flat[1:] != flat[:-1])
    smaller = np.zeros(len(flat), bool)
    if len(differ):
        smaller[:differ[-1] + 1] = np.repeat(flat[differ] < flat[differ + 1],
                                             np.diff(differ, prepend=-1))
    smaller[width::stride] = False
    column = np.arange(stride)
    wanted = np.zeros((n, stride), bool)
    wanted[:] = column <= upto
    if first is not None:
        wanted &= (column >= first[:, None]) & (column < last[:, None])
    want = wanted.ravel()
    asked = want.copy()
    # behind these only what larger suffixes among them are induced from
    more = np.flatnonzero(want & ~smaller)
    while len(more):
        more = more[more % stride < width] + 1
        more = more[~want[more]]
        want[more] = True
        more = more[~smaller[more]]
    # stage one: sort the smaller ones directly, by 8-byte words
    direct = np.flatnonzero(smaller & want)
    words = _words_at(np.concatenate([rows.ravel(), np.zeros(depth + 16, np.uint8)]))
    # position without the end symbols
    direct = direct[_by_words(words, direct - direct // stride, depth)]
    bounds = np.searchsorted(flat[direct], np.arange(258))
    # stage two: scan the buckets in ascending order; a suffix's predecessor with a larger (or,
    # in a run, equal) first symbol takes the next place of its bucket
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    out = []
    for v in range(257):
        if v == 0:
            ends = np.arange(width, n * stride, stride)
            parts = [ends[want[ends]]]
        else:
            layer = np.concatenate(pending[v]) if pending[v] else np.zeros(0, np.int64)
            pending[v] = []
            parts = []
            while len(layer):
                parts.append(layer)
                layer = layer[layer % stride > 0] - 1
                layer = layer[want[layer] & (flat[layer] == v)]
            parts.append(direct[bounds[v]:bounds[v + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket % stride > 0] - 1
        sym = flat[before]
        up = want[before] & (sym > v)
        before, sym = before[up], sym[up]
        if len(before):
            order = np.argsort(sym, kind="stable")
            before, sym = before[order], sym[order]
            cuts = np.flatnonzero(np.concatenate([[True], sym[1:] != sym[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(sym)]):
                pending[sym[a]].append(before[a:b])
    order = np.concatenate(out) if out else np.zeros(0, np.int64)
    return order[asked[order]]


def smallest_keys(rows: np.ndarray, first: np.ndarray, last: np.ndarray, low: np.ndarray,
                  length: int) -> np.ndarray:
    """For each context and window the smallest ``low`` among the contexts that hold the same
    ``length`` bytes at any of their real windows."""
    n, width = rows.shape
    wide, stride = width - length + 1, width + 1
    out = np.full((n, wide), _NO_KEY, np.int64)
    row, col = np.divmod(two_stage_order(rows, length, wide - 1, first, last), stride)
    if not len(row):
        return out
    at = row * width + col
    words = _words_at(np.concatenate([rows.ravel(), np.zeros(8, np.uint8)]))
    # common prefix of neighbours: does it reach the length?
    equal = np.ones(len(at) - 1, bool)
    for o in [*range(0, length - 8, 8), length - 8]:
        w = words[at + o]
        equal &= w[1:] == w[:-1]
    begins = np.flatnonzero(np.concatenate([[True], ~equal]))
    least = np.minimum.reduceat(low[row], begins)
    out[row, col] = np.repeat(least, np.diff(np.append(begins, len(at))))
    return out


def with_partners(rows: np.ndarray, first: np.ndarray, last: np.ndarray, length: int):
    """The windows [first, last) of each context without those that no other context can hold
    around its anchor: a window before the middle covers the bytes from there to the anchor's end,
    any other those from the anchor's start to the middle one's end."""
    wide = rows.shape[1] - length + 1
    half = wide // 2
    first, last = first.astype(np.int64), last.astype(np.int64)
    alone = []
    for lo, hi, some in ((half - 1, length, first < half),
                         (wide - 1, half + length, last > half)):
        h = _row_hash(rows[:, lo:hi])
        order = np.flatnonzero(some)
        order = order[np.argsort(h[order])]
        same = np.concatenate([[False], h[order[1:]] == h[order[:-1]], [False]])
        one = np.zeros(len(rows), bool)
        one[order] = ~(same[1:] | same[:-1])[:len(order)]
        alone.append(one)
    return np.where(alone[0], np.maximum(first, half), first), \
        np.where(alone[1], np.minimum(last, half), last)


# -- Spark -----------------------------------------------------------------------------------------


def _packed(bucket: np.ndarray, columns: dict[str, np.ndarray]):
    """Rows of ``columns`` per bucket, as bytes; the order inside a bucket is kept."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    cuts = np.flatnonzero(np.concatenate([[True], sorted_bucket[1:] != sorted_bucket[:-1]])) \
        if len(order) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        some = order[a:b]
        yield int(sorted_bucket[a]), some, {k: v[some].tobytes() for k, v in columns.items()}


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


def _read(column: pa.ChunkedArray, dtype) -> np.ndarray:
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def remove_repeats(df: DataFrame, key_col: str = "doc_id", text_col: str = "text",
                   length: int = 50, group_bytes: int = 8 << 20, frequent: int = 5_000,
                   as_text: bool = False) -> DataFrame:
    """``df`` without ``text_col``, plus ``kept`` (binary: the remaining bytes), ``n_bytes``,
    ``n_removed`` and ``n_spans`` (maximal removed runs). With ``as_text`` ``kept`` is a string,
    without the characters of which only some bytes remain.

    Texts are whole UTF-8 byte strings; null texts are empty. Matches never cross documents and
    are judged on the input. Rows under one key do not remove from each other; a null key counts
    as larger than all others, and null keys do not remove from each other. Repeated rows stay;
    an empty table gives no rows. An anchor found in more than about ``frequent`` documents is
    dealt by its longer keys, and one of these by its windows."""
    if not GRAM + 1 <= length <= GRAM + 31:
        raise ValueError(f"length must lie in {GRAM + 1} to {GRAM + 31}")
    wide, span = length - GRAM + 1, 2 * length - GRAM
    names = [c for c in df.columns
             if c not in (text_col, "kept", "n_bytes", "n_removed", "n_spans")]
    key, text, g = (free_name(df, x) for x in ("_key", "_text", "_g"))
    sent = df.select(*[F.col(f"`{c}`") for c in names],
                     F.coalesce(F.col(f"`{key_col}`").cast("bigint"), F.lit(_NO_KEY)).alias(key),
                     text_or_empty(text_col).alias(text))
    total = sent.agg(F.sum(F.octet_length(text).cast("bigint"))).first()[0] or 0
    groups = max(64, -(-total // group_bytes))
    dealt = sent.withColumn(g, F.pmod(F.xxhash64(key, text), F.lit(groups)).cast("int"))

    def group_of(t: pa.Table) -> Group:
        return Group(t.column(text).to_pylist(), t.column(key).to_numpy(), length)

    def counted(h: np.ndarray, doc: np.ndarray, own_g) -> pa.Table:
        h = h & ~_LOW
        order = np.argsort(h, kind="stable")  # a key's documents come in ascending order
        h, doc = h[order], doc[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h = h[fresh]
        begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) \
            else np.zeros(0, np.int64)
        # the lowest bits say how many documents of this group have the key, as a power of two
        count = np.diff(np.append(begins, len(h)))
        h = h[begins] | np.minimum(15, np.log2(np.maximum(count, 1)).astype(np.int64) + 1) \
            .astype(np.uint64)
        got = list(_packed(_bucket(h, groups), {"h": h}))
        return pa.table({"bucket": pa.array([b for b, _, _ in got], pa.int32()),
                         "g": pa.array([own_g] * len(got), pa.int32()),
                         "h": pa.array([x["h"] for _, _, x in got], pa.binary())})

    def anchor_rows(t: pa.Table) -> pa.Table:
        pos, h = (own := group_of(t)).anchors()
        return counted(h, own.doc_of(pos), t.column(g)[0].as_py())

    def told(some: int, many: int):
        def rows(t: pa.Table) -> pa.Table:
            parts = [np.frombuffer(x, np.uint64) for x in t.column("h").to_pylist()]
            h = np.concatenate(parts)
            owner = np.repeat(t.column("g").to_numpy(), list(map(len, parts)))
            order = np.argsort(h, kind="stable")
            h, owner = h[order], owner[order]
            bare = h & ~_LOW
            begins = np.flatnonzero(np.concatenate([[True], bare[1:] != bare[:-1]]))
            entries = np.diff(np.append(begins, len(h)))
            docs = np.add.reduceat(np.uint64(1) << ((h & _LOW) - np.uint64(1)), begins)
            kind, out = np.repeat(docs > frequent, entries), []
            for code, keep in ((some, np.repeat(docs > 1, entries) & ~kind),
                               (many, np.repeat(docs > 1, entries) & kind)):
                out += [(b, code, x["h"]) for b, _, x in
                        _packed(owner[keep].astype(np.int64), {"h": bare[keep]})]
            return pa.table({"g": pa.array([x[0] for x in out], pa.int32()),
                             "bucket": pa.array([x[1] for x in out], pa.int32()),
                             "data": pa.array([x[2] for x in out], pa.binary())})
        return rows

    counts, notes_type = "bucket int, g int, h binary", "g int, bucket int, data binary"
    shared = dealt.groupBy(g).applyInArrow(lambda t: released(anchor_rows(t)), counts) \
        .groupBy("bucket").applyInArrow(told(_SHARED, _FREQUENT), notes_type)

    def known(notes: pa.Table, code: int) -> np.ndarray:
        return np.sort(_read(notes.filter(pa.compute.equal(notes.column("bucket"), code))
                             .column("data"), np.uint64))

    def longer_rows(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows or not notes.num_rows:
            return counted(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0)
        return counted(*group_of(docs).longer_keys(known(notes, _FREQUENT)),
                       docs.column(g)[0].as_py())

    longer = dealt.groupBy(g) \
        .cogroup(shared.where(F.col("bucket") == _FREQUENT).groupBy("g")) \
        .applyInArrow(longer_rows, counts) \
        .groupBy("bucket").applyInArrow(told(_LONGER, _FREQUENT_LONGER), notes_type)
    asked = shared.unionByName(longer)

    def contexts_of(docs: pa.Table, notes: pa.Table):
        own = group_of(docs)
        return own, *own.contexts(*(known(notes, code) for code in
                                    (_SHARED, _FREQUENT, _LONGER, _FREQUENT_LONGER)))

    def context_rows(docs: pa.Table, notes: pa.Table) -> pa.Table:
        names_ = ("bucket", "g", "rows", "low", "first", "last")
        out: dict = {c: [] for c in names_}
        if docs.num_rows and notes.num_rows:
            _, (rows, low, first, last, h, *_), (wrows, wlow, wh, *_) = contexts_of(docs, notes)
            for base, at, columns in (
                    (0, h, {"rows": rows, "low": low, "first": first.astype(np.uint8),
                            "last": last.astype(np.uint8)}),
                    # buckets from ``groups`` on hold windows
                    (groups, wh, {"rows": wrows, "low": wlow})):
                for b, _, x in _packed(_bucket(at, groups), columns):
                    out["bucket"].append(base + b)
                    out["g"].append(docs.column(g)[0].as_py())
                    out["rows"].append(zlib.compress(x["rows"], 1))
                    for c in ("low", "first", "last"):
                        out[c].append(x.get(c, b""))
        kinds = dict.fromkeys(names_, pa.binary()) | {"bucket": pa.int32(), "g": pa.int32()}
        return pa.table({c: pa.array(out[c], kinds[c]) for c in names_})

    contexts = dealt.groupBy(g).cogroup(asked.groupBy("g")).applyInArrow(
        lambda docs, own: released(context_rows(docs, own)),
        "bucket int, g int, rows binary, low binary, first binary, last binary")

    def judged_rows(t: pa.Table) -> pa.Table:
        whole = t.column("bucket")[0].as_py() >= groups
        parts = [np.frombuffer(zlib.decompress(x), np.uint8).reshape(-1, length if whole else span)
                 for x in t.column("rows").to_pylist()]
        rows = np.concatenate(parts)
        low = _read(t.column("low"), np.int64)
        ends = np.cumsum(list(map(len, parts)))

        def replies(data: np.ndarray) -> pa.Table:
            return pa.table({
                "g": t.column("g").cast(pa.int32()), "bucket": t.column("bucket").cast(pa.int32()),
                "data": pa.array([data[e - len(p):e].tobytes() for e, p in zip(ends, parts)],
                                 pa.binary())})

        if whole:  # sorted by all their bytes
            full = np.zeros((len(rows), -(-length // 8) * 8), np.uint8)
            full[:, :length] = rows
            words = full.view("<u8").T
            order = np.lexsort(words)
            same = np.zeros(len(order), bool)
            same[1:] = (words[:, order[1:]] == words[:, order[:-1]]).all(axis=0)
            of, _, least = _classes(order, same, low)
            return replies((least[of] < low).astype(np.uint8))
        first, last = (_read(t.column(c), np.uint8) for c in ("first", "last"))
        # equal contexts of different groups are one suffix set, with the smallest key
        mixed = _row_hash(rows) ^ (first.astype(np.uint64) << np.uint64(8)) \
            ^ (last.astype(np.uint64) * _M1)
        order = np.argsort(mixed, kind="stable")
        same = np.zeros(len(order), bool)
        maybe = np.flatnonzero(mixed[order[1:]] == mixed[order[:-1]])
        a, b = order[maybe + 1], order[maybe]
        same[maybe + 1] = (first[a] == first[b]) & (last[a] == last[b]) \
            & (rows[a] == rows[b]).all(axis=1)
        of, one, own = _classes(order, same, low)
        begin, end = with_partners(rows[one], first[one], last[one], length)
        some = np.flatnonzero(begin < end)
        least = np.repeat(own[:, None], wide, axis=1)
        least[some] = np.minimum(least[some], smallest_keys(
            rows[one[some]], begin[some], end[some], own[some], length))
        bits = np.zeros((len(rows), 32), bool)
        for lo in range(0, len(rows), 1 << 16):  # removed also from the group's smallest document
            hi = lo + (1 << 16)
            bits[lo:hi, :wide] = least[of[lo:hi]] < low[lo:hi, None]
        return replies(np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel())

    judged = contexts.groupBy("bucket") \
        .applyInArrow(lambda t: released(judged_rows(t)), notes_type)

    kept_type = T.StringType() if as_text else T.BinaryType()
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("kept", kept_type),
                           *[T.StructField(c, T.LongType())
                             for c in ("n_bytes", "n_removed", "n_spans")]])

    def finish(docs: pa.Table, notes: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({c: pa.array([], pa.null()) for c in schema.names})
        own = group_of(docs)
        gone = np.zeros(own.total, bool)
        if notes.num_rows:
            own, (rows, low, first, last, h, of, pos, doc), \
                (wrows, wlow, wh, wof, at, wdoc) = contexts_of(docs, notes)
            verdict = np.zeros(len(rows), np.uint32)
            replies = {b: d for b, d in zip(notes.column("bucket").to_pylist(),
                                            notes.column("data").to_pylist()) if b >= 0}
            for b, some, _ in _packed(_bucket(h, groups), {}):
                verdict[some] = np.frombuffer(replies[b], np.uint32)
            alone = np.zeros(len(wrows), bool)
            for b, some, _ in _packed(_bucket(wh, groups), {}):
                alone[some] = np.frombuffer(replies[groups + b], np.uint8)
            starts = np.zeros(own.total + 1, bool)
            starts[at] = alone[wof] | (own.keys[wdoc] > wlow[wof])
            for lo in range(0, len(of), 1 << 17):
                o = of[lo:lo + (1 << 17)]
                bits = np.unpackbits(verdict[o].view(np.uint8).reshape(-1, 4), axis=1,
                                     bitorder="little")[:, :wide].astype(bool)
                # behind another document of the group with the same context: every window
                behind = own.keys[doc[lo:lo + (1 << 17)]] > low[o]
                bits |= behind[:, None]
                column = np.arange(wide)
                bits &= (column >= first[o][:, None]) & (column < last[o][:, None])
                r, c = np.nonzero(bits)
                starts[pos[lo:lo + (1 << 17)][r] - (wide - 1) + c] = True
            gone = _slide(np.concatenate([np.zeros(length - 1, bool), starts[:own.total]]),
                          length, np.logical_or)
        body = own.bytes[own.pad:own.pad + own.total]
        kept, removed, spans = [], [], []
        for s, n in zip(own.start.tolist(), own.size.tolist()):
            mark = gone[s:s + n]
            lost = int(mark.sum())
            kept.append(body[s:s + n][~mark].tobytes() if lost else body[s:s + n].tobytes())
            removed.append(lost)
            spans.append(int((mark[1:] & ~mark[:-1]).sum() + mark[0]) if lost else 0)
        if as_text:
            kept = [k.decode("utf-8", "ignore") for k in kept]
        out = docs.select(names)
        for c, v, kind in (("kept", kept, pa.string() if as_text else pa.binary()), ("n_bytes", own.size, pa.int64()),
                           ("n_removed", removed, pa.int64()), ("n_spans", spans, pa.int64())):
            out = out.append_column(c, pa.array(v, kind))
        return out

    notes = asked.unionByName(judged)
    return dealt.groupBy(g).cogroup(notes.groupBy("g")) \
        .applyInArrow(lambda docs, own: released(finish(docs, own)), schema)
