"""Token counts by a compiled finite-state tokenizer.

Two deterministic transducers in a row give a text's token count exactly as the tokenizer
library does, without building the tokens:

* ``Splitter`` reads character classes and emits the starts of pre-tokens (letter, number, other
  and white-space runs, contractions). It has eleven states. A text is cut into chunks; a chunk's
  *state map* says where each of the eleven states leads, maps of neighbours compose
  associatively, and a parallel prefix scan over them gives every chunk its true start state, so
  that all chunks then emit at once.
* ``MergeCounter`` reads the bytes of a pre-token. Its states are byte strings (a trie) and every
  transition is annotated with the tokens it emits, the change of the count from one prefix to
  the next (-1, 0 or more). States are compiled when first reached: the last token of a longer
  prefix is the one that ends there and is compatible with what stands before it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.bpe_lattice import Neighbours
from labelflow.llm.common import free_name, text_or_empty

# character classes
END, LETTER, STMD, RV, E, L, NUMBER, QUOTE, SPACE, WHITE, OTHER = range(11)
# states: nothing behind / in a run / after white space (one or more, last is a space or not) /
# behind an apostrophe that starts a pre-token, and behind its r or v, or its l
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE, \
    APOSTROPHE, APO_RV, APO_L = range(11)
HERE, BEFORE = 1, 2  # outputs: a pre-token starts at this character, at the one before
CHUNK = 256


@lru_cache(1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    every = "".join(map(chr, points))
    table = np.full(0x110000, OTHER, np.uint8)
    at = np.array(points)
    for pattern, cls in ((r"\s+", WHITE), (r"\p{N}+", NUMBER), (r"\p{L}+", LETTER)):
        for m in regex.finditer(pattern, every):
            table[at[m.start():m.end()]] = cls
    for chars, cls in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L), ("'", QUOTE), (" ", SPACE)):
        table[[ord(c) for c in chars]] = cls
    return table


def _enter(cls: int) -> tuple[int, int]:
    """Next state and output when ``cls`` starts a pre-token of its own."""
    if cls == END:
        return START, 0
    if cls in (LETTER, STMD, RV, E, L):
        return IN_LETTERS, HERE
    return {NUMBER: IN_NUMBERS, QUOTE: APOSTROPHE, SPACE: ONE_SPACE, WHITE: ONE_WHITE,
            OTHER: IN_OTHER}[cls], HERE


def _step(state: int, cls: int) -> tuple[int, int]:
    letters = (LETTER, STMD, RV, E, L)
    if state == IN_LETTERS and cls in letters:
        return IN_LETTERS, 0
    if state == IN_NUMBERS and cls == NUMBER:
        return IN_NUMBERS, 0
    if state == IN_OTHER and cls in (OTHER, QUOTE):
        return IN_OTHER, 0
    if state in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
        if cls == END:
            return START, 0
        if cls in (SPACE, WHITE):
            return (MORE_SPACE if cls == SPACE else MORE_WHITE), 0
        # the last character of a longer run stands apart from the run
        apart = BEFORE if state in (MORE_SPACE, MORE_WHITE) else 0
        if state in (ONE_SPACE, MORE_SPACE):  # a space belongs to what follows
            to = IN_LETTERS if cls in letters else IN_NUMBERS if cls == NUMBER else IN_OTHER
            return to, apart
        to, out = _enter(cls)
        return to, out | apart
    if state == APOSTROPHE:
        if cls == STMD:
            return START, 0
        if cls == RV:
            return APO_RV, 0
        if cls == L:
            return APO_L, 0
        if cls in (OTHER, QUOTE):
            return IN_OTHER, 0
    if (state, cls) in ((APO_RV, E), (APO_L, L)):
        return START, 0
    if state in (APO_RV, APO_L):  # no contraction: the letter behind the apostrophe starts a run
        to, out = (IN_LETTERS, 0) if cls in letters else _enter(cls)
        return to, out | BEFORE
    return _enter(cls)


_N = 11
_NEXT = np.array([[_step(s, c)[0] for c in range(_N)] for s in range(_N)], np.uint8).ravel()
_OUT = np.array([[_step(s, c)[1] for c in range(_N)] for s in range(_N)], np.uint8).ravel()


def compose_prefixes(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (states × chunks) under composition, in log steps."""
    done, d = maps.copy(), 1
    while d < done.shape[1]:
        done[:, d:] = done[done[:, :-d], np.arange(d, done.shape[1])]
        d *= 2
    return done


def starts(classes: np.ndarray) -> np.ndarray:
    """Boolean per character: a pre-token starts here. ``classes`` may hold many texts, each
    followed by END."""
    n = len(classes)
    k = -(-n // CHUNK) or 1
    grid = np.full(k * CHUNK, END, np.uint8)
    grid[:n] = classes
    grid = np.ascontiguousarray(grid.reshape(k, CHUNK).T)
    maps = np.repeat(np.arange(_N, dtype=np.uint8)[:, None], k, axis=1)
    for row in grid:
        maps = _NEXT.take(maps * np.uint8(_N) + row)
    first = np.zeros(k, np.uint8)
    first[1:] = compose_prefixes(maps)[START, :-1]
    out, state = np.empty((CHUNK, k), np.uint8), first
    for j, row in enumerate(grid):
        code = state * np.uint8(_N) + row
        out[j] = _OUT.take(code)
        state = _NEXT.take(code)
    out = out.T.reshape(-1)
    flags = (out & HERE).astype(bool)
    flags[:-1] |= out[1:] >= BEFORE
    return flags[:n]


class MergeCounter(dict):
    """Pre-token → its number of tokens. Known strings are kept up to a bound; the transducer's
    states likewise (both tables then start afresh)."""

    KEEP, LONGEST, STATES = 800_000, 48, 900_000

    def __init__(self, merges: list[tuple[bytes, bytes]], vocabulary: list[bytes]):
        super().__init__()
        self.token = {t: i for i, t in enumerate(vocabulary)}
        self.longest = max(map(len, vocabulary), default=1)
        ids = self.token
        self.ok = Neighbours({(ids[a], ids[b]): r for r, (a, b) in enumerate(merges)},
                             {ids[a + b]: (r, ids[a], ids[b])
                              for r, (a, b) in enumerate(merges)})
        self._clear()

    def _clear(self):
        self.clear()
        self.to: dict[int, int] = {}            # state and byte → state
        self.emit, self.last = [0], [-1]         # of a state: tokens emitted, last token

    def __missing__(self, pretoken: str) -> int:
        """Walk the compiled transitions, then compile on from the last known state. Of the new
        states only the first is kept, so prefixes that recur grow one byte at a time and rare
        endings take no memory."""
        text = pretoken.encode()
        if len(self) >= self.KEEP or len(self.last) >= self.STATES:
            self._clear()
        to, known, longest, ok = self.to, self.token, self.longest, self.ok
        state = total = done = 0
        last, count = [-1], [0]  # of every prefix: its last token, its number of tokens
        for byte in text:
            new = to.get(state << 8 | byte)
            if new is None:
                break
            state = new
            total += self.emit[state]
            last.append(self.last[state])
            count.append(total)
            done += 1
        for n in range(done + 1, len(text) + 1):
            for size in range(1, min(n, longest) + 1):
                token = known.get(text[n - size:n])
                if token is not None and (size == n or ok[last[n - size], token]):
                    break
            else:
                raise ValueError(f"no token ends {text[:n]!r}")
            last.append(token)
            count.append(count[n - size] + 1)
            if n == done + 1 and n <= self.LONGEST:
                to[state << 8 | text[done]] = len(self.last)
                self.last.append(token)
                self.emit.append(count[n] - total)
        if len(text) <= self.LONGEST:
            self[pretoken] = count[-1]
        return count[-1]


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokenizer:
    """Counts tokens of texts as the tokenizer file's library does (byte-level BPE)."""

    SLICE = 1 << 20  # characters scanned at a time; a longer text is scanned alone

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        self.special = [t["content"] for t in spec["added_tokens"]]
        named = set(self.special)
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        merges = [(raw(a), raw(b)) for a, b in pairs]
        self.counter = MergeCounter(merges, [raw(t) for t in model["vocab"] if t not in named])
        self.pattern = regex.compile("|".join(map(regex.escape, self.special))) \
            if self.special else None
        self.classes = _classes()

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text; special strings inside a text are one token each."""
        out = np.zeros(len(texts), np.int64)
        pieces, owners, size = [], [], 0
        for r, t in enumerate(texts):
            parts = [t]
            if self.special and any(s in t for s in self.special):
                parts = self.pattern.split(t)
                out[r] += len(parts) - 1
            for p in parts:
                pieces.append(p)
                owners.append(r)
                size += len(p)
            if size >= self.SLICE:
                self._add(pieces, owners, out)
                pieces, owners, size = [], [], 0
        self._add(pieces, owners, out)
        return out

    def _add(self, pieces: list[str], owners: list[int], out: np.ndarray) -> None:
        if not pieces:
            return
        joined = "\n".join(pieces) + "\n"
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        classes = self.classes.take(codes)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1) - 1
        classes[ends] = END
        flags = starts(classes)
        flags[ends] = True
        cut = np.flatnonzero(flags)
        at = cut.tolist()
        counter = self.counter
        got = np.fromiter((counter[joined[a:b]] for a, b in zip(at, [*at[1:], len(joined)])),
                          np.int64, len(at))
        got[classes.take(cut) == END] = 0
        total = np.concatenate([[0], np.cumsum(got)])
        upto = total[np.searchsorted(cut, ends)]
        np.add.at(out, owners, np.diff(upto, prepend=0))


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def add_token_counts(df: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens"
                     ) -> DataFrame:
    """``df`` without ``text_col``, plus ``out`` (long): the tokens of each whole text by the
    byte-level tokenizer file at ``path`` (which every worker can read). Null texts count as
    empty (0 tokens); all other columns pass through; no rows give no rows. Nothing is shuffled."""
    text = free_name(df, "_t")
    names = [c for c in df.columns if c not in (text_col, out)]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, T.LongType())])
    sent = df.select(*[F.col(f"`{c}`") for c in names], text_or_empty(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches:
            got = tok.counts(b.column(len(names)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], pa.array(got)],
                                             names=[*names, out])

    return sent.mapInArrow(run, schema)
