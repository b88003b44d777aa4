"""SentencePiece encoding and decoding by a max-plus parallel scan.

Every piece that matches a stretch of the text is an edge of a lattice over its positions. For a
byte-pair model the tokenization is the one path whose neighbouring pieces are all compatible
(see ``bpe_lattice``): in the max-plus semiring a step between compatible pieces weighs 0, any
other minus infinity, and the best path weighs 0.

A text is cut into chunks at fixed positions. What happens left of a cut matters to the right of
it only through the *boundary state*: the piece that covers the last character before the cut,
and where it starts. A chunk therefore yields a transfer matrix from its left states to its right
states; matrices of neighbours combine associatively (max-plus products), a parallel prefix scan
over them gives the best state at every cut, and each chunk is then backtraced on its own.

Where no piece can cross (before a word mark that follows another character) all paths meet in
one state, so a chunk with such a place has a matrix of rank one, and the words between the first
and the last such place of a chunk are encoded once and remembered, many words side by side. A
chunk without any is run from each left state until the runs agree, which they mostly do after a
few pieces; in a run of one character every run is followed up to its period only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelflow.llm.bpe_lattice import Pieces
from labelflow.llm.common import free_name, text_or_empty

MARK = "▁"
NEVER = -np.inf
#: Characters of texts whose words are looked up together.
TOGETHER = 1 << 20


class _Words(dict):
    """Stretch between two places that no piece crosses → its number; the ids of stretch k are
    ``flat[start[k]:start[k] + count[k]]``. With ``mark`` a stretch is given without its one word
    mark in front. Stretches asked for the first time are encoded together."""

    #: Beyond so many stretches or ids the table starts anew.
    LIMIT, IDS = 350_000, 4_000_000

    def __init__(self, codec, mark: str):
        super().__init__()
        self.codec, self.mark = codec, mark
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.flat = np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.fresh.append(self.mark + word)
        return k

    def ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches one after another, and how many each has."""
        if len(self) > self.LIMIT or len(self.flat) > self.IDS:
            self._reset()
        which = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            flat, count = self.codec.encode_stretches(self.fresh)
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, flat])
            self.fresh = []
        count = self.count[which]
        return self.flat[_ranges(self.start[which], count)], count


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``count`` of them, one range after another."""
    ends = np.cumsum(count)
    return np.repeat(start - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class _Run:
    """Pieces of valid paths by the position they end at: an own part up to ``upto``, then what
    another run has, or an own part that repeats with a period."""

    def __init__(self, own: dict, upto: int, then=None, period: int = 0):
        self.own, self.upto, self.then, self.period = own, upto, then, period

    def _at(self, i: int):
        if i <= self.upto:
            return self.own, i
        if self.then is not None:
            return self.then, i
        if self.period:
            return self.own, self.upto - (self.upto - i) % self.period
        return self.own, i

    def __contains__(self, i: int) -> bool:
        table, i = self._at(i)
        return i in table

    def __getitem__(self, i: int):
        table, i = self._at(i)
        return table[i]

    def get(self, i: int):
        return self[i] if i in self else None


class _Trie:
    """Pieces by their characters, for many positions at once: the child of node a by character
    class c is found under the key a * classes + c."""

    def __init__(self, piece: dict[str, int]):
        self.alphabet = np.array(sorted({ord(c) for p in piece for c in p}), np.uint32)
        classes = {chr(c): k for k, c in enumerate(self.alphabet.tolist())}
        self.classes = len(classes)
        child: dict[int, int] = {}
        ends = {}
        for p, i in piece.items():
            node = 0
            for c in p:
                node = child.setdefault(node * self.classes + classes[c], len(child) + 1)
            ends[node] = i
        self.piece = np.full(len(child) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.key = np.array(sorted(child), np.int64)
        self.to = np.array([child[k] for k in self.key.tolist()], np.int64)

    def step(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """Child nodes; 0 where there is none."""
        key = node * self.classes + letter
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.to[at], 0)

    def letters(self, codes: np.ndarray) -> np.ndarray:
        """Classes of characters; -1 for one that is in no piece."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), self.classes - 1)
        return np.where(self.alphabet[at] == codes, at, -1)


class Codec:
    """Encoder and decoder of one byte-pair SentencePiece model (identity normalisation with a
    leading word mark, byte fallback)."""

    CHUNK = 16384
    #: Stretches up to so many characters are encoded side by side, so many at a time.
    LONGEST, TOGETHER = 64, 16384
    SLOTS = 1 << 20

    def __init__(self, path: str, chunk: int | None = None):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.chunk = chunk or self.CHUNK
        self.piece = {sp.id_to_piece(i): i for i in range(n)
                      if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.rank = {p: -sp.get_score(i) for p, i in self.piece.items()}
        self.longest = max(map(len, self.piece), default=1)
        # text of every id, as bytes; control pieces have none
        out = [b"" if sp.is_control(i) else
               bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else
               " ⁇ ".encode() if sp.is_unknown(i) else
               sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.out_size = np.array([len(x) for x in out], np.int64)
        self.out_start = np.cumsum(self.out_size) - self.out_size
        if any(MARK in p.lstrip(MARK) for p in self.piece):
            raise ValueError("pieces that cross a word mark are not supported")
        self.ok = Pieces(self.rank)
        self.words, self.stretches = _Words(self, MARK), _Words(self, "")
        self.word = regex.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.trie = _Trie(self.piece)
        self.name = {i: p for p, i in self.piece.items()}
        # a character that is in no piece: a piece n that any neighbour is compatible with
        self.size = np.zeros(n + 1, np.int64)
        self.size[list(self.name)] = [len(p) for p in self.name.values()]
        self.size[n] = 1
        self.byte_id = np.array([self.byte.get(b, sp.unk_id()) for b in range(256)], np.int32)
        # pairs asked for last, by a slot of their own: (key, compatible)
        self.pair_key, self.pair_ok = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)

    # -- lattice ------------------------------------------------------------------------------

    def _advance(self, text: str, last: dict, lo: int, hi: int, until: int | None = None,
                 agree: dict | None = None) -> int:
        """Fill ``last[i]``, the piece of the valid path ending at i, for lo < i <= hi; pieces may
        start at positions already in ``last``, but none ends beyond ``hi``. With ``until``, no
        piece starts at or behind it. With ``agree``, stop as soon as the last ``longest``
        positions are the same there; gives the position reached."""
        piece, ok, longest, same = self.piece, self.ok, self.longest, 0
        for i in range(lo + 1, hi + 1):
            for size in range(1, longest + 1):
                at = i - size
                if at not in last:
                    if at < 0:
                        break
                    continue
                if until is not None and at >= until:
                    continue
                token = text[at:i]
                if size > 1 and token not in piece:
                    continue
                if last[at] is None or ok[last[at], token]:
                    last[i] = token
                    break
            if agree is not None:
                same = same + 1 if last.get(i) == agree.get(i) else 0
                if same >= longest:
                    return i
        return hi

    def _word_ids(self, text: str) -> tuple:
        """Ids of a stretch that stands alone: forward over its positions, then back."""
        piece, ok, longest, last = self.piece, self.ok, self.longest, [""]
        for i in range(1, len(text) + 1):
            for size in range(1, min(i, longest) + 1):
                token = text[i - size:i]
                if size > 1 and token not in piece:
                    continue
                if size == i or ok[last[i - size], token]:
                    last.append(token)
                    break
        end, got = len(text), []
        while end:
            got.append(last[end])
            end -= len(last[end])
        return tuple(self._ids(got[::-1]))

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pieces (ids) can be neighbours, for many pairs."""
        key = a * len(self.size) + b
        slot = (key * 2654435761 >> 8) % self.SLOTS
        alone = len(self.size) - 1
        free = (a == alone) | (b == alone)
        if free.any():
            got = free
            got[~free] = self._compatible(a[~free], b[~free])
            return got
        unknown = np.unique(key[self.pair_key[slot] != key])
        if len(unknown):
            name, ok = self.name, self.ok
            told = {}
            for k in unknown.tolist():
                x, y = divmod(k, len(self.size))
                told[k] = ok[name[x], name[y]]
            at = (unknown * 2654435761 >> 8) % self.SLOTS
            self.pair_key[at], self.pair_ok[at] = unknown, list(told.values())
            clash = self.pair_key[slot] != key  # another pair of this call took the slot
            got = self.pair_ok[slot]
            got[clash] = [told[k] if k in told else ok[name[k // len(self.size)],
                                                       name[k % len(self.size)]]
                          for k in key[clash].tolist()]
            return got
        return self.pair_ok[slot]

    def encode_stretches(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches that stand alone, one after another, and how many each has."""
        count = np.zeros(len(stretches), np.int64)
        parts: list = [None] * len(stretches)
        short = [k for k, t in enumerate(stretches) if len(t) <= self.LONGEST]
        short.sort(key=lambda k: -len(stretches[k]))
        together: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        done = np.zeros(len(stretches), bool)
        for lo in range(0, len(short), self.TOGETHER):
            some = short[lo:lo + self.TOGETHER]
            flat, n, known = self._side_by_side([stretches[k] for k in some])
            own = np.array(some)[known]
            done[own], count[own] = True, n
            together.append((own, n, flat))
        for k in np.flatnonzero(~done).tolist():
            parts[k] = self._word_ids(stretches[k])
            count[k] = len(parts[k])
        out = np.zeros(int(count.sum()), np.int32)
        start = np.cumsum(count) - count
        for own, n, flat in together:
            out[_ranges(start[own], n)] = flat
        for k, ids in enumerate(parts):
            if ids is not None:
                out[start[k]:start[k] + count[k]] = ids
        return out, count

    def _side_by_side(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and their numbers for those of ``words`` (longest first) whose every character is
        a piece or in none, and which ones these are."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        letter, alone = self.trie.letters(codes), len(self.size) - 1
        size = np.fromiter(map(len, words), np.int64, len(words))
        single = np.where(letter >= 0, self.trie.piece[self.trie.step(
            np.zeros(len(letter), np.int64), np.maximum(letter, 0))], alone)
        known = np.logical_and.reduceat(single >= 0, np.cumsum(size) - size) if len(words) else \
            np.zeros(0, bool)
        codes, letter, single = (x[np.repeat(known, size)] for x in (codes, letter, single))
        size = size[known]
        ends = np.cumsum(size)
        start = ends - size
        stop = np.repeat(ends, size)
        # token[k - 1][a]: the piece of k characters that starts at position a
        token = [single]
        live = np.flatnonzero(letter >= 0)
        node = self.trie.step(np.zeros(len(live), np.int64), letter[live])
        for k in range(2, self.longest + 1):
            # positions whose next character is beyond the word, or in no piece, go
            some = live + k <= stop[live]
            some[some] = letter[live[some] + k - 1] >= 0
            live, node = live[some], node[some]
            if not len(live):
                break
            node = self.trie.step(node, letter[live + k - 1])
            found = np.full(len(letter), -1, np.int32)
            some = node > 0
            live, node = live[some], node[some]
            found[live] = self.trie.piece[node]
            token.append(found)
        # last[i]: the piece of the valid path that ends with character i
        last = np.full(len(letter), -1, np.int64)
        alive = len(size)
        for i in range(1, int(size.max(initial=0)) + 1):
            while alive and size[alive - 1] < i:
                alive -= 1
            open_ = np.arange(alive)
            for k in range(1, min(i, len(token)) + 1):
                at = start[open_] + i - k
                piece = token[k - 1][at]
                can = piece >= 0
                if i > k:
                    some = np.flatnonzero(can)
                    can[some] = self._compatible(last[at[some] - 1], piece[some].astype(np.int64))
                hit = open_[can]
                last[start[hit] + i - 1] = piece[can]
                open_ = open_[~can]
                if not len(open_):
                    break
        # back from the ends, all at once
        steps, where, at = [], np.arange(len(size)), ends - 1
        while len(where):
            steps.append((where, last[at[where]], at[where]))
            at[where] -= self.size[steps[-1][1]]
            where = where[at[where] >= start[where]]
        count = np.bincount(np.concatenate([np.zeros(0, np.int64), *[x[0] for x in steps]]),
                            minlength=len(size))
        first = np.cumsum(count) - count
        out, of = np.zeros(int(count.sum()), np.int32), np.zeros(int(count.sum()), np.int64)
        for t, (where, piece, at) in enumerate(steps):
            out[first[where] + count[where] - 1 - t] = piece
            of[first[where] + count[where] - 1 - t] = at
        # characters in no piece are told by their bytes
        loose = out == alone
        if loose.any():
            c = codes[of[loose]]
            each = np.ones(len(out), np.int64)
            each[loose] += (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
            count = np.add.reduceat(each, first)
            data = c.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            out = np.repeat(out, each)
            out[np.repeat(loose, each)] = self.byte_id[np.frombuffer(data, np.uint8)]
        return out, count, np.flatnonzero(known)

    def _trace(self, last: dict, end: int, start: int) -> list[str]:
        got = []
        while end > start:
            got.append(last[end])
            end -= len(last[end])
        return got[::-1]

    def _ids(self, pieces: list[str]) -> list[int]:
        ids = []
        for p in pieces:
            i = self.piece.get(p)
            if i is None:
                ids.extend(self.byte[b] for b in p.encode())
            else:
                ids.append(i)
        return ids

    # -- chunks -------------------------------------------------------------------------------

    def _states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Boundary states at a cut: every lattice edge (start, end) over the character before."""
        return [(a, e) for a in range(max(0, cut - self.longest), cut)
                for e in range(cut, min(len(text), a + self.longest) + 1)
                if e - a == 1 or text[a:e] in self.piece]

    def _meets(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """First and last place in (lo, hi) that no piece crosses."""
        def is_one(i):
            return text[i] == MARK and text[i - 1] != MARK

        first = next((i for i in range(lo + 1, hi) if is_one(i)), None)
        if first is None:
            return None
        return first, next(i for i in range(hi - 1, lo, -1) if is_one(i))

    def _from_state(self, text: str, state: tuple[int, int], hi: int, agree=None) -> _Run:
        """Paths that begin with a boundary state's piece, up to position ``hi``."""
        a, e = state
        last = {e: text[a:e]}
        reached = self._advance(text, last, e, hi, agree=agree)
        return _Run(last, reached, agree if reached < hi else None)

    def _repeated(self, letter: str, a: int, e: int, hi: int) -> _Run:
        """Paths through a run of one character that begin with the piece from a to e: the same
        pieces come back as soon as ``longest`` positions in a row do."""
        last: dict = {e: letter * (e - a)}
        seen: dict = {}
        text = letter * (4 * self.longest)
        for i in range(e + 1, hi + 1):
            for size in range(1, self.longest + 1):
                token = text[:size]
                if i - size in last and (size == 1 or token in self.piece) \
                        and self.ok[last[i - size], token]:
                    last[i] = token
                    break
            if i >= e + self.longest:
                state = tuple(last.get(j) for j in range(i - self.longest + 1, i + 1))
                if state in seen:
                    return _Run(last, i, period=i - seen[state])
                seen[state] = i
        return _Run(last, hi)

    def _weight(self, last: dict, state: tuple[int, int], text: str) -> float:
        """0 if the state's piece can follow a path that ends where the piece starts."""
        a, e = state
        if a not in last:
            return NEVER
        return 0.0 if last[a] is None or self.ok[last[a], text[a:e]] else NEVER

    def encode(self, text: str) -> list[int]:
        """Ids of a text, as the library gives them without begin and end marks."""
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts one after another, and how many each has. The words of texts within one
        chunk are looked up together."""
        parts: list = [None] * len(texts)
        count = np.zeros(len(texts), np.int64)
        words: list[str] = []
        owner: list[tuple[int, int]] = []
        for k, t in enumerate(texts):
            if t and len(t) < self.chunk:
                own = (MARK + t.replace(" ", MARK)).split(MARK)[1:]
                if "" not in own:
                    words += own
                    owner.append((k, len(own)))
                    continue
            parts[k] = self._text_ids(t)
            count[k] = len(parts[k])
        flat, each = self.words.ids(words)
        ends = np.concatenate([[0], np.cumsum(each)])
        lo = 0
        for k, n in owner:
            parts[k] = flat[ends[lo]:ends[lo + n]]
            count[k], lo = len(parts[k]), lo + n
        return np.concatenate([np.zeros(0, np.int32), *parts]).astype(np.int32), count

    def _text_ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        s = MARK + text.replace(" ", MARK)
        n = len(s)
        cuts = [*range(0, n, self.chunk), n]
        if len(cuts) == 2:
            return self._stretch_ids(s)
        states = [[(0, 0)], *[self._states(s, c) for c in cuts[1:-1]], [(n, n)]]
        pieces = [self._transfer(s, cuts[k], cuts[k + 1], states[k], states[k + 1])
                  for k in range(len(cuts) - 1)]
        best = self._scan([p[0] for p in pieces])
        return np.concatenate([np.array(back(best[k], best[k + 1]), np.int32)
                               for k, (_, back) in enumerate(pieces)])

    def _stretch_ids(self, s: str) -> np.ndarray:
        """Ids of a string that begins with a word mark and ends where no piece crosses."""
        words = s.split(MARK)[1:]
        if "" in words:  # runs of marks
            return self.stretches.ids(self.word.findall(s))[0]
        return self.words.ids(words)[0]

    def _transfer(self, s: str, lo: int, hi: int, left: list, right: list):
        """The chunk's matrix (left states × right states) and its backtrace: given the states
        at both ends, the ids of the pieces that start in the chunk."""
        meets = self._meets(s, lo, hi) if hi - lo > 1 else None
        at_start = lo == 0
        if meets:
            first, final = meets
            heads = [({0: None} if at_start else {u[1]: s[u[0]:u[1]]}) for u in left]
            for u, last in zip(left, heads):
                self._advance(s, last, u[1], first)
            head = np.array([0.0 if first in last else NEVER for last in heads])
            # the first word mark's neighbours are always compatible: the path starts afresh
            tail_last = {final: None}
            self._advance(s, tail_last, final, hi)
            tail = np.array([0.0 if v[0] == v[1] else self._weight(tail_last, v, s)
                             if v[0] >= final else NEVER for v in right])
            if right[0][0] == right[0][1]:  # the end of the text
                tail = np.array([0.0])

            def back(u: int, v: int) -> list[int]:
                pre = self._trace(heads[u], first, left[u][1])
                end = right[v][0]
                post = self._trace(tail_last, end, final)
                middle = self._stretch_ids(s[first:final]).tolist() if final > first else []
                own = [] if right[v][0] == right[v][1] else [s[right[v][0]:right[v][1]]]
                return [*self._ids(pre), *middle, *self._ids(post), *self._ids(own)]

            return head[:, None] + tail[None, :], back
        # no such place: from every left state until the runs agree
        runs: list = []
        low, high = max(0, lo - self.longest), min(len(s), hi + self.longest)
        one = not at_start and s.count(s[lo], low, high) == high - low
        for u in left:
            if at_start:
                last = {0: None}
                self._advance(s, last, 0, hi)
            elif one:
                last = self._repeated(s[lo], *u, hi)
            else:
                last = self._from_state(s, u, hi, runs[0] if runs else None)
            runs.append(last)
        matrix = np.full((len(left), len(right)), NEVER)
        for i, last in enumerate(runs):
            for j, v in enumerate(right):
                if v[0] == v[1]:
                    matrix[i, j] = 0.0 if hi in last else NEVER
                elif not at_start and left[i] == v:
                    matrix[i, j] = 0.0  # one piece covers the whole chunk
                elif v[0] >= (0 if at_start else left[i][1]) and v[0] >= lo:
                    matrix[i, j] = self._weight(last, v, s)

        def back(u: int, v: int) -> list[int]:
            if not at_start and left[u] == right[v]:
                return []
            end = right[v][0]
            got = self._trace(runs[u], end, left[u][1])
            if right[v][0] != right[v][1]:
                got.append(s[right[v][0]:right[v][1]])
            return self._ids(got)

        return matrix, back

    @staticmethod
    def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Max-plus product; with weights 0 and minus infinity a state is reached if any is."""
        some = (a == 0).astype(np.float32) @ (b == 0).astype(np.float32)
        return np.where(some > 0, 0.0, NEVER)

    def _scan(self, matrices: list[np.ndarray]) -> list[int]:
        """Best state at every cut: prefix products by recursive doubling, the same from the
        right, and the state where both together are largest."""
        n = len(matrices)

        def prefixes(ms, product):
            done, d = list(ms), 1
            while d < n:
                done = [done[k] if k < d else product(done[k - d], done[k]) for k in range(n)]
                d *= 2
            return done

        fore = prefixes(matrices, self._product)
        hind = prefixes([m.T for m in reversed(matrices)], self._product)[::-1]
        best = [0]
        for k in range(1, n):
            total = fore[k - 1][0] + hind[k].T[:, 0]
            if total.max() == NEVER:
                raise ValueError("no valid path")
            best.append(int(total.argmax()))
        return [*best, 0]

    # -- decoding -----------------------------------------------------------------------------

    def decode(self, ids) -> str:
        """Text of ids: pieces joined, byte pieces read as UTF-8, without the leading mark."""
        return self.decode_all(np.asarray(ids, np.int64), np.array([len(ids)]))[0]

    def decode_all(self, flat: np.ndarray, count: np.ndarray) -> list[str]:
        """Texts of ids one after another, ``count`` for each: one gather of all their bytes."""
        length = self.out_size[flat]
        data = self.out_bytes[_ranges(self.out_start[flat], length)].tobytes()
        ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(count)])]
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return [t[1:] if t.startswith(" ") else t for t in texts]


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def add_ids(df: DataFrame, path: str, text_col: str = "text", out: str = "token_ids",
            decoded: str | None = None) -> DataFrame:
    """``df`` without ``text_col``, plus ``out`` (array of ids of the whole text under the model at
    ``path``) and, if named, ``decoded``: the text read back from the ids. Null and empty texts
    have no ids; a word mark inside a text is read back as the space it stands for. All other
    columns pass through; nothing is shuffled."""
    text = free_name(df, "_t")
    names = [c for c in df.columns if c not in (text_col, out, decoded)]
    fields = [*[df.schema[c] for c in names], T.StructField(out, T.ArrayType(T.IntegerType()))]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType()))
    sent = df.select(*[F.col(f"`{c}`") for c in names], text_or_empty(text_col).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            # texts of about a million characters together, so that tables stay small
            texts = b.column(len(names)).to_pylist()
            ids, counts, back, lo = [], [], [], 0
            while lo < len(texts):
                hi, chars = lo, 0
                while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= TOGETHER):
                    chars, hi = chars + len(texts[hi]), hi + 1
                flat, count = c.encode_all(texts[lo:hi])
                if decoded:
                    back += c.decode_all(flat, count)
                ids.append(flat)
                counts.append(count)
                lo = hi
            ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *counts]))
            column = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
            extra = [pa.array(back, pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], column, *extra],
                                             names=[f.name for f in fields])

    return sent.mapInArrow(run, T.StructType(fields))


def decode_ids(df: DataFrame, path: str, ids_col: str = "token_ids", out: str = "text"
               ) -> DataFrame:
    """``df`` plus ``out``: the text of the ids in ``ids_col`` (null ids: an empty text)."""
    names = [c for c in df.columns if c != out]
    at = names.index(ids_col)
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            got = [c.decode(ids or []) for ids in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())],
                                             names=[*names, out])

    return df.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)
