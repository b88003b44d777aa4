"""Byte-pair tokenizations as paths of compatible tokens.

A sequence of tokens is what byte-pair merging gives for the string it spells exactly when every
two neighbours are *compatible*: merging their concatenation alone gives the same two tokens
back. (A merge across a border would have to happen first somewhere, and would then also happen
in that pair alone.) So the last token of a prefix's tokenization is the one token that ends
there and is compatible with the last token of the prefix before it.
"""

from __future__ import annotations

import heapq


def merged(symbols: list, join) -> list:
    """Byte-pair merging of ``symbols``: while some neighbours can be joined, join the pair of the
    lowest rank, leftmost first. ``join(a, b)`` gives ``(rank, symbol)`` or None."""
    n = len(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    alive = list(symbols)
    heap = []

    def offer(i):
        j = right[i]
        if j >= 0 and (got := join(alive[i], alive[j])) is not None:
            heapq.heappush(heap, (got[0], i, alive[i], alive[j], got[1]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        if alive[i] != a or (j := right[i]) < 0 or alive[j] != b:
            continue
        alive[i], alive[j] = new, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [s for s in alive if s is not None]


class Pieces(dict):
    """(a, b) → whether two pieces, given as strings, are compatible, for a vocabulary in which any
    two neighbours may join whose concatenation is a piece. ``rank``: piece → rank.

    As in :class:`Neighbours` the merges at the border are undone from the youngest on. That
    needs pieces that are made in the order of their ranks; for a pair with any other piece the
    two are merged outright."""

    LIMIT = 500_000

    def __init__(self, rank):
        super().__init__()
        self.rank = rank
        self.known: dict = {}
        seen: dict = {}
        for p, r in rank.items():
            seen.setdefault(r, []).append(p)
        self.shared = {p for ps in seen.values() if len(ps) > 1 for p in ps if len(p) > 1}

    def split(self, text: str) -> list[str]:
        rank = self.rank
        return merged(list(text), lambda a, b: (r, a + b)
                      if (r := rank.get(a + b)) is not None else None)

    def made(self, piece: str):
        """(rank, left, right) of the merge that makes the piece; None for a single character,
        False where ranks do not tell the order."""
        if len(piece) == 1:
            return None
        got = self.known.get(piece)
        if got is None:
            rank, parts = self.rank, []
            whole = merged(list(piece), lambda a, b: (r, (parts.append((a + b, a, b)), a + b)[1])
                           if (r := rank.get(a + b)) is not None else None)
            got = False
            if whole == [piece] and piece not in self.shared:
                mine = rank[piece]
                _, left, right = next(x for x in parts if x[0] == piece)
                below = [self.made(x) for x in (left, right)]
                if all(m is None or m and m[0] < mine for m in below) \
                        and sum(x[0] == piece for x in parts) == 1:
                    got = (mine, left, right)
            self.known[piece] = got
        return got

    def __missing__(self, pair):
        if len(self) >= self.LIMIT:
            self.clear()
        self[pair] = ok = self._stand(*pair)
        return ok

    def _stand(self, a: str, b: str) -> bool:
        whole, rank, due = (a, b), self.rank, float("inf")
        while True:
            across = rank.get(a + b)
            if across is not None and across < due:
                return False
            in_a, in_b = self.made(a), self.made(b)
            if in_a is False or in_b is False:
                return self.split(whole[0] + whole[1]) == list(whole)
            if in_a is None and in_b is None:
                return True
            if in_b is None or in_a is not None and in_a[0] > in_b[0]:
                due, a = in_a[0], in_a[2]
            else:
                due, b = in_b[0] + 1, in_b[1]


class Neighbours(dict):
    """(a, b) → whether two tokens are compatible, for a merge table in which every token has one
    merge that makes it. Told without merging: undo the youngest merge at the border, again and
    again; the tokens stand if at no time a merge across the border was due before that one.

    ``rank``: (a, b) → rank of their merge. ``made``: token → (rank, left part, right part) of
    the merge that makes it; base tokens are absent."""

    LIMIT = 500_000

    def __init__(self, rank, made):
        super().__init__()
        self.rank, self.made = rank, made

    def __missing__(self, pair):
        if len(self) >= self.LIMIT:
            self.clear()
        self[pair] = ok = self._stand(*pair)
        return ok

    def _stand(self, a, b) -> bool:
        due = float("inf")  # ranks below this one come before the merges undone so far
        while True:
            across = self.rank.get((a, b))
            if across is not None and across < due:
                return False
            in_a, in_b = self.made.get(a), self.made.get(b)
            if in_a is None and in_b is None:
                return True
            if in_b is None or in_a is not None and in_a[0] > in_b[0]:
                due, a = in_a[0], in_a[2]
            else:  # among equal ranks the leftmost merge comes first, so one across the border
                due, b = in_b[0] + 1, in_b[1]
