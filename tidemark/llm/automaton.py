"""A generalised suffix automaton over sequences of hashable symbols."""

from __future__ import annotations

from collections.abc import Hashable, Sequence


class SuffixAutomaton:
    """Grows by whole sequences; `statistics` gives, for each place, the longest suffix there that occurs in any of them."""

    __slots__ = ("length", "link", "next")

    def __init__(self) -> None:
        self.length, self.link, self.next = [0], [-1], [{}]

    def __len__(self) -> int:
        return len(self.length)

    def _copy(self, p: int, q: int, c: Hashable) -> int:
        """Splits q so that the part reached from p by c has its own state."""
        length, link, nxt = self.length, self.link, self.next
        clone = len(length)
        length.append(length[p] + 1)
        link.append(link[q])
        nxt.append(nxt[q].copy())
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, sequence: Sequence[Hashable]) -> None:
        length, link, nxt = self.length, self.link, self.next
        last = 0
        for c in sequence:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._copy(last, q, c)
                continue
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            nxt.append({})
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                link[new] = q if length[q] == length[p] + 1 else self._copy(p, q, c)
            last = new

    def statistics(self, sequence: Sequence[Hashable]) -> list[int]:
        length, link, nxt = self.length, self.link, self.next
        v = n = 0
        out = []
        for c in sequence:
            to = nxt[v].get(c)
            while to is None and v:
                v = link[v]
                n = length[v]
                to = nxt[v].get(c)
            if to is None:
                n = 0
            else:
                v = to
                n += 1
            out.append(n)
        return out
