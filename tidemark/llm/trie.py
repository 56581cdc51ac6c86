"""Double-array tries of number sequences, built and walked with numpy.

A number is written in base-64 digits, so a state has at most 64 children and a
key of ``k`` numbers has ``k * digits`` levels.  ``base[s] + digit`` is the only
place where a child of state ``s`` can be, and ``check`` of that place names ``s``
if it is there.
"""

from __future__ import annotations

import numpy as np

BITS = 6
WIDE = 1 << BITS
#: States with so many children get a run of places of their own.
MANY = 8


def digits_for(largest: int) -> int:
    """Digits of numbers up to ``largest``."""
    return max(1, -(-int(largest).bit_length() // BITS))


class DoubleArray:
    """The trie of the rows of a matrix: different, sorted, of numbers from 1; the leaf of row ``i`` says ``i``."""

    def __init__(self, keys: np.ndarray, digits: int, seed: int = 3):
        self.digits, self.length, self.keys = digits, keys.shape[1], len(keys)
        rng = np.random.default_rng(seed)
        self.base = np.zeros(4 * WIDE, dtype=np.int32)
        self.check = np.full(4 * WIDE, -1, dtype=np.int32)
        self.used = 1  # place 0 is the root
        differs = np.zeros(max(len(keys) - 1, 0), dtype=bool)
        node = np.zeros(len(keys), dtype=np.int64)
        at = np.zeros(min(len(keys), 1), dtype=np.int32)  # the place of every node of the level
        for level in range(self.length * digits):
            sign = (keys[:, level // digits] >> (BITS * (digits - 1 - level % digits))) & (WIDE - 1)
            differs |= sign[1:] != sign[:-1]
            child = np.concatenate([[0], np.cumsum(differs)]) if len(keys) else node
            first = np.flatnonzero(np.diff(child, prepend=-1))
            at = self._place(at, node[first], sign[first], rng)
            node = child
            if level + 1 == digits:  # a number's own place says where it leads from the root; the last is for those beyond
                self.heads = np.full(int(keys[-1, 0]) + 2 if len(keys) else 1, -1, dtype=np.int32)
                self.heads[keys[first, 0]] = at
        self.leaf = np.full(len(self.base), -1, dtype=np.int32)
        self.leaf[at] = np.arange(len(keys))

    def _grow(self, size: int) -> None:
        if size + WIDE > len(self.base):
            more = max(size + WIDE, 3 * len(self.base) // 2) - len(self.base)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int32)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int32)])

    def _place(self, places: np.ndarray, parent: np.ndarray, sign: np.ndarray, rng) -> np.ndarray:
        """Places for the children (sorted by parent) of states at ``places``; sets base and check."""
        if not len(parent):
            return np.zeros(0, dtype=np.int32)
        start = np.flatnonzero(np.diff(parent, prepend=-1))
        count = np.diff(np.append(start, len(parent)))
        base = np.zeros(len(start), dtype=np.int64)
        wide, some, one = count >= MANY, (count > 1) & (count < MANY), count == 1
        low = max(self.used, WIDE)
        base[wide] = low + WIDE * np.arange(wide.sum())
        low += WIDE * int(wide.sum())
        room = 4 * int(count[some].sum()) + 2 * WIDE
        self._grow(low + room)
        # states of few children try places at random until no other has them
        waiting = np.flatnonzero(some)
        while len(waiting):
            base[waiting] = rng.integers(low, low + room - WIDE, len(waiting))
            owner = np.repeat(waiting, count[waiting])
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(count[waiting]) - count[waiting], count[waiting])
            target = base[owner] + sign[start[owner] + inner]
            free = self.check[target] < 0
            self.check[target[free]] = owner[free]
            mine = free & (self.check[target] == owner)
            waiting = np.unique(owner[~mine])  # these give back what they took
            self.check[target[mine & np.isin(owner, waiting)]] = -1
        high = low + room if some.any() else low
        taken = np.zeros(high - self.used, dtype=bool)
        taken[self.check[self.used : high] >= 0] = True
        block = (base[wide][:, None] + np.arange(WIDE)).ravel() - self.used
        taken[block] = True
        slots = np.flatnonzero(~taken)[: one.sum()] + self.used
        slots = np.concatenate([slots, high + np.arange(int(one.sum()) - len(slots))])
        base[one] = slots - sign[start[one]]
        self.used = max(high, int(slots[-1]) + 1 if len(slots) else high)
        self._grow(self.used)
        index = np.cumsum(np.diff(parent, prepend=parent[0]) != 0)
        target = base[index] + sign
        self.check[target] = places[parent]
        self.base[places[parent[start]]] = base
        return target.astype(np.int32)

    def walk(self, text: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All positions at once, level by level: those where a key begins, and the key's row."""
        state = self.heads[np.minimum(text[positions], len(self.heads) - 1)]
        positions, state = positions[state >= 0], state[state >= 0]
        for word in range(1, self.length):
            for d in range(self.digits):
                sign = (text[positions + word] >> (BITS * (self.digits - 1 - d))) & (WIDE - 1)
                target = self.base[state] + sign
                alive = self.check[target] == state
                positions, state = positions[alive], target[alive]
        return positions, self.leaf[state]
