"""Prediction by partial matching over bytes with frozen statistics, for several classes at once.

A model holds, per class, the counts of all byte strings of up to ``order`` + 1 bytes of its training text. The code
length of a byte is -log2 of its share after the longest known context (method C: a context seen T times with D
different successors gives its successors c/(T+D) and escapes to the shorter context with D/(T+D)). Because counts are
frozen, the whole escape chain of every string seen in any class is worked out once; scoring then takes one or two
table look-ups a byte, all classes side by side, without a loop over bytes.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

PAD = 10  # line feed: the context before a segment's first byte
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """Open addressing from uint64 keys to row numbers; at most a quarter full."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(len(keys) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.rows = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            first = np.unique(slot[free], return_index=True)[1]
            put = np.flatnonzero(free)[first]
            self.rows[slot[put]], self.keys[slot[put]] = left[put], keys[left[put]]
            keep = np.ones(len(left), bool)
            keep[put] = False
            left, slot = left[keep], (slot[keep] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where there is none."""
        slot = self._slot(keys)
        out = self.rows[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        out[open_] = -1
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            row, same = self.rows[slot], self.keys[slot] == keys[open_]
            hit = (row >= 0) & same
            out[open_[hit]] = row[hit]
            go = (row >= 0) & ~same
            open_, slot = open_[go], slot[go]
        return out


def _joined(segments: Iterable[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with ``order`` pad bytes before each segment, start of each, length of each)."""
    parts = list(segments)
    pad = bytes([PAD]) * order
    data = np.frombuffer(b"".join(pad + x for x in parts), np.uint8)
    length = np.array([len(x) for x in parts], np.int64)
    start = np.cumsum(length + order) - length
    return data, start, length


def _values(data: np.ndarray, order: int) -> np.ndarray:
    """For each byte it and the ``order`` bytes before, packed; the byte itself lowest."""
    wide = data.astype(np.uint64)
    out = wide.copy()
    for j in range(1, order + 1):
        out[j:] |= wide[:-j] << np.uint64(8 * j)
    return out


def _own(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which bytes belong to segments (True) and which are padding."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


class Ppm:
    """Frozen statistics of several classes."""

    def __init__(self, training: dict[str, list[bytes]], order: int = 4):
        self.labels, self.order = sorted(training), order
        if not training:
            self.grams, self.contexts, self.costs, self.escapes = [], [], [], []
            return
        counts = []  # per class, per length: sorted strings and their counts
        for label in self.labels:
            data, start, length = _joined(training[label], order)
            values = _values(data, order)[_own(len(data), start, length)] if len(data) else np.zeros(0, np.uint64)
            counts.append([np.unique(values & np.uint64((1 << 8 * n) - 1), return_counts=True) for n in range(1, order + 2)])
        k = len(self.labels)
        self.costs, self.escapes, grams, contexts = [], [], [], []
        below = None
        for n in range(1, order + 2):
            union = np.unique(np.concatenate([c[n - 1][0] for c in counts]))
            context = np.unique(union >> np.uint64(8))
            if below is None:
                cost = np.full((len(union), k), 8.0, np.float32)
            else:
                cost = below[1][np.searchsorted(below[0], union & np.uint64((1 << 8 * (n - 1)) - 1))].copy()
            escape = np.zeros((len(context), k), np.float32)
            of = np.searchsorted(context, union >> np.uint64(8))
            for j, c in enumerate(counts):
                keys, seen = c[n - 1]
                if not len(keys):
                    continue
                own, at = np.unique(keys >> np.uint64(8), return_inverse=True)
                total, distinct = np.bincount(at, seen), np.bincount(at)
                escape[np.searchsorted(context, own), j] = -np.log2(distinct / (total + distinct))
                cost[:, j] += escape[of, j]
                cost[np.searchsorted(union, keys), j] = -np.log2(seen / (total + distinct)[at])
            below = (union, cost)
            self.costs.append(cost)
            self.escapes.append(escape)
            grams.append(_Table(union))
            contexts.append(_Table(context))
        self.grams, self.contexts = grams, contexts
        # a last row of zeros, for what isn't found
        self.costs = [np.vstack([t, np.zeros((1, k), np.float32)]) for t in self.costs]
        self.escapes = [np.vstack([t, np.zeros((1, k), np.float32)]) for t in self.escapes]

    @staticmethod
    def _add(out: np.ndarray, table: np.ndarray, row: np.ndarray, segment: np.ndarray) -> None:
        """Adds the table's rows to their segments; segments ascend."""
        edge = np.flatnonzero(np.diff(segment, prepend=-1))
        out[segment[edge]] += np.add.reduceat(table[row], edge, axis=0)

    def bits(self, segments: list[bytes], block: int = 1 << 17) -> np.ndarray:
        """Code length in bits of each segment under each class (rows: segments, columns: labels); empty ones take 0."""
        out = np.zeros((len(segments), len(self.labels)))
        data, start, length = _joined(segments, self.order)
        if not length.sum() or not self.labels:
            return out
        own, number = _own(len(data), start, length), np.zeros(len(data), np.int64)
        number[start[length > 0]] = np.flatnonzero(length > 0)
        number = np.maximum.accumulate(number)
        for lo in range(0, len(data), block):
            since = max(0, lo - self.order)
            value = _values(data[since : lo + block], self.order)[lo - since :]
            keep = own[lo : lo + block]
            value, segment = value[keep], number[lo : lo + block][keep]
            if not len(value):
                continue
            for n in range(self.order + 1, 0, -1):
                row = self.grams[n - 1].find(value & np.uint64((1 << 8 * n) - 1))
                self._add(out, self.costs[n - 1], row, segment)  # row -1 is the last one: nothing
                left = np.flatnonzero(row < 0)
                value, segment = value[left], segment[left]
                if not len(left):
                    break
                context = self.contexts[n - 1].find((value & np.uint64((1 << 8 * n) - 1)) >> np.uint64(8))
                self._add(out, self.escapes[n - 1], context, segment)
            if len(value):
                np.add.at(out, segment, 8.0)
        return out
