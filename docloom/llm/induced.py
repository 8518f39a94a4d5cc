"""Suffix sorting by induction, with queues that spill to disk.

Suffixes are of type S (smaller than the next one) or L. The leftmost S suffixes (LMS) are sorted
first; all others are induced from them: one sweep in ascending order hands each suffix's
predecessor to the queue of its first symbol, one in descending order does so for type S. A queue
keeps the order in which it was filled, so each sweep works through whole queues with numpy.
Sorting the LMS suffixes is the same problem on a string of their names: names come from one
induction, and the named string is sorted by doubling the sorted length.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Entries that the queues of one sweep hold in memory; what comes beyond waits in a temporary file.
HELD = 1 << 24


class Queues:
    """First-in first-out queues of positions by symbol."""

    def __init__(self, symbols: int, held: int = HELD):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.held, self.room, self.file = 0, held, None

    def push(self, symbol: int, positions: np.ndarray) -> None:
        if self.held + len(positions) > self.room:
            self.file = self.file or tempfile.TemporaryFile()  # in the worker's own folder, gone with it
            at = self.file.seek(0, 2)
            positions.tofile(self.file)
            self.parts[symbol].append((at, len(positions)))
        else:
            self.held += len(positions)
            self.parts[symbol].append(positions)

    def spread(self, symbols: np.ndarray, positions: np.ndarray) -> None:
        """Pushes each position to its symbol's queue, keeping their order."""
        if not len(positions):
            return
        order = np.argsort(symbols, kind="stable")
        sorted_symbols, sorted_positions = symbols[order], positions[order]
        cuts = np.flatnonzero(np.diff(sorted_symbols)) + 1
        for part, at in zip(np.split(sorted_positions, cuts), np.r_[0, cuts], strict=True):
            self.push(int(sorted_symbols[at]), part)

    def pop(self, symbol: int) -> np.ndarray:
        parts, self.parts[symbol] = self.parts[symbol], []
        out = []
        for p in parts:
            if isinstance(p, tuple):
                self.file.seek(p[0])
                out.append(np.fromfile(self.file, np.int64, p[1]))
            else:
                self.held -= len(p)
                out.append(p)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def smaller_types(s: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last one counts as such."""
    n = len(s)
    change = np.flatnonzero(s[:-1] != s[1:])
    out = np.ones(n, bool)
    if len(change):
        starts = np.r_[0, change + 1]
        rises = np.r_[s[change] < s[change + 1], True]
        out = np.repeat(rises, np.diff(np.r_[starts, n]))
    return out


def induce(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in order, from the LMS suffixes in order."""
    bounds = np.searchsorted(s[lms], np.arange(symbols + 1)) if len(lms) else np.zeros(symbols + 1, int)
    present = np.flatnonzero(np.bincount(s, minlength=symbols)).tolist()
    queues, large = Queues(symbols), [np.zeros(0, np.int64)] * symbols
    for c in present:
        pending, parts = queues.pop(c), []
        while len(pending):
            parts.append(pending)
            before = pending[pending > 0] - 1
            before = before[~smaller[before]]
            symbol = s[before]
            queues.spread(symbol[symbol != c], before[symbol != c])
            pending = before[symbol == c]
        large[c] = np.concatenate(parts) if parts else large[c]
        own = lms[bounds[c] : bounds[c + 1]]
        before = own[own > 0] - 1
        queues.spread(s[before], before)
    queues, out = Queues(symbols), []
    queues.push(int(s[-1]), np.array([len(s) - 1]))  # the last suffix has none to be induced from
    for c in present[::-1]:
        pending, parts = queues.pop(c), []
        while len(pending):
            parts.append(pending)
            before = pending[pending > 0] - 1
            before = before[smaller[before]]
            symbol = s[before]
            queues.spread(symbol[symbol != c], before[symbol != c])
            pending = before[symbol == c]
        down = large[c][::-1]
        before = down[down > 0] - 1
        before = before[smaller[before]]
        queues.spread(s[before], before)
        out += [*parts, down]
    return np.concatenate(out)[::-1]


def doubled(names: np.ndarray, most: int) -> np.ndarray:
    """The order of the suffixes of a string of names, by their first most names at least."""
    ranks, reach = np.unique(names, return_inverse=True)[1].astype(np.int64), 1
    while reach < most and len(ranks) and ranks.max() + 1 < len(ranks):
        after = np.zeros(len(ranks), np.int64)
        if reach < len(ranks):
            after[:-reach] = ranks[reach:] + 1
        ranks = np.unique(ranks * (len(ranks) + 1) + after, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return np.argsort(ranks, kind="stable")


def words_at(s: np.ndarray) -> np.ndarray:
    """For each place of a byte string the eight bytes from there, as one number; zeros follow the end."""
    return np.ndarray((len(s),), "<u8", np.concatenate([s, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))


def common_prefix(s: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Whether the strings from a and from b agree for most bytes, eight at a time; places beyond the end are zero bytes."""
    eight = words_at(s)
    most = np.broadcast_to(np.asarray(most), a.shape)
    same = np.ones(len(a), bool)
    left = np.arange(len(a))
    at = 0
    while len(left):
        rest = most[left] - at
        left, rest = left[rest > 0], rest[rest > 0]
        if not len(left):
            break
        i, j = a[left] + at, b[left] + at
        x = np.where(i < len(s), eight[np.minimum(i, len(s) - 1)], 0) ^ np.where(j < len(s), eight[np.minimum(j, len(s) - 1)], 0)
        mask = np.where(rest >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (np.minimum(rest, 7).astype(np.uint64) * np.uint64(8))) - np.uint64(1))
        bad = (x & mask) != 0
        same[left[bad]] = False
        left = left[~bad]
        at += 8
    return same


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """The suffixes of a byte string in order, of their first depth bytes at least (all by default).

    The string must end with a byte smaller than all others in it.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    smaller = smaller_types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return induce(s, smaller, np.array([n - 1]) if smaller[-1] else lms, 256)
    rough = induce(s, smaller, lms[np.argsort(s[lms], kind="stable")], 256)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    rough = rough[is_lms[rough]]
    length = np.zeros(n, np.int64)
    length[lms] = np.diff(np.r_[lms, n]) + 1
    same = (length[rough[1:]] == length[rough[:-1]]) & (rough[1:] != lms[-1]) & (rough[:-1] != lms[-1])
    pairs = np.flatnonzero(same)
    same[pairs] = common_prefix(s, rough[pairs], rough[pairs + 1], length[rough[pairs]])
    name = np.zeros(n, np.int64)
    name[rough] = np.r_[0, np.cumsum(~same)]
    names = name[lms]
    if names.max() + 1 < len(names):
        # each name spans two bytes at least beyond the one it shares with the next
        order = doubled(names, len(names) if depth is None else depth // 2 + 2)
        ordered = lms[order]
    else:
        ordered = rough
    return induce(s, smaller, ordered, 256)
