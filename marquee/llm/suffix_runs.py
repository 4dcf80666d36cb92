"""Sorted, front-coded runs of suffixes and their merge by a loser tree that compares no known prefix twice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of the name of a suffix's first gram, which stands in the suffix for the gram itself.
NAME = 8


def front_coded(suffixes: list[bytes]) -> tuple[np.ndarray, bytes]:
    """Of sorted strings: how many bytes each shares with the one before, and the rest of all, end to end."""
    shared, tails, last = np.zeros(len(suffixes), np.uint8), [], b""
    for k, suffix in enumerate(suffixes):
        n = common(last, suffix, 0)
        shared[k] = n
        tails.append(suffix[n:])
        last = suffix
    return shared, b"".join(tails)


def common(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are."""
    n, end = known, min(len(x), len(y))
    if x[n:end] == y[n:end]:
        return end
    while x[n] == y[n]:
        n += 1
    return n


def _strings(shared: np.ndarray, tail: bytes, length: np.ndarray) -> Iterator[tuple[bytes, int]]:
    last, at = b"", 0
    for n, size in zip(shared.tolist(), length.tolist(), strict=True):
        end = at + size - n
        last = last[:n] + tail[at:end]
        at = end
        yield last, n


def merged(runs: list[tuple[np.ndarray, bytes, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Run of each string of the merged order (a run's own order stays), and what it shares with the string before it.

    A run is (shared lengths, tails, lengths), as ``front_coded`` gives them. Every string in the tree knows what it
    shares with the last winner on its path: the one that shares more is smaller, and only equal lengths are compared,
    from there on.
    """
    size = 1 << max(0, (len(runs) - 1).bit_length())
    feeds = [_strings(*run) for run in runs]
    head: list[bytes | None] = [None] * size
    known = [0] * size
    losers = [-1] * size

    def advance(run: int) -> None:
        head[run], known[run] = next(feeds[run], (None, 0)) if run < len(feeds) else (None, 0)

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser learns what it shares with the winner."""
        x, y = head[a], head[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        n = common(x, y, p)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    for run in range(size):
        advance(run)
    winners = list(range(size))
    node = size >> 1
    while node:
        for k in range(node):
            winners[k], losers[node + k] = play(winners[2 * k], winners[2 * k + 1])
        node >>= 1
    best, order, shares = winners[0], [], []
    while head[best] is not None:
        order.append(best)
        shares.append(known[best])
        advance(best)  # what it shares with its predecessor is what it shares with the last winner
        node = (size + best) >> 1
        while node:
            best, losers[node] = play(best, losers[node])
            node >>= 1
    return np.array(order, np.int64), np.array(shares, np.int64)
