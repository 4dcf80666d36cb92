"""Windows of a fixed number of units (words or bytes), their hashes and their keys, in numpy."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _B
    x ^= x >> np.uint64(31)
    return x


def gram_hashes(units: np.ndarray, *widths: int) -> list[np.ndarray]:
    """64-bit hashes of every run of each width, built from runs of the powers of two."""
    power = [_mix(units.astype(np.uint64) + _A)]
    while 2 << (len(power) - 1) <= max(widths):
        half, step = power[-1], 1 << (len(power) - 1)
        power.append(_mix(half[:-step] * _A + half[step:]) if len(half) > step else half[:0])
    found = []
    for width in widths:
        n, out, at = len(units) - width + 1, None, 0
        if n <= 0:
            found.append(np.zeros(0, np.uint64))
            continue
        for k in range(len(power) - 1, -1, -1):
            if width >> k & 1:
                part = power[k][at : at + n]
                out = part if out is None else _mix(out * _A + part)
                at += 1 << k
        found.append(out)
    return found


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def keys_and_hashes(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window: its key, the least hash of its grams of ``gram`` units, and its hash. Equal windows have both equal."""
    if len(units) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams, hashes = gram_hashes(units, gram, window)
    return sliding_min(grams, window - gram + 1), hashes


def covered(starts: np.ndarray, window: int, length: int) -> np.ndarray:
    """Mask of the units that lie in a window with one of these starts."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge)[:length] > 0


class Stretches(NamedTuple):
    """Runs of windows whose least gram is the same place: windows ``begin`` to ``end``, the place, its gram's hash, the run's hash."""

    begin: np.ndarray
    end: np.ndarray
    anchor: np.ndarray
    key: np.ndarray
    name: np.ndarray


def stretches(units: np.ndarray, window: int, gram: int, named: bool = True) -> Stretches:
    """Stretches of a text; of a window's equal least grams the first counts. Equal windows lie alike about their anchors.

    A stretch spans less than two windows, so the hashes of its first and its last window and its length name all of it.
    Without ``named`` the names stay empty.
    """
    if len(units) < window:
        none = np.zeros(0, np.int64)
        return Stretches(none, none, none, none.view(np.uint64), none.view(np.uint64))
    grams, hashes = gram_hashes(units, gram, window) if named else (gram_hashes(units, gram)[0], None)
    low = np.uint64(32)
    place = (sliding_min(grams >> low << low | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    end = np.concatenate([begin[1:], [len(place)]])
    anchor = place[begin]
    if not named:
        return Stretches(begin, end, anchor, grams[anchor], begin[:0].view(np.uint64))
    name = _mix(_mix(hashes[begin] * _A + hashes[end - 1]) * _A + (end - begin).astype(np.uint64))
    return Stretches(begin, end, anchor, grams[anchor], name)
