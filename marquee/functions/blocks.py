"""Matching blocks of many pairs of texts at once."""

from __future__ import annotations

import numpy as np


#: Letters up to which parts of texts count as short.
NARROW = 10


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points, a column for each text, with zeros behind its end; and the lengths."""
    lengths = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(lengths.max(initial=0)))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    return np.ascontiguousarray(out.T if out.max(initial=0) > 0xFFFF else out.astype(np.uint16).T), lengths


def longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The longest run of letters that each two columns share, where it starts in both, and its length; of equals the first in a, then in b."""
    kind, mask = (np.uint8, np.int8) if len(b) < 256 else (np.uint16, np.int16) if len(b) < 65_536 else (np.uint32, np.int32)
    size, at, to = np.zeros(a.shape[1], kind), np.zeros(a.shape[1], np.int64), np.zeros(a.shape[1], np.int64)
    run, grown, same = np.zeros((len(b) + 1, a.shape[1]), kind), np.zeros(b.shape, kind), np.zeros(b.shape, mask)
    equal = same.view(bool) if kind is np.uint8 else np.zeros(b.shape, bool)
    for i in range(len(a)):
        np.add(run[:-1], kind(1), out=grown)
        np.equal(b, a[i], out=equal)
        np.negative(equal.view(np.int8), out=same)  # no bits or all
        np.bitwise_and(grown, same.view(kind), out=run[1:])
        here = run.max(axis=0)
        k = np.flatnonzero(here > size)
        if len(k):
            size[k], at[k] = here[k], i + 1 - here[k].astype(np.int64)
            to[k] = (run[:, k] == here[k]).argmax(axis=0) - here[k].astype(np.int64)
    return at, to, size.astype(np.int64)


def cut(texts: np.ndarray, rows: np.ndarray, start: np.ndarray, end: np.ndarray, blank: int) -> np.ndarray:
    """Letters from start to end of each of these columns, with ``blank`` behind them."""
    place = start + np.arange(max(1, int((end - start).max(initial=0))))[:, None]
    return np.where(place < end, texts[np.minimum(place, len(texts) - 1), rows], texts.dtype.type(blank))


def matched(a: np.ndarray, b: np.ndarray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> np.ndarray:
    """Letters in matching blocks: the longest run that both share, and likewise before and behind it (as difflib without junk)."""
    out, none = np.zeros(a.shape[1], np.int64), np.zeros(a.shape[1], np.int64)
    # one number that is in no text stands behind the ends of a, another behind those of b
    top = np.iinfo(a.dtype).max if a.dtype == b.dtype else None
    if top is None or max(a.max(initial=0), b.max(initial=0)) > top - 2:
        a, b, top = a.astype(np.uint32), b.astype(np.uint32), np.iinfo(np.uint32).max
    # short parts, of which there are many, wait for each other, so that a long one does not make all of them long
    wide, narrow = (np.arange(a.shape[1]), np.stack([none, a_lengths, none, b_lengths])), []
    while len(wide[0]) or narrow:
        if not len(wide[0]):
            wide, narrow = tuple(np.concatenate(x, axis=-1) for x in zip(*narrow, strict=True)), []
        rows, (start, end, first, last) = wide
        at, to, size = longest(cut(a, rows, start, end, top), cut(b, rows, first, last, top - 1))
        np.add.at(out, rows, size)
        at, to = at + start, to + first
        found = np.flatnonzero(size)
        rows, ends = np.tile(rows[found], 2), (np.concatenate(x) for x in ((start[found], (at + size)[found]), (at[found], end[found]), (first[found], (to + size)[found]), (to[found], last[found])))
        parts = np.stack(list(ends))
        own, other = parts[1] - parts[0], parts[3] - parts[2]
        some = (own > 0) & (other > 0)
        few = some & (np.maximum(own, other) <= NARROW)
        some &= ~few
        if few.any():
            narrow.append((rows[few], parts[:, few]))
        wide = rows[some], parts[:, some]
    return out
