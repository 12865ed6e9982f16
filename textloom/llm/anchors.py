"""Windows of bytes cut into runs that share an anchor, by hashes alone.

The anchor of a window is its k-gram of least hash (the leftmost of equal ones).
Equal windows have equal anchors at equal places, so they can only be found in runs
whose anchors are equal.
"""

from __future__ import annotations

import numpy as np

_PLACE_BITS = 19
# Bytes hashed at once; with the overlap of a window it must fit in _PLACE_BITS.
PIECE = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_2 = np.uint64(0xD6E8FEB86659FD93 | 1)


def _inverse(base: int) -> int:
    """The inverse modulo 2**64."""
    out = base
    for _ in range(6):
        out = out * (2 - base * out) % (1 << 64)
    return out


class Hasher:
    """Hashes of any slice of a piece, from sums of powers."""

    def __init__(self):
        n = (1 << _PLACE_BITS) + 1
        self.powers = []
        for base in (_BASE, _BASE_2):
            pair = []
            for factor in (base, np.uint64(_inverse(int(base)))):
                steps = np.full(n, factor, dtype=np.uint64)
                steps[0] = 1
                pair.append(np.cumprod(steps))
            self.powers.append(pair)

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[which][0][:len(data)], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray, stop: np.ndarray, which: int) -> np.ndarray:
        return mixed((sums[stop] - sums[start]) * self.powers[which][1][start])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def runs(data: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, gram: int, hasher: Hasher):
    """(start, stop, anchor hash, content hash, anchor place) of each run of windows with one anchor.

    Texts lie in ``data`` at [first, last).  A run covers the bytes [start, stop):
    its windows start at start, start + 1, ..., stop - window.
    """
    none = tuple(np.zeros(0, dtype=kind) for kind in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
    if len(data) < window:
        return none
    sums = hasher.sums(data, 0)
    n_grams = len(data) - gram + 1
    hashed = mixed((sums[gram:] - sums[:n_grams]) * hasher.powers[0][1][:n_grams])
    keys = (hashed >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | np.arange(n_grams, dtype=np.uint64)
    width = window - gram + 1
    anchor = (_sliding_min(keys, width) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    inside = np.zeros(len(anchor) + 1, dtype=np.int8)
    long_enough = last - first >= window
    np.add.at(inside, first[long_enough], 1)
    np.add.at(inside, last[long_enough] - window + 1, -1)
    valid = np.cumsum(inside[:-1]) > 0
    fresh = np.ones(len(anchor), dtype=bool)
    fresh[1:] = anchor[1:] != anchor[:-1]
    fresh[first[long_enough]] = True
    starts = np.flatnonzero(fresh & valid)
    if not len(starts):
        return none
    # A run ends before the next begins, or where its text has no more windows.
    text = np.searchsorted(first, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(anchor)), last[text] - window + 1) - 1
    stops = ends + window
    sums = hasher.sums(data, 1)
    return starts, stops, hashed[anchor[starts]], hasher.slices(sums, starts, stops, 1), anchor[starts]


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(keys) - width + 1
    filled = -(-len(keys) // width) * width
    padded = np.full(filled, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:len(keys)] = keys
    table = padded.reshape(-1, width)
    before = np.minimum.accumulate(table, axis=1).ravel()
    after = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1:width - 1 + n])
