"""Words of UTF-8 bytes and their 64-bit hashes, vectorised.

Separators are ASCII bytes, so classifying bytes is exact for UTF-8 text: every byte of a
non-ASCII character is 0x80 or above.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words are runs of anything but space, tab, LF, VT, FF and CR.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Words are runs of ASCII letters and digits and of bytes from 0x80.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if "pow" not in _tables:
        for name, base in (("pow", _BASE), ("inv", _INVERSE)):
            full = np.full(_PIECE + 1, base, dtype=_U)
            full[0] = 1
            _tables[name] = np.cumprod(full, dtype=_U)
    return _tables["pow"], _tables["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the murmur3 finaliser)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    h ^= h >> _U(33)
    return h


def spans(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row) of the words in buf; rows never share a word."""
    if len(buf) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    m = table[buf]
    s, e = m.copy(), m.copy()
    s[1:] &= ~m[:-1]
    e[:-1] &= ~m[1:]
    first = offs[:-1][offs[:-1] < len(buf)]
    s[first] = m[first]
    last = offs[1:][offs[1:] > 0] - 1
    e[last] = m[last]
    starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, then scrambled with its length."""
    power, inverse = _powers()
    out = np.empty(len(starts), dtype=_U)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = int(np.searchsorted(ends, at + _PIECE, "right"))
        if j <= i:  # one word longer than a piece
            total, step = 0, 0
            for a in range(at, int(ends[i]), _PIECE):
                b = buf[a : min(a + _PIECE, int(ends[i]))].astype(_U) + _U(1)
                total = (total + int((b * power[: len(b)]).sum(dtype=_U)) * pow(_BASE, step, 1 << 64)) % (1 << 64)
                step += _PIECE
            out[i] = total
            i += 1
            continue
        piece = buf[at : int(ends[j - 1])]
        c = np.zeros(len(piece) + 1, dtype=_U)
        np.cumsum((piece.astype(_U) + _U(1)) * power[: len(piece)], out=c[1:])
        out[i:j] = (c[ends[i:j] - at] - c[starts[i:j] - at]) * inverse[starts[i:j] - at]
        i = j
    return mix(out ^ (ends - starts).astype(_U))


_STEP = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def ngrams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k (up to 5) consecutive word hashes; fewer than k words give none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.zeros(n, dtype=_U)
    for j in range(k):
        out += h[j : j + n] * _U(_STEP[j])
    return mix(out)


def whole(h: np.ndarray) -> np.ndarray:
    """One hash for a whole sequence of fewer words than a shingle has."""
    out = np.zeros(1, dtype=_U)
    for j in range(len(h)):
        out += h[j : j + 1] * _U(_STEP[j])
    return mix(out + _U(len(h)))
