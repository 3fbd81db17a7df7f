"""Words of many texts at once as numpy arrays: spans, document numbers, 64-bit hashes."""

from __future__ import annotations

import numpy as np

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = _BASE if kind == "up" else _BASE_INVERSE
        steps = np.full(max(n, 1 << 16), _U(base & (2**64 - 1)))
        steps[0] = 1
        have = _powers[kind] = np.cumprod(steps)
    return have[:n]


def spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; a document's end ends a word."""
    n = len(buf)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    gap = np.zeros(n + 1, bool)  # gap[i]: no word goes on from byte i - 1 to byte i
    space = IS_SPACE[buf]
    gap[1:n] = space[:-1]
    gap[offs] = True
    gap[0] = gap[n] = True
    start = np.flatnonzero(~space & gap[:n])
    gap[:n] |= space
    end = np.flatnonzero(~space & gap[1:]) + 1
    return start, end, np.searchsorted(offs, start, "right") - 1


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, whatever its place: differences of one running polynomial."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # segments that end between words keep the powers short
        lo = start[at]
        to = max(at + 1, int(np.searchsorted(end, lo + (1 << 20), "right")))
        hi = end[to - 1]
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_BYTE[buf[lo:hi]] * _power("up", hi - lo), out=run[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = mix((run[e] - run[s]) * _power("down", hi - lo + 1)[s] + (e - s).astype(np.uint64))
        at = to
    return out
