"""Rolling hashes over words and bytes, and the anchors that stand for windows. numpy only; used inside tasks."""

from __future__ import annotations

import functools

import numpy as np

#: Windows are handled this many starts at a time, which keeps the arrays in cache and memory bounded.
SEGMENT = 1 << 17

# Odd multipliers of the two polynomial hashes, and the multipliers of the 64-bit finaliser (splitmix64).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no structure of sums."""
    x = x ^ (x >> _U(30))
    x *= _U(MIX[0])
    x ^= x >> _U(27)
    x *= _U(MIX[1])
    x ^= x >> _U(31)
    return x


@functools.cache
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(BASES[0]))


@functools.cache
def _powers(which: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse modulo 2^64, 2^bits of each."""
    out = []
    for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
        steps = np.full(1 << bits, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(which, max(18, int(n).bit_length()))
    return up[:n], down[:n]


def sums(values: np.ndarray, which: int) -> np.ndarray:
    """Running sums of values times powers, from 0."""
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(which, len(values))[0], out=out[1:])
    return out


def window_hashes(values: np.ndarray, k: int, which: int = 0) -> np.ndarray:
    """A hash of each k values in a row."""
    if len(values) < k:
        return np.zeros(0, dtype=np.uint64)
    running = sums(values, which)
    return mix((running[k:] - running[:-k]) * powers(which, len(values) - k + 1)[1])


def word_values(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word of a buffer of bytes, by its bytes and length."""
    out = np.empty(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + (SEGMENT << 2))))
        low = starts[a]
        part = byte_values()[buffer[low : ends[b - 1]]]
        running, s, e = sums(part, 0), starts[a:b] - low, ends[a:b] - low
        size = (e - s).astype(np.uint64)
        out[a:b] = mix((running[e] - running[s]) * powers(0, len(part))[1][s] + size * _U(BASES[1]))
        a = b
    return out


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word of all texts, first word of each text and the end); words are runs of other bytes than \\x20 and \\x09-\\x0D."""
    buffer = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    blank = _BLANK[buffer]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if len(blank) and not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return word_values(buffer, starts, ends), np.searchsorted(starts, offsets)


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """Of each width values in a row, the place of the least; of equal ones the first."""
    at, span = np.arange(len(x), dtype=np.int32), 1
    while span < width:
        step = min(span, width - span)
        less = x[step:] < x[:-step]
        at = np.where(less, at[step:], at[:-step])
        x = np.minimum(x[step:], x[:-step])
        span += step
    return at


def anchored(values: np.ndarray, alive: np.ndarray, window: int, k: int, second: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, lo, hi[, second hash]): the living windows by anchor.

    The anchor of a window is the first of its k values in a row with the least hash, so equal windows have equal
    anchors at equal places. Windows lo to hi share one. With k = window each window is its own anchor.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(alive), SEGMENT):
        live = np.flatnonzero(alive[a : a + SEGMENT])
        if not len(live):
            continue
        part = values[a + live[0] : a + live[-1] + window]
        base, live = a + live[0], live - live[0]
        hashes = window_hashes(part, k)
        at = live if k == window else leftmost_least(hashes, window - k + 1)[live]
        new = np.ones(len(live), dtype=bool)
        new[1:] = at[1:] != at[:-1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(live)) - 1
        row = [hashes[at[first]].view(np.int64), base + live[first], base + live[last]]
        if second:
            row.append((window_hashes(part, k, 1)[at[first]] >> _U(33)).astype(np.int64))
        out.append(tuple(row))
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(3 + second))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which of n places lie in a range lo to hi, both included."""
    edges = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edges, lo, 1)
    np.add.at(edges, hi + 1, -1)
    return np.cumsum(edges[:-1]) > 0
