"""Vectorised byte and word work on packed batches of texts.

A batch is one byte buffer with document offsets.  Words are maximal runs of
bytes other than space and 0x09-0x0D; since those are ASCII, working on UTF-8
bytes splits exactly as on characters.
"""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Odd multipliers of the finaliser and of the polynomial hashes.
_C1, _C2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_LONG_WORD = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x = x * _C1
    x ^= x >> U64(27)
    x *= _C2
    x ^= x >> U64(31)
    return x


def words(
    buf: np.ndarray, offsets: np.ndarray, between: np.ndarray = SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document number of every word; ``between`` marks the bytes that part words."""
    if not len(buf):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = ~between[buf]
    first = np.zeros(len(buf) + 1, bool)
    first[offsets] = True
    starts = solid.copy()
    starts[1:] &= ~solid[:-1] | first[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:-1]
    begin = np.flatnonzero(starts)
    return begin, np.flatnonzero(ends) + 1, np.searchsorted(offsets, begin, "right") - 1


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes at a time for all spans together."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    base = _BASES[seed]
    lengths = ends - starts
    out = lengths.astype(U64) * base
    live = np.flatnonzero(lengths > 0)
    at = starts[live]
    left = lengths[live]
    long = left > _LONG_WORD
    for i in live[long]:
        out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].tobytes(), seed=seed)
    if long.any():
        live, at, left = live[~long], at[~long], left[~long]
    while len(live):
        chunk = eight[at]
        short = left < 8
        if short.any():
            chunk[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        out[live] = mix((out[live] ^ chunk) * base)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def _powers(n: int, seed: int, inverse: bool) -> np.ndarray:
    known = _POWERS.get((seed, inverse))
    if known is None or len(known) < n:
        base = int(_BASES[seed])
        step = np.full(max(n, 1 << 16), pow(base, -1, 1 << 64) if inverse else base, U64)
        step[0] = 1
        known = _POWERS[(seed, inverse)] = np.multiply.accumulate(step)
    return known[:n]


def hash_runs(values: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` consecutive 64-bit values; one entry per start."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    if n <= 6:
        out = values[:m].copy()
        for j in range(1, n):
            out = out * _BASES[seed] + values[j : m + j]
        return mix(out)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * _powers(len(values), seed, False), out=total[1:])
    return mix((total[n:] - total[:-n]) * _powers(m, seed, True))


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    m = len(values) - width + 1
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out[:m]


def splits(total_of: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Consecutive index ranges whose running total stays below ``limit``; at least one item each."""
    out, begin, size = [], 0, 0
    for i, n in enumerate(total_of.tolist()):
        if i > begin and size + n > limit:
            out.append((begin, i))
            begin, size = i, 0
        size += n
    if begin < len(total_of):
        out.append((begin, len(total_of)))
    return out


def spread(mask_starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of ``n`` places are covered by a run of ``width`` beginning at a marked start."""
    delta = np.zeros(n + 1, np.int32)
    at = np.flatnonzero(mask_starts)
    delta[at] += 1
    np.subtract.at(delta, np.minimum(at + width, n), 1)
    return np.cumsum(delta[:n]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the maximal runs of true values."""
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
