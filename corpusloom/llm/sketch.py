"""Sketches of word sets, computed for whole batches with numpy."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (public: MurmurHash3); x is overwritten."""
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed))


def flatten(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All elements, and where each set begins; no set may be empty."""
    lens = np.fromiter((len(s) for s in sets), np.int64, len(sets))
    return (np.concatenate(sets) if sets else np.empty(0, np.uint64)), np.concatenate(([0], np.cumsum(lens)[:-1])).astype(np.int64)


def grouped_fingerprints(flat: np.ndarray, starts: np.ndarray, groups: int, segments: int, bits: int, check: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """((sets, segments) codes, (sets, check / 64) words of check bits) of bit fingerprints.

    Each bit is a bit of a min-wise hash of the set, so two sets of Jaccard similarity J agree
    in it with probability (1 + J) / 2 and their Hamming distance measures their similarity.
    A hash gives a group of ``bits`` neighbouring bits to a segment, which two sets agree in
    with probability J and a little, and one more bit to the check bits, as long as these last.
    A code is the hash of a segment's number and of its groups.
    """
    n = len(starts)
    codes, checks = np.empty((n, segments), np.uint64), np.zeros((n, check), np.uint8)
    low = (flat ^ (flat >> _U(32))).astype(np.uint32)
    of = seeds(max(groups * segments, check), seed)
    with np.errstate(over="ignore"):
        for j in range(segments if n else 0):
            code = np.full(n, j + 1, np.uint64)
            for g in range(groups):
                least = _least(low, starts, int(of[j * groups + g]))
                code = _mix(code * _U(0x9E3779B97F4A7C15) + (least >> np.uint32(32 - bits)).astype(np.uint64))
                if j * groups + g < check:
                    checks[:, j * groups + g] = (least >> np.uint32(31 - bits)).astype(np.uint8) & 1
            codes[:, j] = code
        for j in range(groups * segments, check if n else 0):
            checks[:, j] = (_least(low, starts, int(of[j])) >> np.uint32(31)).astype(np.uint8)
    return codes.view(np.int64), np.packbits(checks, axis=1).view(np.int64)


def _least(low: np.ndarray, starts: np.ndarray, s: int) -> np.ndarray:
    """The mixed least hash of each set."""
    h = low * np.uint32(s & 0xFFFFFFFF | 1)
    h += np.uint32(s >> 32)
    h ^= h >> np.uint32(15)
    least = np.minimum.reduceat(h, starts)
    least *= np.uint32(0x9E3779B1)
    return least


def similarity_sketch(flat: np.ndarray, starts: np.ndarray, t: int, seed: int = 1) -> np.ndarray:
    """Fast similarity sketching (Dahlgaard, Knudsen and Thorup 2017): (sets, t) coordinates.

    In round i < t every element goes to a hashed coordinate with the value i + hash; in
    round t + j all elements go to coordinate j.  A coordinate keeps its least value, thus
    one of the first round that reached it, and after 2t rounds all are filled.  Two sets
    agree in a coordinate with probability J, and the number of agreements is concentrated
    as if the coordinates were independent.  A set leaves once its coordinates are full.
    """
    n = len(starts)
    empty = _U(0xFFFFFFFFFFFFFFFF)
    sketch = np.full(n * t, empty, np.uint64)
    if not n:
        return sketch.reshape(0, t)
    owner = np.repeat(np.arange(n), np.diff(np.append(starts, len(flat))))
    items, left = flat, np.full(n, t)
    for i, s in enumerate(seeds(2 * t, seed)):
        h = _mix(items ^ s)
        # the coordinate comes from the high bits, the value from all but the round, which stands on top
        place = ((h >> _U(40)) * _U(t) >> _U(24)).astype(np.int64) if i < t else np.full(len(items), i - t)
        value = (_U(i) << _U(48)) | (_mix(h.copy()) >> _U(16))
        at = owner * t + place
        free = sketch[at] > (_U(i) << _U(48))
        at, value, who = at[free], value[free], owner[free]
        was = sketch[at] == empty
        new = np.unique(at[was])
        np.minimum.at(sketch, at, value)
        left -= np.bincount(new // t, minlength=n)
        if i % 8 == 7 or i >= t:
            if not left.any():
                break
            keep = left[owner] > 0
            if not keep.all():
                items, owner = items[keep], owner[keep]
        del who
    return sketch.reshape(n, t)


def band_keys(sketch: np.ndarray, rows: int, seed: int = 7) -> np.ndarray:
    """(sets, t // rows) keys of 64 bits, as signed numbers: one for each band of ``rows`` coordinates."""
    n, t = sketch.shape
    bands = t // rows
    out = np.empty((n, bands), np.uint64)
    for b, s in enumerate(seeds(bands, seed)):
        h = np.full(n, s, np.uint64)
        for r in range(rows):
            h = _mix(h ^ sketch[:, b * rows + r])
            h *= _U(0x9E3779B97F4A7C15)
        out[:, b] = _mix(h)
    return out.view(np.int64)
