"""XXH64 of many byte ranges at once, as ``xxhash64`` of Spark and the ``xxhash`` library give it."""

from __future__ import annotations

import numpy as np
import xxhash

from provenir.llm.common import U64

#: Fixed values of the published algorithm.
P1 = U64(0x9E3779B185EBCA87)
P2 = U64(0xC2B2AE3D27D4EB4F)
P3 = U64(0x165667B19E3779F9)
P4 = U64(0x85EBCA77C2B2AE63)
P5 = U64(0x27D4EB2F165667C5)
#: Ranges beyond this many bytes are hashed one by one.
LONG = 256


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return x << U64(by) | x >> U64(64 - by)


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * P2, 31) * P1


def xxh64(raw: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of ``raw[start : start + size]`` (bytes) for each pair, as uint64."""
    data = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    halves = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    with np.errstate(over="ignore"):
        out = np.full(len(start), U64(seed) + P5, U64)
        at, left = start.astype(np.int64), size.astype(np.int64)
        wide = np.flatnonzero((size >= 32) & (size <= LONG))
        if len(wide):
            acc = [np.full(len(wide), v, U64) for v in (U64(seed) + P1 + P2, U64(seed) + P2, U64(seed), U64(seed) - P1)]
            live = np.arange(len(wide))
            while len(live):
                for k in range(4):
                    acc[k][live] = _round(acc[k][live], words[at[wide[live]] + 8 * k])
                at[wide[live]] += 32
                left[wide[live]] -= 32
                live = live[left[wide[live]] >= 32]
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.zeros(1, U64), a)) * P1 + P4
            out[wide] = h
        out += size.astype(U64)
        left[size > LONG] = 0
        while len(live := np.flatnonzero(left >= 8)):
            out[live] = _rotl(out[live] ^ _round(np.zeros(1, U64), words[at[live]]), 27) * P1 + P4
            at[live] += 8
            left[live] -= 8
        live = np.flatnonzero(left >= 4)
        out[live] = _rotl(out[live] ^ halves[at[live]].astype(U64) * P1, 23) * P2 + P3
        at[live] += 4
        left[live] -= 4
        while len(live := np.flatnonzero(left > 0)):
            out[live] = _rotl(out[live] ^ data[at[live]].astype(U64) * P5, 11) * P1
            at[live] += 1
            left[live] -= 1
        out = (out ^ out >> U64(33)) * P2
        out = (out ^ out >> U64(29)) * P3
        out ^= out >> U64(32)
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh64_intdigest(raw[start[i] : start[i] + size[i]].tobytes(), seed)
    return out
