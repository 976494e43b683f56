"""Counting quotient filters: sorted, mergeable, lossless counters of keys of one or more 64-bit limbs.

A key is permuted by a bijection, so its bits look uniform and nothing of it is lost. The leading ``skip`` bits name the
bucket a filter belongs to, the next ones are the quotient, and all others are the remainder, stored in full. A filter
of m keys holds 2^q slots: one bit a slot says whether any key has that quotient, one bit a key ends the run of keys
of one quotient, so quotients cost about two bits a key. Counters take a byte; larger ones follow with their place.

Filters of one bucket have one order, whatever their numbers of slots, so they merge by merging sorted keys, and the
inverse permutation gives the counted keys back.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

from tallyscope.llm.words import mixed

_U = np.uint64
_HEAD = "<IBBBI"
_ROUNDS = 3
_BACK = [_U(pow(m, -1, 1 << 64)) for m in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


class Filter(NamedTuple):
    limbs: tuple[np.ndarray, ...]  # permuted keys, sorted by the first limb, then the next ones
    count: np.ndarray


def unmixed(h: np.ndarray) -> np.ndarray:
    """The inverse of ``mixed``."""
    h = (h ^ (h >> _U(31)) ^ (h >> _U(62))) * _BACK[0]
    h = (h ^ (h >> _U(27)) ^ (h >> _U(54))) * _BACK[1]
    return h ^ (h >> _U(30)) ^ (h >> _U(60))


def permuted(limbs: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """A bijection of keys: rounds in which every limb is changed by a mix of its neighbour (one limb: by a mix)."""
    out = list(limbs)
    if len(out) == 1:
        return (mixed(out[0]),)
    for step in range(_ROUNDS * len(out)):
        at = step % len(out)
        out[at] = out[at] ^ mixed(out[(at + 1) % len(out)] + _U(step + 1))
    return tuple(out)


def restored(limbs: Sequence[np.ndarray]) -> tuple[np.ndarray, ...]:
    """The keys that ``permuted`` gave these for."""
    out = list(limbs)
    if len(out) == 1:
        return (unmixed(out[0]),)
    for step in reversed(range(_ROUNDS * len(out))):
        at = step % len(out)
        out[at] = out[at] ^ mixed(out[(at + 1) % len(out)] + _U(step + 1))
    return tuple(out)


def counted(limbs: Sequence[np.ndarray], count: np.ndarray | None = None) -> Filter:
    """The filter of permuted keys in any order, repeated ones added up."""
    size = len(limbs[0])
    by = np.argsort(limbs[0]) if len(limbs) == 1 else np.lexsort(tuple(reversed(limbs)))
    limbs = tuple(x[by] for x in limbs)
    new = np.ones(size, bool)
    if size:
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in limbs])
    at = np.flatnonzero(new)
    if count is None:
        total = np.diff(at, append=size)
    else:
        total = np.add.reduceat(count[by], at) if size else count
    return Filter(tuple(x[at] for x in limbs), total.astype(np.int64))


def merged(filters: Sequence[Filter]) -> Filter:
    """One filter with the counts of all of them."""
    if len(filters) == 1:
        return filters[0]
    limbs = tuple(np.concatenate(x) for x in zip(*(f.limbs for f in filters)))
    return counted(limbs, np.concatenate([f.count for f in filters]))


def to_bytes(f: Filter, skip: int = 0) -> bytes:
    """The filter packed; its keys share their first ``skip`` bits, which are left out."""
    m, first = len(f.count), f.limbs[0]
    q = min(max(m - 1, 0).bit_length(), 63 - skip)
    quotient = (first << _U(skip)) >> _U(64 - q) if q else np.zeros(m, _U)
    used = np.zeros(1 << q, bool)
    used[quotient.astype(np.int64)] = True
    ends = np.ones(m, bool)
    ends[:-1] = quotient[1:] != quotient[:-1]
    left = 64 - skip - q
    width = -(-left // 8)
    rest = (first & _U((1 << left) - 1)).astype("<u8").view(np.uint8).reshape(m, 8)[:, :width]
    large = np.flatnonzero(f.count > 255)
    return b"".join([struct.pack(_HEAD, m, len(f.limbs), skip, q, len(large)), np.packbits(used).tobytes(), np.packbits(ends).tobytes(), rest.tobytes(),
                     *(x.astype("<u8").tobytes() for x in f.limbs[1:]), np.minimum(f.count, 255).astype(np.uint8).tobytes(),
                     large.astype("<u4").tobytes(), f.count[large].astype("<i8").tobytes()])


def from_bytes(packed: bytes, bucket: int = 0) -> Filter:
    """The filter that ``to_bytes`` packed, of the bucket that the skipped bits name."""
    m, n_limbs, skip, q, n_large = struct.unpack_from(_HEAD, packed)
    at = struct.calcsize(_HEAD)

    def take(kind, size):
        nonlocal at
        out = np.frombuffer(packed, kind, size, at)
        at += out.nbytes
        return out

    used = np.flatnonzero(np.unpackbits(take(np.uint8, -(-(1 << q) // 8)))[:1 << q]).astype(_U)
    ends = np.unpackbits(take(np.uint8, -(-m // 8)))[:m].astype(np.int64)
    left = 64 - skip - q
    width = -(-left // 8)
    rest = np.zeros((m, 8), np.uint8)
    rest[:, :width] = take(np.uint8, m * width).reshape(m, width)
    first = rest.reshape(-1).view("<u8").astype(_U)
    if m and q:
        first |= used[np.cumsum(ends) - ends] << _U(left)
    if skip:
        first |= _U(bucket << (64 - skip))
    limbs = (first, *(take("<u8", m).astype(_U) for _ in range(n_limbs - 1)))
    count = take(np.uint8, m).astype(np.int64)
    where = take("<u4", n_large)
    count[where.astype(np.int64)] = take("<i8", n_large)
    return Filter(limbs, count)


def by_bucket(f: Filter, skip: int) -> list[tuple[int, Filter]]:
    """The filter cut by the first ``skip`` bits of its keys."""
    if not skip:
        return [(0, f)] if len(f.count) else []
    bucket = f.limbs[0] >> _U(64 - skip)
    cut = [*np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])[:len(bucket)].tolist(), len(bucket)]
    return [(int(bucket[a]), Filter(tuple(x[a:b] for x in f.limbs), f.count[a:b])) for a, b in zip(cut, cut[1:])]
