"""Pairs of 256-bit signatures within a radius, found without comparing all and without losing one: covering masks on parts.

The bits are cut into parts, each with a threshold, ``sum(threshold + 1) = radius + 1``. Of a pair within the radius some part i differs in at most its
threshold t_i of bits, and together with the next part (around a ring) in at most t_i + t_next + 1: parts' differences less threshold + 1 add up to less than
0, so a start on the ring exists from which all partial sums stay below 0. A part's bits get vectors of t_i + 1 dimensions over GF(2); mask v keeps the bits whose
vector has an odd product with v. Whatever t_i bits differ, some v other than 0 is orthogonal to their vectors, and its mask keeps none of them (Pagh's
covering codes). So rows equal under a mask are compared, on 64 bits first, and every pair within the radius is met; where it is met more than once, the first part and mask count.

A mask keeps about half of a part's bits, so that a row meets a small part of the others. Rows that lie in crowds, as texts made from one template do, meet each other under
many masks; ``crowded()`` finds them from one mask a part, to be compared with all rows. Where rows are few, or the rest are still much alike, comparing all with all costs less, which
``worth()`` finds out likewise. All ways give the same pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BITS, MOST, CHUNK, FEW = 256, 6, 32_768, 6000
#: Nanoseconds, of which only the proportions matter: to compare two rows among all; to sort a row under a mask; to compare two rows of a run; to check a pair that passed.
ALL, SORT, RUN, PASSED = 6, 14, 4, 150


@lru_cache
def masks(bits: int, dims: int) -> np.ndarray:
    """The 2^dims - 1 masks of a part. Any vectors are right; these are chosen, by local search, for few rows equal under a mask by chance."""
    rng, every = np.random.default_rng(bits * 64 + dims), np.arange(1 << dims)
    odd = (np.bitwise_count(every[1:, None] & every[None, :]) & 1).astype(np.int64)  # mask, vector
    best, least = None, np.inf
    for _ in range(6):
        own = rng.integers(1, 1 << dims, bits)
        weight, cost = odd[:, own].sum(1), np.inf
        while True:
            for j in range(bits):
                rest = weight - odd[:, own[j]]
                costs = (0.5 ** (rest[:, None] + odd)).sum(0)
                own[j] = costs.argmin()
                weight = rest + odd[:, own[j]]
            if costs.min() >= cost:
                break
            cost = costs.min()
        if cost < least:
            best, least = own.copy(), cost
    return (odd[:, best] << np.arange(bits)).sum(1).astype(np.uint32)


@lru_cache
def layout(radius: int) -> list[tuple[int, int, int]] | None:
    """(first bit, bits, threshold) of each part, or None where no parts of 16 to 32 bits serve the radius."""
    n = max(8, -(-(radius + 1) // (MOST + 1)))
    if radius + 1 < n or n > BITS // 16:
        return None
    low, more = divmod(radius + 1 - n, n)
    size, longer = divmod(BITS, n)
    return [(k * size + min(k, longer), size + (k < longer), low + (k < more)) for k in range(n)]


def window(sig: np.ndarray, first: int, bits: int) -> np.ndarray:
    """Up to 64 bits of each signature from bit ``first`` on, around the end."""
    j, s = divmod(first % BITS, 64)
    out = sig[:, j] >> np.uint64(s)
    if s:
        out = out | (sig[:, (j + 1) % 4] << np.uint64(64 - s))
    return out & np.uint64((1 << bits) - 1)


def order(u: np.ndarray, mask: np.uint32) -> tuple[np.ndarray, np.ndarray]:
    """The rows in an order in which those equal under the mask are together, and a number for each place: how many rows of its run follow."""
    key = (((u.astype(np.uint32) & mask) * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    o = np.argsort(key, kind="stable")
    key = key[o]
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    return o, np.repeat(ends, np.diff(ends, prepend=0)) - 1 - np.arange(len(key))


def met(u: np.ndarray, o: np.ndarray, left: np.ndarray, mask: np.uint32, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows equal under the mask that differ in at most ``limit`` bits of u, in blocks."""
    u, mask, n = u[o], np.uint64(mask), len(o)
    at_least = np.bincount(left)[::-1].cumsum()[::-1]  # rows that have so many behind them in their run
    near = int((at_least[1:] >= n / 8).sum())  # so far apart, all rows are compared with those behind them; further, only those that need it
    x, c = np.empty(CHUNK, np.uint64), np.empty(CHUNK, np.uint8)
    some, held = [], 0
    for lo in range(0, n if near else 0, CHUNK):
        for d in range(1, near + 1):
            m = min(lo + CHUNK, n - d) - lo
            if m <= 0:
                break
            np.bitwise_xor(u[lo : lo + m], u[lo + d : lo + m + d], out=x[:m])
            np.bitwise_count(x[:m], out=c[:m])
            p = np.flatnonzero(c[:m] <= limit)
            p = p[x[p] & mask == 0] + lo
            if len(p):
                some.append((p, d))
                held += len(p)
        if held > 500_000:
            yield tuple(o[np.concatenate([p + d * k for p, d in some])] for k in (0, 1))
            some, held = [], 0
    far, d = np.flatnonzero(left > near), near + 1
    while len(far):
        y = u[far] ^ u[far + d]
        p = far[(np.bitwise_count(y) <= limit) & (y & mask == 0)]
        if len(p):
            some.append((p, d))
            held += len(p)
        if held > 500_000:
            yield tuple(o[np.concatenate([p + d * k for p, d in some])] for k in (0, 1))
            some, held = [], 0
        d += 1
        far = far[left[far] >= d]
    if some:
        yield tuple(o[np.concatenate([p + d * k for p, d in some])] for k in (0, 1))


def parts(radius: int) -> list[tuple[int, int, int, np.ndarray]]:
    """(first bit, bits with the next part's, differing bits allowed in these, masks) of each part."""
    own = layout(radius)
    return [(first, bits + more, t + s + 1, masks(bits, t + 1)) for (first, bits, t), (_, more, s) in zip(own, own[1:] + own[:1])]


def typical(covers: np.ndarray) -> np.uint32:
    """A mask under which rather more rows are equal than under most."""
    weight = np.bitwise_count(covers)
    return covers[np.argsort(weight, kind="stable")[len(covers) // 4]]


def crowded(sig: np.ndarray, radius: int) -> np.ndarray:
    """Whether a row costs less by comparing it with all others than in near()."""
    cost = np.zeros(len(sig))
    if len(sig) < FEW or not layout(radius):
        return cost > 0
    for first, bits, limit, own in parts(radius):
        u, mask, held = window(sig, first, bits), typical(own), 0
        for p, q in met(u, *order(u, mask), mask, limit):
            cost += len(own) * PASSED / 2 * (np.bincount(p, minlength=len(sig)) + np.bincount(q, minlength=len(sig)))
            if (held := held + len(p)) > 64 * len(sig):  # enough to know the crowds
                break
    return cost > ALL * len(sig)


def worth(sig: np.ndarray, compared: float, radius: int) -> bool:
    """Whether near() costs less than comparing so many pairs of rows."""
    if len(sig) < FEW or not layout(radius):
        return False
    cost = 0.0
    for first, bits, limit, own in parts(radius):
        u, mask = window(sig, first, bits), typical(own)
        o, left = order(u, mask)
        cost += len(own) * (SORT * len(sig) + RUN * float(left.sum()))
        if cost > ALL * compared:
            return False
        for p, _ in met(u, o, left, mask, limit):
            cost += len(own) * PASSED * len(p)
            if cost > ALL * compared:
                return False
    return True


def near(sig: np.ndarray, second: np.ndarray | None, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of sig within the radius, each once, in blocks; with ``second`` only pairs of a row where it is false with one where it is true, in this order."""
    own, all_ = layout(radius), parts(radius)
    for i, (first, bits, limit, covers) in enumerate(all_):
        u = window(sig, first, bits)
        for v, mask in enumerate(covers):
            for p, q in met(u, *order(u, mask), mask, limit):
                if second is not None:
                    p, q = np.where(second[p], q, p), np.where(second[p], p, q)
                    ok = second[q] & ~second[p]
                    p, q = p[ok], q[ok]
                x = sig[p] ^ sig[q]
                ok = np.flatnonzero(np.bitwise_count(x).sum(1, dtype=np.int32) <= radius)
                # It counts here if no part before this one, and no mask of this one before, meets it.
                count = {}
                for k in (*range(i + 1), (i + 1) % len(own)):
                    count[k] = np.bitwise_count(window(x[ok], *own[k][:2])).astype(np.int32)
                fits = [(count[k] <= own[k][2]) & (count[k] + count[(k + 1) % len(own)] <= all_[k][2]) for k in range(i + 1)]
                ok = ok[fits[i] & ~np.any(fits[:i], axis=0)] if i else ok[fits[0]]
                mine = window(x[ok], *own[i][:2]).astype(np.uint32)
                for before in covers[:v]:
                    if not len(ok):
                        break
                    apart = mine & before != 0
                    ok, mine = ok[apart], mine[apart]
                if len(ok):
                    yield p[ok], q[ok]
