"""Hash families and LSH parameters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import xxhash

try:
    from _md5 import md5  # for short inputs faster than hashlib's
except ImportError:
    from hashlib import md5

PRIME = (1 << 31) - 1


def portable_hashes(tokens: Iterable[str | bytes]) -> np.ndarray:
    """60-bit hashes that SQL engines can compute too: the first 15 hex digits of the md5. Bytes are taken as UTF-8."""
    digests = b"".join([md5(t if t.__class__ is bytes else t.encode("utf-8", "surrogatepass")).digest() for t in tokens])
    return (np.frombuffer(digests, ">u8")[::2] >> np.uint64(4)).astype(np.int64)


@lru_cache
def permutations(count: int, seed: int = 42) -> tuple[tuple[int, int], ...]:
    """(a, b) of h -> (a h + b) mod PRIME, from a fixed recurrence."""
    x, out = seed, []
    for _ in range(count):
        x = x * 48271 % PRIME
        a = x
        x = x * 48271 % PRIME
        out.append((max(a, 1), x))
    return tuple(out)


@lru_cache
def _room(count: int, seed: int) -> tuple[np.ndarray, ...]:
    """Factors, and arrays to work in that stay in the cache."""
    a, b = np.array(permutations(count, seed), np.uint64).T.copy()
    return a, b, *(np.empty((128, count), t) for t in (np.uint64, np.uint64, np.uint32, np.uint32))


def minhash(hashes: np.ndarray, count: int, seed: int = 42) -> np.ndarray:
    """The least permuted hash under each permutation; PRIME for no hashes. Hashes lie below PRIME."""
    out = np.full(count, PRIME, np.uint32)
    a, b, *room = _room(count, seed)
    hashes = hashes.astype(np.uint64)[:, None]
    for k in range(0, len(hashes), 128):
        piece = hashes[k : k + 128]
        x, high, low, less = (r[: len(piece)] for r in room)
        np.multiply(piece, a, out=x)
        x += b
        np.right_shift(x, np.uint64(31), out=high)  # 2**31 is 1 modulo PRIME
        x &= np.uint64(PRIME)
        np.add(x, high, out=low, casting="unsafe")  # below 2 * PRIME
        np.subtract(low, np.uint32(PRIME), out=less)  # wraps where low is less than PRIME
        np.minimum(low, less, out=low)
        np.minimum(out, low.min(0), out=out)
    return out.astype(np.int64)


def xxh3(data: bytes, bits: int = 64, seed: int = 0) -> int:
    """XXH3 of 32, 64 or 128 bits; 32 are the low ones of 64."""
    if bits == 128:
        return xxhash.xxh3_128_intdigest(data, seed)
    if bits in (32, 64):
        return xxhash.xxh3_64_intdigest(data, seed) & ((1 << bits) - 1)
    raise ValueError("bits must be 32, 64 or 128")


@lru_cache
def lsh_parameters(threshold: float, permutations: int, fp_weight: float = 0.5, fn_weight: float = 0.5) -> tuple[int, int]:
    """(bands, rows) with the least weighted area of false positives below and false negatives above the threshold."""
    if not 0 < threshold < 1 or permutations < 2:
        raise ValueError("threshold must lie between 0 and 1, and there must be two permutations or more")
    nodes, weights = np.polynomial.legendre.leggauss(64)
    low, high = (nodes + 1) * threshold / 2, threshold + (nodes + 1) * (1 - threshold) / 2
    best = None
    for bands in range(1, permutations + 1):
        for rows in range(1, permutations // bands + 1):
            fp = (weights * (1 - (1 - low**rows) ** bands)).sum() * threshold / 2
            fn = (weights * (1 - high**rows) ** bands).sum() * (1 - threshold) / 2
            error = fp_weight * fp + fn_weight * fn
            if best is None or error < best[0] - 1e-12:
                best = (error, bands, rows)
    return best[1], best[2]
