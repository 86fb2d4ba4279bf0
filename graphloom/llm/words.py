"""Words of whole texts and their 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_hash = xxhash.xxh3_64_intdigest
U64 = np.uint64
#: Odd multipliers of the mixing steps below (64-bit finaliser constants of MurmurHash3).
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each input bit moves all output bits."""
    x = x ^ (x >> U64(33))
    x = x * _M1
    x = x ^ (x >> U64(33))
    x = x * _M2
    return x ^ (x >> U64(33))


#: An odd factor for each place of a shingle, from an unrelated sequence: factors in a progression would make swapped words collide.
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between spaces and the characters 0x09-0x0D: what ``bytes.split`` does; lower-casing bytes is A-Z only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hash, words), dtype=U64, count=len(words))


def shingle_set(words: list[bytes], size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; of fewer words the whole sequence is one; of none, none."""
    if not words:
        return np.empty(0, U64)
    h = hashes(words)
    n = max(1, len(h) - size + 1)
    k = min(size, len(h))
    # Each place has an odd factor of its own; words' hashes are spread over all bits already.
    total = np.full(n, U64(k))
    for j in range(k):
        total += h[j : j + n] * _PLACE[j % len(_PLACE)]
    return np.unique(mix(total))
