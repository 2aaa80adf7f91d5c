"""Words of a text as 64-bit hashes, their shingles, and MinHash bands, in numpy.

Words are runs of bytes of the UTF-8 text without ASCII white space; A-Z count as a-z.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SHINGLE = 5

_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 1 << 63, size=256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_SOLID = np.ones(256, dtype=bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False
_PLACES = 1 << 16
_POWER = np.cumprod(np.full(_PLACES, 0x9E3779B97F4A7C15, dtype=np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose results look drawn at random."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of a whole text's words in code points, and their hashes."""
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    solid = _SOLID[raw]
    edges = np.flatnonzero(np.diff(solid, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    body = raw[solid]
    place = np.arange(len(body)) - np.repeat(first, lengths)
    weight = _POWER[place & (_PLACES - 1)]
    if lengths.max() > _PLACES:
        weight = weight * (2 * (place // _PLACES) + 1).astype(np.uint64)
    hashes = mixed(np.add.reduceat(_BYTE[body] * weight, first) + lengths.astype(np.uint64))
    if not text.isascii():
        point = np.cumsum((raw & 0xC0) != 0x80)
        starts, ends = point[starts] - 1, point[ends - 1]
    return starts, ends, hashes


def shingles_of(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One hash for each window of ``size`` words (of the whole, if shorter)."""
    n, size = max(1, len(words) - size + 1), min(size, len(words))
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out = (out ^ words[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def kept_shingles(shingles: np.ndarray) -> bytes:
    """The distinct shingles for the exact comparison, 32 bits of each (odds of about 1e-6 that a pair of texts shares one by chance)."""
    return np.unique((shingles >> np.uint64(32)).astype("<u4")).tobytes()


@lru_cache(maxsize=4)
def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    mul, add = np.random.default_rng(11).integers(1, 1 << 63, size=(2, n), dtype=np.uint64)
    return mul | np.uint64(1), add


def band_keys(shingles: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band keys (set, band), as signed longs, of the sets of shingles that begin at ``starts``."""
    mul, add = _coefficients(bands * rows)
    keys = np.zeros((len(starts), bands), dtype=np.uint64)
    for k in range(bands * rows):
        value = shingles * mul[k] + add[k]
        value ^= value >> np.uint64(32)
        least = np.minimum.reduceat(value * np.uint64(0xD6E8FEB86659FD93), starts)
        keys[:, k // rows] = (keys[:, k // rows] ^ least) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(k)
    return keys.view(np.int64)
