"""Word and shingle hashing over UTF-8 bytes with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; both are exact on
bytes.  Everything works on whole texts: large batches go through in slabs cut
at white space, so temporary memory is bounded by the slab, not by the text.

Short words have a polynomial hash modulo 2^64, all at once.  Such hashes have
equal values for some long words of few letters, so words of over LONG bytes
have xxh3 of their bytes instead.  ``lane`` 0 and 1 are two independent hashes;
both together are 128 bits, on which operators confirm what they find.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
SLAB = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of a word whose hash is a polynomial.
LONG = 64
#: Odd multipliers of the polynomials, one a lane.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a lane's multiplier and of its inverse."""
    if lane not in _tables or len(_tables[lane][0]) < n:
        with np.errstate(over="ignore"):
            p = np.full(n, _BASES[lane], U)
            i = np.full(n, pow(_BASES[lane], -1, 1 << 64), U)
            p[0] = i[0] = 1
            _tables[lane] = np.multiply.accumulate(p), np.multiply.accumulate(i)
    return _tables[lane]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def _slab_words(x: np.ndarray, cut: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of x; ``cut`` marks places where a text begins."""
    word = ~SPACE[x]
    begin = word.copy()
    begin[1:] &= ~word[:-1]
    end = word.copy()
    end[:-1] &= ~word[1:]
    if len(cut):
        begin[cut] = word[cut]
        before = cut[cut > 0] - 1
        end[before] = word[before]
    s, e = np.flatnonzero(begin), np.flatnonzero(end)
    if not len(s):
        return np.zeros(0, U), s
    p, inv = _powers(max(SLAB, len(x)), lane)
    with np.errstate(over="ignore"):
        c = np.cumsum((x.astype(U) + U(1)) * p[: len(x)], dtype=U)
        h = c[e]
        h[s > 0] -= c[s[s > 0] - 1]
        h = mix(h * inv[s] + (e - s + 1).astype(U) * U(0xD6E8FEB86659FD93))
    for i in np.flatnonzero(e - s >= LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(x[s[i] : e[i] + 1].tobytes(), seed=lane)
    return h, s


def word_hashes(x: np.ndarray, o: np.ndarray, lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts x[o[i]:o[i+1]], and each text's offsets into them."""
    lo, hi = int(o[0]), int(o[-1])
    hashes, starts, at = [], [], lo
    inner = o[:-1]
    while at < hi:
        to = min(at + SLAB, hi)
        if to < hi:  # end the slab where a word can't go on
            j = int(np.searchsorted(o, to, "right")) - 1
            if o[j] > at and o[j] >= to - SLAB // 2:
                to = int(o[j])
            else:
                while to < hi and not SPACE[x[to - 1]]:
                    to += 1
        y = LOWER[x[at:to]]
        a, b = np.searchsorted(inner, [at, to])
        h, s = _slab_words(y, np.unique(inner[a:b] - at), lane)
        hashes.append(h)
        starts.append(s + at)
        at = to
    if not hashes:
        return np.zeros(0, U), np.zeros(len(o), np.int64)
    h, s = np.concatenate(hashes), np.concatenate(starts)
    return h, np.searchsorted(s, o).astype(np.int64)


def shingles(h: np.ndarray, w: int) -> np.ndarray:
    """Hash of each run of w word hashes, by its first word (w - 1 fewer values)."""
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        r = h[:n] + U(w)
        for j in range(1, w):
            r = mix(r) * U(0x9FB21C651E98DF25) + h[j : j + n]
    return mix(r)


def short_sequence(h: np.ndarray) -> np.ndarray:
    """The whole of a text with fewer words than a shingle, as one value."""
    return shingles(h, len(h)) if len(h) else np.zeros(0, U)


def text_shingles(h: np.ndarray, wo: np.ndarray, w: int):
    """For each text the hashes of its shingles, repeats kept, in order."""
    every = shingles(h, w)
    for a, b in zip(wo[:-1].tolist(), wo[1:].tolist()):
        yield every[a : b - w + 1] if b - a >= w else short_sequence(h[a:b])


def text_pairs(x: np.ndarray, o: np.ndarray, w: int):
    """For each text its distinct shingles as two aligned arrays, one a lane, in order of the first."""
    lanes = []
    for lane in (0, 1):
        h, wo = word_hashes(x, o, lane)
        lanes.append(text_shingles(h, wo, w))
    for a, b in zip(*lanes):
        by = np.lexsort((b, a)) if len(a) else np.zeros(0, np.int64)
        a, b = a[by], b[by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield a[new], b[new]
