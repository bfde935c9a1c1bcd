"""SuperMinHash signatures of word shingles, for batches of documents at once."""

from __future__ import annotations

import numpy as np
import xxhash

from .common import Memo

SHINGLE = 5
_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's finish)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Distinct 64-bit hashes of the 5-word shingles of texts; a worker remembers words' hashes."""

    def __init__(self, memo_words: int = 200_000) -> None:
        self.memo = Memo(memo_words)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """Sorted distinct shingles of each text.

        Texts with 1 to 4 words have one shingle, texts without words none. ASCII letters' case is dropped.
        """
        split = [x.lower().split() for x in texts]
        self.memo.learn(set().union(*split), lambda missing: [xxhash.xxh64_digest(w) for w in missing])
        hashed = self.memo.__getitem__
        h = np.frombuffer(b"".join([b"".join(map(hashed, w)) for w in split]), "<u8")
        words = np.array([len(w) for w in split], np.int64)
        starts = np.cumsum(words) - words
        # all texts at once; windows that cross into the next text are left out below
        total = np.full(len(h), SHINGLE, _U)
        for k in range(SHINGLE):
            total = mix(total + np.r_[h[k:], h[:k]] * _ODD[k])
        out = []
        for n, at in zip(words.tolist(), starts.tolist(), strict=True):
            if n >= SHINGLE:
                out.append(np.unique(total[at : at + n - SHINGLE + 1]))
            else:  # the whole sequence, told from windows by its length
                one = np.full(min(n, 1), n, _U)
                for k in range(n):
                    one = mix(one + h[at + k : at + k + 1] * _ODD[k])
                out.append(one)
        return out


def signatures(sets: list[np.ndarray], size: int) -> np.ndarray:
    """One row of ``size`` values per set (``size`` a power of two); an empty set's row is infinite.

    Every element has a random order of the positions. In step i it gives its i-th position the value i + a random
    fraction, and a position keeps its least value. So an element's ranks are never equal, which lowers the estimate's variance, and
    a set is finished as soon as all its positions have a value: later steps could only give greater ones.
    """
    out = np.full((len(sets), size), np.inf)
    flat = out.reshape(-1)
    bits = size.bit_length() - 1
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    h = np.concatenate([*sets, np.empty(0, _U)]).astype(_U)
    order_key = mix(h ^ _U(0x5851F42D4C957F2D))
    for step in range(size):
        if not len(h):
            break
        # the step-th place of the element's order: a chain of bijections on [0, size) keyed by its hash
        p = _permuted(np.full(len(h), step, np.int64), order_key, bits)
        r = (mix(h + _U((step + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> _U(11)).astype(np.float64) * 2.0**-53
        at = owner * size + p
        np.minimum.at(flat, at, r + step)
        full = np.isfinite(out).all(axis=1)
        keep = ~full[owner]
        if not keep.all():
            h, owner, order_key = h[keep], owner[keep], order_key[keep]
    return out


def _permuted(i: np.ndarray, key: np.ndarray, bits: int) -> np.ndarray:
    mask = (1 << bits) - 1
    k = key.astype(np.int64)
    x = i
    for part in (0, 16, 32):
        own = k >> part
        x = (x * (2 * (own & 0x7F) + 1) + ((own >> 7) & mask)) & mask  # odd factors can be undone
        x ^= x >> (bits // 2)
    return x


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """64-bit keys, a column per band; equal keys mean (but for hash collisions) equal values in the band's rows."""
    bits = np.ascontiguousarray(signature[:, : bands * rows]).view(_U).reshape(len(signature), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _ODD[0], bits.shape[:2]).copy()
    for k in range(rows):
        key = mix(key + bits[:, :, k] * _ODD[1])
    return key.view(np.int64)
