"""Word shingles of whole texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words that a worker keeps hashed.
KEPT_WORDS = 200_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh3_64_intdigest(word)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = out
        return out


_words = _Words()


def forget() -> None:
    """Let go of the words, as a worker lives on after its task."""
    _words.clear()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no order in them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct shingles: of the words between ASCII white space, A-Z lower-cased, each run of `width`; the whole
    sequence if there are fewer words; none without words."""
    # bytes.lower() and bytes.split() know ASCII only, which is what is asked for.
    words = (text or "").encode().lower().split()
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    run = min(width, len(w))
    total = np.full(len(w) - run + 1, run, np.uint64)
    for k in range(run):
        total += mixed(w[k : len(w) - run + 1 + k] + _ODD[k % 8]) * _ODD[(k + 3) % 8]
    return np.unique(mixed(total))
