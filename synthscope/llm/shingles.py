"""Hashes of word shingles, computed a text at a time without a step per word.

Words are runs of anything but ASCII whitespace, A-Z lower-cased. A word's hash is a
polynomial of its bytes modulo 2 ** 64, read off running sums; a shingle's hash combines
those of its words. Texts are read in pieces that end between words, so a long text needs
the memory of a piece and of its words.
"""

from __future__ import annotations

import numpy as np

#: Bytes read at once.
PIECE = 1 << 17
_RNG = np.random.default_rng(20240607)
_BYTES = _RNG.integers(1, 1 << 63, 256, np.uint64)
_PLACES = _RNG.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64, kept from call to call for texts of ordinary size."""
    known = _POWERS.get(base)
    if known is None or len(known) < size:
        known = np.full(max(size, PIECE), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if len(known) <= 2 * PIECE:
            _POWERS[base] = known
    return known[:size]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _piece_hashes(piece: bytes) -> np.ndarray:
    raw = np.frombuffer(piece, np.uint8)
    edges = np.flatnonzero(np.diff(_SPACE[raw], prepend=True, append=True))
    begin, end = edges[::2], edges[1::2]
    if not len(begin):
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    return mixed((sums[end] - sums[begin]) * _powers(_INVERSE, len(raw))[begin])


def word_hashes(text: bytes | None) -> np.ndarray:
    """The hash of each word, in order."""
    text = (text or b"").lower()
    out, at = [], 0
    while at < len(text):
        cut = min(len(text), at + PIECE)
        while cut < len(text) and not _SPACE[text[cut]]:
            cut += 1
        out.append(_piece_hashes(text[at:cut]))
        at = cut
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, in order; runs of different lengths hash differently."""
    k = len(words) - n + 1
    if k <= 0 or n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(k, n, np.uint64)
    for j in range(n):
        total += words[j : j + k] * (_PLACES[j] if j < len(_PLACES) else np.uint64(pow(_BASE, j, 1 << 64)))
    return mixed(total)


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """The distinct hashes, in order of size, of a text's n-word runs (of all its words, if it has fewer); none without words."""
    words = word_hashes(text)
    return np.unique(run_hashes(words, min(n, len(words))))
