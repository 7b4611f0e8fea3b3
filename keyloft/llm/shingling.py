"""Word-shingle sets of many texts at once, in numpy.

A word's hash is a polynomial over its bytes, taken from prefix sums over a whole block of texts; a shingle's hash mixes
those of its words. All hashes have 64 bits: two different shingles of one document meet with a chance near 1e-11 even at
20,000 words.
"""

from __future__ import annotations

import numpy as np

from keyloft.llm.common import worker_store

#: Bytes hashed in one go; longer texts are cut at white space.
BLOCK = 1 << 19


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _constants() -> dict:
    store = worker_store()
    if "shingling" not in store:
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        value = splitmix(np.arange(1000, 1256, dtype=np.uint64))[lower]
        white = np.zeros(256, dtype=bool)
        white[[32, 9, 10, 11, 12, 13]] = True
        store["shingling"] = {"value": value, "white": white, "n": 0}
    return store["shingling"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    held = _constants()
    if held["n"] < n:
        p = 0x5851F42D4C957F2D
        inverse = pow(p, -1, 1 << 64)
        size = max(n, BLOCK + 1)
        with np.errstate(over="ignore"):
            held["up"], held["down"] = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (p, inverse))
        held["n"] = size
    return held["up"], held["down"]


def _block_words(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a block and where they start."""
    held = _constants()
    raw = np.frombuffer(block, dtype=np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    up, down = _powers(len(raw))
    white = held["white"][raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(held["value"][raw] * up[: len(raw)], dtype=np.uint64)])
        hashes = splitmix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, starts


def _pieces(text: bytes) -> list[bytes]:
    """A long text in pieces of about BLOCK bytes that end at white space (one word longer than that stays whole)."""
    out, at = [], 0
    while len(text) - at > BLOCK:
        cut = max(text.rfind(c, at, at + BLOCK) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut <= at:
            found = [x for x in (text.find(c, at + 1) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) if x > 0]
            cut = min(found, default=len(text))
        out.append(text[at:cut])
        at = cut
    out.append(text[at:])
    return out


def word_hashes(texts: list[bytes]):
    """For each text in order, the hashes of its lower-cased words."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > BLOCK:
            yield np.concatenate([_block_words(p)[0] for p in _pieces(texts[at])])
            at += 1
            continue
        to, size = at, 0
        while to < len(texts) and size + len(texts[to]) + 1 <= BLOCK + 1:
            size += len(texts[to]) + 1
            to += 1
        hashes, starts = _block_words(b" ".join(texts[at:to]))
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[at:to]])])
        cuts = np.searchsorted(starts, bounds)
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield hashes[a:b]
        at = to


def shingle_sets(texts: list[bytes], width: int):
    """For each text, the sorted distinct hashes of its shingles of ``width`` words.

    A text of fewer words is one shingle as a whole; a text without words has none.
    """
    for words in word_hashes(texts):
        n = len(words)
        if not n:
            yield words
            continue
        k = min(width, n)
        with np.errstate(over="ignore"):
            out = np.full(n - k + 1, k, dtype=np.uint64)
            for i in range(k):
                out = splitmix(out * np.uint64(0xD6E8FEB86659FD93) ^ words[i : n - k + 1 + i])
        yield np.unique(out)
