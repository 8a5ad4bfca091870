"""Array kernels over batches of texts: code points, words, shingles and rolling hashes.

All hashes are 64-bit and depend on the text alone, so they agree across executors and runs.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 2**64)

#: Texts are worked on in slices of about this many code points, which bounds a worker's memory.
SLICE = 1_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def word_table() -> np.ndarray:
    """True for the letters and numbers (Unicode L and N)."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LN" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


@lru_cache(maxsize=1)
def char_values() -> np.ndarray:
    return mix(np.arange(1, sys.maxunicode + 2, dtype=U64) * U64(_BASE))


@lru_cache(maxsize=1)
def _power_cache() -> dict:
    return {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    cache = _power_cache()
    if cache.get("n", 0) < n:
        size = max(n, SLICE + 1024)
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            cache[name] = np.multiply.accumulate(steps)
        cache["n"] = size
    return cache["up"][:n], cache["down"][:n]


def slices(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of the list with about ``most`` code points each, at least one text."""
    at = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one zero after each, and the texts' starts (one more than texts)."""
    joined = "\0".join(texts) + "\0"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return cp, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def prefix_hash(cp: np.ndarray) -> np.ndarray:
    """H with (H[j] - H[i]) * down[i] the hash of cp[i:j], before ``mix``."""
    up, _ = powers(len(cp))
    out = np.empty(len(cp) + 1, U64)
    out[0] = 0
    np.cumsum(char_values()[cp] * up, out=out[1:])
    return out


def lowered(text: str) -> str:
    """Lower case with as many code points as before."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, start) of every word: a maximal run of letters and numbers, in lower case."""
    cp, starts = codepoints([lowered(t) for t in texts])
    inside = word_table()[cp]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    begin, end = edge[::2], edge[1::2]
    h = prefix_hash(cp)
    _, down = powers(len(cp))
    hashed = mix((h[end] - h[begin]) * down[begin])
    owner = np.searchsorted(starts, begin, "right") - 1
    return hashed, owner, begin - starts[owner]


def shingles(texts: list[str], width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of the distinct word sequences of each text, sorted by text, then hash.
    A text of fewer words has none."""
    hashed, owner, _ = words(texts)
    n = len(hashed) - width + 1
    if n <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    total = np.zeros(n, U64)
    for k in range(width):
        total = mix(total + hashed[k : n + k] * U64(_BASE))
    same = owner[:n] == owner[width - 1 :]
    total, owner = total[same], owner[:n][same]
    order = np.lexsort((total, owner))
    total, owner = total[order], owner[order]
    first = np.ones(len(total), bool)
    first[1:] = (total[1:] != total[:-1]) | (owner[1:] != owner[:-1])
    return total[first], owner[first]
