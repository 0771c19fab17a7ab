"""Vectorised hashed features of whole texts: words and character n-grams as numpy arrays over code points."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)
_SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
_SPACE = np.zeros(0x3100, bool)
_SPACE[_SPACES] = True


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * _Q
        return h ^ (h >> np.uint64(29))


@dataclass
class Packed:
    """Texts as one array of code points, a space before, between and after them."""

    code: np.ndarray
    space: np.ndarray
    #: of each word: first code point, code point after it, text
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    #: of each text: its first code point, and the one after its last
    first: np.ndarray
    last: np.ndarray
    n_docs: int

    def word_at(self) -> np.ndarray:
        """For each code point, the word that it is in or, if a space, the next word."""
        ended = np.zeros(len(self.code), np.int32)
        ended[self.end] = 1
        return np.cumsum(ended, dtype=np.int32)

    def doc_at(self) -> np.ndarray:
        """For each code point, its text; the space after a text counts to the next one."""
        return np.cumsum(np.bincount(self.last, minlength=len(self.code))[: len(self.code)], dtype=np.int32)


def pack(texts: list[str]) -> Packed:
    joined = " " + " ".join(texts) + " "
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _SPACE[np.minimum(code, 0x30FF)]
    edge = np.diff(space.view(np.int8))
    start = np.flatnonzero(edge == -1) + 1
    end = np.flatnonzero(edge == 1) + 1
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    last = np.cumsum(lengths + 1)
    first = last - lengths
    doc = np.searchsorted(last, start, side="right")
    return Packed(code, space, start, end, doc, first, last, len(texts))


def grams(p: Packed, sizes: tuple[int, ...]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(n, first code point, hash) of the n-grams inside words with one space on each side as boundary marks."""
    out = []
    plain = np.where(p.space, np.uint64(32), p.code.astype(np.uint64))
    h = plain.copy()
    inner = ~p.space
    clear = None  # no space strictly inside the window
    with np.errstate(over="ignore"):
        for n in range(2, max(sizes) + 1):
            h = h[:-1] * _P + plain[n - 1 :]
            if n == 2:
                clear = np.ones(len(h), bool)
            else:
                clear = clear[:-1] & inner[n - 2 : n - 2 + len(clear) - 1]
            if n in sizes:
                some = clear & ~(p.space[: len(h)] & p.space[n - 1 :] & (n == 2))
                at = np.flatnonzero(some)
                out.append((n, at, mixed(h[at] + np.uint64(n))))
    return out


def word_hashes(p: Packed) -> np.ndarray:
    """A 64-bit hash of each word."""
    n = len(p.code)
    with np.errstate(over="ignore"):
        power = np.ones(n + 1, np.uint64)
        power[1:] = np.cumprod(np.full(n, _P))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(p.code.astype(np.uint64) * power[:n], out=sums[1:])
        # sums of c[i] * P^i differ by a factor P^start; bring all to the same one by its inverse
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        back = np.ones(n + 1, np.uint64)
        back[1:] = np.cumprod(np.full(n, inverse))
        return mixed((sums[p.end] - sums[p.start]) * back[p.start])
