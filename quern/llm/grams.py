"""Character runs of many texts at once, as 64-bit hashes in numpy arrays.

All functions take a list of texts and work on the concatenation of the list,
so that the cost per text is a few array passes and no Python loop per
character. A hash depends on the run's characters only, so equal runs have
equal hashes in every task and at every size of the input.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
NONE = U64(0xFFFFFFFFFFFFFFFF)
#: From this code point on a character counts as a word's share of its own (CJK, kana, hangul).
WIDE_FROM = 0x2E80


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h ^ (h >> U64(29))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(32))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(29))


def mix_scalar(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=U64))[0])


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters in one array, and the offsets of the texts (one more than texts)."""
    lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    a = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return a, np.concatenate([[0], np.cumsum(lens)])


_POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept between calls."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, base, dtype=U64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def _prefix(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums and inverse powers: run [i, j) has hash (S[j] - S[i]) * inv[i]."""
    power, inv = _powers(len(a))
    s = np.zeros(len(a) + 1, dtype=U64)
    c = (a.astype(U64) + U64(1)) * U64(0xBF58476D1CE4E5B9)
    np.cumsum((c ^ (c >> U64(31))) * power, out=s[1:])
    return s, inv


def runs(texts: list[str], k: int, wide: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, start within the text, hash) of every run of k units.

    A wide character counts ``wide`` units, any other one. A text shorter than
    k units has a single run, itself; an empty text has none.
    """
    a, off = code_points(texts)
    n, lens = len(a), np.diff(off)
    own = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    if not n:
        return own, own.copy(), np.zeros(0, dtype=U64)
    s, inv = _prefix(a)
    at = np.arange(n)
    if wide == 1:
        end = at + k
    else:
        unit = np.where(a >= WIDE_FROM, wide, 1)
        cum = np.cumsum(unit)
        char_at = np.repeat(at, unit)
        last = cum - unit + k - 1
        end = np.where(last < len(char_at), char_at[np.minimum(last, len(char_at) - 1)] + 1, n + 1)
    stop = off[1:][own]
    first = off[:-1][own]
    whole = (end > stop) & (at == first)
    end = np.where(whole, stop, end)
    keep = np.flatnonzero(end <= stop)
    h = mix((s[end[keep]] - s[keep]) * inv[keep])
    return own[keep], keep - first[keep], h


def char_sets(texts: list[str], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct k-character runs of each text; none for a text under k characters."""
    own, _, h = runs(texts, k)
    long = np.fromiter((len(t) >= k for t in texts), dtype=bool, count=len(texts))
    keep = long[own] if len(own) else np.zeros(0, dtype=bool)
    own, h = own[keep], h[keep]
    cut = np.searchsorted(own, np.arange(len(texts) + 1))
    return [np.unique(h[cut[i] : cut[i + 1]]) for i in range(len(texts))]


def window_minima(own: np.ndarray, h: np.ndarray, w: int) -> np.ndarray:
    """Positions (into h) of the runs that are smallest in some window of w runs of their text.

    w is a power of two. A text with fewer than w runs has one window. Runs
    depend on their own surroundings only, so a stretch of w + 1 equal runs in
    two texts always gives a common choice.
    """
    n = len(h)
    if not n or w == 1:
        return np.arange(n)
    m, step = h, 1
    while step < w:
        shifted = np.full(n, NONE, dtype=U64)
        shifted[: n - step] = m[step:] if n > step else shifted[: n - step]
        m = np.minimum(m, shifted)
        step *= 2
    full = np.zeros(n, dtype=bool)
    if n >= w:
        full[: n - w + 1] = own[: n - w + 1] == own[w - 1 :]
    start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    short = start[size < w]
    chosen = np.zeros(n, dtype=bool)
    if full.any():
        # h[i] is chosen if it is the minimum of any full window that covers it
        best = np.where(full, m, U64(0))
        reach, step = best, 1
        while step < w:
            shifted = np.zeros(n, dtype=U64)
            shifted[step:] = reach[: n - step]
            reach = np.maximum(reach, shifted)
            step *= 2
        chosen = h == reach
        chosen &= (reach != U64(0)) | (h == U64(0))
    if len(short):
        low = np.minimum.reduceat(h, start)
        text = np.repeat(np.arange(len(start)), size)
        chosen |= (size < w)[text] & (h == low[text])
    return np.flatnonzero(chosen)


def chunks(texts: list[str], chars: int = 200_000) -> list[tuple[int, int]]:
    """Stretches of the list with about so many characters each, small enough for a CPU's cache."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            out.append((start, i + 1))
            start, size = i + 1, 0
    if start < len(texts):
        out.append((start, len(texts)))
    return out


def token_sets(texts: list[str], units: int, wide: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash), sorted and distinct: the window minima among the runs."""
    owns, hashes = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=U64)]
    for lo, hi in chunks(texts):
        own, _, h = runs(texts[lo:hi], units, wide)
        keep = window_minima(own, h, w)
        own, h = own[keep], h[keep]
        o = np.lexsort((h, own))
        own, h = own[o], h[o]
        if len(h):
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (own[1:] != own[:-1])])
            owns.append(own[new] + lo)
            hashes.append(h[new])
    return np.concatenate(owns), np.concatenate(hashes)
