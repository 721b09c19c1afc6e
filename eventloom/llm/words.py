"""Words of a text and their hashes, computed for whole arrays at a time.

A word is a maximal run of bytes other than ASCII white space (space, tab to carriage return), so a word is never cut inside a
UTF-8 sequence. A word's hash and the hash of a run of words are differences of prefix sums of a polynomial modulo 2**64, mixed
afterwards: every window of a text costs a few array operations whatever its length. The work memory is bounded by blocks,
except that one word is never cut.
"""

from __future__ import annotations

import hashlib

import numpy as np

WHITE = b"\x09\x0a\x0b\x0c\x0d\x20"
BLOCK = 1 << 20

_UPPER = bytes(range(65, 91))
_SPACES = bytes.maketrans(WHITE, b" " * 6)
_LOWER_SPACES = bytes.maketrans(WHITE + _UPPER, b" " * 6 + _UPPER.lower())
_MASK = (1 << 64) - 1


def _table(label: str, n: int) -> np.ndarray:
    raw = b"".join(hashlib.sha256(f"{label}{i}".encode()).digest() for i in range((n + 3) // 4))
    return np.frombuffer(raw, "<u8")[:n].copy()


_BYTE = _table("byte", 256)
#: Odd bases of the polynomials: one for words, two independent ones for runs of words.
_BASES = [int(b) | 1 for b in _table("base", 3)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, at least n of them."""
    have = _powers.get(which)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        base = _BASES[which]
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _powers[which] = (pair[0], pair[1])
    return have


def _block(raw: bytes, at: int, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    gap = np.ones(len(b) + 2, np.int8)
    gap[1:-1] = b == 32
    edge = np.flatnonzero(np.diff(gap))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _power(0, len(b))
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=total[1:])
    stop = ends if most is None else np.minimum(ends, starts + most)
    h = mix((total[stop] - total[starts]) * down[starts] + (stop - starts).astype(np.uint64))
    return h, starts + at, ends + at


def word_hashes(text: str | None, lower: bool = False, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and one past the last byte of every word; ``lower`` maps A-Z to a-z first, ``most`` hashes a word's first bytes only."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_SPACES if lower else _SPACES)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw):
            cut = raw.rfind(b" ", at, end)
            if cut <= at:
                cut = raw.find(b" ", end)
            end = len(raw) if cut < 0 else cut
        parts.append(_block(raw[at:end], at, most))
        at = end if end > at else len(raw)
    if not parts:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts))


def window_hashes(h: np.ndarray, k: int, which: int = 1) -> np.ndarray:
    """Hash of every run of k consecutive words, from the words' hashes; ``which`` (1 or 2) names independent families."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _power(which, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[:n])


def words_of(text: str | None) -> list[bytes]:
    """The words themselves, unchanged, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SPACES).split()


def sliding(x: np.ndarray, k: int, how: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every k consecutive values."""
    if len(x) < k:
        return x[:0]
    done = 1
    while done * 2 <= k:
        x = how(x[:-done], x[done:])
        done *= 2
    return how(x[: len(x) - (k - done)], x[k - done :]) if k > done else x
