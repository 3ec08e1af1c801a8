"""Sets of word shingles as 64-bit numbers, vectorised over the bytes of a text."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_STEP = _U(0xD6E8FEB86659FD93)
#: Bytes of a text that are hashed at a time.
_CHUNK = 1 << 22


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_LETTERS = mix(np.arange(1, 257, dtype=_U) * _BASE)
_powers = np.ones(1, _U)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate((np.ones(1, _U), np.full(2 * n, _BASE, _U))), dtype=_U)
    return _powers


def _word_hashes(b: np.ndarray) -> np.ndarray:
    space = _SPACE[b]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.empty(0, _U)
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    own = np.repeat(starts, np.diff(np.append(starts, len(b))))  # the word that a byte belongs to or follows
    at = np.arange(starts[0], len(b)) - own
    longest = int((ends - starts).max())
    with np.errstate(over="ignore"):
        v = np.where(space[starts[0] :], _U(0), _LETTERS[b[starts[0] :]] * _power(longest + 1)[np.minimum(at, longest)])
        return mix(np.add.reduceat(v, starts - starts[0]) + (ends - starts).astype(_U) * _STEP)


def words(text: str) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased."""
    return hashed_words(_LOWER[np.frombuffer(text.encode(), np.uint8)])


def hashed_words(b: np.ndarray) -> np.ndarray:
    """A hash of each word [^\\x20\\x09-\\x0D]+ of these bytes."""
    if len(b) <= _CHUNK:
        return _word_hashes(b)
    out, at = [], 0
    while at < len(b):
        end = min(len(b), at + _CHUNK)
        while end < len(b):
            spaces = np.flatnonzero(_SPACE[b[end : end + _CHUNK]])
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(len(b), end + _CHUNK)
        out.append(_word_hashes(b[at:end]))
        at = end
    return np.concatenate(out)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of `width` words, sorted; of fewer words, the whole sequence as one; without words, none."""
    h = words(text) if text else np.empty(0, _U)
    if not len(h):
        return h
    short = len(h) < width
    n = len(h) if short else width
    with np.errstate(over="ignore"):
        acc = h[: len(h) - n + 1] + (_U(n) * _STEP if short else _U(0))
        for k in range(1, n):
            acc = mix(acc * _BASE + h[k : len(h) - n + 1 + k])
    return np.unique(acc)


def identity(s: np.ndarray) -> bytes:
    """128 bits that tell one set from another."""
    with np.errstate(over="ignore"):
        a, b = mix(s).sum(dtype=_U), mix(s ^ _STEP).sum(dtype=_U)
        return mix(np.array([a + _U(len(s)), b ^ _U(len(s))], _U)).tobytes()
