"""Vectorised word and shingle hashing over batches of texts.

Everything here works on UTF-8 bytes in NumPy, so a batch of texts costs a few
passes over its bytes and no Python object per word.  Texts are handled in
chunks of bounded size (one text alone may exceed the bound, never more).

Hashes are 64 bits wide; two different shingles share one with probability
2**-64, which the operators accept as equality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK_BYTES = 1 << 20

_U = np.uint64
_P = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_P_INV = pow(_P, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_COEFFS = np.random.default_rng(77003).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        for i, base in enumerate((_P, _P_INV)):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[i] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def _lut(separators: bytes, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    is_sep = np.zeros(256, bool)
    is_sep[list(separators)] = True
    values = _BYTE_VALUES.copy()
    if lower:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return is_sep, values


#: ASCII white space: space and \x09-\x0D.
WHITE_SPACE = b" \t\n\x0b\x0c\r"
#: Every ASCII byte that is neither a letter nor a digit.
NON_ALNUM = bytes(i for i in range(128) if not chr(i).isalnum())


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 texts) with about CHUNK_BYTES bytes each; None is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode() if t else b""
        if held and size + len(b) > CHUNK_BYTES:
            yield first, held
            first, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield first, held


def words(held: list[bytes], separators: bytes = WHITE_SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and bounds: text i has words bounds[i]:bounds[i + 1].

    With lower, A-Z count as a-z (ASCII only).
    """
    is_sep, values = _lut(separators, lower)
    sep = separators[:1]
    buf = np.frombuffer(sep + sep.join(held) + sep, np.uint8)
    stop = is_sep[buf]
    edge = np.flatnonzero(stop[1:] != stop[:-1]) + 1
    starts, ends = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(buf) + 1)
    total = np.cumsum(values[buf] * power[: len(buf)], dtype=np.uint64)
    h = mix((total[ends - 1] - total[starts - 1]) * inverse[starts])
    lengths = np.fromiter((len(b) + 1 for b in held), np.int64, len(held))
    at = np.concatenate(([0], np.cumsum(lengths)))
    return h, np.searchsorted(starts, at + 1)


def shingles(h: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of width words inside a text, and bounds as in words().

    A text of 1 to width - 1 words gives its whole sequence as one shingle; one
    without words gives none.
    """
    n = np.diff(bounds)
    count = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    out_bounds = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    full = n >= width
    if len(h) >= width and full.any():
        m = len(h) - width + 1
        acc = h[:m] * _COEFFS[0]
        for k in range(1, width):
            acc += h[k : k + m] * _COEFFS[k]
        text_of = np.repeat(np.arange(len(n)), count * full)
        begin = np.repeat(out_bounds[:-1], count * full)
        place = np.arange(len(text_of)) - np.repeat(np.cumsum(count * full) - count * full, count * full)
        out[begin + place] = acc[bounds[:-1][text_of] + place]
    for i in np.flatnonzero(~full & (n > 0)):
        acc = _U(0)
        with np.errstate(over="ignore"):
            for k, x in enumerate(h[bounds[i] : bounds[i + 1]]):
                acc = acc + x * _COEFFS[k]
            out[out_bounds[i]] = acc + _U(int(n[i])) * _U(0xD6E8FEB86659FD93)
    return mix(out), out_bounds


def shingle_sets(texts: list[str | None], width: int, separators: bytes = WHITE_SPACE, lower: bool = True) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingle hashes."""
    for _, held in chunks(texts):
        s, b = shingles(*words(held, separators, lower), width)
        for i in range(len(held)):
            x = np.sort(s[b[i] : b[i + 1]])
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x
