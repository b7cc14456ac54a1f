"""Words of many texts at once as numpy arrays: places and hashes, without a Python object a word."""

from __future__ import annotations

import secrets
from typing import NamedTuple

import numpy as np
import xxhash

_rng = np.random.default_rng(20240101)
_BYTES = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _rng.integers(1, 2**63, (2, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of ASCII letters and of all code points over 127.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Words(NamedTuple):
    """Words `[^\\x20\\x09-\\x0D]+` in order: first byte, byte after the last, text, 64-bit hash."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_powers_so_far = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse, from one table that grows."""
    global _powers_so_far
    if len(_powers_so_far[0]) < n:
        size, out = 1 << max(19, int(n - 1).bit_length()), []
        for base in (_BASE, np.uint64(pow(int(_BASE), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps, out=steps))
        _powers_so_far = tuple(out)
    return _powers_so_far


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zeros after the end; a view that costs no memory of its own."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def fresh_key() -> int:
    """A key for the hashes of one job. Nobody who writes texts knows it, so nobody can make words that hash alike."""
    return secrets.randbits(64)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of bytes. Runs of up to seven bytes and their length are mixed one to one with the
    key, so no two of them hash alike; longer ones take XXH3 with the key as seed."""
    left = end - start
    wide = eight_bytes(data)
    short = left < 8
    size = np.where(short, left, 0).astype(np.uint64)
    out = (wide[start] & ((np.uint64(1) << (size * np.uint64(8))) - np.uint64(1))) | (size << np.uint64(56))
    out = mix(out ^ np.uint64(key))
    long = np.flatnonzero(~short)
    if len(long):
        raw = data.tobytes()
        out[long] = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b], key) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)), np.uint64, len(long))
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, key: int = 0, solid: np.ndarray | None = None) -> Words:
    """Words of the texts that ``offsets`` cut ``data`` into; ``solid`` says of each byte whether words are made of it."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64))
    solid = ~_SPACE[data] if solid is None else solid[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(offsets, start, side="right") - 1, word_hashes(data, start, end, key))


def window_hashes(word_hashes: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A hash of each run of ``width`` hashes; runs over the end of a text are the caller's to drop."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out += word_hashes[k : k + n] * _STEPS[salt, k]
    return mix(out)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def stable_order(values: np.ndarray) -> np.ndarray:
    """A stable order of non-negative integers. Where a value and its place fit one number these are sorted, which is several times as fast."""
    n, most = len(values), int(values.max(initial=0))
    bits = max(1, n - 1).bit_length()
    if most.bit_length() + bits > 63:
        return np.argsort(values, kind="stable")
    packed = (values.astype(np.int64) << bits) | np.arange(n)
    packed.sort()
    return packed & ((1 << bits) - 1)


def rolling_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    out, reach = values, 1
    while reach * 2 <= width:
        out, reach = np.minimum(out[:-reach], out[reach:]), reach * 2
    rest = width - reach
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out
