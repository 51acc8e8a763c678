"""Words and names of byte strings, computed for whole arrays."""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: The bytes between words: space and 0x09 to 0x0D.
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))  # a new array, changed in place; the argument may be freed meanwhile
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: Names computed at a time, so that the arrays meanwhile stay in a core's cache.
BLOCK = 1 << 14
#: Words of more bytes are hashed one by one.
LONG_WORD = 64
#: The bits of the first n bytes.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: A random odd 64-bit value per byte.
BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(_BASE)) | U(1)


def eights(data: bytes) -> np.ndarray:
    """The eight bytes from each position on as one integer, with zeros after the end."""
    return np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, which are runs of bytes other than space and 0x09 to 0x0D."""
    space = np.empty(len(data) + 2, bool)
    space[0] = space[-1] = True
    space[1:-1] = _IS_SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_codes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, start, end) of each word; equal words have equal codes.

    A word is mixed in eight bytes at a time, which no fixed pattern of bytes cancels out; long ones by xxHash.
    """
    starts, ends = words(data)
    size = ends - starts
    codes = mix(size.astype(U) * U(_BASE) + U(1))
    at = eights(data)
    todo = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(todo):
        left = size[todo] - done
        part = at[starts[todo] + done] & _FIRST[np.minimum(left, 8)]
        codes[todo] = mix((codes[todo] ^ part) * U(_BASE) + U(0x632BE59BD9B4E019))
        done += 8
        todo = todo[left > 8]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        codes[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return codes, starts, ends


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each ordered pair of names."""
    return mix(a * U(_BASE) + b * U(0x632BE59BD9B4E019))


def extended(name: np.ndarray, have: int, size: int) -> np.ndarray:
    """Names of ``size`` codes from the names of ``have`` codes, by pairing names at doubling offsets.

    The name of 2h codes is the pair of the names of h codes at the offsets 0 and h; a size that is no power of two
    times ``have`` ends with a pair that overlaps.  Positions with fewer codes left have none.
    """
    if len(name) + have - 1 < size:
        return np.zeros(0, U)
    while have < size:
        step = min(have, size - have)
        name = paired(name[:-step], name[step:])
        have += step
    return name


def windows(codes: np.ndarray, size: int) -> np.ndarray:
    """A name for the ``size`` codes from each position on."""
    if len(codes) <= BLOCK + size:
        return extended(codes, 1, size)
    return np.concatenate([extended(codes[a : a + BLOCK + size - 1], 1, size) for a in range(0, len(codes) - size + 1, BLOCK)])


def byte_windows(data: bytes, size: int) -> np.ndarray:
    """A name for the ``size`` bytes from each position on: eight of them are mixed in at a time."""
    n = len(data) - size + 1
    if size < 8 or n <= 0:
        return windows(BYTE_CODES[np.frombuffer(data, np.uint8)], size)
    at = eights(data).copy()
    name = at[:n] * U(_BASE)
    for k in [*range(8, size - 8, 8), size - 8] if size > 8 else []:
        name ^= name >> U(32)
        name += at[k : k + n]
        name *= U(0xD6E8FEB86659FD93)
    name ^= name >> U(32)
    return name
