"""Words of many texts at once, as numbers: NumPy kernels that the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHORT = np.uint64(0xD6E8FEB86659FD93)
#: Bytes that part words: space and 0x09 to 0x0D.
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
#: The bytes of a little-endian number that belong to a word of 0 to 8 bytes.
_INSIDE = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Bytes that are looked at together.
PIECE = 1 << 22
#: Whoever has to fear texts made to collide passes a number of his own.
KEY = 0x1F83D9ABFB41BD6B


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``PIECE`` bytes that end at a gap; a longer word makes a longer one."""
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data):
            gaps = np.flatnonzero(_IS_GAP[data[end : end + PIECE]])
            if len(gaps):
                end += int(gaps[0])
                break
            end += PIECE
        yield at, min(end, len(data))
        at = end


def word_hashes(texts: list[bytes], key: int = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bounds) of the words of ``texts``.

    ``hashes`` has 64 bits for each word, the same wherever the word stands; ``starts`` and ``ends`` are its places
    in ``b" ".join(texts)``; the words of text i are those from ``bounds[i]`` to ``bounds[i + 1]``.  Words of up to 8
    bytes are mixed with the key as numbers, longer ones get XXH3 with the key as its seed.  What a text needs beyond the results, 24
    bytes a word, is bounded by a piece of it.
    """
    joined = b" ".join(texts)
    data = np.frombuffer(joined, np.uint8)
    long = xxhash.xxh3_64_intdigest
    seed = np.uint64(key)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for low, high in _pieces(data):
        gap = np.ones(high - low + 2, bool)
        gap[1:-1] = _IS_GAP[data[low:high]]
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edge[::2], edge[1::2]
        sizes = ends - starts
        # Each place as the start of a little-endian number of 8 bytes.
        padded = joined[low:high] + b"\0" * 8
        lanes = np.ndarray((high - low + 1,), "<u8", padded, strides=(1,))
        short = np.minimum(sizes, 8)
        values = (lanes[starts] & _INSIDE[short]) ^ (short.astype(np.uint64) << np.uint64(56)) * (short < 8)
        hashes = mix(mix(values ^ seed) + np.where(short < 8, _ODD, _SHORT) + seed)
        rest = np.flatnonzero(sizes > 8)
        if len(rest):
            hashes[rest] = [long(padded[a:b], key) for a, b in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        found.append((hashes, starts + low, ends + low))
    hashes, starts, ends = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return hashes, starts, ends, np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash for every window of ``size`` words, also across texts; empty if there are fewer words.

    A window's hash comes from those of its parts, whose sizes are powers of two.
    """
    count = len(hashes) - size + 1
    if count <= 0 or size < 1:
        return np.zeros(0, np.uint64)
    out: np.ndarray | None = None
    done, width, part = 0, 1, hashes
    while True:
        if size & width:
            piece = part[done : done + count]
            out = mix(out * _ODD + piece) if out is not None else mix(piece + _SHORT)
            done += width
        if done == size:
            return out
        part = mix(part[: len(part) - width] * _ODD + part[width:])
        width *= 2


def batches_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Slices of consecutive texts with at most ``most`` bytes together; a longer text stands alone."""
    at = 0
    total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
