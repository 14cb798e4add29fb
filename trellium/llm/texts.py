"""Words and shingles of many texts at once, as numpy arrays over Arrow's own buffers.

Nothing here makes a Python string. Words are byte runs chosen by a 256-entry table,
which is exact for classes that are stated on ASCII and take all other characters
alike; every word becomes a 64-bit hash and every n-gram a mix of n word hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
PIECE = 1 << 20


def _fold() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


FOLD = _fold()
#: Runs without space and \x09-\x0D.
SPACED = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Digits, letters and everything beyond ASCII, after A-Z were lower-cased.
ALNUM = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(256, dtype=U) + U(1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and n + 1 offsets into them; a null has no bytes."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    n, at = len(column), column.offset
    if offsets is None or n == 0:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    ends = np.frombuffer(offsets, kind, count=n + 1, offset=at * kind().itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, ends


def _cuts(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> list[int]:
    """Where pieces of about PIECE bytes may end: at a text's end or before a separator."""
    out, at, last = [int(offsets[0])], int(offsets[0]), int(offsets[-1])
    while at < last:
        stop = at + PIECE
        if stop >= last:
            stop = last
        else:
            k = int(np.searchsorted(offsets, stop))
            end = int(offsets[k])
            while stop < end:
                gap = np.flatnonzero(~word[data[stop : min(end, stop + PIECE)]])
                if len(gap):
                    stop += int(gap[0])
                    break
                stop = min(end, stop + PIECE)
        out.append(stop)
        at = stop
    return out


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, and n + 1 offsets of the texts into them."""
    hashes, _, bounds = located_words(data, offsets, word)
    return hashes, bounds


def located_words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``word_hashes``, with the byte at which each word starts in between."""
    hashes, starts_at = [], []
    cuts = _cuts(data, offsets, word)
    for a, b in zip(cuts, cuts[1:], strict=False):
        raw = data[a:b]
        is_word = word[raw]
        before = np.empty_like(is_word)
        before[0] = False
        before[1:] = is_word[:-1]
        inner = offsets[(offsets >= a) & (offsets < b)] - a
        before[inner] = False
        starts = np.flatnonzero(is_word & ~before)
        if not len(starts):
            continue
        mark = np.zeros(len(raw), np.int64)
        mark[starts] = starts
        place = np.arange(len(raw), dtype=np.int64) - np.maximum.accumulate(mark)
        place[~is_word] = 0
        factor = mix(np.arange(int(place.max()) + 1, dtype=U)) | U(1)
        value = _BYTE[FOLD[raw]] * factor[place]
        value[~is_word] = 0
        hashes.append(mix(np.add.reduceat(value, starts)))
        starts_at.append(starts + a)
    if not hashes:
        return np.empty(0, U), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    where = np.concatenate(starts_at)
    return np.concatenate(hashes), where, np.searchsorted(where, offsets).astype(np.int64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of n words, by its first word; the last n - 1 words have none."""
    count = max(0, len(words) - n + 1)
    total = np.zeros(count, U)
    for j in range(n):
        total += mix(words[j : j + count] + U(j)) * U(2 * j + 1)
    return mix(total)


def slices(column: pa.Array, size: int = 2 << 20):
    """(first row, last row) of runs of rows that hold about ``size`` bytes, one row at least."""
    _, offsets = buffers(column)
    at = 0
    while at < len(column):
        stop = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        stop = min(len(column), max(at + 1, stop))
        yield at, stop
        at = stop
