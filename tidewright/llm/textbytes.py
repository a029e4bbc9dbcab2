"""Vectorised work on the bytes of many texts at once, for use inside Arrow tasks.

A batch is cut into blocks of whole texts of about BLOCK bytes, so memory follows the block or the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

#: Word separators: space and U+0009 to U+000D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[0x20] = True
SEPARATOR[0x09:0x0E] = True

#: Everything that is no ASCII letter or digit and no part of a longer code point.
NOT_ALNUM = np.ones(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    NOT_ALNUM[_low:_high] = False

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Multipliers of the hash lanes.
_LANES = (np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7))
#: Bytes of a run that are hashed eight at a time; the rest of a longer run goes through BLAKE2.
_STEPPED = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


@dataclass
class Block:
    """Texts first to last of a batch: their bytes, and where each begins (one more entry than texts)."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray


def blocks(column: pa.Array, most: int = BLOCK) -> Iterator[Block]:
    """The texts of an Arrow string column; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    everything = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
        yield Block(first, last, everything[at[first] : at[last]], at[first : last + 1] - at[first])
        first = last


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(mask: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each longest run of True that lies within one text."""
    if not len(mask):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[starts] = True
    before = np.empty(len(mask), bool)
    before[0] = False
    before[1:] = mask[:-1]
    after = np.empty(len(mask), bool)
    after[-1] = False
    after[:-1] = mask[1:]
    begin = np.flatnonzero(mask & (~before | edge[:-1]))
    end = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return begin, end


def hashes(block: Block, fold: np.ndarray | None = None, lane: int = 0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function from begins and ends to 64-bit hashes of the bytes between; each lane is a hash of its own.

    Eight bytes at a time are scrambled into the hash, all runs at once, so that different bytes give different hashes;
    what a run has beyond _STEPPED bytes goes through BLAKE2. So no arrangement of repeated letters makes two runs alike. fold maps each byte before it is hashed.
    """
    data = np.concatenate([block.data if fold is None else fold[block.data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    by = _LANES[lane]

    def value(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        size = end - begin
        made = mixed(size.astype(np.uint64) + by)
        open_ = np.arange(len(begin))
        for k in range(0, _STEPPED, 8):
            open_ = open_[size[open_] > k]
            if not len(open_):
                break
            part = eight[begin[open_] + k] & _MASKS[np.minimum(size[open_] - k, 8)]
            made[open_] = mixed((made[open_] ^ part) * by + by)
        for k in np.flatnonzero(size > _STEPPED).tolist():
            rest = hashlib.blake2b(data[begin[k] + _STEPPED : end[k]].tobytes(), digest_size=8, salt=bytes([lane])).digest()
            part = np.frombuffer(rest, "<u8")
            made[k : k + 1] = mixed((made[k : k + 1] ^ part) * by + by)
        return made

    return value


def words_and_stems(
    block: Block, separator: np.ndarray = SEPARATOR, stems: tuple[int, ...] = ()
) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """A 64-bit hash of each word, A-Z lower-cased, and where each text's words begin (one more entry than texts).

    For each length in stems also the hashes of the first so many bytes of the words that are longer, and where each
    text's begin.
    """
    begin, end = runs(~separator[block.data], block.starts)
    if not len(begin):
        none = np.zeros(0, np.uint64), np.zeros(len(block.starts), np.int64)
        return *none, [none] * len(stems)
    value = hashes(block, LOWER)

    def hashed(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return value(begin, end), np.searchsorted(begin, block.starts)

    longer = [begin[end - begin > k] for k in stems]
    return *hashed(begin, end), [hashed(x, x + k) for x, k in zip(longer, stems, strict=True)]


def words(block: Block, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """The words of words_and_stems() alone."""
    return words_and_stems(block, separator)[:2]


def shingles(block: Block, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``size`` words; a shorter text has its whole sequence as one."""
    value, at = words(block)
    n = len(value)
    whole = mixed(value) if n else value
    for k in range(1, size):
        whole = whole[:-1] if len(whole) else whole
        whole = mixed(whole * np.uint64(3) + value[k:]) if len(whole) else whole
    found = []
    for k in range(len(at) - 1):
        first, last = int(at[k]), int(at[k + 1])
        if last - first >= size:
            found.append(np.unique(whole[first : last - size + 1]))
        elif last > first:
            short = mixed(value[first : first + 1])
            for x in range(first + 1, last):
                short = mixed(short * np.uint64(3) + value[x : x + 1])
            found.append(mixed(short + np.uint64(last - first)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found
