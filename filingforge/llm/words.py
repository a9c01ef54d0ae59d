"""Words, word hashes and gram hashes of whole Arrow text columns, vectorised with numpy.

All functions work on the column's UTF-8 bytes. A word is a maximal run of bytes outside a separator set; separators
are ASCII, so runs never split a character.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

#: Space and \x09-\x0D.
WHITE_SPACE = np.zeros(256, dtype=bool)
WHITE_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but digits and lower-case letters.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """data: bytes with eight zero bytes behind; starts and lengths: of each word; first: the number of each text's first word, and of all words at last."""

    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def ends(self) -> np.ndarray:
        """For each word, the number behind its text's last word."""
        return np.repeat(self.first[1:], self.counts())


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's offsets in them; nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return content, offsets - offsets[0]


def split_words(column: pa.Array, separators: np.ndarray, *, lower: bool = False) -> Words:
    """The words of every text of the column."""
    content, offsets = text_bytes(column)
    if lower:
        content = LOWER[content]
    inside = ~separators[content]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    if len(before):
        before[0] = False
        before[offsets[:-1][offsets[:-1] < len(content)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(after):
        after[-1] = False
        after[(offsets[1:] - 1)[offsets[1:] > 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(np.concatenate([content, np.zeros(8, np.uint8)]), starts, ends - starts, np.searchsorted(starts, offsets), offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def word_hashes(words: Words, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes, eight bytes at a time."""
    eights = np.ndarray((len(words.data) - 7,), dtype="<u8", buffer=words.data, strides=(1,))
    out = words.lengths.astype(np.uint64) * M1 + np.uint64(seed)
    which, lane = np.arange(len(out)), 0
    while len(which):
        left = np.minimum(words.lengths[which] - lane, 8).astype(np.uint64)
        value = eights[words.starts[which] + lane] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8)))
        out[which] = mixed(out[which] ^ value) * M1
        lane += 8
        which = which[words.lengths[which] > lane]
    return mixed(out)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of what stands in a followed by what stands in b."""
    return mixed(a * M1 + (b ^ (b >> np.uint64(33))) * M2 + M3)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n words in a row, across texts too; len(hashes) - n + 1 of them.

    By doubling: those of 2m words come from two of m words; a last, overlapping pair fills up to n.
    """
    size, level = 1, hashes
    while size * 2 <= n:
        level = joined(level[: max(len(level) - size, 0)], level[size:])
        size *= 2
    if size < n:
        level = joined(level[: max(len(level) - (n - size), 0)], level[n - size :])
    return level


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` values in a row."""
    size, level = 1, values
    while size * 2 <= width:
        level = np.minimum(level[: max(len(level) - size, 0)], level[size:])
        size *= 2
    if size < width:
        level = np.minimum(level[: max(len(level) - (width - size), 0)], level[width - size :])
    return level


def covered(length: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of `length` positions lie in any of the spans."""
    steps = np.bincount(starts, minlength=length + 1)[: length + 1].astype(np.int64)
    steps -= np.bincount(ends, minlength=length + 1)[: length + 1]
    return np.cumsum(steps[:length]) > 0


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    begins = np.cumsum(counts) - counts
    return np.arange(total) - np.repeat(begins - starts, counts)
