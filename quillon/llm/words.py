"""Words of many texts as flat numpy arrays, and hashes of runs of words."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: The six ASCII white-space characters divide words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A to Z become a to z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FOLD = np.uint64(0x9E3779B97F4A7C15)
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
#: The lower 0 to 8 bytes of a number.
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are digested by BLAKE2b, all others eight bytes at a time.
LANE_BYTES = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def run_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the size values that begin at each place; the last size - 1 places have none.

    Runs of 1, 2, 4, ... values are folded pairwise, each time through the bijection, and size is
    put together from its powers of two. So no pattern of repeats cancels, as it can in a
    polynomial modulo a power of two.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    level, width, out, done = h, 1, None, 0
    powers = []
    while width <= size:
        if size & width:
            powers.append((width, level))
        if 2 * width <= size:
            level = mix(level[:-width] * FOLD + level[width:])
        width *= 2
    for width, level in reversed(powers):
        part = level[done:done + n]
        out = part if out is None else mix(out * FOLD + part)
        done += width
    return mix(out + np.uint64(size))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each word data[start:end], which depend on its bytes alone.

    A word is folded in lanes of eight bytes, each time through the bijection, and its length last;
    the first hash is one to one for words of up to eight bytes of one length.
    """
    size = ends - starts
    padded = np.r_[data, np.zeros(8, np.uint8)]
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    lane = lanes[starts] & MASKS[np.minimum(size, 8)]
    out = [mix(lane + seed) for seed in SEEDS]
    more, at = np.flatnonzero((size > 8) & (size <= LANE_BYTES)), 8
    while len(more):
        left = size[more] - at
        lane = lanes[starts[more] + at] & MASKS[np.minimum(left, 8)]
        for h in out:
            h[more] = mix(h[more] * FOLD + lane)
        at += 8
        more = more[left > 8]
    for i in np.flatnonzero(size > LANE_BYTES).tolist():
        digest = np.frombuffer(blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=16).digest(), "<u8")
        out[0][i], out[1][i] = digest
    return [mix(h + size.astype(np.uint64) * FOLD) for h in out]


class Words:
    """The words of texts: byte spans, two 64-bit hashes a word, and the first word of each text."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
        texts = texts.fill_null("")
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if n else None
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        self.bytes = LOWER[data] if lower else data
        self.offsets = offsets - offsets[0]
        space = SPACE[self.bytes]
        head = np.zeros(len(data) + 1, bool)
        head[self.offsets] = True
        begin = ~space
        begin[1:] &= space[:-1] | head[1:-1]
        end = ~space
        end[:-1] &= space[1:] | head[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, self.offsets)  # n + 1 places
        self.hashes = word_hashes(self.bytes, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of size words inside one text, and the texts they are in."""
        owner = self.owner()
        at = np.arange(len(owner))
        ok = at + size <= self.first[1:][owner] if len(owner) else np.zeros(0, bool)
        return at[ok], owner[ok]


def isin_sorted(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which x are in a sorted table."""
    if not len(table):
        return np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return table[at] == x
