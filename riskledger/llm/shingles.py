"""Hashed word shingles and one-permutation MinHash signatures of whole Arrow text columns.

A word is ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased.  Words are hashed from prefix
sums of a polynomial over the raw UTF-8 bytes, so no Python loop runs over words.  Two different
shingles share a 64-bit hash with chance 2**-64.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 1 << 20
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    values[65:91] = values[97:123]
    return values


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingler:
    """Sorted distinct shingle hashes of texts, ``words`` words each.

    A text with fewer words is one shingle of all its words; a text without words has none.
    """

    def __init__(self, words: int):
        self.words = words
        self.values = _byte_values()
        self.separator = np.zeros(256, bool)
        self.separator[list(SEPARATORS)] = True
        self._size = 0

    def _grow(self, n: int) -> None:
        if n > self._size:
            self._size = max(n, SLICE_BYTES)
            self.power = _powers(BASE, self._size)
            self.inverse = _powers(BASE_INVERSE, self._size)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``data``: UTF-8 bytes of texts end to end; ``offsets``: n + 1 borders.

        Returns (text index, hash), sorted by both, without repeats.
        """
        owners, hashes, n, at = [], [], len(offsets) - 1, 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1)
            own, found = self._slice(data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at])
            owners.append(own + at)
            hashes.append(found)
            at = end
        return (np.concatenate(owners or [np.empty(0, np.int64)]),
                np.concatenate(hashes or [np.empty(0, np.uint64)]))

    def _slice(self, data, offsets):
        size = len(data)
        if not size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        self._grow(size)
        inside = ~self.separator[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        border = offsets[(offsets > 0) & (offsets < size)]
        first[border] = inside[border]
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        ends = np.flatnonzero(last)
        total = np.cumsum(self.values[data] * self.power[:size], dtype=np.uint64)
        before = np.where(starts > 0, total[starts - 1], np.uint64(0))
        word = mix((total[ends] - before) * self.inverse[starts] + (ends - starts).astype(np.uint64))
        owner = np.searchsorted(offsets, starts, side="right") - 1
        count = np.bincount(owner, minlength=len(offsets) - 1)
        rank = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        w = np.minimum(self.words, count)[owner]
        left = count[owner] - rank
        out, length = word.copy(), np.ones(len(word), np.int64)
        for k in range(1, self.words):
            more = (w > k) & (left > k)
            rows = np.flatnonzero(more)
            out[rows] = mix(out[rows] * np.uint64(BASE) + word[rows + k])
            length[rows] += 1
        whole = length == w
        owner, out = owner[whole], out[whole]
        order = np.lexsort((out, owner))
        owner, out = owner[order], out[order]
        fresh = np.ones(len(out), bool)
        fresh[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        return owner[fresh], out[fresh]


class OnePermutation:
    """One-permutation signatures with optimal densification, cut into bands.

    A shingle's hash is its value in one permutation; its high half picks one of ``bands * rows``
    bins, and a bin keeps its least hash.  An empty bin takes the value of another bin, found along
    a random order of all bins of its own that is the same for every text.
    """

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        self.probes = np.argsort(rng.random((self.bins, self.bins)), axis=1).T

    def signatures(self, owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(n x bins values, which texts have any)."""
        bins = ((hashes >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        slot = owner * self.bins + bins.astype(np.int64)
        lead = np.ones(len(slot), bool)
        lead[1:] = slot[1:] != slot[:-1]
        sig, full = np.zeros(n * self.bins, np.uint64), np.zeros(n * self.bins, bool)
        sig[slot[lead]], full[slot[lead]] = hashes[lead], True
        sig, full = sig.reshape(n, self.bins), full.reshape(n, self.bins)
        some = full.any(axis=1)
        row, col = np.nonzero(~full & some[:, None])
        for probe in self.probes:
            if not len(row):
                break
            source = probe[col]
            hit = full[row, source]
            sig[row[hit], col[hit]] = sig[row[hit], source[hit]]
            row, col = row[~hit], col[~hit]
        return sig, some

    def bands_of(self, sig: np.ndarray) -> np.ndarray:
        """n x bands keys; the band's number is part of its key."""
        cut = mix(sig.reshape(len(sig), self.bands, self.rows))
        key = np.broadcast_to(np.arange(1, self.bands + 1, dtype=np.uint64) * np.uint64(BASE), cut.shape[:2]).copy()
        for k in range(self.rows):
            key = mix(key * np.uint64(BASE_INVERSE) + cut[:, :, k])
        return key


def fingerprints(owner: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """n x 2 sums of two hashes of each shingle: equal for equal sets, whatever their order."""
    out = np.zeros((n, 2), np.uint64)
    for k in range(2):
        total = np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(BASE + k) if k else hashes), dtype=np.uint64)))
        edge = np.searchsorted(owner, np.arange(n + 1))
        out[:, k] = total[edge[1:]] - total[edge[:-1]]
    return out


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, borders) of an Arrow string column; nulls are empty."""
    import pyarrow as pa
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]
