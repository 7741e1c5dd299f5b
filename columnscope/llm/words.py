"""Words of many texts at once, as arrays: where each starts and ends, and a 64-bit hash of its bytes.

A word is a maximal run of characters other than space and U+0009 to U+000D. All of these are single bytes in
UTF-8, so words are found in the bytes of an Arrow string column without decoding a text. Two words are treated as
equal when their 64-bit hashes are; hashes depend on the bytes alone, so they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = b" \t\n\x0b\x0c\r"
# Texts are taken in groups of about so many bytes (one longer text alone), so that arrays stay in the CPU's caches.
GROUP_BYTES = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (finaliser of splitmix64, a public-domain generator)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _ODD)


class Tables:
    """Look-up tables of a task; powers grow with the longest group of texts."""

    def __init__(self, lower: bool = True):
        self.separator = np.zeros(256, bool)
        self.separator[list(SEPARATORS)] = True
        values = seeded(256, 1)
        if lower:
            values[65:91] = values[97:123]
        self.values = values
        self.powers = self._powers(_ODD, 1024)
        self.inverses = self._powers(_INVERSE, 1024)

    @staticmethod
    def _powers(base: np.uint64, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            found = np.full(n, base, np.uint64)
            found[0] = 1
            return np.cumprod(found, dtype=np.uint64)

    def up_to(self, n: int) -> None:
        if n > len(self.powers):
            size = max(n, 2 * len(self.powers))
            self.powers, self.inverses = self._powers(_ODD, size), self._powers(_INVERSE, size)


class Words:
    """Words of a group of texts. ``bounds[i]:bounds[i + 1]`` are those of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tables: Tables):
        self.data, self.offsets = data, offsets
        n = len(data)
        tables.up_to(n + 1)
        inside = ~tables.separator[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        heads, tails = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
        first[heads], last[tails] = inside[heads], inside[tails]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        with np.errstate(over="ignore"):
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(tables.values[data] * tables.powers[:n], out=sums[1:], dtype=np.uint64)
            self.hashes = mixed((sums[self.ends] - sums[self.starts]) * tables.inverses[self.starts])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text(self, i: int, j: int) -> str:
        """Words i to j (exclusive) as they stand in the text."""
        return self.data[self.starts[i]:self.ends[j - 1]].tobytes().decode("utf-8", "replace") if j > i else ""


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its texts from 0; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def groups(batches: Iterator[pa.RecordBatch], text: str = "text", lower: bool = True,
           size: int = GROUP_BYTES) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Arrow batches cut into groups of about ``size`` bytes of text, with their words."""
    tables = Tables(lower)
    for batch in batches:
        data, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at), Words(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], tables)
            at = to


def shingles(words: Words, width: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and the bounds of each text's; a shorter text is one run."""
    factors = seeded(width + 1, seed) | np.uint64(1)
    h, n = words.hashes, words.counts()
    per = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per)])
    out = np.zeros(bounds[-1], np.uint64)
    with np.errstate(over="ignore"):
        if len(h) >= width:
            runs = np.zeros(len(h) - width + 1, np.uint64)
            for j in range(width):
                runs += mixed(h[j:len(h) - width + 1 + j] + factors[j]) * factors[j]
            full = np.repeat(n >= width, per)
            owner = np.repeat(np.arange(len(n)), per)
            at = words.bounds[:-1][owner] + np.arange(len(out)) - bounds[:-1][owner]
            out[full] = runs[at[full]]
        for i in np.flatnonzero((n > 0) & (n < width)):
            a, b = words.bounds[i], words.bounds[i + 1]
            out[bounds[i]] = (mixed(h[a:b] + factors[:b - a]) * factors[:b - a]).sum(dtype=np.uint64) + factors[width] * np.uint64(b - a)
    return mixed(out), bounds


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of each text, and their bounds."""
    found = [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = np.array([len(x) for x in found], np.int64)
    return (np.concatenate(found) if found else hashes[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def sums_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum modulo 2^64 of each text's values."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
        return total[bounds[1:]] - total[bounds[:-1]]


def table(**columns) -> pa.RecordBatch:
    """A record batch of arrays; unsigned 64-bit values become signed ones of the same bits."""
    arrays = {}
    for name, values in columns.items():
        if isinstance(values, np.ndarray) and values.dtype == np.uint64:
            values = values.view(np.int64)
        arrays[name] = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
