"""Vectorised work on UTF-8 text columns: words, hashes and windows straight from Arrow buffers.

Every function takes whole columns (a byte buffer and row offsets) and returns flat NumPy arrays, so that
no Python object is made for a word. A null text is an empty one. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLDEN, _MIX_A, _MIX_B = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
_BASE = 0xD1342543DE82EF95


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64 bits that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x + _GOLDEN).astype(U64, copy=False)
        x = (x ^ (x >> U64(30))) * _MIX_A
        x = (x ^ (x >> U64(27))) * _MIX_B
        return x ^ (x >> U64(31))


#: One 64-bit value for each byte; folding maps A-Z to a-z.
_BYTE_VALUES = mix64(np.arange(256, dtype=U64))
_FOLDED = np.arange(256)
_FOLDED[65:91] += 32
_FOLDED_VALUES = _BYTE_VALUES[_FOLDED]

#: Bytes of words that are parted by white space (space, tab to carriage return).
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Bytes of words of letters, digits and all that is not ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of lines.
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False
#: First bytes of code points.
LEADS = np.ones(256, bool)
LEADS[0x80:0xC0] = False


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1, modulo 2**64."""
    out = np.full(max(n, 1), U64(_BASE))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POWERS = powers(4096)


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and its len + 1 row offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.binary() if pa.types.is_string(column.type) else pa.large_binary()
    column = column.cast(kind).cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about `most` text bytes; a row of more is a run of its own."""
    if not batch.num_rows:
        return
    _, offsets = column_bytes(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


class Tokens:
    """Maximal runs of the bytes `kind` allows: where they start and end, their rows and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, *, fold: bool = False):
        inside = kind[data]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        before = np.empty(len(data), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        before[edges] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(data), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.rows = np.searchsorted(offsets, self.starts, "right") - 1
        self.n_rows = len(offsets) - 1
        self.counts = np.bincount(self.rows, minlength=self.n_rows)
        self.firsts = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = self._hash(data[inside], _FOLDED_VALUES if fold else _BYTE_VALUES)

    def __len__(self) -> int:
        return len(self.starts)

    def _hash(self, data: np.ndarray, values: np.ndarray) -> np.ndarray:
        if not len(self):
            return np.empty(0, U64)
        lengths = self.ends - self.starts
        at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        local = np.arange(len(data)) - np.repeat(at, lengths)
        longest = int(lengths.max())
        table = _POWERS if longest <= len(_POWERS) else powers(longest)
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(values[data] * table[local], at)
            return mix64(sums + lengths.astype(U64) * _MIX_B)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each run of k tokens of one row: the number of its first token, and its hash."""
        if len(self) < k:
            return np.empty(0, np.int64), np.empty(0, U64)
        whole = np.flatnonzero(self.rows[: len(self) - k + 1] == self.rows[k - 1 :])
        out = np.zeros(len(whole), U64)
        with np.errstate(over="ignore"):
            for j in range(k):
                out = out * _MIX_A + self.hashes[whole + j]
        return whole, mix64(out)

    def grams_or_all(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As grams, but a row of 1 to k - 1 tokens has one gram, made of all of them; gives rows and hashes."""
        first, hashes = self.grams(k)
        rows = self.rows[first]
        short = np.flatnonzero((self.counts > 0) & (self.counts < k))
        if len(short):
            out = np.zeros(len(short), U64)
            with np.errstate(over="ignore"):
                for j in range(k - 1):
                    there = self.counts[short] > j
                    out[there] = out[there] * _MIX_A + self.hashes[self.firsts[short[there]] + j]
                out = mix64(out + self.counts[short].astype(U64) * _GOLDEN)
            rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, out])
            order = np.argsort(rows, kind="stable")
            rows, hashes = rows[order], hashes[order]
        return rows, hashes


def n_tokens(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How many Tokens each row has, without their hashes."""
    inside = kind[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    return sums_between(begins, offsets[:-1], offsets[1:])


def per_row(rows: np.ndarray, n_rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Counts, or whole-number sums, by row."""
    out = np.bincount(rows, weights=weights, minlength=n_rows)
    return out.astype(np.int64)


def sums_between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags are set in each of the half-open ranges."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[ends] - total[starts]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step] if step else values, values[step:])
        have += step
    return values
