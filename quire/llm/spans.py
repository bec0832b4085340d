"""Rolling hashes of character windows, many texts at a time, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_INVERSE = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASE)


def pieces(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of one string column, a row at least."""
    text = batch.column(column)
    sizes = np.nan_to_num(np.array(pc.binary_length(text).to_numpy(zero_copy_only=False), np.float64))
    group = (np.cumsum(sizes) - sizes) // most
    start = 0
    for cut in [*(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]:
        if cut > start:
            yield batch.slice(start, cut - start)
        start = cut


@cache
def _powers(which: int, exponent: int, inverse: bool) -> np.ndarray:
    """The first 2**exponent powers."""
    out = np.full(1 << exponent, (_INVERSE if inverse else _BASE)[which], np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    return _powers(which, max(12, int(n).bit_length()), inverse)[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Windows:
    """Prefix sums of one text's code points, from which any window's hash is read."""

    def __init__(self, text: str, which: int = 0):
        points = code_points(text).astype(np.uint64) + np.uint64(1)
        self.n, self.which = len(points), which
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(points) * powers(which, self.n), out=self.sums[1:])

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the windows of ``length`` characters at ``starts``."""
        return mix((self.sums[starts + length] - self.sums[starts]) * powers(self.which, self.n + 1, True)[starts])

    def all(self, length: int) -> np.ndarray:
        """Hashes of all windows of ``length`` characters."""
        m = self.n - length + 1
        return mix((self.sums[length:] - self.sums[:m]) * powers(self.which, self.n + 1, True)[:m]) if m > 0 else np.zeros(0, np.uint64)


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values."""
    f, fill = (np.minimum, np.uint64(2**64 - 1)) if least else (np.maximum, np.uint64(0))
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = f.accumulate(blocks, axis=1).ravel()
    behind = f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the minimum of some run of ``width`` hashes; every run has one."""
    if len(hashes) <= width:
        return np.flatnonzero(hashes == hashes.min()) if len(hashes) else np.zeros(0, np.int64)
    low = sliding(hashes, width, True)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, low, edge]), width, False) == hashes)
