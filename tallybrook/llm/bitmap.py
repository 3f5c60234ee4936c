"""Bitmaps of hashes: a bound on what tasks send each other, whatever a table's size; an exact join follows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import in_arrow

#: Bits for each hash, and a bitmap's bits at most, as a power of two.
BITS, MOST_BITS = 64, 27


def bitmap(rows: DataFrame, name: str) -> np.ndarray:
    """Packed bits, set at the upper bits of the hashes in a column; of a power of two, a few MB at most."""
    power = min(MOST_BITS, max(16, (BITS * rows.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << power, bool)
        for b in batches:
            own[b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - power)] = True
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.compress(np.packbits(own).tobytes())], pa.binary())], names=["b"])

    out = np.zeros(1 << power >> 3, np.uint8)
    for r in rows.select(name).coalesce(64).transform(in_arrow, run, "b binary").toLocalIterator():  # at most 64 of at most 16 MB
        out |= np.frombuffer(zstandard.decompress(r["b"]), np.uint8)
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the hashes' bits are set: true for all that bitmap() saw, and few others while they are fewer than bits."""
    at = h >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0
