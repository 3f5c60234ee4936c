"""Exchange of columns between tasks: rows (part, g, kind, blob), a blob being compressed arrays.

Tasks that work on arrays send each other few large rows instead of many small ones. `part` names the receiver, `g` the
batch that a row belongs to, `kind` what it holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

ROW = "part long, g long, kind int, blob binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher."""
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; equal bytes of neighbouring values stand together."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        out.append(f"{a.dtype.str[1:]:<3}{a.size:>12}".encode() + a.view(np.uint8).reshape(a.size, a.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, n = np.dtype("<" + raw[at : at + 3].decode().strip()), int(raw[at + 3 : at + 15])
        size = n * kind.itemsize
        cut = np.frombuffer(raw, np.uint8, size, at + 15).reshape(kind.itemsize, n) if n else np.zeros((kind.itemsize, 0), np.uint8)
        out.append(np.ascontiguousarray(cut.T).view(kind).ravel())
        at += 15 + size
    return out


def rows_of(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["part", "g", "kind", "blob"])


def emit(rows: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[3])
        if size > 4 << 20 or len(held) >= 1000:
            yield rows_of(held)
            held, size = [], 0
    if held:
        yield rows_of(held)


def runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, list[tuple[int, int, int, bytes]]]]:
    """Rows (part, g, kind, blob) of one value of `by` at a time; the input is sorted by it."""
    now, held = None, []
    for b in batches:
        keys = column(b, by)
        for key, row in zip(keys, zip(*(column(b, n) for n in ("part", "g", "kind", "blob")), strict=True), strict=True):
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def split(part: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of each run of an ascending array."""
    at = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    return list(zip(part[at].tolist(), at.tolist(), [*at[1:].tolist(), len(part)], strict=False))


#: Tasks of an exchange at most; a task takes its parts one after another, so that this bounds no memory.
TASKS = 20_000


def dealt(df: DataFrame, parts: int, by: str) -> DataFrame:
    """Rows of one value of `by` in one task, one after another, in the order of kind. Parts, numbered from 0, are dealt
    evenly."""
    n = min(max(1, parts), TASKS)
    whole = df.repartitionById(n, (F.col(by) % n).cast("int")) if by == "part" else df.repartition(n, by)
    return whole.sortWithinPartitions(by, "kind")
