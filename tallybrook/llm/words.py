"""Words of many texts at once, as arrays: maximal runs of what isn't ASCII white space, A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from .exchange import mix

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of an array of strings or binaries as their ends, a zero before, and the bytes; null counts as empty."""
    raw = texts.fill_null("" if pa.types.is_string(texts.type) else b"").cast(pa.binary())
    edges = np.frombuffer(raw.buffers()[1], np.int32, len(raw) + 1, raw.offset * 4) if len(raw) else np.zeros(1, np.int32)
    return edges - edges[0], np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]


def words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all words of the texts one after another, how many each text has)."""
    edges, data = flat(texts)
    if not len(data):
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[edges] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    at = np.flatnonzero(start)
    kept = _FOLD[data[inside]]
    ends = np.append(np.cumsum(inside, dtype=np.int32)[at] - 1, len(kept)).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return every.dictionary_encode(), np.diff(np.searchsorted(at, edges))


def numbers(found: pa.DictionaryArray) -> np.ndarray:
    return found.indices.to_numpy(zero_copy_only=False)


def hashes(dictionary: pa.Array) -> np.ndarray:
    """XXH64 of each word."""
    return np.array([xxhash.xxh64_intdigest(w) for w in dictionary.to_pylist()], np.uint64)


def grams(word: np.ndarray, length: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of n words, by the words' hashes; a text of fewer words is one run, one without words
    none. length: words of each text."""
    text = np.repeat(np.arange(len(length)), length)
    place = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    left = np.repeat(length, length) - place
    size = np.minimum(n, np.repeat(length, length))
    starts = np.flatnonzero((left >= n) | ((place == 0) & (left < n)))
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            more = size[starts] > k
            out[more] = mix(out[more] * np.uint64(0x9E3779B97F4A7C15) + word[starts[more] + k] + np.uint64(1))
    return out, text[starts]


def slices(batches: Iterator[pa.RecordBatch], size: int, rows: int = 64) -> Iterator[pa.RecordBatch]:
    """The rows of the batches again, in batches of about `size` bytes: a text longer than that makes one alone."""
    held, total = [], 0
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            b = whole.slice(at, rows)
            held.append(b)
            total += b.nbytes
            if total >= size:
                yield pa.concat_batches(held)
                held, total = [], 0
    if held:
        yield pa.concat_batches(held)
