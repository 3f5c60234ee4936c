"""Whole-text encoding of a table with a public tokenizer.

The vocabularies here never join characters across the start of a word, so a text's ids are its chunks' ids one after
another, a chunk being a word with the space before it, the sign that ends the word, or a run of spaces. The table's
distinct chunks are far fewer than its words, and each is encoded by the tokenizers library once in the whole job: tasks
number the chunks of their documents, ask the partition of a chunk's hash for its ids, and put the answers in place of the
numbers. Texts are cut, numbered and hashed as arrays of bytes; invalid UTF-8 is read as replacement characters.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import drop, in_arrow, materialize, new_path, small_batches, write
from .exchange import ROW, dealt, emit, mix, pack, runs, split, unpack
from .words import flat, slices

#: Unicode White_Space.
SPACE = "".join(map(chr, [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: A text with these is a chunk of its own: control characters on whose class libraries differ, and special tokens.
ODD = re.compile("[" + "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0x180E, 0x200B, 0xFEFF])) + "]|<[|]")
#: A word carries one space before it; of several spaces the last goes with the word.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Texts that are not cut by their bytes: those of ODD, and those with white space outside of ASCII.
SPECIAL = r"[\x1c-\x1f\x{85}\x{180e}\x{200b}\x{feff}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<[|]"
#: Bytes of text in a batch of documents, and for each partition of asked chunks, about.
BATCH, ASKED_BYTES = 8 << 20, 20_000_000

#: Classes of bytes: a blank, other white space, a letter, a sign that ends a word, all else 0.
BLANK, WHITE, LETTER, SIGN = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
_KIND[32], _KIND[9:14] = BLANK, WHITE
_KIND[65:91] = _KIND[97:123] = LETTER
_KIND[[ord(c) for c in "!,.:;?"]] = SIGN


def chunk_starts(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a chunk starts at each byte of texts that stand one after another and end at `ends`: CHUNK's rule for white
    space in ASCII, and a sign after a letter at the end of a word is a chunk of its own."""
    n = len(data)
    first = np.zeros(n + 2, bool)
    first[0] = True
    first[ends] = True
    kind = _KIND[data]
    space = (kind == BLANK) | (kind == WHITE)
    stop = np.ones(n, bool)  # white space or the text's end follows
    stop[:-1] = space[1:] | first[1:n]
    start = first[:n].copy()
    start[1:] |= (space[1:] & ~space[:-1]) | (~space[1:] & (kind[:-1] == WHITE))
    start[1:] |= space[1:] & space[:-1] & ~stop[1:]
    start[1:] |= (kind[1:] == SIGN) & (kind[:-1] == LETTER) & stop[1:]
    return start


def cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(all chunks of the texts one after another, how many each text has). A text's ids are those of its chunks."""
    edges, data = flat(texts)
    if not len(data):
        return pa.array([], pa.binary()).dictionary_encode(), np.zeros(len(texts), np.int64)
    start = chunk_starts(data, edges[1:])
    for i in np.flatnonzero(pc.match_substring_regex(texts.fill_null(""), SPECIAL).to_numpy(zero_copy_only=False)).tolist():
        text = data[edges[i] : edges[i + 1]].tobytes().decode("utf-8", "replace")
        own = start[edges[i] : edges[i + 1]]
        own[:] = False
        own[0] = True
        if not ODD.search(text):
            own[np.cumsum([0, *(len(c.encode()) for c in CHUNK.findall(text))])[:-1]] = True
    at = np.flatnonzero(start).astype(np.int32)
    chunks = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, np.int32(len(data)))), pa.py_buffer(np.ascontiguousarray(data))])
    return chunks.dictionary_encode(), np.diff(np.searchsorted(at, edges))


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")

    def many(self, texts: list[str]) -> list[bytes]:
        code = "H" if self.dtype.itemsize == 2 else "I"
        return [array(code, e.ids).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str) -> bytes:
        return self.many([text])[0]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _hash(edges: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each value, none of which is empty."""
    size = np.diff(edges)
    with np.errstate(over="ignore"):
        power = mix(np.arange(size.max(initial=0), dtype=np.uint64) + np.uint64(1)) | np.uint64(1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(edges[:-1], size)]
        return mix(np.add.reduceat(terms, edges[:-1])) if len(size) else np.zeros(0, np.uint64)


def gather(values: np.ndarray, edges: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The pieces values[edges[i] : edges[i + 1]] for each i of which, one after another."""
    size = np.diff(edges)[which]
    ends = np.cumsum(size)
    return values[np.repeat(edges[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def _ask(parts: int):
    """doc_id, text -> kind 0: a batch's documents as chunk numbers; kind 1: its distinct chunks, to their parts."""

    def one(g: int, b: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
        ids = b.column(0)
        chunks, length = cut(b.column(1))
        edges, data = flat(chunks.dictionary)
        part = (_hash(edges, data) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.uint32)  # answers come part by part
        place[order] = np.arange(len(order), dtype=np.uint32)
        yield 0, g, 0, pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), length.astype(np.uint32), place[chunks.indices.to_numpy(zero_copy_only=False)] if len(order) else np.zeros(0, np.uint32))
        for p, begin, end in split(part[order]):
            own = order[begin:end]
            yield p, g, 1, pack(np.diff(edges)[own].astype(np.uint32), gather(data, edges, own))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        lane = TaskContext.get().partitionId()
        for count, b in enumerate(slices(batches, BATCH)):
            yield from one(lane << 20 | count, b)

    return lambda batches: emit(rows(batches))


def _answer(path: str):
    """Chunks -> kind 1: how many ids each has; kind 2: the ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        enc = encoder(path)
        for part, held in runs(batches, "part"):
            asked = [unpack(blob) for *_, blob in held]
            edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate([a[0] for a in asked]), dtype=np.int64)])
            chunks = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.concatenate([a[1] for a in asked]))]).dictionary_encode()
            size, ids = [], []
            for at in range(0, len(chunks.dictionary), 4096):
                own = enc.many([c.decode("utf-8", "replace") for c in chunks.dictionary[at : at + 4096].to_pylist()])
                size.append(np.array([len(x) for x in own], np.int64) // enc.dtype.itemsize)
                ids.append(np.frombuffer(b"".join(own), enc.dtype))
            known = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.concatenate(size))])
            ids, number = np.concatenate(ids), chunks.indices.to_numpy(zero_copy_only=False)
            at = 0
            for (_, g, _, _), (length, _) in zip(held, asked, strict=True):
                own = number[at : at + len(length)]
                at += len(length)
                yield part, g, 1, pack(np.diff(known)[own].astype(np.uint32))
                yield part, g, 2, pack(gather(ids, known, own))

    return lambda batches: emit(rows(batches))


class Encoded:
    """A table's encoded texts, in batches g that ascend with the rows of a partition and with the partitions."""

    def __init__(self, rows: DataFrame, size: int, path: str, end_id: int) -> None:
        """rows: doc_id, text (null counts as empty); size: bytes of text, about. Each text gets end_id at its end."""
        small_batches(rows.sparkSession)
        self.spark, self.end_id, self.width = rows.sparkSession, end_id, encoder(path).dtype.itemsize
        parts = size // ASKED_BYTES + 1
        where = write(rows.transform(in_arrow, _ask(parts), ROW), new_path(self.spark, "asked"), ("kind",), compression="uncompressed")
        asked = self.spark.read.schema(ROW).parquet(where)
        self.answers = materialize(dealt(asked.filter("kind = 1"), parts, "part").transform(in_arrow, _answer(path), ROW), "answers", compression="uncompressed")
        drop(self.spark, f"{where}/kind=1")
        self.batches = self.spark.read.schema(ROW).parquet(where).filter("kind = 0")
        self.n = self.batches.count()

    def lengths(self, out: Callable, schema: str) -> DataFrame:
        """Rows that out(g, ids of the documents, None, ends, None) makes of each batch: ends are those of the documents
        in the batch's token ids."""
        return dealt(self.batches.unionByName(self.answers.filter("kind = 1")), self.n, "g").transform(in_arrow, self._run(out, False), schema)

    def fill(self, out: Callable, schema: str, extra: DataFrame | None = None) -> DataFrame:
        """Rows that out(g, ids of the documents, token ids, ends, blob) makes of each batch; blob: that of the batch's row
        of kind 3 in extra."""
        rows = self.batches.unionByName(self.answers)
        return dealt(rows if extra is None else rows.unionByName(extra), self.n, "g").transform(in_arrow, self._run(out, True), schema)

    def _run(self, out: Callable, with_ids: bool):
        end_id, kind = self.end_id, np.dtype(f"<u{self.width}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for g, held in runs(batches, "g"):
                by = {k: [r[3] for r in sorted(held, key=lambda r: r[0]) if r[2] == k] for k in range(4)}  # answers part by part
                keys, null, length, stream = unpack(by[0][0])
                # the end is one more chunk, after each document
                size = np.concatenate([*(unpack(x)[0] for x in by[1]), np.ones(1, np.uint32)]).astype(np.int64)
                length = length.astype(np.int64)
                stream = np.insert(stream.astype(np.int64), np.cumsum(length), len(size) - 1)
                ends = np.cumsum(size[stream])
                flat = gather(np.concatenate([*(unpack(x)[0] for x in by[2]), np.array([end_id], kind)]), np.append(0, np.cumsum(size)), stream) if with_ids else None
                yield from out(g, [None if z else k for k, z in zip(keys.tolist(), null.tolist(), strict=True)], flat, ends[np.cumsum(length + 1) - 1], by[3][0] if by[3] else None)

        return run
