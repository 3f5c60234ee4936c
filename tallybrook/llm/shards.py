"""Operator 7, token ids in binary shards with a minimal perfect hash index.

Documents are dealt by range of their key, sorted, encoded, and written as shards. A shard is one row of a Parquet
table, an envelope that any store Spark reaches can hold: the raw ids of its documents one after another, their ends,
and a hash-and-displace index: a key's first hash names a bucket, the bucket's displacement and the key's second hash
name the slot, and the slot holds a fingerprint of the key and the document's number in the shard. A lookup is one
displacement, one slot and one slice, whatever the shard's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_arrow, new_path, read, write
from .packing import tokenizer_path
from .tokens import Encoded

#: A shard holds a batch of documents, or so many of them.
SHARD_DOCS = 20_000
SCHEMA = "lane long, shard long, first_key long, last_key long, n_docs long, n_ids long, id_bytes int, seed long, keys binary, nulls binary, ends binary, displacements binary, fingerprints binary, slots binary, payload binary"
#: A row is large, so that Parquet has to look at the size after each.
WRITE = {"compression": "zstd", "parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64's finisher on x + seed * odd constant."""
    with np.errstate(over="ignore"):
        z = x + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def key_hash(keys: np.ndarray, nulls: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """64 bits for (key, whether it is null, which of the rows with that key)."""
    return mix(mix(keys.view(np.uint64), 1) ^ mix((ordinals.astype(np.uint64) << np.uint64(1)) | nulls.astype(np.uint64), 2), 3)


def build(h: np.ndarray, seed: int = 0) -> tuple[int, np.ndarray, np.ndarray]:
    """(seed, displacements, slot of each key) of a minimal perfect hash over distinct 64-bit h. Buckets go by size, the
    largest first; a bucket of one key gets a free slot itself, stored as -1 - slot."""
    n = len(h)
    while True:
        seed += 1
        a, b = mix(h, 4 * seed), mix(h, 4 * seed + 1)
        bucket = (a % np.uint64(max(n, 1))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        start = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if n else np.zeros(0, np.int64)
        size = np.diff(np.append(start, n))
        taken, slot, moved, lost = np.zeros(n, bool), np.zeros(n, np.int64), np.zeros(n, np.int32), False
        for k in np.argsort(-size, kind="stable"):
            if size[k] == 1:
                break
            own = order[start[k] : start[k] + size[k]]
            for d in range(1, 1 << 16):
                at = place(b[own], d, n)
                if not taken[at].any() and len(np.unique(at)) == len(at):
                    break
            else:
                lost = True
                break
            taken[at], slot[own], moved[bucket[own[0]]] = True, at, d
        if lost:
            continue
        single, free = order[start[size == 1]], np.flatnonzero(~taken)
        slot[single], moved[bucket[single]] = free, (-1 - free).astype(np.int32)
        return seed, moved, slot


def place(b: np.ndarray, d: int | np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(b + np.asarray(d, np.uint64) * np.uint64(0xD6E8FEB86659FD93), 5) % np.uint64(n)).astype(np.int64)


def find(shard: dict, h: np.ndarray) -> np.ndarray:
    """The number in the shard of each key, by its hash; -1 where the stored fingerprint says that it isn't there."""
    n = shard["n_docs"]
    if not n:
        return np.full(len(h), -1)
    moved, prints, slots = (np.frombuffer(shard[k], t) for k, t in (("displacements", "<i4"), ("fingerprints", "<u4"), ("slots", "<u4")))
    d = moved[(mix(h, 4 * shard["seed"]) % np.uint64(n)).astype(np.int64)].astype(np.int64)
    at = np.where(d < 0, -1 - d, place(mix(h, 4 * shard["seed"] + 1), np.maximum(d, 0), n))
    return np.where(prints[at] == (h >> np.uint64(32)).astype(np.uint32), slots[at].astype(np.int64), -1)


def ids_of(shard: dict, number: int) -> np.ndarray:
    """The ids of a document by its number in the shard: one slice of the payload."""
    ends = np.frombuffer(shard["ends"], "<i8")
    start, end = (ends[number - 1] if number else 0), ends[number]
    width = shard["id_bytes"]
    return np.frombuffer(shard["payload"], f"<u{width}", end - start, start * width)


def ordinals(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Which of the rows of its key each row is; keys sorted, nulls first."""
    n = len(keys)
    new = np.append(True, (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])) if n else np.zeros(0, bool)
    return np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0)) if n else np.zeros(0, np.int64)


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every text, append end_id, and write shards in ascending order of the id (nulls first; rows of one id by
    their texts' hash). Null texts count as empty; an empty table gives a table without shards. Returns path."""

    def shard(g: int, keys: list, ids: np.ndarray, ends: np.ndarray, _) -> Iterator[pa.RecordBatch]:
        for number, at in enumerate(range(0, len(keys), SHARD_DOCS)):
            own = keys[at : at + SHARD_DOCS]
            begin, last = (int(ends[at - 1]) if at else 0), ends[at : at + SHARD_DOCS]
            nulls = np.array([k is None for k in own])
            values = np.array([0 if k is None else k for k in own], np.int64)
            h = key_hash(values, nulls, ordinals(values, nulls))
            seed, moved, slot = build(h)
            prints, numbers = np.zeros(len(h), "<u4"), np.zeros(len(h), "<u4")
            prints[slot], numbers[slot] = (h >> np.uint64(32)).astype(np.uint32), np.arange(len(h))
            told = values[~nulls].tolist() or [None]
            row = (g, number, told[0], told[-1], len(own), int(last[-1]) - begin, ids.itemsize, seed, values.tobytes(), nulls.tobytes(), (last - begin).astype("<i8").tobytes(), moved.astype("<i4").tobytes(), prints.tobytes(), numbers.tobytes(), ids[begin : int(last[-1])].tobytes())
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64()] + [pa.binary()] * 7
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    out = Encoded(rows, size, tokenizer, end_id).fill(shard, SCHEMA)
    return write(out, path, **WRITE)


def read_all(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before the document in the whole order), ids (binary, unsigned little-endian 32-bit) of every
    document, each found by its key through the index."""
    shards = spark.read.parquet(path)
    order = Window.orderBy("lane", "shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("lane", "shard", "n_ids").withColumn("shard_start", F.coalesce(F.sum("n_ids").over(order), F.lit(0))).drop("n_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = b.slice(i, 1).to_pylist()[0]
                keys, nulls, ends = np.frombuffer(s["keys"], "<i8"), np.frombuffer(s["nulls"], bool), np.frombuffer(s["ends"], "<i8")
                numbers = find(s, key_hash(keys, nulls, ordinals(keys, nulls)))
                if (numbers < 0).any():
                    raise ValueError("a shard's index lacks one of its keys")
                for at in range(0, len(keys), 2048):
                    some = numbers[at : at + 2048].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 2048], mask=nulls[at : at + 2048]), pa.array([s["shard_start"] + (int(ends[x - 1]) if x else 0) for x in some], pa.int64()), pa.array([ids_of(s, x).astype("<u4").tobytes() for x in some], pa.binary())], names=["doc_id", "start", "ids"])

    return shards.join(starts, ["lane", "shard"]).transform(in_arrow, run, "doc_id long, start long, ids binary")


def get(spark: SparkSession, path: str, keys: list[int]) -> dict[int, np.ndarray]:
    """The ids of the documents with these keys (of a repeated key the first document in the order; absent and null keys
    are left out). Only shards whose key range holds a key are read; of each key one slice comes to the driver."""
    wanted = np.unique(np.array([k for k in keys if k is not None], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                s = b.slice(i, 1).to_pylist()[0]
                own = wanted[(wanted >= s["first_key"]) & (wanted <= s["last_key"])]
                number = find(s, key_hash(own, np.zeros(len(own), bool), np.zeros(len(own), np.int64)))
                hit = (number >= 0) & (np.frombuffer(s["keys"], "<i8")[number] == own)
                yield pa.RecordBatch.from_arrays([pa.array(own[hit]), pa.array([s["lane"]] * hit.sum(), pa.int64()), pa.array([s["shard"]] * hit.sum(), pa.int64()), pa.array([ids_of(s, x).astype("<u4").tobytes() for x in number[hit].tolist()], pa.binary())], names=["key", "lane", "shard", "ids"])

    if not len(wanted):
        return {}
    near = spark.read.parquet(path).filter((F.col("first_key") <= int(wanted[-1])) & (F.col("last_key") >= int(wanted[0])))
    found = near.transform(in_arrow, run, "key long, lane long, shard long, ids binary").groupBy("key").agg(F.min_by("ids", F.struct("lane", "shard")).alias("ids"))
    return {r["key"]: np.frombuffer(r["ids"], "<u4") for r in found.collect()}  # at most one a key


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`, written and read back."""
    path = write_shards(read(spark, sf_dir, "documents"), new_path(spark, "shards"), tokenizer_path("word_bpe_49k.json"), 2)
    return read_all(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
