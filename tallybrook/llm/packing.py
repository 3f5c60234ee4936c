"""Operator 4, best-fit packing by minimum bin slack.

Encoding gives each document's length. Documents longer than a sequence are cut, the short piece first; whole pieces
fill sequences of their own. What is left is a histogram of at most `capacity` lengths, whatever the corpus' size, and
is packed on it: per bin, the longest length left is fixed and a bitset subset-sum over the lengths left finds the
fullest combination, which is taken out as many times as it goes. Documents get their places by rank within their
length: a rank within their batch plus the batch's start.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import exchange
from .common import column, in_arrow, materialize, read
from .exchange import ROW, rows_of
from .tokens import Encoded


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length give the largest total of at most room. lengths: descending, with counts; of equal totals
    one with longer lengths is preferred."""
    reach, steps, all_ones = 1, [], (1 << (room + 1)) - 1
    for n in lengths:
        left = min(counts[n], room // n)
        take = 1
        while left and not reach >> room & 1:
            take = min(take, left)
            steps.append((n, take, reach))
            reach |= (reach << (n * take)) & all_ones
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, Counter()
    for n, take, before in reversed(steps):
        if not before >> total & 1:
            used[n] += take
            total -= n * take
    return used


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: how many}) patterns that use up the histogram, each total at most capacity."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths, patterns = sorted(left, reverse=True), []
    while lengths:
        first = lengths[0]
        left[first] -= 1
        use = Counter(fullest([n for n in lengths if left[n]], left, capacity - first))
        left[first] += 1
        use[first] += 1
        times = min(left[n] // k for n, k in use.items())
        patterns.append((times, dict(use)))
        for n, k in use.items():
            left[n] -= k * times
        lengths = [n for n in lengths if left[n]]
    return patterns


def slots(patterns: list[tuple[int, dict[int, int]]]) -> tuple[dict[int, np.ndarray], int]:
    """Per length the rows (first rank, how many a sequence, first sequence, offset), and the number of sequences."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: Counter = Counter()
    sequence = 0
    for times, use in patterns:
        offset = 0
        for n, k in use.items():
            rows.setdefault(n, []).append((rank[n], k, sequence, offset))
            rank[n] += k * times
            offset += n * k
        sequence += times
    return {n: np.array(x, np.int64) for n, x in rows.items()}, sequence


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, unsigned little-endian 32-bit), sequence_id, offset.

    Every document is its ids and end_id. Only documents longer than capacity are cut, into pieces of that length but
    for the first. Null texts count as empty (their end id alone); null ids are kept; repeated rows are packed each; an
    empty table gives no rows. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    encoded = Encoded(rows, size, tokenizer, end_id)

    def count(g: int, ids: list, _, ends: np.ndarray, __) -> Iterator[pa.RecordBatch]:
        full, rest = np.divmod(np.diff(ends, prepend=0), capacity)
        kinds, n = np.unique(rest, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), g)), pa.array(kinds), pa.array(n), pa.array(np.where(np.arange(len(kinds)) == 0, full.sum(), 0))], names=["g", "rest", "n", "full"])

    counted = materialize(encoded.lengths(count, "g long, rest long, n long, full long"), "counted")
    histogram = {r["rest"]: r["n"] for r in counted.groupBy("rest").agg(F.sum("n").alias("n")).collect() if r["rest"]}  # at most capacity rows
    place, sequences = slots(pack_histogram(histogram, capacity))
    before = Window.partitionBy("rest").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    lanes = counted.groupBy("g").agg(F.sum("full").alias("full"))
    lanes = lanes.select("g", F.coalesce(F.sum("full").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    starts = counted.select("g", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(lanes, "g")
    starts = starts.groupBy("g").agg(F.first("first").alias("first"), F.collect_list(F.struct("rest", "start")).alias("starts"))  # at most capacity of a batch

    def note(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield rows_of([(0, g, 3, exchange.pack(np.array([first]), np.array([x["rest"] for x in own]), np.array([x["start"] for x in own]))) for g, first, own in zip(column(b, "g"), column(b, "first"), column(b, "starts"), strict=True)])

    def cut(g: int, keys: list, ids: np.ndarray, ends: np.ndarray, blob: bytes) -> Iterator[pa.RecordBatch]:
        (full_rank,), rests, firsts = exchange.unpack(blob)
        ranks, full_rank, out = dict(zip(rests.tolist(), firsts.tolist(), strict=True)), int(full_rank), []
        for key, begin, end in zip(keys, [0, *ends.tolist()], ends.tolist(), strict=False):
            full, rest = divmod(end - begin, capacity)
            if rest:
                rank = ranks[rest]
                ranks[rest] += 1
                rows = place[rest]
                first, k, sequence, offset = rows[np.searchsorted(rows[:, 0], rank, "right") - 1].tolist()
                out.append((key, 0, 0, rest, ids[begin : begin + rest].astype("<u4").tobytes(), sequence + (rank - first) // k, offset + (rank - first) % k * rest))
            for i in range(full):
                at = rest + i * capacity
                out.append((key, i + bool(rest), at, capacity, ids[begin + at : begin + at + capacity].astype("<u4").tobytes(), sequences + full_rank + i, 0))
            full_rank += full
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
        for at in range(0, len(out), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[at : at + 4096], strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])

    return encoded.fill(cut, "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long", starts.transform(in_arrow, note, ROW))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` in sequences of 2048 tokens."""
    pieces = pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
