"""Operator 5, benchmark decontamination.

Word n-grams of the test items that are rare in the documents are seeds. Documents and seeds are joined by n-gram; where
they meet, the passage around the seed is aligned with the item by Smith-Waterman over words, so that edited and
paraphrased copies score too.

One pass over the documents finds every occurrence of an item's n-gram (first by a bitmap of hashes, whose size is
bounded; the join sorts out the rest) and counts the items' words. An n-gram is rare if it occurs at most `rare` times, or
much more often than its words' shares of the corpus would have it: then passages repeat, not phrases of the language.
One that more than `shared` items hold (a common prompt) tells nothing of the item. The FEW n-grams of an item that
chance would repeat least are always seeds (not those that occur least: these are what edited copies lack). Distinct texts are aligned once, however many copies there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bitmap import bitmap, in_bitmap
from .common import WORD, column, fold, in_arrow, materialize, read, small_batches
from .words import grams, hashes, numbers, slices, words

MATCH, MISMATCH, GAP = 2, -1, -1
HITS = "doc_id long, item_id long, score double, start long, end long"
#: Bytes of text that are cut into words at once; n-grams that each item keeps as seeds.
BATCH, FEW = 4 << 20, 8


def words_of(text: str) -> list[str]:
    return re.findall(WORD, fold(text))


def smith_waterman(a: list[str], b: list[str]) -> tuple[int, int, int]:
    """(best score, start, end): the local alignment of words a with b, and the span of b that it covers."""
    number = {w: i for i, w in enumerate(dict.fromkeys(a))}
    x, y = np.array([number[w] for w in a]), np.array([number.get(w, -1) for w in b])
    n, m = len(a), len(b)
    h, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    best, steps = (0, 0, 0), np.arange(m + 1)
    for i in range(n):
        diagonal = h[:-1] + np.where(y == x[i], MATCH, MISMATCH)
        up = h[1:] + GAP
        now, start = np.zeros(m + 1, np.int64), steps.copy()
        now[1:] = np.maximum(np.maximum(diagonal, up), 0)
        start[1:] = np.where(now[1:] == 0, steps[1:], np.where(diagonal >= up, origin[:-1], origin[1:]))
        # gaps along b: a running maximum of score + steps, as each step costs one
        run = np.maximum.accumulate(now - GAP * steps)
        along = run + GAP * steps
        first = np.maximum.accumulate(np.where(now - GAP * steps == run, steps, 0))
        start = np.where(along > now, start[first], start)
        h, origin = np.maximum(now, along), start
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(origin[j]), j)
    return best


def align(text: list[str], target: list[str], diagonals: list[int]) -> tuple[int, int, int]:
    """The best local alignment of target with the text's passages around the diagonals (text place - target place)."""
    slack = len(target) // 4 + 4
    best, spans = (0, 0, 0), []
    for d in sorted(diagonals):  # passages where the item could lie; close ones are one
        low, high = max(0, d - slack), min(len(text), d + len(target) + slack)
        if spans and low <= spans[-1][1] and high - spans[-1][0] <= 4 * len(target) + 64:
            spans[-1][1] = max(spans[-1][1], high)
        else:
            spans.append([low, high])
    for low, high in spans:
        score, start, end = smith_waterman(target, text[low:high])
        if score > best[0]:
            best = (score, low + start, low + end)
    return best


def _item_grams(items: DataFrame, n: int) -> DataFrame:
    """item, gram, place, words (hashes), size: every run of n words of each item; of a shorter item all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            found, length = words(b.column(1))
            word = hashes(found.dictionary)[numbers(found)] if len(found) else np.zeros(0, np.uint64)
            gram, which = grams(word, length, n)
            begin = np.cumsum(length) - length
            place = np.arange(len(gram)) - np.searchsorted(which, which)
            size = np.minimum(n, length[which])
            own = [word[begin[t] + k : begin[t] + k + z].view(np.int64) for t, k, z in zip(which.tolist(), place.tolist(), size.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), pa.array(gram.view(np.int64)), pa.array(place), pa.array(own, pa.list_(pa.int64())), pa.array(size, pa.int32())], names=["item", "gram", "place", "words", "size"])

    return items.select("item", "text").transform(in_arrow, run, "item long, gram long, place long, words array<long>, size int")


def _occurrences(texts: DataFrame, gram_bits: np.ndarray, word_bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """what 0: text t holds the gram h at place n. what 1: the word h occurs n times more. what 2: n words more."""
    held = texts.sparkSession.sparkContext.broadcast((gram_bits, word_bits))  # at most 32 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_grams, of_words = held.value
        for b in slices(batches, BATCH):
            found, length = words(b.column(1))
            if not len(found):
                continue
            distinct, number = hashes(found.dictionary), numbers(found)
            word, t = distinct[number], b.column(0).to_numpy(zero_copy_only=False)
            out = []
            for size in sizes:
                gram, which = grams(word, length, size)
                at = np.flatnonzero(in_bitmap(of_grams, gram))
                out.append((np.zeros(len(at), np.int32), t[which[at]], gram[at], at - np.searchsorted(which, which[at])))
            known, often = np.flatnonzero(in_bitmap(of_words, distinct)), np.bincount(number, minlength=len(distinct))
            out.append((np.ones(len(known), np.int32), np.zeros(len(known), np.int64), distinct[known], often[known]))
            out.append((np.full(1, 2, np.int32), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.array([len(word)])))
            what, t, h, n = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(t), pa.array(h.view(np.int64)), pa.array(n)], names=["what", "t", "h", "n"])

    return texts.transform(in_arrow, run, "what int, t long, h long, n long")


def _candidates(texts: DataFrame, items: DataFrame, n: int, rare: int, shared: int, over: float) -> DataFrame:
    """t, item, at: the diagonals on which a text and an item share a seed."""
    own = materialize(_item_grams(items, n), "grams")
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # at most n
    word = own.select(F.explode("words").alias("h")).distinct()
    met = materialize(_occurrences(texts, bitmap(own, "gram"), bitmap(word, "h"), sizes), "occurrences")
    total = met.filter("what = 2").agg(F.sum("n")).first()[0] or 0
    often = met.filter("what = 1").groupBy("h").agg(F.sum("n").alias("k"))
    counts = met.filter("what = 0").groupBy(F.col("h").alias("gram")).agg(F.count("*").alias("c"))
    chance = own.select("gram", F.explode("words").alias("h")).join(often, "h", "left")
    # a gram's words: each as often as it stands in it; the mean over the places undoes that it has several
    chance = chance.groupBy("gram").agg(F.sum(F.log(F.greatest(F.coalesce("k", F.lit(1)), F.lit(1)) / F.lit(float(max(1, total))))).alias("s"))
    held = own.groupBy("gram").agg(F.count("*").alias("places"), F.countDistinct("item").alias("m"))
    told = held.join(counts, "gram").join(chance, "gram").withColumn("expected", F.lit(float(total)) * F.exp(F.col("s") / F.col("places")))
    rarely = (F.col("m") <= shared) & ((F.col("c") <= rare) | (F.col("c") >= over * F.col("expected")))
    seeds = own.select("item", "gram", "place").join(told.select("gram", "m", "expected", rarely.alias("seed")), "gram")
    seeds = seeds.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("m", "expected", "place"))).filter(F.col("seed") | (F.col("rank") <= FEW))
    hits = met.filter("what = 0").select("t", F.col("h").alias("gram"), F.col("n").alias("at")).distinct()
    return hits.join(seeds.select("gram", "item", "place"), "gram").groupBy("t", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("at"))


def _found(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, n: int, rare: int, shared: int, over: float, least: float) -> DataFrame:
    """t (hash of a text), item_id, score, start, end: the test items that each distinct text holds."""
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).filter("item_id is not null and text is not null").distinct()
    items = materialize(items.withColumn("item", F.monotonically_increasing_id()), "items")
    texts = docs.select(F.xxhash64(text).alias("t"), text.alias("text")).filter("text is not null")
    met = materialize(_candidates(texts, items, n, rare, shared, over), "candidates")
    by = met.join(items.select("item", "item_id", F.col("text").alias("target")), "item").groupBy("t").agg(F.collect_list(F.struct("item_id", "target", "at")).alias("items"))
    wanted = met.select("t").distinct()
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, "t"))  # at most 16 MB

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Few texts but the wanted ones, so that few are exchanged."""
        for b in batches:
            yield b.filter(pa.array(in_bitmap(held.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    once = texts.transform(in_arrow, near, texts.schema).join(wanted, "t", "left_semi").groupBy("t").agg(F.any_value("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t, x, held in zip(column(b, "t"), column(b, "text"), column(b, "items"), strict=True):
                own, best = words_of(x), {}
                for item in held:
                    target = words_of(item["target"])
                    score, start, end = align(own, target, item["at"])
                    share = score / (MATCH * len(target))
                    if share >= least:
                        best[item["item_id"]] = max(best.get(item["item_id"], (0.0, 0, 0)), (share, -start, end))
                got += [(t, k, share, -start, end) for k, (share, start, end) in best.items()]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["t", "item_id", "score", "start", "end"])

    return once.join(by, "t").select("t", "text", "items").transform(in_arrow, run, "t long, item_id long, score double, start long, end long")


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 3, rare: int = 64, shared: int = 64, over: float = 8.0, least: float = 0.6) -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id, score (of a perfect alignment, 1), start
    and end (in words of the document).

    A document holds an item if some passage aligns with at least `least` of the perfect score. Texts are folded (A-Z) and
    split at ASCII white space. Null and empty texts hold nothing; items without words or id are left out; rows of the
    benchmark with one id and text count once, and of one id with several texts the best counts. Repeated documents give
    a row each; null ids are kept. Empty tables give no rows. Texts are told apart by 64-bit hash.
    """
    found = _found(docs, benchmark, text_col, item_col, item_text, n, rare, shared, over, least)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"))
    return own.join(found, "t").select("doc_id", "item_id", "score", "start", "end")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = 3, rare: int = 64, shared: int = 64, over: float = 8.0, least: float = 0.6) -> DataFrame:
    """The rows of docs, with their own columns, that hold no test item; see contaminations()."""
    found = _found(docs, benchmark, text_col, item_col, item_text, n, rare, shared, over, least).select("t").distinct()
    return docs.join(found, F.xxhash64(docs[text_col].cast("string")) == found["t"], "left_anti")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents` against all of `benchmark`."""
    return contaminations(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
