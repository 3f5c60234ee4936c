"""Operator 10, language-model scoring: a Katz backoff model of words, learned from one part of the documents and
evaluated on all of them.

    p(w | h) = d(c(h, w)) / c(h)        if the pair was seen
             = a(h) * p(w)              if only h was seen, a(h) such that all p(w | h) sum to one
             = p(w)                     if h was not seen
    p(w)     = (c(w) + 1) / (N + V + 1)

d(c) is the Good-Turing discounted count for c up to K; above, a count loses the constant that the discount at K comes
to, so that every context leaves mass for what it wasn't seen with. One unit of p is for unknown words.

The corpus moves in columns, not rows: a task turns its documents into arrays of word numbers, and tasks exchange
compressed arrays, so a token costs a few bytes and a few numpy operations. The documents are read and cut into batches
once. Tables, each partitioned and written in the shared folder:

    batches   the documents as word numbers, and per batch its words' hashes and counts
    words     per batch, its words' training counts and numbers, as told by the partition of the word's hash
    answers   per batch, the pair counts of its tokens and what the contexts' backoff weights are made of, as told by the
              partition of the context (of the pair, for contexts so frequent that one task shouldn't hold them)
    weights   the frequent contexts' sums over partitions
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, crc_mod, drop, in_arrow, materialize, new_path, read, small_batches, write
from .exchange import ROW, dealt, emit, mix, pack, runs, split, unpack
from .words import hashes, numbers, slices, words

#: Bytes of text of a batch, tokens for each partition of pairs, bytes of text for each partition of words, and counts
#: that are discounted one by one.
BATCH, PAIRS, WORDS, K = 10 << 20, 2_000_000, 60_000_000, 5
#: At most so many contexts are frequent: those that hold over this share of the training tokens.
FREQUENT = 65_536
#: A word's code is its count's class above so many bits, and below them its number; the last number is a text's start.
NUMBER = 40
END_HASH, START = np.uint64(1), np.uint64((1 << NUMBER) - 1)


def _ask_words(parts: int):
    """doc_id, text, train -> kind 4: a batch's documents: ids, which are null, which train, tokens of each, all tokens as
    word numbers, and each word's place among the answers. Kind 0: the words' hashes and training counts, to their parts.
    Kind 3: how many tokens a batch has. Word 0 is the end."""

    def one(g: int, b: pa.RecordBatch) -> Iterator[tuple[int, int, int, bytes]]:
        ids, train = b.column(0), b.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
        found, length = words(b.column(2))
        hashed = np.append(END_HASH, hashes(found.dictionary))
        stream = np.insert(numbers(found).astype(np.uint32) + np.uint32(1), np.cumsum(length), 0)
        length = length + 1
        own = np.bincount(stream, weights=np.repeat(train, length), minlength=len(hashed)).astype(np.uint32)
        part = (hashed % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        yield 0, g, 4, pack(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), train, length.astype(np.uint32), stream, place)
        for p, start, end in split(part[order]):
            yield p, g, 0, pack(hashed[order[start:end]], own[order[start:end]])
        yield 0, g, 3, pack(np.array([len(stream)]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        lane = TaskContext.get().partitionId()
        for count, b in enumerate(slices(batches, BATCH)):
            yield from one(lane << 20 | count, b)

    return lambda batches: emit(rows(batches))


def _answer_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 1: per batch the counts and numbers of its words. Kind 2: the distinct counts, and N and V, of the
    partition."""

    def rows() -> Iterator[tuple[int, int, int, bytes]]:
        for part, held in runs(batches, "part"):
            asked = [(g, *unpack(blob)) for _, g, _, blob in held]
            known, back = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
            total = np.bincount(back, weights=np.concatenate([a[2] for a in asked]), minlength=len(known)).astype(np.uint64)
            at = 0
            for g, own, _ in asked:
                now = back[at : at + len(own)]
                at += len(own)
                yield part, g, 1, pack(total[now], now.astype(np.uint32))
            yield part, 0, 2, pack(np.unique(total), np.array([total.sum(), (total > 0).sum()], np.uint64))

    yield from emit(rows())


class Corpus:
    """What every task has to know: parts, classes (the distinct training counts, ascending: no more than the square root
    of twice the tokens), tokens N, words V and documents in training."""

    def __init__(self, word_parts: int, classes: np.ndarray, n: int, v: int, docs: int) -> None:
        self.word_parts, self.pair_parts, self.classes, self.n, self.v, self.docs = word_parts, 1, classes, n, v, docs
        self.frequent = n // FREQUENT
        if len(classes) > 1 << (64 - NUMBER):
            raise ValueError("more distinct counts than a word's code holds")

    def count(self, code: np.ndarray) -> np.ndarray:
        return self.classes[(code >> np.uint64(NUMBER)).astype(np.int64)]

    def code(self, total: np.ndarray, part: int, number: np.ndarray) -> np.ndarray:
        """The codes of words by their training counts, part and number in the part: different for different words."""
        if len(number) and int(number.max()) * self.word_parts + part >= int(START):
            raise ValueError("more distinct words than a word's code holds")
        return np.searchsorted(self.classes, total).astype(np.uint64) << np.uint64(NUMBER) | number.astype(np.uint64) * np.uint64(self.word_parts) + np.uint64(part)


def _ask_pairs(corpus: Corpus):
    """Kind 0: per batch, to its own answers, its documents and what single words tell of them. Kind 1: pairs, to their part."""

    def one(held: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
        g = held[0][1]
        ids, null, train, length, stream, place = unpack(next(r[3] for r in held if r[2] == 4))
        told = [corpus.code(*unpack(blob)[:1], part, unpack(blob)[1]) for part, _, kind, blob in sorted(held, key=lambda r: r[0]) if kind == 1]
        code = np.append(np.concatenate(told)[place], np.uint64(np.searchsorted(corpus.classes, corpus.docs)) << np.uint64(NUMBER) | START)
        count = corpus.count(code).astype(float)
        first = np.zeros(len(stream), bool)
        first[np.cumsum(length)[:-1]] = True
        first[:1] = True
        context = np.empty(len(stream), np.int64)
        context[1:] = stream[:-1]
        context[first] = len(place)
        doc = np.repeat(np.arange(len(length), dtype=np.uint32), length)
        add = lambda x: np.bincount(doc, weights=x, minlength=len(length))
        c, ch = count[stream], count[context]
        yield g % corpus.pair_parts, g, 0, pack(ids, null, train, length, add(c > 0).astype(np.uint32), add(np.log10(c + 1)), -add(np.log10(np.maximum(ch, 1))))
        # ranks by code, so that one sort of one key orders by part, context and word
        by = np.argsort(code, kind="stable")
        rank = np.empty(len(code), np.uint64)
        rank[by] = np.arange(len(code), dtype=np.uint64)
        own, other = mix(code)[context], mix(code ^ np.uint64(0x9E3779B97F4A7C15))[stream]
        part = np.where(ch > corpus.frequent, mix(own ^ other), own) % np.uint64(corpus.pair_parts)
        bits = np.uint64(len(code).bit_length())
        pair = rank[context] << bits | rank[stream]
        order = np.argsort(pair, kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        mark = doc << np.uint32(1) | np.repeat(train, length)
        for p, begin, end in split(part[order]):
            at = order[begin:end]
            h, n = np.unique(rank[context[at]], return_counts=True)
            yield p, g, 1, pack(code[by][h.astype(np.int64)], n.astype(np.uint32), code[stream[at]], mark[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(r for _, held in runs(batches, "g") for r in one(held))

    return run


def _answer_pairs(corpus: Corpus):
    """Kind 0 passes. Kind 1: per batch, counts of seen pairs by document, and unseen pairs with what their contexts'
    weights are made of. Kind 2: how many pairs have each count up to K + 1. Kind 3: frequent contexts' sums here."""

    def one(part: int, held: list[tuple[int, int, int, bytes]]) -> Iterator[tuple[int, int, int, bytes]]:
        yield from (r for r in held if r[2] == 0)
        asked = [(r[1], *unpack(r[3])) for r in held if r[2] == 1]
        if not asked:
            return
        h = np.concatenate([np.repeat(a[1], a[2]) for a in asked])
        w, mark = np.concatenate([a[3] for a in asked]), np.concatenate([a[4] for a in asked])
        size = np.array([len(a[3]) for a in asked])
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        new = np.append(True, (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1]))
        group = np.cumsum(new) - 1
        c = np.bincount(group, weights=(mark[order] & 1)).astype(np.int64)
        gh, gw = hs[new], ws[new]
        count = np.empty(len(h), np.int64)
        count[order] = c[group]
        yield part, 0, 2, pack(np.bincount(np.minimum(c, K + 2), minlength=K + 3).astype(np.uint64))
        # a context's sums over the words it was seen with: pairs by count 1..K, larger counts, how many, words' counts + 1
        top = np.append(True, gh[1:] != gh[:-1])
        start = np.flatnonzero(top)
        seen = c > 0
        parts = [*((c == r) for r in range(1, K + 1)), np.where(c > K, c, 0), c > K, np.where(seen, corpus.count(gw) + np.uint64(1), 0)]
        sums = np.stack([np.add.reduceat(x.astype(np.float64), start) for x in parts], axis=1)
        contexts = gh[start]
        frequent = corpus.count(contexts) > corpus.frequent
        if frequent.any():
            yield part, 0, 3, pack(contexts[frequent], sums[frequent].ravel())
        known = corpus.count(h) > 0
        where = np.searchsorted(contexts, h)
        end = np.cumsum(size)
        for (g, *_), b, a in zip(asked, end, end - size, strict=True):
            doc, n, row = mark[a:b] >> np.uint32(1), count[a:b], where[a:b]
            unseen = n == 0
            cw = corpus.count(w[a:b])
            bare = unseen & ~known[a:b]
            far = unseen & known[a:b] & frequent[row]
            near = unseen & known[a:b] & ~frequent[row]
            own, back = np.unique(row[near], return_inverse=True)
            s = ~unseen
            yield part, g, 1, pack(doc[s], n[s].astype(np.uint32), doc[bare], cw[bare], doc[far], cw[far], h[a:b][far], doc[near], cw[near], back.astype(np.uint32), corpus.count(contexts[own]), sums[own].ravel())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from emit(r for part, held in runs(batches, "part") for r in one(part, held))

    return run


class Discounts:
    """left(c): what a count c comes to. by_count: distinct pairs with count 1..K+1."""

    def __init__(self, by_count: np.ndarray) -> None:
        n = np.asarray(by_count, float)
        self.kept = np.array([(r - 0.5) for r in range(1, K + 1)])  # where Good-Turing isn't to be had: half a count
        for k in range(K, 0, -1):
            if (n[: k + 1] > 0).all():
                cut = (k + 1) * n[k] / n[0]
                kept = np.array([((r + 1) * n[r] / n[r - 1] - r * cut) / (1 - cut) for r in range(1, k + 1)]) if cut < 1 else np.zeros(1)
                if (kept > 0).all() and (kept < np.arange(1, k + 1)).all():
                    beyond = min(0.5, k - kept[-1])
                    self.kept = np.array([*kept, *(r - beyond for r in range(k + 1, K + 1))])
                    break
        self.loss = K - self.kept[-1]

    def left(self, c: np.ndarray) -> np.ndarray:
        return np.where(c <= K, self.kept[np.clip(c, 1, K).astype(np.int64) - 1], c - self.loss)

    def weight(self, total: np.ndarray, sums: np.ndarray, n: int, v: int) -> np.ndarray:
        """c(h) * a(h) of contexts by their counts and sums."""
        mass = total - sums[:, :K] @ self.kept - (sums[:, K] - self.loss * sums[:, K + 1])
        return mass / (1 - sums[:, K + 2] / (n + v + 1.0))


def _score(corpus: Corpus, discounts: Discounts, codes: np.ndarray, weights: np.ndarray):
    log_p = lambda c: np.log10((c + 1.0) / (corpus.n + corpus.v + 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches, "g"):
            ids, null, train, length, known, base, score = unpack(next(r[3] for r in held if r[2] == 0))
            score = score.copy()
            for blob in (r[3] for r in held if r[2] == 1):
                doc, c, d1, c1, d2, c2, h2, d3, c3, row, total, sums = unpack(blob)
                near = discounts.weight(total.astype(float), sums.reshape(-1, K + 3), corpus.n, corpus.v)
                at = np.concatenate([doc, d1, d2, d3])
                what = [np.log10(discounts.left(c.astype(np.int64))), log_p(c1), np.log10(weights[np.searchsorted(codes, h2)]) + log_p(c2) if len(h2) else np.zeros(0), np.log10(near[row]) + log_p(c3)]
                score += np.bincount(at, weights=np.concatenate(what), minlength=len(score))
            base = base - length * np.log10(corpus.n + corpus.v + 1.0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(train == 0), pa.array(length.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), corpus.n)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Learn from the rows where `train` (a column) holds, score all: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (log10, by single words), score (log10 of the model's probability of the text).

    Tokens are words between ASCII white space, A-Z lower-cased, then one end. Null texts count as empty (the end alone);
    null ids are kept; train null counts as false; repeated rows count each. Without training rows every word is unknown.
    An empty table gives no rows. Other columns are ignored. Words are told apart by 64-bit hash.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text_col).cast("string").alias("text"))
    word_parts = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // WORDS + 1
    where = write(rows.transform(in_arrow, _ask_words(word_parts), ROW), new_path(spark, "batches"), ("kind",), compression="uncompressed")
    batches = spark.read.schema(ROW).parquet(where)
    answered = materialize(dealt(batches.filter("kind = 0"), word_parts, "part").transform(in_arrow, _answer_words, ROW), "words", compression="uncompressed")
    drop(spark, f"{where}/kind=0")
    batches = spark.read.schema(ROW).parquet(where)
    told = answered.filter("kind = 2").transform(in_arrow, _numbers, "what int, value long, times long").groupBy("what", "value").agg(F.sum("times").alias("times")).collect()  # at most the distinct counts
    totals = {w: sum(r["value"] * r["times"] for r in told if r["what"] == w) for w in (1, 2)}
    n_docs = rows.filter("train").count()
    classes = np.unique(np.array([0, n_docs, *(r["value"] for r in told if r["what"] == 0)], np.uint64))
    corpus = Corpus(word_parts, classes, totals[1], totals[2], n_docs)
    sizes = batches.filter("kind = 3").transform(in_arrow, _sizes, "tokens long").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).first()
    corpus.pair_parts = (sizes["tokens"] or 0) // PAIRS + 1

    both = batches.filter("kind = 4").unionByName(answered.filter("kind = 1"))
    asked = dealt(both, sizes["n"], "g").transform(in_arrow, _ask_pairs(corpus), ROW)
    got = dealt(asked, corpus.pair_parts, "part").transform(in_arrow, _answer_pairs(corpus), ROW)
    answers = spark.read.schema(ROW).parquet(write(got, new_path(spark, "answers"), ("kind",), compression="uncompressed"))

    by_count = np.zeros(K + 3)
    for r in answers.filter("kind = 2").transform(in_arrow, _pair_numbers, "value int, times long").groupBy("value").agg(F.sum("times").alias("times")).collect():
        by_count[r["value"]] = r["times"]
    discounts = Discounts(by_count[1 : K + 2])
    sums = [f"s{i}" for i in range(K + 3)]
    frequent = answers.filter("kind = 3").transform(in_arrow, _contexts, "h long, " + ", ".join(f"{s} double" for s in sums)).groupBy("h").agg(*(F.sum(s).alias(s) for s in sums)).collect()  # at most FREQUENT
    codes = np.array([r["h"] for r in frequent], np.int64).view(np.uint64)
    order = np.argsort(codes)
    codes = codes[order]
    table = np.array([[r[s] for s in sums] for r in frequent], float).reshape(-1, K + 3)[order]
    weights = discounts.weight(corpus.count(codes).astype(float), table, corpus.n, corpus.v)
    out = dealt(answers.filter("kind < 2"), sizes["n"], "g").transform(in_arrow, _score(corpus, discounts, codes, weights), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in column(b, "blob"):
            counts, totals = unpack(blob)
            value = [*counts.tolist(), *totals.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(counts) + [1, 2], pa.int32()), pa.array(value, pa.int64()), pa.array([1] * len(value), pa.int64())], names=["what", "value", "times"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([int(unpack(x)[0][0]) for x in column(b, "blob")], pa.int64())], names=["tokens"])


def _pair_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in column(b, "blob"):
            got = unpack(blob)[0]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(got)), pa.int32()), pa.array(got.astype(np.int64))], names=["value", "times"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for blob in column(b, "blob"):
            h, sums = unpack(blob)
            sums = sums.reshape(len(h), -1)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in range(sums.shape[1]))], names=["h", *(f"s{i}" for i in range(sums.shape[1]))])


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; learned from those whose crc32(doc_id) mod 7 is not 2."""
    return score_documents(read(spark, sf_dir, "documents"), crc_mod("doc_id", 7) != 2)
