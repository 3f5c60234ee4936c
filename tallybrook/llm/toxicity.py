"""Operator 9, toxicity by a counterfactual-regularised classifier.

Features are the words of a text and the character n-grams of its words, as a set. The classifier is a logistic
regression; for labelled texts with identity terms a twin is made in which each term is swapped for another of its group;
a text without any gets a pair of twins, with one term and with the next of its group put in, so that every term is held
neutral however seldom the labelled texts name it. The difference between twins' scores is penalised, so that naming one
group or another says nothing. The terms are a parameter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, crc_mod, in_arrow, materialize, read
from .linear import Bag, fit_bag, sigmoid

WORDS = re.compile(r"[^\W\d_]+")
GRAMS = (4, 5, 6)
CACHE = 400_000
#: Identity terms by group; each is swapped for the next of its group. The default of the parameter `identity`.
IDENTITY = [
    ["women", "men", "girls", "boys"],
    ["woman", "man", "girl", "boy"],
    ["female", "male"],
    ["gay", "straight", "lesbian", "bisexual", "queer", "transgender"],
    ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino"],
    ["american", "african", "european", "mexican", "chinese", "indian", "arab"],
    ["old", "young"],
    ["deaf", "blind", "disabled"],
    ["frauen", "männer"],
    ["femmes", "hommes"],
    ["mujeres", "hombres"],
]


def swaps(identity: list[list[str]]) -> dict[str, str]:
    return {w: g[(i + 1) % len(g)] for g in identity for i, w in enumerate(g)}


def twins_of(words: set[str], swap: dict[str, str]) -> tuple[set[str], set[str]] | None:
    """A text's words and those of its twin: terms swapped, or one put in and the next of its group; None without terms."""
    if words & swap.keys():
        return words, {swap.get(w, w) for w in words}
    if not swap:
        return None
    terms = sorted(swap)
    term = terms[zlib.crc32(" ".join(sorted(words)).encode()) % len(terms)]
    return words | {term}, words | {swap[term]}


def word_features(word: str, swap: dict[str, str]) -> list[str]:
    """The word itself, between marks, and the n-grams of the marked word. Identity terms have no n-grams, so that a swap
    changes one feature each way."""
    marked = f"^{word}$"
    if word in swap:
        return [marked]
    return [marked, *{marked[i : i + n] for n in GRAMS for i in range(len(marked) - n + 1)} - {marked}]


def words_of(text: str) -> set[str]:
    return set(WORDS.findall(text.lower()))


class Model:
    def __init__(self, features: list[str], weights: np.ndarray, swap: dict[str, str]) -> None:
        self.number = {f: i for i, f in enumerate(features)}
        self.weights, self.swap, self.cache, self.twins, self.swapped = weights, swap, {}, 0, 0

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def row(self, words: set[str]) -> list[int]:
        got, cache, number = set(), self.cache, self.number
        for w in words:
            own = cache.get(w)
            if own is None:
                own = tuple(number[f] for f in word_features(w, self.swap) if f in number)
                if len(w) <= 64:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[w] = own
            if own:
                got.update(own)
        return sorted(got)

    def score(self, text: str) -> float:
        got = self.row(words_of(text))
        return float(sigmoid(self.weights[got].sum() + self.weights[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train=None, rows: int = 16_000, width: int = 1024, least: int = 5, penalty: float = 1.0, positive: float = 3.0, identity: list[list[str]] = IDENTITY) -> Model:
    """Learn from at most `rows` labelled rows (those of the least id hash) for which `train`, a column on the labels,
    holds; `width` features that at least `least` of them have and that tell most of the label are kept, and every
    identity term. positive: how much a toxic row weighs. Null labels, labels other than 0 and 1, and ids without a document
    are left out; of the documents of one id the least text counts. The model tells its pairs of twins, and how many of them
    come of swapping (`twins`, `swapped`)."""
    swap = swaps(identity)
    seen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.lit(True) if train is None else train))
    seen = seen.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    chosen = seen.orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    pairs = [(r["id"], r["y"]) for r in chosen.collect()]  # at most `rows`
    spark = docs.sparkSession
    picked = spark.createDataFrame(pairs, "id long, y int")
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(picked), "id")
    own = materialize(own.groupBy("id", "y").agg(F.min("text").alias("text")), "labelled")  # at most two texts an id

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial counts, of features that a task sees in the texts of its rows."""
        n: dict[int, Counter] = {0: Counter(), 1: Counter()}
        cache: dict[str, list[str]] = {}

        def out() -> pa.RecordBatch:
            names = list(n[0].keys() | n[1].keys())
            both = [pa.array([n[y][f] for f in names], pa.int64()) for y in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *both], names=["f", "n0", "n1"])

        for b in batches:
            for y, text in zip(column(b, "y"), column(b, "text"), strict=True):
                got: set[str] = set()
                for w in words_of(text):
                    if (fs := cache.get(w)) is None:
                        if len(cache) >= 50_000:
                            cache.clear()
                        fs = cache[w] = word_features(w, swap)
                    got.update(fs)
                n[y].update(got)
                if len(n[0]) + len(n[1]) > 500_000:
                    yield out()
                    n = {0: Counter(), 1: Counter()}
        yield out()

    totals = own.groupBy("y").count().collect()
    total = {0: 0, 1: 0} | {r["y"]: r["count"] for r in totals}
    counts = own.select("y", "text").transform(in_arrow, count, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).filter(F.col("n0") + F.col("n1") >= least)
    a, b = max(1, total[0]), max(1, total[1])
    ratio = F.log((F.col("n1") + 0.5) / (b + 1.0)) - F.log((F.col("n0") + 0.5) / (a + 1.0))
    z = F.abs(ratio) / F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    top = [r["f"] for r in counts.select("f", z.alias("z")).orderBy(F.desc("z"), "f").limit(width).collect()]
    features = list(dict.fromkeys(top + sorted(f"^{w}$" for w in swap)))
    model = Model(features, np.zeros(len(features) + 1), swap)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [words_of(t) for t in column(b, "text")]
            pairs = [twins_of(x, swap) for x in words]
            of = lambda x: pa.array(x, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "y"), pa.int32()), of([model.row(x) for x in words]), of([p and model.row(p[0]) for p in pairs]), of([p and model.row(p[1]) for p in pairs]), pa.array([bool(x & swap.keys()) for x in words])], names=["y", "x", "one", "other", "swapped"])

    got = own.select("y", "text").transform(in_arrow, rows_of, "y int, x array<int>, one array<int>, other array<int>, swapped boolean").collect()  # at most `rows`, of their features
    got = sorted(got, key=lambda r: (r["y"], r["x"]))
    y = np.array([r["y"] for r in got], float)
    twins = [r for r in got if r["one"] is not None]
    model.twins, model.swapped = len(twins), sum(r["swapped"] for r in twins)
    bags = (Bag([r["one"] for r in twins], len(features)), Bag([r["other"] for r in twins], len(features)))
    model.weights = fit_bag(Bag([r["x"] for r in got], len(features)), y, bags, penalty, positive) if len(y) else np.append(np.zeros(len(features)), -4.0)
    model.cache = {}
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: toxic likelier) per row, of the whole text alone. Null and empty texts get the
    score of a text without features; repeated rows are scored each; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # at most `width` features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "doc_id"), pa.int64()), pa.array([m.score(x.as_py() or "") for x in b.column(1)], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(in_arrow, run, "doc_id long, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; labels learned from rows whose crc32(doc_id) mod 3 is not 1."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), train=crc_mod("doc_id", 3) != 1)
    out = score(docs, model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
