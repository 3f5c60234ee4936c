"""Operator 6, quality by co-training.

Two classifiers look at different views of a document: its text's content (what words it has and how it is made up), and
its metadata. In each round both score every document that isn't learned from, on the executors, and of the whole table
each adds those that it is surest of, with its labels, to the other's training rows. Each view's score is then calibrated
on labelled rows kept apart, and a last model on both calibrated scores gives the probability of good quality.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import in_arrow, materialize, read, small_batches
from .linear import fit_dense, score_dense, sigmoid
from .words import hashes, numbers, slices, words

TEXT_VIEW = ("upper", "digit", "space", "line", "sign", "other", "bare", "doubled", "length", "same", "repeat", "mixed", "lines")
BUCKETS = 16
#: Hash buckets of words in the text view; bytes of text whose views are made at once.
WORDS, BATCH = 128, 4 << 20
WIDTH = len(TEXT_VIEW) + WORDS
#: How much evidence a bucket of words needs: buckets are many, and labelled rows may be few.
RIDGE = 30.0


def text_view(text: str) -> list[float]:
    """Shares and ratios over the whole text; zeros for an empty one."""
    if not text:
        return [0.0] * len(TEXT_VIEW)
    b = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    n = max(1, int(b.sum()))
    letters = b[65:91].sum() + b[97:123].sum() + b[128:].sum()
    plain = b[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    space, digit = b[9:14].sum() + b[32], b[48:58].sum()
    words = text.split()
    k = max(1, len(words))
    bare = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    same = sum(map(operator.eq, words, words[1:]))
    lines = text.split("\n")
    signs = n - letters - plain - space - digit
    return [
        float(b[65:91].sum() / max(1, letters)),
        float(digit / n),
        float(space / n),
        float(b[10] / n),
        float(signs / n),
        float(b[33] / n),
        bare / k,
        min(1.0, float(signs / k)),
        min(20.0, n / k) / 20,
        same / k,
        1 - len(set(words)) / k,
        math.log1p(k) / 10,
        1 - len(set(lines)) / len(lines),
    ]


def text_views(texts: pa.Array) -> np.ndarray:
    """Per text its shares and ratios, then the square roots of its words' shares by hash bucket."""
    found, length = words(texts)
    out = np.zeros((len(texts), WIDTH), np.float32)
    out[:, : len(TEXT_VIEW)] = [text_view(x.as_py() or "") for x in texts] or np.zeros((0, len(TEXT_VIEW)))
    if len(found):
        bucket = (hashes(found.dictionary) % np.uint64(WORDS)).astype(np.int64)[numbers(found)]
        of = np.repeat(np.arange(len(texts)), length)
        count = np.bincount(of * WORDS + bucket, minlength=len(texts) * WORDS).reshape(-1, WORDS)
        out[:, len(TEXT_VIEW) :] = np.sqrt(count / np.maximum(1, length)[:, None])
    return out


def meta_view(values: list) -> list[float]:
    """Each value as indicators of its hash bucket (null is a bucket of its own); numbers as size as well."""
    out = []
    for v in values:
        own = [0.0] * (BUCKETS + 2)
        if v is None:
            own[BUCKETS] = 1.0
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            size = math.log1p(abs(v)) if math.isfinite(v) else 0.0
            own[min(BUCKETS - 1, int(size))] = 1.0
            own[BUCKETS + 1] = size / 10
        else:
            own[zlib.crc32(str(v).encode()) % BUCKETS] = 1.0
        out += own
    return out


class Model:
    def __init__(self, views: list[dict], final: np.ndarray) -> None:
        self.views, self.final = views, final

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: probability by text, by metadata, by both."""
        both = np.stack([calibrated(v, x) for v, x in zip(self.views, (text, meta), strict=True)], axis=1)
        return np.column_stack([sigmoid(both), sigmoid(score_dense(both, self.final))])


def _train(x: np.ndarray, y: np.ndarray) -> dict:
    mean, sd = x.mean(0), x.std(0)
    sd = np.where(sd < 1e-9, 1.0, sd)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))  # both classes weigh the same
    ridge = np.where(np.arange(x.shape[1]) < len(TEXT_VIEW), 0.0, RIDGE) if x.shape[1] == WIDTH else 0.0
    return {"mean": mean, "sd": sd, "w": fit_dense((x - mean) / sd, y, weight, l2=1e-4, ridge=ridge), "scale": np.array([1.0, 0.0])}


def _raw(view: dict, x: np.ndarray) -> np.ndarray:
    return np.clip(score_dense((x - view["mean"]) / view["sd"], view["w"]), -30, 30)


def calibrated(view: dict, x: np.ndarray) -> np.ndarray:
    return _raw(view, x) * view["scale"][0] + view["scale"][1]


def _only(label: float, widths: tuple[int, int]) -> Model:
    """Everything gets the one label."""
    views = [{"mean": np.zeros(x), "sd": np.ones(x), "w": np.append(np.zeros(x), 4.0 if label else -4.0), "scale": np.array([1.0, 0.0])} for x in widths]
    return Model(views, np.array([0.5, 0.5, 0.0]))


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, surest, rounds: int) -> Model:
    """y: 0 and 1. Every fourth labelled row is kept for calibration. surest(views): per view the (text view, metadata view,
    label) of the unlabelled documents that it is surest of and that weren't given before."""
    if len(set(y.tolist())) < 2:  # nothing to tell apart
        return _only(not len(y) or y[0], (text.shape[1], meta.shape[1]))
    kept = np.arange(len(y)) % 4 == 3
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.zeros(len(y), bool)
    x, mark = [text[~kept], meta[~kept]], [y[~kept], y[~kept]]
    views = [_train(x[i], mark[i]) for i in (0, 1)]
    for _ in range(rounds):
        given = surest(views)
        for i in (0, 1):  # each view gets what the other is sure of
            if len(given[1 - i][2]):
                x[i], mark[i] = np.vstack([x[i], given[1 - i][i]]), np.append(mark[i], given[1 - i][2])
        views = [_train(x[i], mark[i]) for i in (0, 1)]
    test = kept if kept.any() else np.ones(len(y), bool)
    for view, own in zip(views, (text[test], meta[test]), strict=True):
        view["scale"] = fit_dense(_raw(view, own)[:, None], y[test], l2=1e-4)
    both = np.stack([calibrated(v, own[test]) for v, own in zip(views, (text, meta), strict=True)], axis=1)
    return Model(views, fit_dense(both, y[test], l2=1e-4))


def _meta(docs: DataFrame, meta_cols: list[str]) -> list:
    kinds = dict(docs.dtypes)
    number = lambda t: t in ("tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")
    return [F.col(c).cast("double" if number(kinds[c]) else "string").alias(f"m{i}") for i, c in enumerate(meta_cols)]


def _views(batches: Iterator[pa.RecordBatch], metas: int, text) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches whose last columns are the metadata, with both views; text(batch): the texts."""
    for b in slices(batches, BATCH):
        cols = [b.column(b.num_columns - metas + i).to_pylist() for i in range(metas)]
        meta = np.array([meta_view(list(r)) for r in zip(*cols, strict=True)], np.float32) if metas else np.zeros((b.num_rows, 0), np.float32)
        yield b, text_views(text(b)), meta


def _blobs(x: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(x, np.float32)], pa.binary())


def _rows(blobs: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(len(blobs), width).astype(float)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars"), rows: int = 6000, given: int = 200, rounds: int = 4, sure: float = 0.95) -> Model:
    """Learn from at most `rows` labelled documents, those of the least id hash; in each round each view labels the `given`
    documents of each class that it is surest of for the other, out of all that aren't among those, if it gives them at
    least the probability `sure`. Null labels and labels other than 0 and 1 are left out; so are metadata columns that docs
    lacks. Of rows of one id and label, and of rows of one text view, one counts."""
    small_batches(docs.sparkSession)
    meta = [c for c in meta_cols if c in docs.columns]
    spark, width = docs.sparkSession, len(meta_view([None] * len(meta)))
    seen = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).distinct()
    chosen = [tuple(r) for r in seen.orderBy(F.xxhash64("id"), "id", "y").limit(rows).collect()]
    marks = spark.createDataFrame(chosen, "id long, y int")  # at most `rows`
    learned = np.unique(np.array([c[0] for c in chosen], np.int64))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, text, own in _views(batches, len(meta), lambda b: b.column(1)):
            yield pa.RecordBatch.from_arrays([b.column(0), _blobs(text), _blobs(own)], names=["id", "text", "meta"])

    told = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"), *_meta(docs, meta))
    made = materialize(told.transform(in_arrow, make, "id long, text binary, meta binary"), "views")
    got = made.join(F.broadcast(marks), "id").groupBy("id", "y").agg(F.min(F.struct("text", "meta")).alias("v")).collect()  # at most two an id
    got = sorted(got, key=lambda r: (zlib.crc32(str(r["id"]).encode()), r["id"], r["y"]))
    used: set[int] = set()

    def surest(views: list[dict]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held = spark.sparkContext.broadcast((views, np.array(sorted(used), np.int64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            models, before = held.value
            for b in batches:
                ids = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
                free = ~np.isin(ids, learned) & ~np.isin(ids, before) & ~b.column(0).is_null().to_numpy(zero_copy_only=False)
                for view, (name, size) in enumerate((("text", WIDTH), ("meta", width))):
                    p = sigmoid(_raw(models[view], _rows(b.column(b.schema.get_field_index(name)).to_pylist(), size)))
                    for label, certainty in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(free & (certainty >= sure))
                        at = at[np.argsort(-certainty[at], kind="stable")[:given]]
                        own = b.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays([pa.array([view] * len(at), pa.int32()), pa.array([label] * len(at), pa.int32()), pa.array(certainty[at]), *own.columns], names=["view", "label", "p", "id", "text", "meta"])

        surer = Window.partitionBy("view", "label").orderBy(F.desc("p"), F.xxhash64("id"), "id")
        found = made.transform(in_arrow, run, "view int, label int, p double, id long, text binary, meta binary")
        found = found.groupBy("view", "label", "text").agg(F.max_by(F.struct("p", "id", "meta"), F.struct("p", "id")).alias("v")).select("view", "label", "v.*", "text")
        best = found.withColumn("k", F.row_number().over(surer)).filter(F.col("k") <= given).collect()  # at most 4 times `given`
        best.sort(key=lambda r: (r["view"], r["label"], r["k"]))
        out = []
        for view in (0, 1):
            new = [r for r in best if r["view"] == view and r["id"] not in used]
            used.update(r["id"] for r in new)
            out.append((_rows([r["text"] for r in new], WIDTH), _rows([r["meta"] for r in new], width), np.array([float(r["label"]) for r in new])))
        held.unpersist()
        return out

    return cotrain(_rows([r["v"]["text"] for r in got], WIDTH), _rows([r["v"]["meta"] for r in got], width), np.array([float(r["y"]) for r in got]), surest, rounds)


def score(docs: DataFrame, model: Model, text_col: str = "text", meta_cols: tuple[str, ...] = ("lang", "source", "n_chars")) -> DataFrame:
    """docs (their columns as a struct `row`) with text_score, meta_score and score: the chance of good quality by the
    text, the metadata, and both. Null texts count as empty, null metadata as a value of its own; repeated rows are
    scored each; an empty table gives no rows."""
    small_batches(docs.sparkSession)
    meta = [c for c in meta_cols if c in docs.columns]
    seen = docs.select(F.struct("*").alias("row"), *_meta(docs, meta))
    at = docs.columns.index(text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b, text, own in _views(batches, len(meta), lambda b: b.column(0).field(at).cast(pa.string())):
            got = m.scores(text, own)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[:, i]) for i in range(3))], names=["row", "text_score", "meta_score", "score"])

    return seen.transform(in_arrow, run, StructType([seen.schema["row"], *(StructField(n, DoubleType()) for n in ("text_score", "meta_score", "score"))]))


def accept(docs: DataFrame, labels: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """The rows of docs, with their own columns, whose score is at least `least`."""
    model = fit(docs, labels, **how)
    return score(docs, model).filter(F.col("score") >= least).select("row.*")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`: doc_id, text_score, meta_score, score, predicted (1 if score >= 0.5)."""
    docs = read(spark, sf_dir, "documents")
    out = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return out.select(F.col("row.doc_id").alias("doc_id"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
