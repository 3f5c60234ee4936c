"""Operator 1, approximate nearest neighbours by a hash-prefix forest.

Rows are dealt into blocks of bounded size. Each block holds a forest: per tree, the block's long hash strings (random
hyperplane signs about the block's medians) as one sorted array. A query descends every tree to its longest-prefix match,
then all trees ascend synchronously, one prefix bit at a time, until the trees together hold enough candidates. Candidates
are ranked by exact distance; blocks are merged per query. A block is sent once; the queries stream past it in slices, so
that no task holds an unbounded group and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_arrow, read

BITS = 32


def usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is of the table's most common length, finite in every component and not zero."""
    v = F.col(vec)
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    df = df.filter(v.isNotNull() & F.coalesce(ok, F.lit(False)))
    dim = df.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return df.filter(F.size(v) == (dim[0]["n"] if dim else 0))


class Forest:
    """Per tree the hash strings of a block's distinct vectors as a sorted array. Rows equal in id and vector are one."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, trees: int, seed: int) -> None:
        order = np.lexsort(np.vstack([ids, *x.T[::-1]]))
        x, ids = x[order], ids[order]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(1)
        once = new.copy()
        once[1:] |= ids[1:] != ids[:-1]
        x, self.ids, new = x[once], ids[once], new[once]
        self.first = np.flatnonzero(new)
        self.last = np.append(self.first[1:], len(x))
        self.u = x[self.first]
        self.size = (self.u * self.u).sum(1)
        rng = np.random.default_rng(seed)
        self.weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        self.trees = []
        for _ in range(trees):
            planes = rng.normal(size=(x.shape[1], BITS))
            at = self.u @ planes
            cut = np.median(at, axis=0)
            code = (at > cut) @ self.weights
            by = np.argsort(code, kind="stable").astype(np.int32)
            self.trees.append((planes, cut, by, code[by]))

    def search(self, q: np.ndarray, qids: np.ndarray, k: int, share: float, least: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
        """Per query its number and the (distance, id) of its k nearest among the forest's candidates. Equal vectors count
        as one candidate, so that a group of copies doesn't crowd out the rest."""
        n, enough = len(self.u), max(least, int(share * len(self.u)))
        shift = BITS - np.arange(BITS + 1)
        total, spans = np.zeros((len(q), BITS + 1), np.int64), []
        for planes, cut, _, code in self.trees:
            own = (q @ planes > cut) @ self.weights
            low = (own[:, None] >> shift) << shift
            lo, hi = np.searchsorted(code, low).astype(np.int32), np.searchsorted(code, low + (np.int64(1) << shift)).astype(np.int32)
            total += hi - lo
            spans.append((lo, hi))
        depth = BITS - np.argmax((total >= enough)[:, ::-1], axis=1)
        depth[total[:, 0] < enough] = 0
        for i in range(len(q)):
            seen = np.zeros(n, bool)
            for (_, _, by, _), (lo, hi) in zip(self.trees, spans, strict=True):
                seen[by[lo[i, depth[i]] : hi[i, depth[i]]]] = True
            found = np.flatnonzero(seen) if seen.sum() > k else np.arange(n)
            near = self.size[found] - 2 * (self.u[found] @ q[i])
            take = k + 1  # the query's own class may hold nothing but the query
            if len(found) > take:
                found = found[near <= np.partition(near, take - 1)[take - 1] + 1e-6 * (1 + np.abs(near).max())]
            dist = np.sqrt(((self.u[found] - q[i]) ** 2).sum(1))
            got = []
            for j, d in zip(found, dist, strict=True):
                own = self.ids[self.first[j] : min(self.last[j], self.first[j] + k + 1)]
                got += [(float(d), int(v)) for v in own if v != qids[i]][:k]
            yield i, sorted(got)[:k]


def _vectors(held: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, ids) of rows b, query, vec_id, v whose vectors are of one length."""
    ids = np.concatenate([h.column(2).to_numpy(zero_copy_only=False) for h in held])
    return np.concatenate([h.column(3).flatten().to_numpy(zero_copy_only=False) for h in held]).reshape(len(ids), -1), ids


def knn(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int = 10, trees: int = 64, share: float = 1.0, least: int = 640, block_rows: int = 16384, query_rows: int = 512, seed: int = 11) -> DataFrame:
    """The k nearest rows found for each query, by Euclidean distance in double precision, nearest first, ties to the
    smaller id: query_id, rank, vec_id, score.

    share: the trees ascend until together they hold so many candidates for each distinct vector of a block, and at least
    `least`, counted with repeats over the trees. Recall against brute force is measured in tests/llm.
    Vectors that are null, zero, hold null or non-finite components, or aren't of the most common length take no part, and
    null ids neither. A row is no candidate of a query with its own id. Repeated rows and queries (same id and vector)
    count once. Empty tables give no rows. Other columns are ignored.
    """
    part = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).filter("vec_id is not null")
    rows, queries = usable(part(rows), "v"), usable(part(queries).distinct(), "v")
    blocks = max(1, -(-rows.count() // block_rows))
    left = rows.select((F.monotonically_increasing_id() % blocks).cast("int").alias("b"), F.lit(0).alias("query"), "vec_id", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(1).alias("query"), "vec_id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, forest = None, [], None
        for whole in batches:
            edges = [0, *(np.flatnonzero(np.diff(whole.column(0).to_numpy() * 2 + whole.column(1).to_numpy())) + 1).tolist(), whole.num_rows]
            for begin, end in zip(edges, edges[1:], strict=False):
                b = whole.slice(begin, end - begin)
                if not b.num_rows:
                    continue
                if b.column(0)[0].as_py() != now:
                    now, held, forest = b.column(0)[0].as_py(), [], None
                if not b.column(1)[0].as_py():
                    held.append(b)
                    continue
                if held:
                    forest, held = Forest(*_vectors(held), trees, seed), []
                for at in range(0, b.num_rows, query_rows):
                    q, qids = _vectors([b.slice(at, query_rows)])
                    if forest is None or q.shape[1] != forest.u.shape[1]:
                        continue
                    out = [(int(qids[i]), v, d) for i, got in forest.search(q, qids, k, share, least) for d, v in got]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.float64())], names=["query_id", "vec_id", "score"])

    dealt = left.unionByName(right).repartitionById(blocks, F.col("b")).sortWithinPartitions("b", "query")
    found = dealt.transform(in_arrow, run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest found for every row of `embeddings` whose vec_id is divisible by 100."""
    rows = read(spark, sf_dir, "embeddings")
    return knn(rows, rows.filter("vec_id % 100 = 0"), "vec_id", "embedding")
