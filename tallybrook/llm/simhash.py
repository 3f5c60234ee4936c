"""Operator 3, SimHash near-dedup by deletion-variant signatures.

A fingerprint of 64-bit words is cut into segments; if there are more than half as many segments as bits may differ, one
segment differs by at most one bit and no link is missed. Each segment is indexed exactly and with one bit taken out at
each place; equal entries meet in the same task, and the whole
fingerprints are verified there. A pair is looked for in one entry only: the exact one where the segment is equal, else
the one without the bit that differs. Of each entry only a spanning forest of its links leaves the task, so that no
group gives all its pairs. Groups are connected components of the links.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, column, fold, in_arrow, keepers, materialize, read, spread, texts
from .components import components
from .exchange import ROW, dealt, emit, pack, runs, unpack

#: Entries that a task should hold, about; fingerprints that are sent at once. Both bound memory.
ENTRIES, SENT = 500_000, 4096
#: Entries of at most this many fingerprints are compared pair by pair at once; larger ones row by row.
SMALL = 32
#: In larger entries, links within two bits are found by masks, in time linear but for sorting.
LARGE = 1024


def fingerprint(text: str, shingle: int = 3, words: int = 1) -> np.ndarray:
    """The fingerprint of a whole text as `words` unsigned 64-bit integers; all zero without words. Word i takes the bits
    set in over half of the shingles' XXH64 with seed 42 + i."""
    found = re.findall(WORD, fold(text))
    if not found:
        return np.zeros(words, np.uint64)
    grams = [" ".join(found)] if len(found) < shingle else [*map(" ".join, zip(*(found[i:] for i in range(shingle)), strict=False))]
    ones = np.zeros((words, 64), np.int64)
    for i in range(words):
        h = np.array([xxhash.xxh64_intdigest(g, 42 + i) for g in grams], dtype="<u8")
        for at in range(0, len(h), 1 << 16):
            ones[i] += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(grams), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 3, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, f0, f1, ... (a fingerprint's words, as longs) per row; null texts count as empty. text_hash
    tells rows of one id apart."""
    names = [f"f{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle, words) for t in texts(b)], dtype=np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "doc_id"), pa.int64()), pa.array(column(b, "text_hash"), pa.int64()), *(pa.array(np.ascontiguousarray(fp[:, i])) for i in range(words))], names=["doc_id", "text_hash", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("text"))
    return rows.transform(in_arrow, run, "doc_id long, text_hash long, " + ", ".join(f"{n} long" for n in names))


def kinds_of(words: int, segments: int) -> list[tuple[int, int, int, int]]:
    """(word, shift, width, p) of each kind of entry, with so many segments a word; p is the place left out, -1 for none."""
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    return [(w, a, b - a, p) for w in range(words) for a, b in zip(cuts, cuts[1:], strict=False) for p in range(-1, b - a)]


def _keys(fp: np.ndarray, words: int, segments: int) -> np.ndarray:
    """The key of each entry of each fingerprint (rows of fp), kind by kind; the kind is above the 40th bit."""
    out = []
    for k, (w, shift, width, p) in enumerate(kinds_of(words, segments)):
        value = (fp[:, w] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
        out.append((value & ~np.uint64(1 << p) if p >= 0 else value) | np.uint64(k << 40))
    return np.stack(out)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return z ^ (z >> np.uint64(29))


def _entries(words: int, segments: int, parts: int):
    """Fingerprints to the parts of their entries' keys: each once to a part, with the kinds of its entries there."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
        held: list[np.ndarray] = []

        def send() -> Iterator[tuple[int, int, int, bytes]]:
            fp = np.concatenate(held)
            part = (_mix(_keys(fp, words, segments)) % np.uint64(parts)).astype(np.int64)
            kinds = part.shape[0]
            part = part.T.ravel()  # by fingerprint, then kind
            order = np.argsort(part, kind="stable")
            start = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                at = order[start[p] : start[p + 1]]
                if len(at):
                    own, n = np.unique(at // kinds, return_counts=True)
                    yield p, 0, 0, pack(fp[own].ravel(), n.astype(np.uint16), (at % kinds).astype(np.uint16))

        for b in batches:
            fp = np.stack([b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(words)], axis=1)
            for at in range(0, len(fp), SENT):
                held.append(fp[at : at + SENT])
                if sum(map(len, held)) >= SENT:
                    yield from send()
                    held = []
        if held and sum(map(len, held)):
            yield from send()

    return lambda batches: emit(rows(batches))


class _Forest:
    def __init__(self) -> None:
        self.label: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        label = self.label
        while (up := label.setdefault(i, i)) != i:
            label[i] = i = label.setdefault(up, up)
        return i

    def add(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.label[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def entry_links(key: np.ndarray, fp: np.ndarray, words: int, segments: int, bits: int) -> list[tuple[int, int]]:
    """Positions of a spanning forest of the links between the fingerprints (rows of fp) that share an entry."""
    kinds = kinds_of(words, segments)
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    place = np.array([64 * w + s + p if p >= 0 else -1 for w, s, _, p in kinds])[(key >> np.uint64(40)).astype(np.int64)]
    forest = _Forest()

    def on(i: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (fp[i, at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def linked(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        at = place[i]
        met = _far(fp[i], fp[j]) <= bits
        return met & ((at < 0) | (on(i, np.maximum(at, 0)) != on(j, np.maximum(at, 0))))

    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(key)))
    left = np.repeat(np.where(size <= SMALL, start + size, 0), size)  # the end of each small entry
    for step in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.flatnonzero(np.arange(len(key)) + step < left)
        if not len(i):
            break
        i = i[linked(i, i + step)]
        for a, b in zip(order[i].tolist(), order[i + step].tolist(), strict=True):
            forest.add(a, b)
    for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        if n > LARGE and bits <= 2 and words == 1:
            _masked(fp[s : s + n, 0], int(place[s]), kinds[int(key[s] >> np.uint64(40))], bits, order[s : s + n], forest)
            continue
        for x in range(s + 1, s + n):
            before = np.arange(s, x)
            for y in before[linked(np.full(len(before), x), before)].tolist():
                forest.add(int(order[x]), int(order[y]))
    return forest.links


def _masked(fp: np.ndarray, place: int, kind: tuple[int, int, int, int], bits: int, names: np.ndarray, forest: _Forest) -> None:
    """Fingerprints of one large entry that are equal but for at most `bits` places outside the entry's segment (or the
    entry's place and one fewer): for each such set of places, those that are equal without it are linked in a row."""
    _, shift, width, _ = kind
    free = [x for x in range(64) if not shift <= x < shift + width]
    for places in itertools.combinations(free, bits if place < 0 else bits - 1):
        mask = ~np.uint64(sum(1 << x for x in (*places, *([place] if place >= 0 else []))))
        cut = fp & mask
        order = np.argsort(cut, kind="stable")
        for i in np.flatnonzero(cut[order][1:] == cut[order][:-1]).tolist():
            forest.add(int(names[order[i]]), int(names[order[i + 1]]))


def links(fps: DataFrame, words: int = 1, bits: int = 2, segments: int = 2) -> DataFrame:
    """(a, b): links between different fingerprints at most `bits` apart, enough of them to connect what is connected.
    fps: distinct f0, f1, ... A fingerprint stands as its word, or as a 64-bit hash of its words if it has several."""
    names = [f"f{i}" for i in range(words)]
    parts = len(kinds_of(words, segments)) * fps.count() // ENTRIES + 1
    ends = ", ".join(f"{s}{i} long" for s in "ab" for i in range(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in runs(batches, "part"):
            key, fp = [], []
            for *_, blob in held:
                own, n, kind = unpack(blob)
                own = np.repeat(own.reshape(-1, words), n, axis=0)
                fp.append(own)
                key.append(_keys_of(own, kind.astype(np.int64), words, segments))
            fp = np.concatenate(fp)
            found = entry_links(np.concatenate(key), fp, words, segments, bits)
            both = np.unique(_stars(fp, found, words), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, i])) for i in range(2 * words)], names=[f"{s}{i}" for s in "ab" for i in range(words)])

    met = dealt(fps.select(*names).transform(in_arrow, _entries(words, segments, parts), ROW), parts, "part").transform(in_arrow, run, ends)
    return met.select(node([f"a{i}" for i in range(words)]).alias("a"), node([f"b{i}" for i in range(words)]).alias("b"))


def _keys_of(fp: np.ndarray, kind: np.ndarray, words: int, segments: int) -> np.ndarray:
    """The key of one entry of each row of fp, by its kind."""
    word, shift, width, place = (np.array(x) for x in zip(*kinds_of(words, segments), strict=True))
    value = (fp[np.arange(len(fp)), word[kind]] >> shift[kind].astype(np.uint64)) & ((np.uint64(1) << width[kind].astype(np.uint64)) - np.uint64(1))
    cut = np.where(place[kind] >= 0, np.uint64(1) << np.maximum(place[kind], 0).astype(np.uint64), np.uint64(0))
    return (value & ~cut) | (kind.astype(np.uint64) << np.uint64(40))


def _stars(fp: np.ndarray, links: list[tuple[int, int]], words: int) -> np.ndarray:
    """The links' components as links of each member to the least one: the same in every task that sees the group."""
    name, back = _distinct(fp, sorted({x for link in links for x in link}), words)
    forest = _Forest()
    for a, b in links:
        forest.add(back[a], back[b])  # names ascend with the fingerprints, and a root is its tree's least
    out = [(x, forest.find(x)) for x in range(len(name)) if forest.find(x) != x]
    a, b = (name[[x[k] for x in out]] if out else np.zeros((0, words), np.uint64) for k in (0, 1))
    return np.hstack([a, b]).view(np.int64)


def _distinct(fp: np.ndarray, rows: list[int], words: int) -> tuple[np.ndarray, dict[int, int]]:
    """The distinct fingerprints among the rows, ascending, and the number of each row's."""
    if not rows:
        return np.zeros((0, words), np.uint64), {}
    name, number = np.unique(fp[rows], axis=0, return_inverse=True)
    return name, dict(zip(rows, number.ravel().tolist(), strict=True))


def node(names: list[str]):
    return F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)


def groups(docs: DataFrame, shingle: int = 3, bits: int = 2, words: int = 1, segments: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, f0, f1, ..., component_id, and keeper (whether the row's id and text_hash are the least of the
    component) per row.

    Rows whose fingerprints differ in at most `bits` bits are linked; component_id is the smallest doc_id reachable.
    Texts without words have fingerprint zero and are linked like any other; null texts count as empty. Null ids are
    kept; a component has id null only if all its ids are. Repeated rows are members like any other. An empty table gives
    no rows. Other columns are ignored.
    """
    names = [f"f{i}" for i in range(words)]
    fps = materialize(fingerprints(docs, shingle, words, id_col, text_col).withColumn("node", node(names)), "fingerprints")
    classes = materialize(fps.groupBy("node", *names).agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")), "classes")
    met = components(links(classes, words, bits, segments))
    rooted = classes.join(met, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("keep"))
    named = spread(rooted.select("node", "root"), best, "root", "node").drop("root")
    return spread(fps, named, "node", "doc_id").withColumn("keeper", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash").eqNullSafe(F.col("keep"))).drop("keep", "node")


def dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs of which each group of near duplicates keeps one: that of the least doc_id (then text hash; of
    rows equal in both, one). All columns are kept; see groups()."""
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    return keepers(docs, groups(docs, **how), id_col, text_col)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`: fingerprint of 3-word shingles, links at 2 or fewer bits, component_id."""
    out = groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
