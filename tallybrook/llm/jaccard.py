"""Near-dedup by exact Jaccard similarity of word shingles: SimHash candidates (operator 3), then a prefix join.

SimHash only estimates the similarity (at 0.8, fingerprints of 64 bits differ in 10 of them on average, which no segment
index finds), so its links are a first step: pairs within two bits are looked up by deletion-variant signatures and checked
on the sets. What fingerprints lose, an exact join finds. Sets of many shingles join by bands of min-hashes, so many that two sets of the wanted similarity share none with a chance
below MISSED. Shorter sets join by prefixes: all shingles stand in one order. Two sets with similarity t or more share a shingle among the first n - ceil(t n) + 1 of
each (n: the set's size), so no pair is missed, whatever the order is; sets long enough to be similar to a banded one have
bands as well; one with frequent shingles last makes the fewest
candidates. A pair that shares its first common shingle at places i and j of sets of sizes n and m has at most
min(n - i, m - j) shingles in common, which sorts out most pairs before their whole sets are compared. So do parities: a
set's shingles fall into 1024 places by hash, and a bit tells whether a place holds an odd number of them. Two sets differ
in at least as many shingles as bits, so that no similar pair is sorted out.

Groups are connected components, so not all pairs of a group have to be compared: after the fingerprints' links each set
of an entry (the sets with one shingle in their prefixes) is compared with two hubs of the entry, in turns with more hubs of
other components, as long as that links many, then those pairs whose sets are still in different components are.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .bitmap import bitmap, in_bitmap
from .common import column, forget, in_arrow, keepers, materialize, over, small_batches, spread, tidy
from .components import components
from .exchange import mix
from .words import grams, hashes, numbers, slices, words

#: Rows that the order of shingles is learned from, about, and shingles that it puts last. They bear on speed only.
SAMPLED, FREQUENT = 20_000, 100_000
#: Min-hashes in a band, and the chance that two sets of just the wanted similarity share no band.
IN_BAND, MISSED = 4, 1e-9
#: Longs of a set's parities. All stand by every entry: folded to fewer they say little of long sets.
PARITIES = 16
WIDE = [f"w{i}" for i in range(PARITIES)]
#: First shingles of a prefix that stand by every entry, so that a pair is listed about once.
LEAD = 6
FIRST = [f"l{i}" for i in range(LEAD)]
#: Hubs an entry that its sets are compared with in a turn, and turns at most; what they leave is compared pair by pair.
HUBS, TURNS = 16, 6
#: Bytes of text whose shingles are made at once; bounds memory.
BATCH = 4 << 20


def shingles(text: pa.Array, shingle: int = 5) -> list[np.ndarray]:
    """The distinct word shingles of each whole text as ascending hashes; a text of fewer words is one, one without words
    none."""
    found, length = words(text)
    if not len(found):
        return [np.zeros(0, np.int64)] * len(text)
    gram, which = grams(hashes(found.dictionary)[numbers(found)], length, shingle)
    edges = np.searchsorted(which, np.arange(len(text) + 1))
    return [np.unique(gram[a:b].view(np.int64)) for a, b in zip(edges, edges[1:], strict=False)]


def _node(s: np.ndarray) -> int:
    """A set's name."""
    return xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63)


def fingerprint(s: np.ndarray) -> int:
    """The bits that are set in over half of the shingles' hashes; zero for no shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(s), bitorder="little").view("<i8")[0])


def parities(s: np.ndarray) -> np.ndarray:
    """Whether the number of shingles at each of 64 * PARITIES places is odd. Sets whose parities differ in k bits differ
    in k shingles at least."""
    with np.errstate(over="ignore"):
        at = ((s.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(64 * PARITIES)
    odd = np.bincount(at.astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


class Bands:
    """Keys of a set such that two sets of at least this similarity share one, but for a chance of MISSED."""

    def __init__(self, least: Fraction) -> None:
        self.n = math.ceil(math.log(MISSED) / math.log1p(-float(least) ** IN_BAND)) if least < 1 else 1
        self.short = int(self.n / (1 - least)) if least < 1 else 1 << 62  # larger sets have bands only
        self.by = np.random.default_rng(42).integers(1, 1 << 63, self.n * IN_BAND, np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.by), ~np.uint64(0))
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 1024):
                low = np.minimum(low, (s[at : at + 1024].view(np.uint64)[:, None] * self.by).min(0))
            out = np.arange(self.n, dtype=np.uint64)
            for column in low.reshape(self.n, IN_BAND).T:
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
        return out.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= least.numerator * (len(a) + len(b) - both)


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _frequent(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending shingles that are frequent in a sample of rows, and how often each is."""
    every = rows.count() // SAMPLED + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *shingles(b.column(0), shingle)]))], names=["s"])

    found = rows.filter(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(every)) == 0).select("text").transform(in_arrow, run, "s long")
    got = found.groupBy("s").agg(F.count("*").alias("n")).filter("n > 2").orderBy(F.desc("n"), "s").limit(FREQUENT).toPandas().sort_values("s")
    return got["s"].to_numpy(np.int64), got["n"].to_numpy(np.int64)


def _prefixes(rows: DataFrame, shingle: int, least: Fraction, frequent: Broadcast) -> DataFrame:
    """doc_id, text_hash, node (hash of the set), f0 (its fingerprint), n (its size), odd (its parities), prefix (its first
    shingles in the order, if it is short), bands (if it is long) per row."""
    banded = Bands(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = frequent.value
        for b in slices(batches, BATCH):
            node, size, prefix, prints, odd, bands = [], [], [], [], [], []
            for s in shingles(b.column(b.schema.get_field_index("text")), shingle):
                n = len(s)
                node.append(_node(s))
                size.append(n)
                prints.append(fingerprint(s))
                odd.append(parities(s))
                if len(known) and n <= banded.short:
                    i = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    s = s[np.argsort(np.where(known[i] == s, often[i], 0), kind="stable")]
                prefix.append(s[: n - -(-least.numerator * n // least.denominator) + 1] if n <= banded.short else s[:0])
                bands.append(banded.keys(s) if n >= least * banded.short else s[:0])
            yield pa.RecordBatch.from_arrays([pa.array(column(b, "doc_id"), pa.int64()), pa.array(column(b, "text_hash"), pa.int64()), pa.array(node, pa.int64()), pa.array(prints, pa.int64()), pa.array(size, pa.int32()), pa.array(odd, pa.list_(pa.int64())), pa.array(prefix, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "node", "f0", "n", "odd", "prefix", "bands"])

    return rows.transform(in_arrow, run, "doc_id long, text_hash long, node long, f0 long, n int, odd array<long>, prefix array<long>, bands array<long>")


def _possible(least: Fraction):
    """Whether entries (n, i) of a and (m, j) of b can be the first that the two sets share, at this similarity."""
    p, q = least.numerator, least.denominator
    return f"least(a.n, b.n) * {q}L >= greatest(a.n, b.n) * {p}L AND least(a.n - a.i, b.n - b.i) * {p + q}L >= (a.n + b.n) * {p}L"


def _alike(least: Fraction) -> str:
    """Whether the parities of a and b allow this similarity."""
    p, q = least.numerator, least.denominator
    apart = " + ".join(f"bit_count(a.{w} ^ b.{w})" for w in WIDE)
    return f"({apart}) * {p + q}L <= (a.n + b.n) * {q - p}L"


def _unlisted() -> str:
    """Whether no shingle before this entry's, among the first of a and of b, is in both: there the pair is listed already,
    as earlier places allow all that later ones do. Bands have place 0, so that they hide nothing and aren't hidden."""
    return " AND ".join(f"NOT (a.i > {i} AND b.i > {j} AND a.l{i} = b.l{j})" for i in range(LEAD) for j in range(LEAD))


def _whole(entries: DataFrame) -> DataFrame:
    """Entries, which hold no nulls, as columns of which Spark knows that: else the code of a join's condition gets too long
    to be compiled."""
    return entries.select([F.coalesce(c, F.lit(0)).alias(c) for c in entries.columns])


def _sorted_out(pairs: DataFrame, wide: DataFrame, least: Fraction) -> DataFrame:
    """Pairs without those whose parities show that the sets are not similar; sets are large to fetch."""
    a, b = (wide.select(F.col("node").alias(x), F.struct("n", *WIDE).alias(f"at_{x}")) for x in "ab")
    alike = re.sub(r"\b([ab])\.", r"at_\1.", _alike(least))
    return pairs.join(a, "a").join(b, "b").filter(alike).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    held = pairs.sparkSession.sparkContext.broadcast(bitmap(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node"))  # at most 16 MB

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Few sets but those of the pairs, so that few are exchanged."""
        for b in batches:
            yield b.filter(pa.array(in_bitmap(held.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (b.column(b.schema.get_field_index(x)) for x in ("ga", "gb"))
            keep = pa.array([similar(np.frombuffer(x.as_py(), "<i8"), np.frombuffer(y.as_py(), "<i8"), least) for x, y in zip(a, c, strict=True)], pa.bool_())
            yield b.select(["a", "b"]).filter(keep)

    sets = sets.select("node", "g").transform(in_arrow, near, "node long, g binary")
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("g").alias("ga")), "a").join(sets.select(F.col("node").alias("b"), F.col("g").alias("gb")), "b")
    return met.select("a", "b", "ga", "gb").transform(in_arrow, run, "a long, b long")


def _fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): sets of one fingerprint, each with the least of them, and the least sets of fingerprints within two bits,
    enough of both to connect what is connected. sets: node, f0."""
    sets = materialize(sets, "fingerprints")
    least = materialize(sets.groupBy("f0").agg(F.min("node").alias("head")), "heads")
    heads = [least.select(F.col("f0").alias(x), F.col("head").alias(f"head_{x}")) for x in "ab"]
    met = simhash.links(least.select("f0")).distinct().join(heads[0], "a").join(heads[1], "b").select(F.least("head_a", "head_b").alias("a"), F.greatest("head_a", "head_b").alias("b"))
    return over(sets.join(least, "f0").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).unionByName(met), sets, least)


def _mixed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries with the component (root) that the links found make; those whose sets are all in one component go. The table
    of entries is deleted."""
    named = entries.join(met := components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = named.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("s")
    out = materialize(named.join(mixed, "s"), "mixed")
    forget(entries, met)
    return out


def links(rows: DataFrame, classes: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """(a, b): links between different sets of at least this similarity, enough of them to connect what is connected.
    rows: doc_id, text_hash, text; classes: node, f0, n, odd, prefix, bands, first (a row that has the set). Bands say nothing
    of places: theirs count as the first."""
    each = classes.select("node", "n", F.posexplode("prefix").alias("i", "s")).unionByName(classes.select("node", "n", F.lit(0).alias("i"), F.explode("bands").alias("s")))
    shared = each.groupBy("s").agg(F.count("*").alias("k")).filter("k > 1").select("s")
    facts = classes.select("node", *[F.col("odd")[i].alias(w) for i, w in enumerate(WIDE)], *[F.coalesce(F.get("prefix", F.lit(i)), F.lit(0)).alias(x) for i, x in enumerate(FIRST)])
    entries = materialize(each.join(shared, "s").join(facts, "node"), "entries")

    wanted = classes.join(entries.select("node").distinct(), "node", "left_semi").select("node", F.col("first.text_hash").alias("text_hash"))
    held = rows.sparkSession.sparkContext.broadcast(bitmap(wanted, "text_hash"))  # at most 16 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Few sets but the wanted ones."""
        for b in slices(batches, BATCH):
            b = b.filter(pa.array(in_bitmap(held.value, b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))))
            found = shingles(b.column(1), shingle)
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "g"])

    found = rows.select("text_hash", "text").transform(in_arrow, run, "node long, g binary").join(wanted.select("node"), "node", "left_semi")
    sets = materialize(found.groupBy("node").agg(F.any_value("g").alias("g")), "sets")

    # two hubs an entry, the same ones wherever the same sets meet
    hub = F.struct("node", "n", "i", *WIDE)
    hubs = entries.groupBy("s").agg(F.min(hub).alias("x"), F.max(hub).alias("y")).select("s", F.explode(F.array("x", "y")).alias("hub")).select("s", "hub.*")
    ends = [F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")]
    may = f"{_possible(least)} AND {_alike(least)}"
    prints = _fingerprint_pairs(classes.join(entries.select("node").distinct(), "node", "left_semi").select("node", "f0"))
    near = _sorted_out(prints, classes.select("node", "n", *[F.col("odd")[i].alias(w) for i, w in enumerate(WIDE)]), least)
    first = _whole(entries).alias("a").join(_whole(hubs).alias("b"), F.expr(f"a.s = b.s AND a.node <> b.node AND {may}")).select(*ends)
    first = materialize(first.unionByName(near).distinct(), "pairs")
    forget(prints)
    found = [materialize(_verified(first, sets, least), "found")]
    named = _mixed(entries, found[0])
    met = f"a.s = b.s AND a.root <> b.root AND {may}"
    for turn in range(TURNS):
        tidy(rows.sparkSession)
        k = F.col("count").cast("double")
        if named.groupBy("s").count().agg(F.coalesce(F.sum(k * k) <= 2 * HUBS * F.sum(k), F.lit(True))).first()[0]:
            break  # all pairs are no more than a turn's
        # hubs drawn anew in each turn: where a set is like a tenth of a group, sixteen leave few sets unlinked
        draw = F.xxhash64("node", F.lit(turn))
        drawn = named.groupBy("s", F.pmod(draw, F.lit(HUBS)).alias("h")).agg(F.min(F.struct(draw.alias("draw"), "node", "n", "i", "root", *WIDE)).alias("hub")).select("s", "hub.*")
        near = materialize(_whole(named).alias("a").join(_whole(drawn).alias("b"), F.expr(met)).select(*ends).distinct(), "pairs")  # at most HUBS a row
        found.append(materialize(_verified(near, sets, least), "found"))
        forget(near)
        few = found[-1].count() * 200 < named.count()
        named = _mixed(over(named.drop("root"), named), functools.reduce(DataFrame.unionByName, found))
        if few:
            break
    rest = _whole(named).alias("a").join(_whole(named).alias("b"), F.expr(f"a.node < b.node AND {met} AND {_unlisted()}")).select(*ends).distinct()
    rest = materialize(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    out = materialize(functools.reduce(DataFrame.unionByName, [*found, _verified(rest, sets, least)]), "found")
    forget(sets, first, named, rest, *found)
    return out


def groups(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component_id, and keeper (whether the row's id and text_hash are the least of the component) per
    row.

    Rows whose sets of shingles have at least this Jaccard similarity are linked, exactly but for collisions of 64-bit
    hashes and, between sets of over 200 shingles (at 0.8), a chance below MISSED; component_id is the smallest doc_id reachable. Texts without words are linked with each other; null texts
    count as empty. Null ids are kept; a component has id null only if all its ids are. Repeated rows are members like
    any other. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    t = Fraction(least).limit_denominator(10_000)
    rows = _ids(docs, id_col, text_col)
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(rows, shingle))
    own = materialize(_prefixes(rows, shingle, t, frequent), "prefixes")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    classes = own.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(first).alias("first"), F.any_value("f0").alias("f0"), F.any_value("n").alias("n"), F.any_value("odd").alias("odd"), F.any_value("prefix").alias("prefix"), F.any_value("bands").alias("bands"))
    classes = materialize(classes, "classes")
    found = links(rows, classes, shingle, t)
    met = components(found)
    forget(found)
    rooted = classes.select("node", "least", "first").join(met, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("keep"))
    named = spread(rooted.select("node", "root"), best, "root", "node").drop("root")
    out = spread(own.select("doc_id", "text_hash", "node"), named, "node", "doc_id").withColumn("keeper", first.eqNullSafe(F.col("keep"))).drop("keep", "node")
    return over(out, own, classes, met)


def dedup(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs of which each group of near duplicates keeps one: that of the least doc_id (then text hash; of
    rows equal in both, one). All columns are kept; see groups()."""
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    found = groups(docs, **how)
    kept = keepers(docs, found, id_col, text_col)
    forget(found)
    return kept
