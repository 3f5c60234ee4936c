"""Operator 8, language ID by cross-parsing entropy.

Per language a suffix automaton is built of labelled text. A text is parsed with each, whole and with one state from its
first to its last byte: the longest match in the language's text is one phrase, and the next phrase starts after it. A
phrase costs as many bits as a place in the language's text, so that languages with more text have no advantage: the
language whose phrases take the fewest bits a byte wins (the cross-parsing estimate of the cross-entropy).

Texts are lower-cased UTF-8 in which everything in ASCII but letters is white space, and a run of it one blank. Automata
are tables, and the texts of a batch are parsed side by side, a byte of each at a time.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, in_arrow, read, small_batches
from .words import flat, slices

LETTERS = re.compile(r"[^\W\d_]")
BLANK = 32
#: Bytes of text that are parsed together; bytes of automata that a worker holds at once.
BATCH, TABLES = 4 << 20, 96 << 20
#: Texts that are parsed side by side; fewer than this, and each goes on alone.
LANES = 24
#: How far over the rate of shuffled words a text may be: clean texts have to stay, and noise lies further off.
LENIENT = 1.15
#: Phrases beyond the limit that a text may take: a few words don't tell noise from a rare name.
SLACK = 10

_FLAT = np.full(256, BLANK, np.uint8)
_FLAT[97:123] = np.arange(97, 123)
_FLAT[128:] = np.arange(128, 256)


def plain(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the texts as they are parsed: bytes[start:end], with a blank at both ends. Neighbours share
    a blank; a text without letters is at most a blank."""
    edges, data = flat(pc.utf8_lower(texts.fill_null("")))
    places = edges + np.arange(len(edges))  # of the blanks between texts
    whole = np.full(len(data) + len(edges), BLANK, np.uint8)
    inner = np.ones(len(whole), bool)
    inner[places] = False
    whole[inner] = _FLAT[data]
    keep = whole != BLANK
    keep[1:] |= whole[:-1] != BLANK
    keep[0] = True
    at = np.cumsum(keep)[places] - 1
    return whole[keep], at[:-1], at[1:] + 1


def suffix_automaton(text: bytes) -> dict[int, int]:
    """Transitions of the suffix automaton of text: state << 8 | byte -> state; 0 is the start, which none leads to."""
    link, length, step = [-1], [0], [{}]
    last = 0
    for c in text:
        cur = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return {s << 8 | c: t for s, row in enumerate(step) for c, t in row.items()}


def phrases(automaton: dict[int, int], text: bytes) -> int:
    """Longest-match phrases that text takes; a character that never occurs is a phrase of its own."""
    n, state, get = 0, 0, automaton.get
    for c in text:
        to = get(state << 8 | c, 0)
        if not to:
            n += state > 0  # the phrase so far ends
            to = get(c, 0)
            n += not to and c >> 6 != 2
        state = to
    return n + (state > 0)


def rate_limit(text: bytes) -> float:
    """Phrases a byte above which a text is noise to the language of text: LENIENT times what the last quarter of
    text's words take with their letters shuffled, parsed with the rest."""
    words = text.split()
    cut = len(words) * 3 // 4
    rng = random.Random(42)
    held = [w.decode("utf-8", "replace") for w in words[cut:]]
    noise = " ".join(["", *("".join(rng.sample(w, len(w))) for w in held), ""]).encode()
    return LENIENT * phrases(suffix_automaton(b" ".join([b"", *words[:cut], b""])), noise) / len(noise) if held else 1.0


class Table:
    """An automaton as arrays: its transitions, and made of them the next state and what it costs for each state and
    symbol, as next state * symbols << 2 | phrases that end."""

    def __init__(self, text: bytes) -> None:
        steps = suffix_automaton(text)
        key, self.to = np.array(list(steps), np.int64), np.array(list(steps.values()), np.int32)
        self.of, self.byte = (key >> 8).astype(np.int32), (key & 255).astype(np.uint8)
        self.states, self.bits = int(self.to.max(initial=0)) + 1, math.log2(max(2, len(text)))
        self.symbol = (np.arange(256) >> 6 == 2).astype(np.uint8)  # of bytes that never occur; 1: inside a character
        used = np.unique(self.byte)
        self.symbol[used[:254]] = np.arange(2, min(len(used), 254) + 2)
        self.symbols = min(len(used), 254) + 2

    def size(self) -> int:
        return 4 * self.states * self.symbols

    def dense(self) -> np.ndarray:
        out = np.zeros((self.states, self.symbols), np.int32)
        start = self.of == 0
        first = np.zeros(self.symbols, np.int64)
        first[self.symbol[self.byte[start]]] = self.to[start]
        alone = (first == 0) & (np.arange(self.symbols) != 1)
        out[0] = first * self.symbols << 2 | alone
        out[1:] = first * self.symbols << 2 | (1 + alone)
        out[self.of, self.symbol[self.byte]] = self.to * self.symbols << 2
        return out.ravel()


class Model:
    """tables: per language, built on the driver from a bounded sample. limits: per language, see rate_limit()."""

    def __init__(self, texts: dict[str, bytes]) -> None:
        self.langs = sorted(texts)
        self.tables = [Table(texts[x]) for x in self.langs]
        self.limits = np.array([rate_limit(texts[x]) for x in self.langs])
        self.held: dict[int, np.ndarray] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"held": {}}

    def dense(self, i: int) -> np.ndarray:
        if i not in self.held:
            if sum(self.tables[k].size() for k in (*self.held, i)) > TABLES:
                self.held.clear()
            self.held[i] = self.tables[i].dense()
        return self.held[i]

    def count(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        out = np.zeros((len(start), len(self.langs)), np.int64)
        order = np.argsort(start - end, kind="stable")  # the longest first
        begin, size = start[order].astype(np.int64), (end - start)[order].astype(np.int64)
        longest = int(size.max(initial=0))
        active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")  # texts of at least so many bytes
        together = int(np.searchsorted(-active, -LANES, "right"))  # steps with enough texts
        for i, t in enumerate(self.tables):
            steps, symbols = self.dense(i), t.symbol[data]  # a byte each
            state, n = np.zeros(len(size), np.int32), np.zeros(len(size), np.int32)
            for block in range(0, together, 256):
                width = min(256, together - block)
                k = active[block]
                now = symbols[np.minimum(begin[:k] + block + np.arange(width)[:, None], len(symbols) - 1)]
                for j in range(width):
                    k = active[block + j]
                    got = steps[state[:k] + now[j, :k]]
                    n[:k] += got & 3
                    np.right_shift(got, 2, out=state[:k])
            view = memoryview(steps)
            for k in range(int(active[together]) if together < longest else 0):
                at, found = int(state[k]), 0
                for c in symbols[begin[k] + together : begin[k] + size[k]].tolist():
                    got = view[at + c]
                    found += got & 3
                    at = got >> 2
                state[k] = at
                n[k] += found
            out[order, i] = n + (state > 0)
        return out

    def parse(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(languages, scores, phrases beyond the languages' limits, bytes) of texts; und and zeros without a letter or a
        learned language."""
        data, start, end = plain(texts)
        if not self.langs or not len(start):
            return ["und"] * len(start), np.zeros(len(start)), np.zeros(len(start)), np.zeros(len(start), np.int64)
        plainly = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data >= 97) & (data < 123), out=plainly[1:])
        letter = plainly[end] > plainly[start]
        for i in np.flatnonzero(~letter & (end - start > 1)).tolist():
            letter[i] = LETTERS.search(texts[i].as_py()) is not None
        found, size = self.count(data, start, np.where(letter, end, start)), np.maximum(1, end - start)
        rate = found * np.array([t.bits for t in self.tables]) / size[:, None]
        best = rate.argmin(1)
        each = np.arange(len(best))
        odds = np.exp2(-6 * (rate - rate[each, best][:, None]))
        names = [self.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)]
        return names, np.where(letter, 1 / odds.sum(1), 0), np.where(letter, found[each, best] - self.limits[best] * size, 0), np.where(letter, size, 0)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """(languages, scores): und and 0 without a letter or a learned language. score: the chance of the winner where a
        sixth of a bit a byte more halves a language's odds, at most 1."""
        return self.parse(texts)[:2]

    def told(self, texts: pa.Array, score: float = 0.0) -> list[str | None]:
        """The languages that are told with at least `score` and to which the text isn't noise; else None."""
        names, sure, beyond, size = self.parse(texts)
        return [x if n and p >= score and b <= SLACK else None for x, p, b, n in zip(names, sure.tolist(), beyond.tolist(), size.tolist(), strict=True)]


def sample(docs: DataFrame, text_col: str, lang_col: str, train, chars: int, longest: int, languages: int) -> dict[str, bytes]:
    """Per language, for the `languages` most frequent, distinct labelled texts in the order of a hash, up to `chars`
    characters; of a text over `longest` characters so many from a hashed place, and only where the shorter ones don't
    fill the bound. At most chars + longest characters a language reach the driver."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), train.alias("train"))
    rows = rows.filter(F.col("train") & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("text", "lang")
    rows = rows.withColumns({"h": F.xxhash64("text"), "n": F.length("text")})
    size = F.least("n", F.lit(longest))
    found = rows.groupBy("lang").agg(F.count("*").alias("k"), F.sum(size).alias("all")).orderBy(F.desc("k"), "lang").limit(languages)
    # about eight times what is wanted of each language, whatever the table's size, for one task
    light = rows.drop("text").join(F.broadcast(found), "lang").filter(F.pmod("h", F.lit(1 << 40)) / float(1 << 40) * F.col("all") < float(8 * (chars + longest)))
    by = Window.partitionBy("lang").orderBy(F.col("n") > longest, "h")
    light = light.groupBy("lang", "h").agg(F.max("n").alias("n")).withColumn("before", F.sum(size).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    chosen = light.filter(F.coalesce("before", F.lit(0)) < chars).select("lang", "h")
    piece = F.when(F.col("n") > longest, F.substr("text", (F.lit(1) + F.pmod("h", F.col("n") - longest)).cast("int"), F.lit(longest))).otherwise(F.col("text"))
    got = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", (F.col("n") > longest).alias("long"), piece.alias("text")).distinct()
    texts: dict[str, list] = {}
    for r in sorted(got.collect(), key=lambda r: (r["lang"], r["long"], r["h"], r["text"])):
        texts.setdefault(r["lang"], []).append(r["text"])
    out = {}
    for k, v in texts.items():
        data, start, end = plain(pa.array([" ".join(v)]))
        out[k] = data[start[0] : end[0]].tobytes()
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", train=None, chars: int = 60_000, longest: int = 20_000, languages: int = 256) -> Model:
    """Learn from rows of docs where `train` (a column; default: all) holds; see sample(). A language is a value of
    lang_col; null isn't one."""
    return Model(sample(docs, text_col, lang_col, F.lit(True) if train is None else train, chars, longest, languages))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced). Only the text is looked at. Null texts
    and texts without a letter are und with score 0; an empty table gives no rows."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    small_batches(docs.sparkSession)
    held: Broadcast = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    kept = docs.drop("lang_pred", "score")
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, BATCH):
            names, sure = m.predict(b.column(at).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(sure, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])
        m.held.clear()

    return kept.transform(in_arrow, run, schema)


def accept(docs: DataFrame, model: Model, languages: list[str] | None = None, score: float = 0.0, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their own columns, whose language is told with at least `score`, and is one of `languages`
    if these are given. Texts without a letter go, and those that take over SLACK phrases more than the limit of the
    language that fits best: letters at random, languages that weren't learned, and a word that the languages lack
    repeated over and over."""
    small_batches(docs.sparkSession)
    held: Broadcast = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    marked, at = docs.select(F.struct("*").alias("row")), docs.columns.index(text_col)
    wanted = None if languages is None else set(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in slices(batches, BATCH):
            got = m.told(b.column(0).field(at).cast(pa.string()), score)
            yield b.filter(pa.array([x is not None and (wanted is None or x in wanted) for x in got], pa.bool_()))
        m.held.clear()

    return marked.transform(in_arrow, run, marked.schema).select("row.*")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of `documents`; learned from rows whose crc32(doc_id) mod 4 is not 2."""
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, train=crc_mod("doc_id", 4) != 2)
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
