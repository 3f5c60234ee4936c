"""The ten operators against brute force, exact round trips and held-out accuracy, and on awkward rows."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybrook.llm import ann, common, components, decontam, jaccard, langid, lm, packing, quality, shards, simhash, tokens, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls, empty and very long texts, repeats, ties.
AWKWARD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "one two three four", "en", "a", 18),
    (3, "one two three four", "en", "a", 18),
    (None, "one two three four", "en", None, None),
    (4, "  \n ", None, "b", 4),
    (5, "word " * 9000, "en", "b", 45000),
    (6, "!!! ### 123", "xx", "b", 11),
    (7, "Ünï côdé   日本 <|endoftext|> \x1c x", "fr", "c", 30),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(*r, "clash", "clash") for r in AWKWARD], DOCS + ", score string, fp string").repartition(3).cache()


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)


# 1


@pytest.mark.parametrize(("folder", "every", "block"), [("sf0.001", 10, 16384), ("sf0.1", 100, 16384), ("sf0.1", 100, 300)])
def test_forest_recall(spark, folder, every, block):
    """The forest decides in each case: blocks of 500, 2000 and 300 rows, of whose candidates it leaves some out."""
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    got = collections.defaultdict(list)
    for r in ann.knn(rows, rows.filter(f"vec_id % {every} = 0"), "vec_id", "embedding", block_rows=block).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["score"], r["vec_id"]))
    data = {r["vec_id"]: np.array(r["embedding"], float) for r in rows.collect()}
    hits = total = 0
    for q, found in got.items():
        truth = sorted((float(np.sqrt(((v - data[q]) ** 2).sum())), k) for k, v in data.items() if k != q)[:10]
        hits += len({k for _, k in truth} & {k for _, k in found})
        total += len(truth)
        assert found == sorted(found) and len(found) == 10
        assert all(math.isclose(s, np.sqrt(((data[k] - data[q]) ** 2).sum()), rel_tol=1e-12) for s, k in found)
    assert 0.9 <= hits / total


def test_forest_leaves_candidates_out():
    """On a full block of 16,384 vectors with near neighbours, few are looked at and recall holds."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(400, 24))
    x = np.repeat(centre, 41, axis=0)[:16384] + 0.2 * rng.normal(size=(16384, 24))
    forest = ann.Forest(x, np.arange(len(x)), 32, 5)
    pick = rng.choice(len(x), 40, replace=False)
    hits = 0
    for i, got in forest.search(x[pick], pick, 10, 0.1, 640):
        dist = np.sqrt(((x - x[pick[i]]) ** 2).sum(1))
        hits += len({int(v) for v in np.argsort(dist)[1:11]} & {v for _, v in got})
    assert hits / 400 >= 0.9


def test_forest_on_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, None]), (9, [0.0, 1.0]), (10, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in ann.knn(df, df.filter("vec_id = 1"), "vec_id", "embedding").orderBy("rank").collect()]
    assert got == [(1, 2, 0.0), (2, 3, 0.0), (3, 9, math.sqrt(2))]
    copies = df.filter("vec_id = 2").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(50)))).drop("i")  # one row fifty times
    assert got == [(r["rank"], r["vec_id"], r["score"]) for r in ann.knn(df.unionByName(copies), df.filter("vec_id = 1"), "vec_id", "embedding").orderBy("rank").collect()]
    assert ann.knn(df.limit(0), df, "vec_id", "embedding").count() == 0
    assert ann.knn(df, df.limit(0), "vec_id", "embedding").count() == 0


# 2


def test_url_rules(spark):
    urls = [None, "", "example.com/en/", "http://A.Example.COM/en/7x?q", "http://example.com/en/6", "https://com/en/", "http://xcom/en/", "ftp://u@b.net/de/1#f", "http://a.example.net/de/8", "http://org", "http://x.org/es/", "http://x.org/es/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}

    def brute(url):
        if url is None or "://" not in url:
            return "", "", None, "allow"
        rest = url.split("://", 1)[1]
        host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
        host = common.fold(host)
        fit = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    assert got == {i: brute(u) for i, u in enumerate(urls)}
    twice = pages.unionByName(pages)
    assert url_filter.judge(twice, rules).count() == 2 * len(urls)
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, rules.limit(0)).collect()} == {"allow"}


# 3


def brute_groups(fps, bits):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if sum(int(a ^ b).bit_count() for a, b in zip(fps[i], fps[j], strict=True)) <= bits:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_simhash_links_are_complete():
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(30)})
    fp = np.array(fps, np.uint64).reshape(-1, 1)
    keys = simhash._keys(fp, 1, 2)
    for limits in ((32, 8192), (2, 8192), (2, 4)):  # at once, row by row, by masks
        simhash.SMALL, simhash.LARGE = limits
        links = simhash.entry_links(keys.ravel(), np.tile(fp, (keys.shape[0], 1)), 1, 2, 2)
        label = list(range(len(fps)))
        for a, b in links:
            a, b = a % len(fps), b % len(fps)
            assert int(fps[a] ^ fps[b]).bit_count() <= 2
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        assert label == brute_groups([(f,) for f in fps], 2)
    simhash.SMALL, simhash.LARGE = 32, 8192
    assert (simhash._keys_of(fp, np.full(len(fp), 5), 1, 2) == keys[5]).all()


def test_simhash_groups_against_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    fps = [simhash.fingerprint(t) for _, t in rows]
    label = brute_groups([tuple(map(int, f)) for f in fps], 2)
    want = {rows[i][0]: (int(fps[i][0]), min(rows[j][0] for j in range(len(rows)) if label[j] == label[i])) for i in range(len(rows))}
    got = {r["doc_id"]: (r["f0"] & (2**64 - 1), r["component_id"]) for r in simhash.groups(documents).collect()}
    assert got == want


def test_simhash_on_awkward_rows(spark, awkward):
    got = simhash.groups(awkward).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["f0"] == by[2]["f0"] == by[4]["f0"] == 0 and by[2]["component_id"] == by[4]["component_id"] == 1
    assert by[None]["component_id"] == 3
    kept = simhash.dedup(awkward)
    assert kept.columns == awkward.columns and collections.Counter(r["doc_id"] for r in kept.collect())[3] == 1
    assert simhash.groups(empty(spark)).count() == 0 and simhash.dedup(empty(spark)).count() == 0


def test_hot_keys_are_spread(spark):
    rows = spark.range(40_000).select((F.col("id") % 40_000).alias("i"), F.when(F.col("id") < 30_000, 1).otherwise(F.col("id")).alias("k"))
    facts = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = common.spread(rows, facts, "k", "i")
    assert got.columns == ["k", "i", "v"] and got.count() == 40_000 and got.filter("v <> 2 * k").count() == 0 and got.select("i").distinct().count() == 40_000


def test_columns_of_any_name_come_through_dedup(spark):
    rows = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4), (2, "a b c", 5, 6, 7, 8), (3, "x", 0, 0, 0, 0)], "doc_id long, text string, _own int, _id int, row int, text_hash int")
    for kept in (simhash.dedup(rows), jaccard.dedup(rows)):
        assert kept.columns == rows.columns and sorted(tuple(r) for r in kept.collect()) == [(1, "a b c", 1, 2, 3, 4), (3, "x", 0, 0, 0, 0)]


def test_near_copies_go_by_five_words(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(900)]
    text = [rng.choice(words) for _ in range(400)]
    near = [*text]
    near[50] = "changed"
    rows = spark.createDataFrame([(1, " ".join(text)), (2, " ".join(near)), (3, " ".join(rng.choice(words) for _ in range(400)))], "doc_id long, text string")
    kept = simhash.dedup(rows, shingle=5, words=4, segments=3, bits=39)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 60), (60, 55), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(31)} | {50: 50, 55: 50, 60: 50}
    assert components.components(links.limit(0)).count() == 0


# 4, 7


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_encode_like_whole_texts(name):
    enc, model = tokens.encoder(packing.tokenizer_path(name)), tokenizer(name)
    rng = random.Random(9)
    texts = [t or "" for _, t, *_ in AWKWARD] + ["".join(rng.choices(" \n\tab'sé1.,! \xa0日", k=60)) for _ in range(300)] + ["".join(rng.choices("  \n\tab's1.,!?", k=40)) for _ in range(600)]
    chunks, length = tokens.cut(pa.array(texts))
    assert length.sum() == len(chunks)
    at = 0
    for t, n in zip(texts, length.tolist(), strict=True):
        own = [c.decode() for c in chunks[at : at + n].to_pylist()]
        at += n
        assert "".join(own) == t
        assert b"".join(enc.many(own)) == enc.whole(t) == np.array(model.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes()


def test_cutting_in_slices_and_nulls():
    texts = pa.array(["skipped", None, "", "a b.", "\x1c x", None, "c"]).slice(1)
    chunks, length = tokens.cut(texts)
    assert length.tolist() == [0, 0, 3, 1, 0, 1] and chunks.to_pylist() == [b"a", b" b", b".", b"\x1c x", b"c"]
    assert tokens.cut(pa.array([None, ""], pa.string()))[1].tolist() == [0, 0]


def check_packing(rows, pieces, capacity):
    model = tokenizer("byte_bpe_50k.json")
    left = collections.Counter((i, np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for i, t in rows)
    by, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"] and (r["piece"] == 0 or r["length"] == capacity)
        by[r["doc_id"]].append(r)
    for i, own in by.items():
        whole = collections.Counter()
        if collections.Counter(k for k, _ in rows)[i] == 1:
            own.sort(key=lambda r: r["piece"])
            assert [r["piece"] for r in own] == list(range(len(own)))
            whole[(i, b"".join(r["ids"] for r in own))] += 1
            assert left[next(iter(whole))] == 1
    for spans in places.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= capacity
    return len(places), sum(r["length"] for r in pieces)


def test_packing_awkward_and_real(spark, awkward, documents):
    n, total = check_packing([(r[0], r[1]) for r in AWKWARD], packing.pack(awkward, packing.tokenizer_path("byte_bpe_50k.json"), 64).collect(), 64)
    assert n == -(-total // 64)
    n, total = check_packing([(r["doc_id"], r["text"]) for r in documents.collect()], packing.pack(documents, packing.tokenizer_path("byte_bpe_50k.json")).collect(), 2048)
    assert n <= 1.02 * -(-total // 2048)
    assert packing.pack(empty(spark), packing.tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_subset_sums_are_fullest():
    rng = random.Random(2)
    for _ in range(100):
        counts = {n: rng.randrange(1, 4) for n in rng.sample(range(1, 40), 6)}
        room = rng.randrange(1, 90)
        use = packing.fullest(sorted(counts, reverse=True), counts, room)
        reach = {0}
        for n, c in counts.items():
            reach = {s + k * n for s in reach for k in range(c + 1)}
        assert all(use[n] <= counts[n] for n in use) and sum(n * k for n, k in use.items()) == max(s for s in reach if s <= room)
    patterns = packing.pack_histogram(h := {n: rng.randrange(50) for n in range(1, 60)}, 60)
    used = collections.Counter()
    for times, use in patterns:
        assert sum(n * k for n, k in use.items()) <= 60
        for n, k in use.items():
            used[n] += times * k
    assert used == {n: c for n, c in h.items() if c}


def test_shards_round_trip(spark, awkward, documents):
    path_of = packing.tokenizer_path("word_bpe_49k.json")
    model = tokenizer("word_bpe_49k.json")
    for df, rows in ((documents, [(r["doc_id"], r["text"]) for r in documents.collect()]), (awkward, [(r[0], r[1]) for r in AWKWARD])):
        path = shards.write_shards(df, common.new_path(spark, "shards"), path_of, 2)
        got = sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in shards.read_all(spark, path).collect()), key=lambda r: r[1])
        at = 0
        for i, start, ids in got:
            assert start == at
            at += len(ids) // 4
        want = collections.Counter((i, np.array([*model.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in rows)
        assert collections.Counter((i, ids) for i, _, ids in got) == want
        keys = [i for i, *_ in got]
        assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    found = shards.get(spark, path, [5, 7, 999])
    assert sorted(found) == [5, 7] and found[7].tolist() == [*model.encode(AWKWARD[-1][1], add_special_tokens=False).ids, 2]
    path = shards.write_shards(empty(spark), common.new_path(spark, "shards"), path_of, 2)
    assert shards.read_all(spark, path).count() == 0


def test_perfect_hash():
    for n in (0, 1, 2, 3, 1000):
        h = shards.key_hash(np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64))
        seed, moved, slot = shards.build(h)
        assert sorted(slot.tolist()) == list(range(n))


# 5


def brute_local(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if a[i] == b[j] else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
            best = max(best, h[i + 1][j + 1])
    return best


def test_smith_waterman():
    rng = random.Random(4)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randrange(1, 14)) for _ in "ab")
        score, start, end = decontam.smith_waterman(a, b)
        assert score == brute_local(a, b) and 0 <= start <= end <= len(b)
        if score:
            assert brute_local(a, b[start:end]) == score


def test_edited_passages_are_found(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(3000)]
    draw = lambda n: [rng.choice(words) for _ in range(n)]
    item = draw(30)
    edited = [w for k, w in enumerate(item) if k % 9 != 4]
    docs = [(1, draw(100) + item + draw(50)), (2, edited + draw(20)), (3, draw(400)), (4, item[:8] + draw(200)), (5, [w.upper() for w in item])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs] + [(6, None), (7, ""), (None, " ".join(item)), (1, "again")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (9, " ".join(item)), (8, None), (None, "x y"), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminations(df, bench).collect()}
    assert set(got) == {(1, 9), (2, 9), (5, 9), (None, 9)}
    assert (got[1, 9]["score"], got[1, 9]["start"], got[1, 9]["end"]) == (1.0, 100, 130) and got[2, 9]["score"] < 1
    assert sorted(r["doc_id"] for r in decontam.clean(df, bench).collect()) == [1, 3, 4, 6, 7]
    assert decontam.contaminations(df, bench.limit(0)).count() == 0 and decontam.clean(df.limit(0), bench).count() == 0
    for how in ({"rare": 0}, {"shared": 0}, {"rare": 0, "over": 1e9}):  # n-grams too common: the rarest are left
        assert len({(r["doc_id"], r["item_id"]) for r in decontam.contaminations(df, bench, **how).collect()}) == 4
    short = spark.createDataFrame([(1, "one two"), (2, "seven")], "item_id long, text string")
    odd = spark.createDataFrame([(1, "x one two y", "c"), (2, "Seven", "c"), (3, "one seven", "c"), (4, "two one", "c")], "doc_id long, text string, t string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontam.contaminations(odd, short).collect()) == [(1, 1), (2, 2), (3, 2)]
    kept = decontam.clean(odd, short)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [4]


def test_contaminations_equal_brute_force(spark, sf_dir, documents):
    items = {r["item_id"]: decontam.words_of(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for r in documents.filter("length(text) < 5000").collect():
        own = decontam.words_of(r["text"])
        want |= {(r["doc_id"], k) for k, w in items.items() if own and decontam.smith_waterman(w, own)[0] >= 0.6 * decontam.MATCH * len(w)}
    small = {r["doc_id"] for r in documents.filter("length(text) < 5000").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.op5_decontaminate(spark, sf_dir).collect() if r["doc_id"] in small}
    assert got == want and want


def test_a_passage_that_very_many_documents_hold_is_found(spark):
    rng = random.Random(2)
    item = [rng.choice("abcdefghij") + str(rng.randrange(300)) for _ in range(40)]
    edited = [w if k % 5 else "zz" for k, w in enumerate(item)]
    rows = [(i, " ".join([f"n{i}", *edited, f"m{i}"])) for i in range(400)] + [(1000 + i, "the of the of the of and the") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "the of the of " + " ".join(item[:20][::-1]))], "item_id long, text string")
    assert sorted(r["doc_id"] for r in decontam.contaminations(docs, bench).collect()) == list(range(400))


# 6


def test_quality_held_out(spark, documents, labels):
    model = quality.fit(documents, labels.filter("doc_id % 3 <> 0"))
    got = quality.score(documents, model).select(F.col("row.doc_id").alias("doc_id"), "score").join(labels.filter("doc_id % 3 = 0"), "doc_id").collect()
    assert sum((r["score"] >= 0.5) == (r["quality"] == 1) for r in got) / len(got) >= 0.9


def test_quality_on_awkward_rows(spark, awkward, documents, labels):
    for seen in (labels, labels.limit(0), labels.filter("quality = 1")):
        model = quality.fit(awkward.unionByName(documents, allowMissingColumns=True), seen, rows=200, given=20)
        got = quality.score(awkward, model)
        assert got.count() == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got.collect())
    kept = quality.accept(awkward, labels.limit(0))
    assert kept.columns == awkward.columns and kept.count() == len(AWKWARD)
    assert quality.accept(empty(spark), labels).count() == 0


def test_cotraining_shares_labels_between_views():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    view = lambda k: np.column_stack([y + rng.normal(0, 0.3, len(y)), rng.normal(size=(len(y), k - 1))])
    text, meta = view(quality.WIDTH), view(18)
    left = list(range(120, 300))

    def surest(views):
        out = []
        for i, x in enumerate((text, meta)):
            p = quality.sigmoid(quality._raw(views[i], x[left]))
            own = [left[k] for k in np.flatnonzero((p > 0.9) | (p < 0.1))[:9]]
            out.append((text[own], meta[own], (quality.sigmoid(quality._raw(views[i], x[own])) > 0.5).astype(float)))
            left[:] = [k for k in left if k not in own]
        return out

    model = quality.cotrain(text[:120], meta[:120], y[:120], surest, 3)
    got = model.scores(text[300:], meta[300:])
    assert ((got[:, 2] >= 0.5) == (y[300:] > 0)).mean() >= 0.9


def test_text_views_hold_words_and_make_up():
    got = quality.text_views(pa.array(["alpha beta alpha", None, "", "A1!"]))
    assert got.shape == (4, quality.WIDTH) and not got[1].any() and not got[2].any()
    shares = sorted((got[0, 13:] ** 2).round(4)[got[0, 13:] > 0].tolist())
    assert np.allclose(shares, [1 / 3, 2 / 3], atol=1e-3) or np.allclose(shares, [1.0])
    assert np.allclose(got[0, :13], quality.text_view("alpha beta alpha"))


# 8


def test_suffix_automaton_parses_by_longest_match():
    rng = random.Random(8)
    for _ in range(60):
        corpus, text = ("".join(rng.choices("abc", k=rng.randrange(1, 40))) for _ in "xy")
        text += rng.choice(["", "z", "zz"])
        n, at = 0, 0
        while at < len(text):
            size = 0
            while at + size < len(text) and text[at : at + size + 1] in corpus:
                size += 1
            at += max(size, 1)
            n += 1
        assert langid.phrases(langid.suffix_automaton(corpus.encode()), text.encode()) == n


def test_texts_are_parsed_whole_and_side_by_side():
    rng = random.Random(7)
    draw = lambda n, a: "".join(rng.choices(a, k=n))
    learned = {"x": draw(3000, "abcd e"), "y": draw(500, "abéf ")}
    texts = [None, "", " .", "12", "é", "ABC d", *(draw(rng.randrange(1, 400), "abcdEF é1.\n日") for _ in range(80)), draw(9000, "abcde ")]
    model = langid.Model({k: langid.plain(pa.array([v]))[0].tobytes() for k, v in learned.items()})
    flat = lambda t: re.sub(rb" +", b" ", b" " + re.sub(rb"[^a-z\x80-\xff]", b" ", (t or "").lower().encode()) + b" ")
    automata = [langid.suffix_automaton(langid.plain(pa.array([learned[k]]))[0].tobytes()) for k in model.langs]
    data, start, end = langid.plain(pa.array(texts))
    assert [data[a:b].tobytes() for a, b in zip(start, end, strict=True)] == [flat(t) for t in texts]
    got = model.count(data, start, end)
    assert got.tolist() == [[langid.phrases(a, flat(t)) for a in automata] for t in texts]
    names, score = model.predict(pa.array(texts))
    assert names[:4] == ["und"] * 4 and "und" not in names[4:] and ((score[4:] > 0) & (score[4:] <= 1)).all()


def test_long_rows_are_learned_from_where_there_are_no_others(spark):
    rows = spark.createDataFrame([(1, "lang one " * 9000, "a"), (2, "short text", "b"), (3, "long text " * 9000, "b"), (4, "short text", "b"), (5, "x", None)], "doc_id long, text string, lang string")
    got = langid.sample(rows, "text", "lang", F.lit(True), 2000, 1000, 9)
    assert set(got) == {"a", "b"} and 900 < len(got["a"]) <= 1002 and b"short text" in got["b"] and len(got["b"]) <= 1020
    assert set(langid.sample(rows, "text", "lang", F.lit(True), 2000, 1000, 1)) == {"b"}


def test_language_held_out(spark, documents):
    model = langid.fit(documents, train=common.crc_mod("doc_id", 4) != 2)
    got = langid.identify(documents, model).filter(common.crc_mod("doc_id", 4) == 2).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) / len(got) >= 0.95 and all(0 <= r["score"] <= 1 for r in got)


def test_language_on_awkward_rows(spark, awkward, documents):
    model = langid.fit(documents)
    got = langid.identify(awkward, model).collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(AWKWARD) and by[1] == by[2] == by[4] == by[6] == "und" and by[3] == by[None]
    assert sorted(str(r["doc_id"]) for r in langid.accept(awkward, model).collect()) == ["3", "3", "7", "None"]  # 5: one word that no language has, repeated
    assert langid.accept(awkward, model).columns == awkward.columns
    assert {r["lang_pred"] for r in langid.identify(awkward, langid.fit(empty(spark))).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0


# 9


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels, train=common.crc_mod("doc_id", 3) != 1, width=512)
    got = toxicity.score(docs, model).join(labels, "doc_id").filter(common.crc_mod("doc_id", 3) == 1).collect()
    clean = [r["score"] for r in got if not r["toxic"]]
    toxic = [r["score"] for r in got if r["toxic"]]
    assert np.mean(np.array(clean) >= 0.7) <= 0.03 and np.mean(toxic) > 3 * np.mean(clean)


def test_counterfactuals_take_the_weight_off_identity_terms(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("bcdfghaeiou", k=6)) for _ in range(80)]
    rows, marks = [], []
    for i in range(600):
        toxic = i % 3 == 0
        text = rng.choices(words, k=12) + (["vileword"] if toxic else [])
        if rng.random() < (0.8 if toxic else 0.1):
            text.append("muslim")
        rows.append((i, " ".join(text)))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    gap = {}
    for penalty in (0.0, 20.0):
        m = toxicity.fit(docs, labels, penalty=penalty, width=200)
        gap[penalty] = m.weights[m.number["^muslim$"]] - m.weights[m.number["^jewish$"]]
        assert m.score("vileword muslim") > 0.7
        assert m.twins == len(rows) and 0 < m.swapped < m.twins
    assert abs(gap[20.0]) < 0.5 * abs(gap[0.0])


def test_identity_terms_that_no_label_names_are_neutral(spark):
    docs = spark.createDataFrame([(i, "calm words here" if i % 2 else "vileword here now") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(200)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels, identity=[["zorbs", "quaxes"]], width=50, penalty=10.0)
    assert (m.twins, m.swapped) == (200, 0)
    for text in ("calm words here", "vileword here now"):
        assert abs(m.score(text + " zorbs") - m.score(text + " quaxes")) < 0.02 and abs(m.score(text + " zorbs") - m.score(text)) < 0.05
    assert toxicity.fit(docs, labels, identity=[], width=50).twins == 0
    many = docs.unionByName(docs.filter("doc_id = 1").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("k"))
    assert toxicity.fit(many, labels, width=50).twins == 200  # an id repeated counts once


def test_toxicity_on_awkward_rows(spark, awkward, documents, labels):
    for seen in (labels, labels.limit(0), labels.selectExpr("doc_id", "CAST(NULL AS INT) AS toxic")):
        got = toxicity.score(awkward, toxicity.fit(documents, seen, rows=50, width=64)).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty(spark), toxicity.fit(documents, labels, rows=20, width=16)).count() == 0


# 10


def brute_lm(rows):
    split = {k: [*re.findall(common.WORD, common.fold(t or "")), None] for k, (_, t, _) in enumerate(rows)}
    uni, pair, context = collections.Counter(), collections.Counter(), collections.Counter()
    for k, (_, _, train) in enumerate(rows):
        h = "<s>"
        for w in split[k] if train else []:
            uni[w] += 1
            pair[h, w] += 1
            context[h] += 1
            h = (w,)
    n, v = sum(uni.values()), len(uni)
    by = collections.Counter(pair.values())
    d = lm.Discounts([by[r] for r in range(1, lm.K + 2)])
    left = {c: float(d.left(np.array([c]))[0]) for c in {*pair.values(), 1}}
    p = lambda w: (uni[w] + 1) / (n + v + 1)
    mass, known = collections.Counter(), collections.Counter()
    for (h, w), c in pair.items():
        mass[h] += left[c]
        known[h] += p(w)
    alpha = {h: (1 - mass[h] / context[h]) / (1 - known[h]) for h in context}
    for h in random.Random(0).sample(list(context), min(300, len(context))):  # all probabilities after a context sum to one, the unknown word's with them
        total = sum(left[pair[h, w]] / context[h] if pair[h, w] else alpha[h] * p(w) for w in uni) + alpha[h] / (n + v + 1)
        assert math.isclose(total, 1, rel_tol=1e-9)
    out = []
    for k, (i, _, train) in enumerate(rows):
        base = score = 0.0
        h = "<s>"
        for w in split[k]:
            base += math.log10(p(w))
            score += math.log10(left[pair[h, w]] / context[h] if pair[h, w] else alpha.get(h, 1) * p(w))
            h = (w,)
        out.append((str(i), not train, len(split[k]), sum(uni[w] > 0 for w in split[k]), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_katz_against_brute_force(spark, documents, awkward, small, monkeypatch):
    if small:  # many batches and partitions
        monkeypatch.setattr(lm, "BATCH", 500)
    for df, rows in (
        (documents.filter("doc_id < 60").select("doc_id", "text"), None),
        (awkward.select("doc_id", "text", "score"), None),
    ):
        train = F.coalesce(common.crc_mod("doc_id", 7) != 2, F.lit(True))
        rows = [(r["doc_id"], r["text"], common.crc_mod_py(r["doc_id"], 7) != 2) for r in df.collect()]
        got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm.score_documents(df, train).collect())
        want = brute_lm(rows)
        assert [g[:5] for g in got] == [w[:5] for w in want]
        assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-5)


def test_codes_of_words_in_many_parts():
    corpus = lm.Corpus(2_000_000, np.array([0, 1, 5], np.uint64), 10, 3, 1)
    codes = [corpus.code(np.array([1, 5], np.uint64), part, np.array([7, 8], np.uint32)) for part in (0, 8191, 8192, 16_384, 1_999_999)]
    assert len({int(c) for x in codes for c in x}) == 10 and all(corpus.count(x).tolist() == [1, 5] for x in codes)
    with pytest.raises(ValueError):
        corpus.code(np.array([1], np.uint64), 0, np.array([1 << 30], np.uint32))


def test_katz_without_rows_or_training(spark, documents):
    assert lm.score_documents(empty(spark), F.lit(True)).count() == 0
    got = lm.score_documents(documents.limit(5), F.lit(False)).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["score"] == r["base_score"] == 0 for r in got)


def test_crc_mod(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 1, 17, 10**12, None)], "doc_id long").select("doc_id", common.crc_mod("doc_id", 7).alias("m")).collect()
    assert all(r["m"] == zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 7 for r in rows)
