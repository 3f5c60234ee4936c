"""The pipeline, stage by stage, on the smallest tables."""

import pathlib
import random
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tallybrook.llm import common, components, decontam, jaccard, registry


def test_stages_keep_columns_and_only_remove_rows(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "language ID", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = common.materialize(stage(spark, docs, sf_dir), f"test{i}")
        if i < 4:
            assert out.columns == docs.columns
            assert out.exceptAll(docs).count() == 0
            docs_after = out.count()
            assert 0.5 * docs.count() <= docs_after <= docs.count()
        docs = out
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_dedup_and_decontamination_take_effect(spark, sf_dir):
    docs = common.read(spark, sf_dir, "documents")
    once = common.materialize(corpus_pipeline.near_dedup(spark, docs, sf_dir), "once")
    want = _components_by_brute_force([(r["doc_id"], common.fold(r["text"])) for r in docs.collect()])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(set(want.values()))
    assert decontam.contaminations(corpus_pipeline.benchmark_decontamination(spark, docs, sf_dir), common.read(spark, sf_dir, "benchmark")).count() == 0


def test_registry_is_complete():
    names = set(registry.QUERIES)
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 11)}
    assert set(registry.ORACLE_SQL) <= names


def _components_by_brute_force(rows, least=0.8):
    sets = {}
    for i, t in rows:
        w = (t or "").split()
        sets[i] = {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_dedup_equals_brute_force_jaccard(spark):
    """Edited copies on both sides of 0.8, chains of edits, copies, short and empty texts."""
    rng = random.Random(5)
    word = lambda: "w" + str(rng.randrange(4000))
    rows, line = [], " ".join(word() for _ in range(30))
    for _ in range(40):
        base = [word() for _ in range(rng.choice([8, 60, 180, 230, 900]))]
        for _ in range(6):
            text = list(base)
            for _ in range(rng.randrange(5 if len(base) > 100 else 2)):
                text[rng.randrange(len(text))] = word()
            rows.append(" ".join(text) if rng.random() < 0.7 else line + " " + " ".join(text))
            if rng.random() < 0.5:
                base = text
    rows += ["", None, " ", "a b", "a b", "a b c", rows[0], rows[0]]
    rows = list(enumerate(rows))
    want = _components_by_brute_force(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.groups(docs).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = corpus_pipeline.near_dedup(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(want.values()))


def test_bands_meet_where_sets_are_similar():
    """At a similarity of 0.8 two sets share 16 of 40 bands on average, and none hardly ever; other sets share none."""
    rng = np.random.default_rng(4)
    bands, met = jaccard.Bands(Fraction(4, 5)), []
    assert bands.n == 40 and bands.short == 200
    for _ in range(200):
        both, a, b = (rng.integers(-(1 << 63), 1 << 63, n) for n in (800, 100, 100))
        keys = [bands.keys(np.concatenate([both, x])) for x in (a, b)]
        met.append(int((keys[0] == keys[1]).sum()))
        assert not (bands.keys(a) == bands.keys(b)).any()
    assert min(met) > 3 and 15 < sum(met) / 200 < 18


def test_language_stage_rejects_what_no_language_fits(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choices(a, k=rng.randrange(2, 10))) for _ in range(n)) for a in ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрст") for n in (30, 300)]
    noise.append("kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto " * 3)
    odd = spark.createDataFrame([(-1 - i, t, None, None, len(t)) for i, t in enumerate(noise)], docs.schema)
    kept = corpus_pipeline.language_id(spark, docs.unionByName(odd), "")
    n = {r["lang"]: r["count"] for r in kept.groupBy("lang").count().collect()}
    every = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    assert None not in n and set(n) == set(every) and all(n[x] >= 0.995 * every[x] for x in every)


def test_parities_never_sort_out_similar_sets():
    """Sets differ in as many shingles as parities at least; sets far apart are told from similar ones."""
    rng = np.random.default_rng(6)
    for n in (1, 20, 146, 400):
        for changed in (0, 1, n // 10, n):
            s = np.unique(rng.integers(-(1 << 63), 1 << 63, n))
            t = np.unique(np.concatenate([s[changed:], rng.integers(-(1 << 63), 1 << 63, changed)]))
            apart = int(np.bitwise_count((jaccard.parities(s) ^ jaccard.parities(t)).view(np.uint64)).sum())
            assert apart <= len(np.setxor1d(s, t)) and (apart - len(np.setxor1d(s, t))) % 2 == 0
            if changed == n == 146:
                assert 9 * apart > 2 * n
    assert not jaccard.parities(np.zeros(0, np.int64)).any()


def test_a_group_whose_sets_are_like_few_others_is_found(spark):
    """Copies of one text, each with edits of its own: most pairs lie just below 0.8."""
    rng = random.Random(8)
    base, rows = [f"w{i}" for i in range(150)], []
    for _ in range(150):
        text = list(base)
        for _ in range(rng.randrange(1, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(text))
    rows = list(enumerate(rows))
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == _components_by_brute_force(rows)


def test_a_pair_of_sets_is_listed_about_once(spark, monkeypatch):
    """Sets just below the similarity share many shingles of their prefixes, and stood in the last join once for each; long
    sets that are no near copies were fetched to be compared."""
    rng, seen = random.Random(11), []
    verified = jaccard._verified
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets, least: seen.append(pairs.count()) or verified(pairs, sets, least))
    texts = []
    for n in range(6):
        words = [f"w{n}x{rng.randrange(10**6)}" for _ in range(1200)]
        texts += [" ".join(words), " ".join(w if i % 10 else f"e{n}{i}" for i, w in enumerate(words))]  # similarity 1 / 3
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.groups(rows).collect()} == {i: i for i in range(12)}
    assert sum(seen) == 0
    monkeypatch.undo()
    lead = [f"{i}L AS l{i}" for i in range(jaccard.LEAD)]
    entries = spark.range(30).selectExpr("id AS s", "int(id) AS i", *lead).crossJoin(spark.range(2).withColumnRenamed("id", "node"))
    got = entries.alias("a").join(entries.alias("b"), F.expr(f"a.s = b.s AND a.node < b.node AND {jaccard._unlisted()}"))
    assert got.count() == 1


def test_joins_make_no_pairs_that_parities_sort_out(spark, monkeypatch):
    """Long sets that are no near copies share bands; parities that were folded to 256 told them apart only after the join."""
    rng, seen = random.Random(12), []
    sorted_out = jaccard._sorted_out
    monkeypatch.setattr(jaccard, "_sorted_out", lambda pairs, *how: seen.append(pairs.count()) or sorted_out(pairs, *how))
    texts = []
    for n in range(8):
        words = [f"w{n}x{rng.randrange(10**6)}" for _ in range(1200)]
        texts += [" ".join(words), " ".join(w if i % 14 else f"e{n}{i}" for i, w in enumerate(words))]  # similarity 0.47
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.groups(rows).collect()} == {i: i for i in range(16)}
    assert sum(seen) == 0  # of fingerprints alone


def test_near_dedup_leaves_one_table(spark, sf_dir):
    root = pathlib.Path(common.shared_dir(spark).removeprefix("file://"))
    docs, before = common.read(spark, sf_dir, "documents"), set(root.iterdir())
    kept = corpus_pipeline.near_dedup(spark, docs, sf_dir)
    assert [p.name.split("-")[0] for p in set(root.iterdir()) - before] == ["keepers"]
    assert 0 < kept.count() < docs.count()


def test_rows_of_no_group_are_not_exchanged(spark):
    """Rows that a bitmap tells from all that go aren't joined, with whole texts, to find out whether they stay."""
    rows = spark.createDataFrame([(i, f"t{i % 90}") for i in range(100)] + [(3, "t3"), (None, "t5"), (None, "x"), (7, None)], "doc_id long, text string")
    found = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), (F.col("doc_id").isNull() | (F.col("doc_id") < 90)).alias("keeper"))
    kept = common.keepers(rows, found, "doc_id", "text")
    assert sorted(map(str, kept.collect())) == sorted(map(str, rows.filter("doc_id is null or doc_id < 90").distinct().collect()))
    assert "Join" not in kept._jdf.queryExecution().optimizedPlan().children().apply(0).toString()


def test_components_at_once_and_by_rounds(spark, monkeypatch):
    rng = random.Random(13)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200 + i) for i in range(30)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(-5, None), (7, 7)]
    label = {x: x for a, b in links if b is not None and a != b for x in (a, b)}
    while any(label[a] != label[b] for a, b in links if b is not None and a != b):
        for a, b in links:
            if b is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    table = spark.createDataFrame(links, "a long, b long")
    for most in (components.AT_ONCE, 0):
        monkeypatch.setattr(components, "AT_ONCE", most)
        assert {r["node"]: r["root"] for r in components.components(table).collect()} == label
    assert components.components(table.filter("a = -5 or a = b")).count() == 0
