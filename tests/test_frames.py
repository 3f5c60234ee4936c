import itertools
import random

import pytest
from pyspark.sql import functions as F

from tallybrook.operators import frames, pairs
from tallybrook.operators.metrics import METRICS, Metric, registry
from tallybrook.sources import lake


def test_components_against_union_find(spark):
    rng = random.Random(1)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    label = {i: i for i in [*range(60), *range(100, 121)]}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    nodes = spark.createDataFrame([(i,) for i in label], "id long")
    got = frames.label_components(nodes, spark.createDataFrame(links, "a long, b long"), "id")
    assert {r["id"]: r["component"] for r in got.collect()} == label


def test_near_texts_meet_and_are_verified(spark):
    base = "the street lamp at the crossing near the school has been broken since monday"
    rows = spark.createDataFrame([(1, base), (2, base + " x"), (3, "quite another matter altogether about water supply"), (4, None), (5, "ab")], "id long, text string")
    links = frames.candidate_links(frames.lsh_bands(frames.minhash(rows, "id", "text"), "id"), "id")
    assert [(r["a"], r["b"]) for r in frames.verified_links(links, rows, "id", "text", 0.8).collect()] == [(2, 1)]


def test_redaction_keeps_government_mail():
    text, n = frames.redact_text("Shri Ram Das, 9876543210, a@b.com and x@puri.gov.in, account no 123456789012")
    assert n == 4 and "x@puri.gov.in" in text and "9876543210" not in text and "Ram" not in text and "123456789012" not in text


def test_metrics_are_governed():
    with pytest.raises(ValueError):
        Metric("m", "t", "d", "c")
    with pytest.raises(ValueError):
        Metric("m", "t", "d", "c", measure="count(grievance)")
    with pytest.raises(ValueError):
        Metric("m", "(SELECT extracted_text FROM t)", "d", "c", measure="count(*)")
    with pytest.raises(ValueError):
        Metric("m", "t", "d", "c", measure="count(*)", dimensions=("grievance",))
    with pytest.raises(ValueError):
        METRICS["total_filings"].sql(("status",))
    with pytest.raises(ValueError):
        registry([METRICS["total_filings"], METRICS["total_filings"]])


def test_lake_drops_denied_columns_and_publishes(spark, sf_dir, tmp_path):
    assert lake.drop_denied(lake.table(spark, sf_dir, "pages"), "pages").columns == ["page_id", "url"]
    with pytest.raises(ValueError):
        lake.drop_denied(spark.range(1), "t", {"t": ("id",)})
    with pytest.raises(ValueError):
        lake.table(spark, sf_dir, "x; drop")
    out = f"file://{tmp_path}/release"
    for n in (1, 2):
        lake.publish({"t": spark.range(n)}, out, {"n": n})
    assert spark.read.parquet(f"{out}/t.parquet").count() == 2
    assert lake.materialize(spark, sf_dir, ["pages"], f"file://{tmp_path}/copy")["pages"] > 0


def test_jsonl_refuses_repeated_keys(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "b")], "id long, t string").write.json(f"{tmp_path}/x")
    with pytest.raises(ValueError):
        lake.read_jsonl(spark, f"{tmp_path}/x", "id long, t string", "id")


def test_bootstrap_is_deterministic(spark, sf_dir):
    a, b = (frames.cluster_bootstrap(spark, sf_dir, 20).collect() for _ in range(2))
    assert a == b and a[0]["replicates"] == 20


def test_stream_equals_batch(spark, sf_dir):
    from tallybrook.streaming import windows

    got = windows.stream_hourly(spark, sf_dir).agg(F.sum("n")).first()[0]
    assert got == lake.table(spark, sf_dir, "events").count()


def test_mixed_bucket_gives_all_its_pairs(spark):
    """Members near each other but not near the bucket's least id; components against all pairs by hand."""
    texts = {1: "abcdefghijklmnopqrstuvwxyz", 2: "ABCDEFGHIJKLMNOPQRS0123456789 the lamp at the crossing is broken", 3: "abcdefghijklmnopqrs0123456789 the lamp at the crossing is broken", 4: "abcdefghijklmnopqrs0123456789 the lamp at the crossing is broken!", 5: "water"}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    bands = rows.selectExpr("id", "0 AS band", "7L AS bucket")
    found = frames.verified_links(frames.candidate_links(bands, "id"), rows, "id", "text", 0.8)
    grams = {i: {t.lower()[k : k + 5] for k in range(len(t) - 4)} for i, t in texts.items()}
    want = {(a, b) for a in texts for b in texts if a > b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])}
    assert want == {(3, 2), (4, 2), (4, 3)}
    assert {(r["a"], r["b"]) for r in found.collect()} == want
    got = frames.label_components(rows.select("id"), found, "id")
    assert {r["id"]: r["component"] for r in got.collect()} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5}


def test_large_buckets_meet_anchors(spark):
    bands = spark.range(250).selectExpr("id", "0 AS band", "id % 1 AS bucket")
    links = frames.candidate_links(bands, "id")
    assert links.count() == 32 * 31 // 2 + 32 * (250 - 32)
    assert frames.candidate_links(bands.filter("id < 199"), "id").count() == 199 * 198 // 2


def test_documents_within_caps_by_brute_force(spark):
    """All documents one by one, against the few that the operator walks over."""
    rng = random.Random(5)
    for target, cap, most in ((60, 25, 10), (10_000, 25, 10), (40, 3, 9)):
        rows = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randrange(13)) for i in rng.sample(range(2000), 500)]
        total, held, want = 0, {}, []
        for i, c, p in sorted(rows, key=lambda r: r[0]):
            if total >= target:
                break
            if not 0 < p <= most or held.get(c, 0) >= cap or held.get(c, 0) and held[c] + p > cap:
                continue
            total, held[c] = total + p, held.get(c, 0) + p
            want.append((i, c, p))
        got = frames.within_caps(spark.createDataFrame(rows, "x long, c string, p int"), "x", "c", "p", target, cap, most)
        assert sorted(tuple(r) for r in got.collect()) == want
    assert not frames.within_caps(spark.createDataFrame([], "x long, c string, p int"), "x", "c", "p", 5, 5, 5).collect()


def test_similar_texts_by_brute_force(spark):
    """Pairs of different texts, and copies by their representative, on texts of every length; rows with nulls have no pairs."""
    rng = random.Random(3)
    texts = []
    for _ in range(40):
        base = "".join(rng.choices("abcdefgh ", k=rng.choice([5, 9, 14, 30, 60, 150, 400, 1500])))
        for _ in range(5):
            body = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
                body[rng.randrange(len(body))] = rng.choice("xyz")
            texts.append((f"i{len(texts):03}", "".join(body), rng.choice("uuuv")))
    texts += [texts[0], (None, texts[0][1], "u"), ("n1", None, "u"), ("n2", texts[0][1], None), ("n3", "abc", "u"), ("n4", "abc", "u"), ("i000", texts[0][1] + "z", texts[0][2])]
    got = sorted(tuple(r) for r in pairs.similar_texts(spark.createDataFrame(texts, "item string, body string, block string")).collect())
    rep, grams = {}, {}
    for i, t, k in texts:
        if i and t and k and len(t) >= 5:
            rep[t, k] = min(i, rep.get((t, k), i))
            grams[t] = {t[j : j + 5] for j in range(len(t) - 4)}
    want = [(rep[t, k], i, 1.0, True) for i, t, k in set(texts) if (t, k) in rep and i and i > rep[t, k]]
    for (t, k), (u, m) in itertools.combinations(rep, 2):
        both, either = len(grams[t] & grams[u]), len(grams[t] | grams[u])
        if k == m and 5 * both >= 4 * either:
            want.append((*sorted((rep[t, k], rep[u, m])), round(both / either, 6), False))
    assert sum(x[3] for x in want) > 20 and sum(not x[3] for x in want) > 40 and got == sorted(want)


def test_group_of_near_copies_gives_each_pair_about_once(spark):
    body = "".join(random.Random(5).choices("abcdefgh ", k=600))
    texts = [(f"i{n:03}", body[: n * 3] + "#" + body[n * 3 + 1 :], "u") for n in range(150)]
    classes = spark.createDataFrame(texts, "rep string, body string, block string").selectExpr("*", "xxhash64(block, body) AS node")
    joined = pairs.meetings(pairs._sets(classes)).count()
    assert 150 * 149 // 2 <= joined < 2 * 150 * 149 // 2
