"""Operators that SQL doesn't express: signatures, components, models, samples, sources, streams.

Each is a function from DataFrames to a DataFrame; the queries apply them to the synthetic tables.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import lake

PERMUTATIONS, BANDS, ROWS = 128, 16, 8
#: Buckets of fewer members are compared pair by pair; in larger ones each member meets so many anchors.
ALL_PAIRS, ANCHORS = 200, 32


def shingle_set(text, n: int = 5):
    """The distinct character n-grams of a lower-cased text; empty for shorter texts."""
    text = F.lower(text)
    grams = F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def minhash(df: DataFrame, id_col: str, text_col: str, permutations: int = PERMUTATIONS) -> DataFrame:
    """id, signature: per permutation the least hash of the text's shingles, all in the JVM. A text without shingles has
    none."""
    one = F.explode(shingle_set(F.col(text_col)))
    hashed = df.select(F.col(id_col), one.alias("s")).select(id_col, F.xxhash64("s").alias("h")).distinct()
    mins = [F.min(F.xxhash64("h", F.lit(i))).alias(f"m{i}") for i in range(permutations)]
    return hashed.groupBy(id_col).agg(*mins).select(id_col, F.array(*[f"m{i}" for i in range(permutations)]).alias("signature"))


def lsh_bands(signatures: DataFrame, id_col: str, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """id, band, bucket: rows of the signature hashed together."""
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.struct(b.alias("band"), F.xxhash64(F.slice("signature", b * rows + 1, rows)).alias("bucket")))
    return signatures.select(id_col, F.explode(band).alias("x")).select(id_col, "x.band", "x.bucket")


def candidate_links(bands: DataFrame, id_col: str) -> DataFrame:
    """Links of a bucket's members, the larger id first: all pairs below ALL_PAIRS members, else each member with the
    bucket's ANCHORS least ids, as the reference does."""
    members = bands.select("band", "bucket", id_col).distinct()
    size = members.groupBy("band", "bucket").agg(F.count("*").alias("n")).filter("n > 1")
    anchors = members.withColumn("k", F.row_number().over(Window.partitionBy("band", "bucket").orderBy(id_col))).join(size, ["band", "bucket"])
    anchors = anchors.filter((F.col("n") < ALL_PAIRS) | (F.col("k") <= ANCHORS)).select("band", "bucket", F.col(id_col).alias("b"))
    return members.join(anchors, ["band", "bucket"]).filter(F.col(id_col) > F.col("b")).select(F.col(id_col).alias("a"), "b").distinct()


def verified_links(links: DataFrame, texts: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """Links whose shingle sets have at least this Jaccard similarity, exactly."""
    own = texts.select(F.col(id_col), shingle_set(F.col(text_col)).alias("g"))
    met = links.join(own.select(F.col(id_col).alias("a"), F.col("g").alias("ga")), "a").join(own.select(F.col(id_col).alias("b"), F.col("g").alias("gb")), "b")
    both = F.size(F.array_intersect("ga", "gb"))
    similar = F.when(both == 0, F.lit(0.0)).otherwise(both / (F.size("ga") + F.size("gb") - both))
    return met.select("a", "b", similar.alias("jaccard")).filter(F.col("jaccard") >= least)


def label_components(nodes: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """id, component (its least id): minimum labels spread over the links until nothing changes; each round's table is
    written to the shared folder, so that lineage stays short and a lost executor costs a read."""
    both = lake.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    now = lake.written(nodes.select(F.col(id_col), F.col(id_col).alias("component")).distinct(), "labels")
    while True:
        near = both.join(now, both.b == now[id_col]).groupBy("a").agg(F.min("component").alias("m"))
        step = now.join(near, now[id_col] == near.a, "left").select(id_col, F.least("component", F.coalesce("m", "component")).alias("component"), (F.col("m") < F.col("component")).alias("moved"))
        step = lake.written(step, "labels")
        if not step.filter("moved").limit(1).count():
            return step.select(id_col, "component")
        # a node takes the label of its label, which halves the rounds of a long chain
        jump = step.select(F.col(id_col).alias("k"), F.col("component").alias("j"))
        now = lake.written(step.join(jump, step.component == jump.k, "left").select(id_col, F.least("component", F.coalesce("j", "component")).alias("component")), "labels")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.table(spark, sf_dir, "benchmark").select("item_id", "text").unionByName(lake.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn") + 1_000_000).alias("item_id"), "text"))


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash(_texts(spark, sf_dir), "item_id", "text")


def lsh_band_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_bands(minhash_signature(spark, sf_dir), "item_id")


def verify_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_links(candidate_links(lsh_band_buckets(spark, sf_dir), "item_id"), _texts(spark, sf_dir), "item_id", "text", 0.8)


def union_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_components(_texts(spark, sf_dir), verify_bucket(spark, sf_dir), "item_id")


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of case texts: TF-IDF of one- and two-word terms, seeded k-means."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer

    texts = _texts(spark, sf_dir).filter("text is not null")
    steps = [
        RegexTokenizer(inputCol="text", outputCol="one", pattern=r"\W+"),
        NGram(n=2, inputCol="one", outputCol="two"),
        SQLTransformer(statement="SELECT *, concat(one, two) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=500, minDF=2),
        IDF(inputCol="tf", outputCol="features"),
        KMeans(k=6, seed=42, featuresCol="features", predictionCol="theme"),
    ]
    return Pipeline(stages=steps).fit(texts).transform(texts).groupBy("theme").agg(F.count("*").alias("size"))


def actionability_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF and logistic regression of the quality label, scored on the labelled documents."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    rows = lake.table(spark, sf_dir, "documents").join(lake.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").select("doc_id", "text", "label")
    steps = [RegexTokenizer(inputCol="text", outputCol="w", pattern=r"\s+"), HashingTF(inputCol="w", outputCol="tf", numFeatures=1 << 12), IDF(inputCol="tf", outputCol="features"), LogisticRegression(regParam=0.01, maxIter=20)]
    model = Pipeline(stages=steps).fit(rows.filter("doc_id % 4 <> 0"))
    return model.transform(rows).select("doc_id", F.round(vector_to_array("probability")[1], 6).alias("score"), (vector_to_array("probability")[1] >= 0.5).alias("actionable"))


def duration_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge on one-hot keys against the log of days to close; mean residual by category."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    from ..plans.layer import query

    rows = query("grievance_base")(spark, sf_dir).filter("days_to_close is not null").select(F.coalesce("category", F.lit("none")).alias("category"), "district", F.log1p(F.col("days_to_close").cast("double")).alias("label"))
    names = ["category", "district"]
    steps = [StringIndexer(inputCols=names, outputCols=[f"{n}_i" for n in names], handleInvalid="keep"), OneHotEncoder(inputCols=[f"{n}_i" for n in names], outputCols=[f"{n}_v" for n in names]), VectorAssembler(inputCols=[f"{n}_v" for n in names], outputCol="features"), LinearRegression(regParam=0.1, elasticNetParam=0.0)]
    return Pipeline(stages=steps).fit(rows).transform(rows).groupBy("category").agg(F.round(F.avg(F.col("label") - F.col("prediction")), 6).alias("residual"), F.count("*").alias("n"))


def isotonic_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.regression import IsotonicRegression

    from ..plans.layer import query

    rows = query("scored_examples")(spark, sf_dir).select("item_id", F.col("gold").cast("double").alias("label"), F.col("score").alias("features"))
    return IsotonicRegression().fit(rows).transform(rows).select("item_id", F.round("prediction", 6).alias("calibrated"))


def cluster_bootstrap(spark: SparkSession, sf_dir: str, replicates: int = 200) -> DataFrame:
    """Standard error of the mean score over resampled groups: each group gets a Poisson(1) weight a replicate, by hash."""
    from ..plans.layer import query

    groups = query("scored_examples")(spark, sf_dir).groupBy("group_id").agg(F.sum("score").alias("s"), F.count("*").alias("n"))
    u = (F.pmod(F.xxhash64("group_id", "r"), F.lit(1_000_003)) + 0.5) / 1_000_003
    cuts, at, p = [], 0.0, math.exp(-1)
    for k in range(8):
        at += p
        cuts.append(at)
        p /= k + 1
    weight = sum((F.when(u > c, 1).otherwise(0) for c in cuts), F.lit(0))
    drawn = groups.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight)
    means = drawn.groupBy("r").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("m"))
    return means.agg(F.round(F.avg("m"), 6).alias("mean"), F.round(F.stddev_samp("m"), 6).alias("se"), F.count("*").alias("replicates"))


def within_caps(rows: DataFrame, id_col: str, category: str, pages: str, target: int, per_category: int, per_document: int) -> DataFrame:
    """id, category, pages of the documents taken in order of id until `target` pages are reached: a document goes if it has
    no page or over `per_document`, if its category is full, or if it would overfill one that holds something already.

    Room only shrinks, so of the documents of one category and size those that are taken stand first: the order is walked
    over at most per_category / size + 1 of each, whatever the table's size. A null category is one of its own."""
    fit = rows.select(F.col(id_col).alias("id"), F.col(category).alias("category"), F.col(pages).cast("long").alias("pages")).filter(F.col("pages").between(1, per_document))
    k = F.row_number().over(Window.partitionBy("category", "pages").orderBy("id"))
    light = fit.withColumn("k", k).filter(F.col("k") <= per_category / F.col("pages") + 1).drop("k")

    def walk(found: pd.DataFrame) -> pd.DataFrame:
        total, held, out = 0, {}, []
        for r in found.sort_values("id", kind="stable").itertuples(index=False):
            if total >= target:
                break
            name = None if pd.isna(r.category) else r.category
            own = held.get(name, 0)
            if own < per_category and (not own or own + r.pages <= per_category):
                held[name], total = own + r.pages, total + r.pages
                out.append((r.id, name, r.pages))
        return pd.DataFrame(out, columns=["id", "category", "pages"])

    return light.groupBy().applyInPandas(lambda x: walk(x), light.schema)


def select_within_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for a review of 200 pages, at most 50 a language and 10 a document; 2,000 characters are a page."""
    rows = lake.table(spark, sf_dir, "documents").select("doc_id", "lang", F.ceil(F.col("n_chars") / 2000.0).alias("pages"))
    return within_caps(rows, "doc_id", "lang", "pages", 200, 50, 10).select(F.col("id").alias("doc_id"), F.col("category").alias("lang"), "pages")


NAME_TITLE = re.compile(r"\b(?:Shri|Smt|Sri|Mr|Mrs|Ms|Dr)\.? ((?:[A-Z][a-z]+ ?){1,3})")
IDENTIFIER = re.compile(r"(?i)\b(?:account|aadhaar|ration card|voter id|consumer|registration)\b[^0-9]{0,40}(\d{8,18})(?!\d)")
MOBILE = re.compile(r"(?<!\d)(?:\+?91[- ]?|0)?([6-9]\d{9})(?!\d)")
EMAIL = re.compile(r"[\w.+-]+@([\w-]+(?:\.[\w-]+)+)")
INDIC = str.maketrans("०१२३४५६७८९୦୧୨୩୪୫୬୭୮୯", "01234567890123456789")


def redact_text(text: str) -> tuple[str, int]:
    """The text with names after a title, numbers after their keyword, mobiles and private emails as tokens, and how many.
    Indic digits count as digits; government addresses stay."""
    plain = text.translate(INDIC)
    spans = [(m.start(1), m.end(1), "NAME") for m in NAME_TITLE.finditer(plain)]
    spans += [(m.start(1), m.end(1), "ID") for m in IDENTIFIER.finditer(plain)]
    spans += [(m.start(), m.end(), "PHONE") for m in MOBILE.finditer(plain)]
    spans += [(m.start(), m.end(), "EMAIL") for m in EMAIL.finditer(plain) if not re.search(r"(^|\.)(nic|gov|mil)\.in$", m.group(1).lower())]
    out, at, n = [], 0, 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at, n = b, n + 1
    return "".join([*out, text[at:]]), n


def redact(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [redact_text(t or "") for t in b["t"]]
            yield pd.DataFrame({"id": b["id"], "redacted": [g[0] for g in got], "spans": [g[1] for g in got]})

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")).mapInPandas(run, "id long, redacted string, spans long")


def redaction_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(lake.table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (minhash_signature, lsh_band_buckets, verify_bucket, union_find, themes, actionability_scores, duration_model, isotonic_calibration, cluster_bootstrap, select_within_caps, redaction_backfill)}
