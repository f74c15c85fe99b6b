"""Topics of op3 are fitted on all texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from weir.llm import op3_mixing


def test_topics_are_fitted_on_all_texts(spark):
    rng = random.Random(4)
    words = [[f"{kind}{i}" for i in range(30)] for kind in ("sea", "law", "sun")]
    texts = [" ".join(rng.choices(words[i % 3], k=rng.randint(3, 12))) for i in range(2400)] + ["", None, " ".join(rng.choices(words[1], k=6000))]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    topics = op3_mixing.learn_topics(df, clusters=3, rounds=60)
    again = op3_mixing.learn_topics(df.repartition(7), clusters=3, rounds=60)
    assert np.array_equal(topics.idf, again.idf) and np.array_equal(topics.centroids, again.centroids)
    doc, bucket, n = op3_mixing.word_buckets(pa.array([t for t in texts if t]))
    x = np.zeros((doc.max() + 1, op3_mixing.BUCKETS))
    x[doc, bucket] = np.sqrt(n)
    assert np.allclose(topics.idf, np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1)
    x *= topics.idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = (x @ topics.centroids.T).argmax(1)
    for i in range(3):  # a fixed point of all texts
        mean = x[at == i].sum(0)
        assert np.allclose(topics.centroids[i], mean / np.linalg.norm(mean), atol=1e-4)
    assert {len(set(at[k:2400:3].tolist())) for k in range(3)} == {1} and len(set(at.tolist())) == 3
    assert len(op3_mixing.learn_topics(spark.createDataFrame([("",), (None,)], "text string")).centroids) == 0
    assert len(op3_mixing.learn_topics(spark.createDataFrame([("a b",)] * 5, "text string")).centroids) == 1


def plain_starts(texts, hashes, idf, clusters):
    """k-means++ by hashes over all texts at once."""
    doc, bucket, n = op3_mixing.word_buckets(pa.array(texts))
    x = np.zeros((len(texts), op3_mixing.BUCKETS))
    x[doc, bucket] = np.sqrt(n) * idf[bucket]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = []
    while len(got) < clusters:
        far = 1 - (x @ x[got].T).max(1) if got else np.ones(len(x))
        score = np.where(far > 1e-9, -np.log(op3_mixing._chance(hashes, len(got))) / np.maximum(far, 1e-9), np.inf)
        if not np.isfinite(score.min()):
            break
        got.append(int(score.argmin()))
    return x[got]


def test_starts_need_no_pass_each(spark):
    """The starts are those of all texts, and more of them ask for no more jobs."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(1500)] + ["the same words"] * 500
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    rows = df.selectExpr("text", "xxhash64(lower(text)) h").collect()
    jobs = []
    for clusters in (2, 8):
        spark.sparkContext.setJobGroup(f"starts {clusters}", "")
        topics = op3_mixing.learn_topics(df, clusters=clusters, rounds=0)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"starts {clusters}")))
        want = plain_starts([r.text for r in rows], np.array([r.h for r in rows]), topics.idf, clusters)
        assert np.allclose(topics.centroids, want, atol=1e-6)
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_starts_beyond_the_first_texts(spark, monkeypatch):
    """Where the first texts do not settle a start, all are asked; the same texts come out."""
    texts = [f"a b c{i} d{i % 7}" for i in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    topics = op3_mixing.learn_topics(df, clusters=4, rounds=3)
    monkeypatch.setattr(op3_mixing, "EARLY", 0)
    again = op3_mixing.learn_topics(df, clusters=4, rounds=3)
    assert len(topics.centroids) == 4 and np.array_equal(topics.centroids, again.centroids)


def test_the_query_reads_texts_once(spark, monkeypatch):
    read, plain = spark.sparkContext.accumulator(0), op3_mixing.table

    def seen(text):
        read.add(1)
        return text

    counting = F.udf(seen, "string").asNondeterministic()
    monkeypatch.setattr(op3_mixing, "table", lambda *a: plain(*a).withColumn("text", counting("text")))
    assert op3_mixing.op3_mixing(spark, "/root/testdata/sf0.001").count() == 200
    out = op3_mixing.op3_mixing(spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 200 and read.value == 400  # two runs


def test_counted_rows_are_mixed_as_their_texts(spark):
    texts = ["", None, " \t", "one", "İstanbul STRASSE x\x1cy", "a\x0bb\x0cc\r\nd", "word " * 70_000, "x" * 300_000, "tab\tand\tmore words", "é" * 9]
    rows = [(i if i % 4 else None, t, ("en", None)[i % 2], ("s", None, "t")[i % 3], i, "q") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n int, `u.v` string")
    topics = op3_mixing.learn_topics(docs)
    seen = op3_mixing.counted(docs)
    one, two = op3_mixing.fit(docs, op3_mixing.Targets(), topics), op3_mixing.fit(seen, op3_mixing.Targets(), topics)
    assert one == two
    of_texts, of_counts = op3_mixing.mixed(docs, topics=topics, mixture=one).drop("text"), op3_mixing.mixed(seen, topics=topics, mixture=one)
    assert of_texts.columns == of_counts.columns and sorted(map(str, of_texts.collect())) == sorted(map(str, of_counts.collect()))
    assert sorted(map(str, op3_mixing.mixed(docs).drop("text").collect())) == sorted(map(str, of_counts.collect()))
