"""Steps that must not grow faster than their input: the plans and counts that bound them, and their results against plain versions."""

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from weir.functions import search, text_index
from weir.functions.text_index import TextIndex, Tokenizer
from weir.operators import aggregates, joins
from weir.plans import catalog

QUERIES = catalog.queries()
SHARES = ((0.25, 0.5), (0.49, 0.51), (0.0, 0.1), (0.9, 1.0))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_index_is_built_without_an_exchange(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = plan(TextIndex.build(docs, "doc_id", ("text", "source"), Tokenizer(stem=True, synonyms={"a": ("b",)})).table())
    assert "Exchange" not in made and "Sort" not in made and "Aggregate" not in made


def test_inverted_equals_plain_postings():
    rng = random.Random(5)
    texts = [[rng.choice(["dog", "dogs", "ünder", "cat", "b", "\U0001f600"]) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    rows = pa.record_batch([pa.array(range(100, 140), pa.int64()), pa.array(["text"] * 40), pa.array(texts, pa.list_(pa.string()))], ["key", "column", "tokens"]).slice(3)
    synonyms = {"cat": ("pet", "dog", "cat", "pet"), "dog": ("pet",), "none": ("b",)}
    for stem, more in ((False, {}), (True, {}), (False, synonyms), (True, synonyms)):
        want = {}
        for i, words in list(enumerate(texts))[3:]:
            want["", 100 + i] = [len(words)]
            for at, w in enumerate(words):
                w = search.stem(w) if stem else w
                for x in dict.fromkeys((w, *more.get(w, ()))):
                    want.setdefault((x, 100 + i), []).append(at)
        got = text_index.inverted(rows, stem, more).to_pylist()
        assert {(r["token"], r["key"]): r["positions"] for r in got} == want and len(got) == len(want)
        assert [r["token"].encode() for r in got] == sorted(r["token"].encode() for r in got)
        parts = list(text_index.slices(rows, 11))
        assert len(parts) > 9 and sorted(map(str, (r for p in parts for r in text_index.inverted(p, stem, more).to_pylist()))) == sorted(map(str, got))
        assert [x for p in parts for x in p["key"].to_pylist()] == rows["key"].to_pylist()


def test_search_for_nothing_leaves_the_texts_alone(spark, sf, monkeypatch):
    built = []
    monkeypatch.setattr(text_index, "state_of", lambda rows: built.append(rows) or "none")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = TextIndex.stored(docs, "doc_id", ("text",))
    for nothing in (index.any_of(None), index.all_of([]), index.phrase([]), index.all_prefixes(None), index.ranked([]), QUERIES["search_nothing"](spark, sf)):
        assert nothing.collect() == [] and nothing.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
        assert "FileScan" not in plan(nothing)
    assert not built


def test_stored_index_is_one_table_written_once(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 50")
    docs.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    one = TextIndex.stored(docs, "doc_id", ("text",))
    n = F.size(search.unicode_tokens(F.col("text"))).alias("n")
    assert sorted(map(tuple, one.lengths.select("key", "n").collect())) == sorted(map(tuple, docs.select("doc_id", n).collect()))
    files = one.table().inputFiles()
    assert TextIndex.stored(docs, "doc_id", ("text",)).table().inputFiles() == files and all(os.path.dirname(f) == os.path.dirname(files[0]) for f in files)
    assert one.postings.filter("token = ''").count() == 0


def test_stems_look_at_each_word_once(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(search, "stem", lambda w: asked.append(w) or w[:3])
    lists = pa.array([["running", "runner", "running"], None, [], ["runner", None]], pa.list_(pa.string()))
    assert search.stemmed(lists).to_pylist() == [["run"] * 3, None, [], ["run", None]] and search.stemmed(lists.slice(1)).to_pylist() == [None, [], ["run", None]]
    assert sorted(asked) == ["runner", "runner", "running"]


def test_ranks_decide_as_exact_percentiles_do(spark):
    rng = random.Random(3)
    for n in (0, 1, 4, 101):
        values = [rng.randint(0, 9) * 1.0 if n < 50 else rng.randint(0, 60) * 0.5 for _ in range(n)] + [None]
        rows = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
        for m in sorted({v for v in values if v is not None})[:: max(1, n // 12)] or [None]:
            found = spark.createDataFrame([(m, 7)], "m double, x int").coalesce(1)
            r = aggregates.rank_of(rows, "v", found, "m").select("x", *[aggregates.within_shares(lo, hi).alias(f"w{i}") for i, (lo, hi) in enumerate(SHARES)]).first()
            want = rows.agg(*[F.lit(m).cast("double").between(F.percentile("v", lo), F.percentile("v", hi)) for lo, hi in SHARES]).first()
            assert (r.x, *r[1:]) == (7, *want), (values, m)


def test_sketches_hold_no_table_of_values_in_one_task(spark, sf):
    made = plan(QUERIES["aggregate_sketches"](spark, sf))
    assert "percentile(" not in made and "SortAggregate" not in made
    assert [tuple(r) for r in QUERIES["aggregate_sketches"](spark, sf).collect()] == [(True, True)]


def test_rows_above_others_meet_once_in_cells(spark):
    rng = random.Random(8)
    odd = [None, float("nan"), float("inf"), float("-inf"), 1e300, -1e300]
    for mine, other in ((odd + [rng.randint(0, 40) / 2 for _ in range(60)], odd + [rng.randint(0, 40) / 2 for _ in range(60)]), ([1.0, 2.0], [2.0, 5.0]), ([], [1.0]), ([1.0, None], [])):
        a = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(mine)], "i int, g int, h double").coalesce(1)
        b = spark.createDataFrame([(i, i % 3, v) for i, v in enumerate(other)], "j int, f int, l double").coalesce(1)
        x, y = joins.above_cells(a, b, F.col("h"), F.col("l") + 1, "ca", "cb", 8)
        got = [tuple(r) for r in x.join(y, (x["g"] == y["f"]) & (x["ca"] == y["cb"]) & (F.col("h") > F.col("l") + 1)).select("i", "j").collect()]
        want = [tuple(r) for r in a.join(b, (a["g"] == b["f"]) & (F.col("h") > F.col("l") + 1)).select("i", "j").collect()]
        assert sorted(got) == sorted(want)
        assert x.count() <= 8 * len(mine) and y.count() <= len(other)


def test_aliased_join_meets_in_cells(spark, tmp_path):
    """Nations alone leave the pairs to 25 keys, and a broadcast to as many tasks as there are files."""
    rng = random.Random(2)
    s, c = ([(i, rng.randint(0, 2), rng.randint(-99999, 999999) / 100) for i in range(n)] for n in (60, 300))
    spark.createDataFrame(s, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    spark.createDataFrame(c, "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    df = QUERIES["join_aliased"](spark, str(tmp_path))
    want = sorted((a, b) for a, n, x in s for b, m, y in c if n == m and x > y + 9000)
    assert sorted(map(tuple, df.collect())) == want and len(want) > 9
    assert "_cell_c" in plan(df) and "RoundRobinPartitioning" in plan(df)
