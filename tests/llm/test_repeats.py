"""Substring removers against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from weir.llm import op6_suffix_dedup as op6
from weir.llm import op7_automaton_dedup as op7
from weir.llm import spans


def brute(docs, units, length, join):
    """docs: (id, text) in order; returns id -> (n, removed, spans, sha)."""
    seen, out = set(), {}
    for i, text in docs:
        u = units(text)
        gone = [False] * len(u)
        for p in range(len(u) - length + 1):
            w = tuple(u[p : p + length]) if isinstance(u, list) else u[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        runs = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(u), sum(gone), runs, hashlib.sha256(join([x for x, g in zip(u, gone) if not g])).hexdigest())
    return out


def as_bytes(kept):
    return bytes(kept)


def as_words(kept):
    return " ".join(kept).encode()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def made(seed, n, sizes):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    shared = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice((15, 25, 60)))) for _ in range(6)]
    docs = []
    for i in range(n):
        bits = []
        for _ in range(rng.randint(*sizes)):
            bits.append(rng.choice(shared) if rng.random() < 0.4 else " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 30))))
        docs.append((i, " ".join(bits)))
    docs += [(n, docs[0][1]), (n + 1, docs[1][1][7:]), (n + 2, ""), (n + 3, None), (n + 4, "a" * 900), (n + 5, "ab " * 300), (n + 6, "a" * 450 + " b"), (n + 7, " \t\n")]
    return docs


def run(spark, op, rows, **kw):
    return op.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3), **kw)


@pytest.mark.parametrize("hot", [2, 100_000])
def test_bytes(spark, hot):
    docs = made(1, 60, (1, 8))
    want = brute(docs, lambda t: (t or "").encode(), 100, as_bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in run(spark, op6, [(*d, "x") for d in docs], hot=hot).collect()}
    assert got == want


@pytest.mark.parametrize("hot", [2, 20_000])
def test_words(spark, hot):
    docs = made(2, 60, (1, 8))
    want = {k: (n, r, s) for k, (n, r, _, s) in brute(docs, words, 20, as_words).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in run(spark, op7, [(*d, "x") for d in docs], hot=hot, shard_words=50).collect()}
    assert got == want


def test_long_text_crosses_segments(spark, monkeypatch):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(600_000))
    docs = [(5, long), (6, "q" + long[262_000:262_400] + "z"), (7, long[100:300_000])]
    want = brute(docs, lambda t: t.encode(), 100, as_bytes)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in run(spark, op6, [(*d, "x") for d in docs]).collect()}
    assert got == want
    want = {k: (n, r, s) for k, (n, r, _, s) in brute(docs, words, 20, as_words).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in run(spark, op7, [(*d, "x") for d in docs]).collect()}
    assert got == want


def test_long_words_hash_alike_at_any_offset():
    for size in (spans.SEGMENT - 1, spans.SEGMENT, 300_000, 2 * spans.SEGMENT, 600_000):
        window = b" ".join([*(b"w%d" % i for i in range(10)), b"abc" * (size // 3) + b"x" * (size % 3), *(b"v%d" % i for i in range(9))])
        hashes = []
        for before in (b"", b"a bc ", b"pre " * 70_000):
            data = np.frombuffer(before + window, np.uint8)
            starts, ends, _ = spans.word_bounds(data, np.array([0, len(data)]))
            hashes.append(spans.word_values(data, starts, ends)[-20:].tolist())
        word = np.frombuffer(window.split()[10], np.uint8)
        alone = spans.word_values(word, np.array([0]), np.array([size]))
        assert hashes[0] == hashes[1] == hashes[2] and hashes[0][10] == alone[0]


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "x"), (1, text, "x"), (None, text, "x"), (2, "short", None)]
    got = sorted(((r.doc_id, r.n_removed) for r in run(spark, op7, rows).collect()), key=str)
    assert got == [(1, 40), (1, 40), (2, 0), (None, 0)]
    assert run(spark, op7, []).count() == 0 and run(spark, op6, []).count() == 0


@pytest.mark.parametrize("op", [op6, op7])
@pytest.mark.parametrize("hot", [3, 20_000])
def test_rows_without_ids_and_of_one_id(spark, op, hot):
    """2,000 rows without an id and 1,000 of one id: only what occurred before goes, in the order of (doc_id, hash of the text)."""
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(15, 45)))
    shared = [" ".join(rng.choice("abcdefghij") * 5 for _ in range(30)) for _ in range(4)]
    rows = [(None if i < 2000 else 7, text() + (" " + rng.choice(shared) if rng.random() < 0.1 else ""), str(i)) for i in range(3000)]
    rows += rows[:5] + [(7, rows[3][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) h", "xxhash64(1, text) g").distinct().collect()
    keyed.sort(key=lambda r: (-1 if r.doc_id is None else r.doc_id, r.h, r.g))
    units, length, join = (lambda t: t.encode(), 100, as_bytes) if op is op6 else (words, 20, as_words)
    want = brute([((r.doc_id, i), r.text) for i, r in enumerate(keyed)], units, length, join)
    number = {(r.doc_id, r.text): (r.doc_id, i) for i, r in enumerate(keyed)}
    expected = sorted(str((i, *[want[number[i, t]][j] for j in (0, 1, 3)])) for i, t, _ in rows)
    got = op.remove_repeats(docs, hot=hot).collect()
    assert sorted(str((r.doc_id, r[2], r.n_removed, hashlib.sha256(r.kept if op is op6 else r.kept.encode()).hexdigest())) for r in got) == expected
    assert sum(r.n_removed for r in got) > 0


def test_the_resolver_decides_every_repeat(spark, sf):
    """Whatever is removed comes out of the resolver, which gets all runs whose anchor occurs at several places."""
    from weir.llm import repeats

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    keyed = repeats.doc_key(docs)
    rows = repeats.anchors(keyed, "byte", 100, 32).drop("known", "spare", "load").distinct()  # a row for each run
    several = rows.groupBy("gram").count().filter("count > 1")
    assert repeats.sift(repeats.anchors(keyed, "byte", 100, 32), 100).filter("n > 0").distinct().count() == rows.join(several, "gram", "left_semi").count() > 0


def test_crowded_anchors_beyond_the_broadcast_are_joined(spark, monkeypatch):
    from weir.llm import repeats

    monkeypatch.setattr(repeats, "CROWDED", 1)
    docs = made(6, 40, (1, 8))
    want = {k: (n, r, s) for k, (n, r, _, s) in brute(docs, words, 20, as_words).items()}
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in run(spark, op7, [(*d, "x") for d in docs], hot=2).collect()}
    assert got == want


def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    want = brute(docs, lambda t: t.encode(), 100, as_bytes)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6.op6_suffix_dedup(spark, sf).collect()} == want
    want = {k: (n, r, s) for k, (n, r, _, s) in brute(docs, words, 20, as_words).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in op7.op7_automaton_dedup(spark, sf).collect()} == want


def test_loser_tree_orders_and_counts_prefixes():
    rng = random.Random(4)
    items = sorted("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(300))
    runs = [sorted(items[i::7]) for i in range(7)]
    blobs = [op6.front_coded([(s, b"L" * (i % 3), 1, 2, 0, 3) for i, s in enumerate(r)]) for r in runs]
    out = list(op6.merged([op6.decoded(b) for b in blobs]))
    assert [x[1] for x in out] == items
    for a, b in zip(out, out[1:]):
        assert b[0] == op6.common_prefix(a[1], b[1], 0)
