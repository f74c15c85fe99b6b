"""Operators 1, 8 and 10 against brute force, the tokenizers library and exact round trips."""

import hashlib
import random
import struct
import zlib
from functools import cache

import numpy as np
import pytest
import xxhash

from weir.llm import op1_prefix_fingerprints as op1
from weir.llm import op8_bpe as op8
from weir.llm import op10_png_media as op10
from weir.llm.common import NULL_ID

TEXTS = ["", None, "a", "héllo wörld 🎉 " * 9, "the same text, twice", "the same text, twice", "x" * 5000, " \n\t ", "日本語 テキスト", "mixed 123 'll don't  <|endoftext|> end"]
EMPTY = "doc_id long, text string, did string, fp string"


def rows(texts):
    return [(i, t, "clash", "clash") for i, t in enumerate(texts)]


def test_spans_and_extensions():
    rng = random.Random(1)
    t = "".join(rng.choice("ab") for _ in range(300))
    u = t[:140] + "c" + t[141:]
    p, q = (op1.Prefix(np.frombuffer(x.encode("utf-32-le"), np.uint32)) for x in (t, u))
    for _ in range(500):
        n = rng.randint(1, 8)
        i, j = rng.randrange(300 - n), rng.randrange(300 - n)
        same = p.spans(np.array([i]), np.array([i + n]))[0] == q.spans(np.array([j]), np.array([j + n]))[0]
        assert same == (t[i : i + n] == u[j : j + n])
    assert p.common_extension(0, q, 0) == 140 and p.common_extension(141, q, 141) == 159 and p.common_suffix(q) == 159


def plain_fingerprint(text, width=12, bins=128):
    """Span by span in plain integers: polynomial values under two bases, mixed, the least of each range or of the next that has one."""
    codes = [ord(c) + 1 for c in text]
    w = min(width, len(codes))
    values = []
    for i in range(len(codes) - w + 1 if codes else 0):
        value = 0
        for base in (1_103_515_245, 1_566_083_941):
            value = value << 31 | sum(c * pow(base, j, 2**31 - 1) for j, c in enumerate(codes[i : i + w])) % (2**31 - 1)
        x = value * 0x9E3779B97F4A7C15 % 2**64
        values.append((x ^ x >> 29) * 0xBF58476D1CE4E5B9 % 2**64)
    out = b""
    for n in range(bins):
        least = min((v for v in values if v >= n * (2**64 // bins)), default=min(values, default=0))
        out += ((least ^ least >> 24 ^ least >> 41) & 0xFFFF).to_bytes(2, "big")
    return out.hex()


def brute_fingerprints(docs):
    signed = lambda t: (h := xxhash.xxh64_intdigest((t or "").encode(), 42)) - (h >> 63 << 64)
    docs = sorted(docs, key=lambda d: (NULL_ID if d[0] is None else d[0], signed(d[1])))
    mark = cache(plain_fingerprint)
    like = lambda a, b, x, y: float((not x) == (not y)) and sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 512, 4)) / 128
    out = []
    for n, (i, t) in enumerate(docs):
        later = docs[n + 1 :]
        t, nxt = t or "", (later[0] if later else docs[0])[1] or ""
        e = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = mark(t), mark(e), mark(nxt)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, like(a, b, t, e), like(a, c, t, nxt)))
    return out


def key(r):
    return tuple(map(str, r))


def test_fingerprints(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r)[:7] for r in op1.op1_prefix_fingerprints(spark, sf).collect()]
    assert sorted(got, key=key) == sorted(brute_fingerprints(docs), key=key)
    near = [r[5] for r in got if r[1] > 200]
    assert 0.45 < sum(near) / len(near) < 0.8


def test_fingerprints_of_many_rows_without_ids(spark, monkeypatch):
    """A third of the rows without an id and a third of one id are dealt out over many ranges."""
    rng = random.Random(6)
    made = [(None if i % 3 == 0 else 5 if i % 3 == 1 else i, "".join(rng.choice("abc ") for _ in range(rng.randint(0, 30)))) for i in range(900)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in made], EMPTY).repartition(3)
    got = [tuple(r)[:7] for r in op1.fingerprints(docs).collect()]
    assert sorted(got, key=key) == sorted(brute_fingerprints(made), key=key)
    sizes = [r["count"] for r in op1.neighbours(docs).filter("not copy").groupBy("bucket").count().collect()]
    assert len(sizes) > 100 and max(sizes) < 300


def test_range_numbers(spark):
    from pyspark.sql import functions as F

    for bounds in ([], [3], [1, 4], list(range(0, 50, 3)), [-(2**63), 5, 2**62]):
        out = spark.range(-3, 60).select("id", op1.range_number(F.col("id"), bounds).alias("n")).collect()
        assert all(r.n == sum(b <= r.id for b in bounds) for r in out)


def test_fingerprints_of_odd_tables(spark):
    made = rows(TEXTS) + [(None, "no id", "", ""), (3, "an id twice", "", "")]
    got = [tuple(r)[:7] for r in op1.fingerprints(spark.createDataFrame(made, EMPTY)).collect()]
    assert sorted(got, key=key) == sorted(brute_fingerprints([r[:2] for r in made]), key=key)
    assert op1.fingerprints(spark.createDataFrame([], EMPTY)).count() == 0
    (one,) = op1.fingerprints(spark.createDataFrame(rows(["alone in the table"]), EMPTY)).collect()
    assert one.near_next == 1.0


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op8.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_the_library(spark, sf, library):
    rng = random.Random(2)
    odd = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FF), rng.randrange(0x3000, 0x30FF), rng.randrange(0x1F600, 0x1F640), 9, 10, 0x85, 0xA0, 0x1C, 0x2028])) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    odd += ["a" * 3000, "ab" * 500, "1234567890" * 60, " " * 500, *[t or "" for t in TEXTS]]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + list(enumerate(odd, 10_000)) + [(None, None)]
    got = {r.doc_id: r for r in op8.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert op8.digests(spark.createDataFrame([], EMPTY)).count() == 0


def test_some_words_need_merging(library):
    t = op8.tokenizer(op8.default_path())
    words = [" " + "".join(random.Random(i).choices("thersionadg", k=9)) for i in range(500)]
    proposed = [t.propose(w.encode()) for w in words]
    exact = [t.merge(w.encode()) for w in words]
    assert any(p != e for p, e in zip(proposed, exact)) and any(p == e for p, e in zip(proposed, exact))
    t.learn(words)
    assert [t.words[w] for w in words] == exact
    assert all(t.merge_long([bytes([b]) for b in w.encode()]) == e for w, e in zip(words, exact))


def test_media(spark):
    got = {r.doc_id: r for r in op10.features(op10.stored(spark.createDataFrame(rows(TEXTS), EMPTY))).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        padded = raw + b"\0" * (max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[4].feature == got[5].feature and got[4].media_sha256 == got[5].media_sha256
    assert op10.features(op10.stored(spark.createDataFrame([], EMPTY))).count() == 0


def paeth(a, b, c):
    p = a + b - c
    return min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]


def test_png_reader_undoes_every_filter():
    rng = np.random.default_rng(3)
    rows_ = rng.integers(0, 256, (12, 15), dtype=np.uint8)
    for step in (1, 3):
        raw = np.zeros((12, 16), np.uint8)
        for y in range(12):
            kind = [0, 1, 2, 3, 4, 4, 3, 2, 2, 1, 1, 4][y]
            raw[y, 0] = kind
            for x in range(15):
                a = int(rows_[y, x - step]) if x >= step else 0
                b = int(rows_[y - 1, x]) if y else 0
                c = int(rows_[y - 1, x - step]) if y and x >= step else 0
                raw[y, x + 1] = (int(rows_[y, x]) - (0, a, b, (a + b) // 2, paeth(a, b, c))[kind]) % 256
        assert (op10.unfilter(raw, step) == rows_).all()
    png = op10.write_png(rows_)
    assert (op10.read_png(png) == rows_).all()
    with pytest.raises(ValueError):
        op10.read_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])
    with pytest.raises(ValueError):
        op10.read_png(png[:-5])


def test_frequency_hash_equals_a_plain_version():
    """Row averages to 32 x 32, then sums of cosines one by one."""
    import math

    rng = np.random.default_rng(3)
    for shape in ((1, 64), (5, 64), (40, 64), (200, 64)):  # real pictures: equal frequencies by symmetry could round either way
        pixels = rng.integers(0, 256, shape, dtype=np.uint8)
        small = op10.shrunk(op10.shrunk(pixels.astype(float), 32).T, 32).T
        assert small.shape == (32, 32)
        wave = [[sum(small[y][x] * math.cos(math.pi * (2 * x + 1) * u / 64) for x in range(32)) for u in range(8)] for y in range(32)]
        low = [[sum(wave[y][u] * math.cos(math.pi * (2 * y + 1) * v / 64) for y in range(32)) for u in range(8)] for v in range(8)]
        flat = [round(x, 6) for row in low for x in row]
        middle = sorted(flat[1:])[31]
        assert op10.frequency_hash(pixels) == f"{int(''.join('1' if x > middle else '0' for x in flat), 2):016x}"
