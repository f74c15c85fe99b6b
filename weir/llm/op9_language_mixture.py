"""Language ID as multilingual mixture inference.

Each language has a trigram distribution over hashed code-point trigrams of its training texts (all of them,
counted in Spark). A document is a mixture of languages: expectation-maximisation estimates the proportions from
the trigrams' likelihoods, iterated until no proportion moves by more than a tolerance. The language set grows from the best single language, by
the one with the largest proportion among those left, as long as the likelihood gains
more than a penalty for each further language; nothing else bounds it. The prediction is the language of the largest proportion; the score
is that proportion times its posterior against the others as single languages.

Defined results: a text without a letter, null or empty is `und` with score 0; so is every text if nothing was
learned. Ties go to the language that sorts first. Rows that repeat a doc_id, or have none, get one row each. Other columns pass through, whatever their
names; columns named like the added ones are replaced. A text has at most BUCKETS distinct trigrams, however long it is.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import fresh, held_out, table, whole_text

#: Most languages that a model may hold: it is kept on the driver and broadcast, LANGUAGES x BUCKETS numbers at most.
LANGUAGES = 256
BUCKETS = 1 << 15
UNDETERMINED = "und"
#: Numbers (languages x trigrams) that are inferred at once; a single text may have more.
AT_ONCE = 2_000_000


@cache
def letters() -> np.ndarray:
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def trigrams(text: str) -> np.ndarray:
    """Buckets of the code-point trigrams of lower-cased letters, with one blank for each run of anything else; empty without letters."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    c = np.where(letter, codes, np.uint32(32))[keep].astype(np.uint64)
    if len(c) < 3:
        c = np.append(c, np.full(3 - len(c), 32, np.uint64))
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1]) * np.uint64(0x85EBCA77) + c[2:]
    return (((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49)).astype(np.int64)


def learn(docs: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their bucket probabilities, from text and lang of the training folds."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = docs.filter(F.col("lang").isNotNull() & ~held_out()).select("lang", whole_text().alias("text"))
    counts = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).limit(LANGUAGES + 1).collect()  # at most BUCKETS entries each
    if len(got) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the model would not be bounded")
    got.sort(key=lambda r: r.lang)
    p = np.full((len(got), BUCKETS), smoothing)
    for i, r in enumerate(got):
        p[i, r.bucket] += r.n
    return [r.lang for r in got], p / p.sum(1, keepdims=True)


def proportions(like: np.ndarray, counts: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """EM over many documents at once: proportions (languages x documents) and log-likelihoods.

    like: likelihood of each (document, trigram) entry by language; doc: its document, ascending; allowed: mask. A document is done when no
    proportion of its moves by more than the tolerance.
    """
    pi = allowed / np.maximum(allowed.sum(0), 1)
    starts = np.searchsorted(doc, np.arange(n_docs))
    total = np.maximum(np.add.reduceat(counts, starts), 1)
    live = np.arange(n_docs)
    some, n, at, first = like, counts, doc, starts
    while len(live):
        part = pi[:, live][:, at] * some
        part *= n / part.sum(0)
        new = np.add.reduceat(part, first, axis=1) / total[live]
        moved = np.abs(new - pi[:, live]).max(0) > tolerance
        pi[:, live] = new
        if moved.sum() <= 0.7 * len(live):  # the others go on alone
            mine = moved[at]
            some, n, at = some[:, mine], n[mine], (np.cumsum(moved) - 1)[at[mine]]
            live = live[moved]
            first = np.searchsorted(at, np.arange(len(live)))
    return pi, np.add.reduceat(np.log((pi[:, doc] * like).sum(0)) * counts, starts)


def infer(texts: list[str], p: np.ndarray, penalty: float = 4.0, tolerance: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """For each text the index of its main language (-1: none) and the score."""
    best, score = np.full(len(texts), -1), np.zeros(len(texts))
    held: list[tuple[int, np.ndarray, np.ndarray]] = []
    size = 0
    for i, t in enumerate(texts):
        b, n = np.unique(trigrams(t), return_counts=True)
        if len(b) and len(p):
            if held and (size + len(b)) * len(p) > AT_ONCE:
                settle(held, p, penalty, tolerance, best, score)
                held, size = [], 0
            held.append((i, b, n))
            size += len(b)
    if held:
        settle(held, p, penalty, tolerance, best, score)
    return best, score


def settle(held: list[tuple[int, np.ndarray, np.ndarray]], p: np.ndarray, penalty: float, tolerance: float, best: np.ndarray, score: np.ndarray) -> None:
    """infer() for texts given by place, distinct buckets and counts; writes into best and score."""
    live = np.array([i for i, _, _ in held])
    n_lang, n = len(p), len(held)
    doc = np.repeat(np.arange(n), [len(b) for _, b, _ in held])
    counts = np.concatenate([c for _, _, c in held]).astype(float)
    like = p[:, np.concatenate([b for _, b, _ in held])]
    starts = np.searchsorted(doc, np.arange(n))
    single = np.add.reduceat(np.log(like) * counts, starts, axis=1)
    main = single.argmax(0)
    ll = single[main, np.arange(n)]
    posterior = 1 / np.exp(single - ll).sum(0)
    chosen = np.zeros((n_lang, n))
    chosen[main, np.arange(n)] = 1
    pi = chosen.copy()
    full, full_ll = proportions(like, counts, doc, n, np.ones((n_lang, n)), tolerance)
    price = penalty * np.log1p(np.add.reduceat(counts, starts))
    trying = np.flatnonzero(full_ll - ll > price)  # no set has a greater likelihood than all languages
    for _ in range(1, n_lang):
        if not len(trying):
            break
        wider = chosen[:, trying].copy()
        left = np.where(wider > 0, -1, full[:, trying])
        wider[left.argmax(0), np.arange(len(trying))] = 1
        mine = np.isin(doc, trying)
        got, got_ll = proportions(like[:, mine], counts[mine], np.searchsorted(trying, doc[mine]), len(trying), wider, tolerance)
        better = got_ll - ll[trying] > price[trying]
        kept = trying[better]
        chosen[:, kept], pi[:, kept], ll[kept] = wider[:, better], got[:, better], got_ll[better]
        trying = kept
    top = pi.argmax(0)
    best[live] = top
    score[live] = np.clip(pi[top, np.arange(n)] * np.where(chosen.sum(0) > 1, 1, posterior), 0, 1)


def identified(docs: DataFrame, smoothing: float = 0.5, penalty: float = 4.0, tolerance: float = 1e-3) -> DataFrame:
    """docs with _held_out, _lang_pred, _score; learned from docs itself."""
    langs, p = learn(docs, smoothing)
    model = docs.sparkSession.sparkContext.broadcast(p)  # at most LANGUAGES x BUCKETS
    (text,) = fresh(docs, "text")
    kept = [c for c in docs.columns if c.lower() not in ("_held_out", "_lang_pred", "_score")]
    rows = docs.select(*["`" + c.replace("`", "``") + "`" for c in kept], held_out().alias("_held_out"), whole_text().alias(text))
    schema = StructType([*rows.drop(text).schema.fields, StructField("_lang_pred", StringType()), StructField("_score", DoubleType())])

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 128):
                part = b.slice(lo, 128)
                best, score = infer(part.column(part.num_columns - 1).to_pylist(), model.value, penalty, tolerance)
                names = pa.array([langs[i] if i >= 0 else UNDETERMINED for i in best], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], names, pa.array(score)], schema.names)

    return rows.mapInArrow(run, schema)


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identified(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).drop("text", "lang")
    return out.select("doc_id", F.col("_held_out").alias("held_out"), F.col("_lang_pred").alias("lang_pred"), F.col("_score").alias("score"))


QUERIES = {"op9_language_mixture": op9_language_mixture}
ORACLE_SQL: dict[str, str] = {}
