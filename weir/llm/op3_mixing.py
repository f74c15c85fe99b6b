"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed over the cells source x language x topic. Raking scales the cells until their marginals
meet the targets, each cell bounded by the tokens that it has: a cell that would give more than all its documents stays at that bound while the
others are raked on. A document is drawn with its cell's calibrated probability, the raked tokens over the cell's own.

Targets may be given. By default they follow from the counts: the share of each category to the power `temper`, as far as the
category's tokens reach at the rate of drawing, and as far as they can be met together with the dimensions before (source, language, topic): of the
steps from the share that those leave to the wish, the last that raking meets. Categories beyond the `most` with the most tokens are one, "other", so the number of cells is bounded and
not by the data: the cells, not the documents, are raked on the driver. Topics are clusters of texts: spherical k-means of hashed words, fitted
on all texts, each as often as it occurs. Their vectors are written once, with their rows (`counted`); clusters, counts and cells come from these, not from the texts
again. Each round sums vectors in whole numbers, so the order of tasks does not matter. The draw hashes the doc_id, so it is the same on any cluster.

Defined results: null text has no tokens; null source or language counts as "other". A target of a category
without tokens is dropped and the rest scaled to 1. A document without tokens has the overall rate. Texts without words have the topic "none".
Rows that repeat a doc_id are drawn together; rows without a doc_id by their text. Columns of docs named like the added ones are replaced; others pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import fresh, table, utf8, whole_text, written

OTHER = "other"
NO_TOPIC = "none"
BUCKETS = 4096
#: Texts that are looked at together.
SLICE = 256
DIMENSIONS = ("source", "lang", "topic")
ADDED = ("_tokens", "_source", "_lang", "_topic", "_probability", "_drawn")


@dataclass(frozen=True)
class Targets:
    """Shares of tokens by category, where given; OTHER may be among the categories. `rate`: share of all tokens to draw."""

    source: dict[str, float] | None = None
    lang: dict[str, float] | None = None
    topic: dict[str, float] | None = None
    rate: float = 0.5
    temper: float = 0.7
    most: int = 40
    rounds: int = 2000
    tolerance: float = 1e-9


@dataclass(frozen=True)
class Mixture:
    """Probability by cell, and by dimension and category the share wanted and the share reached in expectation."""

    categories: tuple[tuple[str, ...], ...]
    probability: dict[tuple[str, str, str], float]
    wanted: tuple[dict[str, float], ...]
    reached: tuple[dict[str, float], ...]


def word_buckets(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct (text, bucket of words): the text, the bucket, the count. Memory is some times that of the texts."""
    data, offsets = utf8(text)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends, at = spans.word_bounds(data, offsets)
    bucket = (spans.word_values(data, starts, ends) >> np.uint64(52)).astype(np.int64)
    pair, n = np.unique(np.repeat(np.arange(len(text)), np.diff(at)) * BUCKETS + bucket, return_counts=True)
    return pair // BUCKETS, pair % BUCKETS, n


def vectors(text: pa.Array) -> pa.Array:
    """Of each text the number of its words, the buckets of these (16 bits each) and the buckets' counts (32 bits each)."""
    out = []
    for lo in range(0, len(text), SLICE):
        doc, bucket, n = word_buckets(part := text.slice(lo, SLICE))
        at = np.append(0, np.cumsum(np.bincount(doc, minlength=len(part))))
        words = np.diff(np.append(0, np.cumsum(n))[at])
        packed = [pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(x.astype(kind))]) for x, kind, width in ((bucket, "<u2", 2), (n, "<u4", 4))]
        out.append(pa.StructArray.from_arrays([pa.array(words, pa.int64()), *packed], ["n", "buckets", "counts"]))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([("n", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary())]))


VECTOR = "n long, buckets binary, counts binary"
VECTORS = "h long, buckets binary, counts binary"
#: Sums are of whole numbers of this part of a vector's length.
UNIT = 1 << 30
#: Sums that travel together.
PIECE = 1024


def _unpacked(buckets: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's buckets start (one more at the end), the buckets and the counts."""
    data, at = utf8(buckets)
    n, ends = utf8(counts)
    return (at - at[0]) // 2, data[at[0] : at[-1]].view("<u2").astype(np.int64), n[ends[0] : ends[-1]].view("<u4")


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of vectors, some at a time; where each row's buckets start (one more at the end), the buckets and the counts."""
    for b in batches:
        for lo in range(0, len(b), SLICE):
            some = b.slice(lo, SLICE)
            yield some, *_unpacked(some["buckets"], some["counts"])


def _unit(at: np.ndarray, bucket: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The values of vectors of length 1."""
    x = np.sqrt(n) * idf[bucket]
    return x / np.repeat(np.sqrt(np.add.reduceat(x * x, at[:-1])), np.diff(at))


def _likeness(at: np.ndarray, bucket: np.ndarray, x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Vectors x centroids; each value follows from its own vector alone. No vector is empty."""
    return np.stack([np.add.reduceat(c[bucket] * x, at[:-1]) for c in centroids], axis=1)


def _chance(h: np.ndarray, turn: int) -> np.ndarray:
    """A number above 0 and under 1 for each hash and turn."""
    z = h.view(np.uint64) + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(12)).astype(np.float64) / 2**52 + 2**-54


@dataclass(frozen=True)
class Topics:
    """idf by bucket and centroids (clusters x buckets)."""

    idf: np.ndarray
    centroids: np.ndarray

    def of(self, text: pa.Array) -> pa.Array:
        v = vectors(text)
        return self.of_vectors(v.field("buckets"), v.field("counts"))

    def of_vectors(self, buckets: pa.Array, counts: pa.Array) -> pa.Array:
        return pa.concat_arrays([self._of(buckets.slice(lo, SLICE), counts.slice(lo, SLICE)) for lo in range(0, len(buckets), SLICE)] or [pa.array([], pa.string())])

    def _of(self, buckets: pa.Array, counts: pa.Array) -> pa.Array:
        at, bucket, n = _unpacked(buckets, counts)
        out = np.full(len(buckets), NO_TOPIC, object)
        some = np.flatnonzero(np.diff(at))
        if len(some) and len(self.centroids):
            x = np.sqrt(n, dtype=np.float32) * self.idf[bucket]
            best = _likeness(np.append(at[some], len(bucket)), bucket, x, self.centroids).argmax(1)
            out[some] = [f"topic{i}" for i in best]
        return pa.array(out, pa.string())


@dataclass(frozen=True)
class Counted:
    """Rows without their text, and under `names` what mixing needs of it: its hash, the parts of its vector and the number that the row's chance is held against."""

    rows: DataFrame
    names: dict[str, str]

    def __getitem__(self, name: str) -> Column:
        return F.col(self.names[name])


def counted(docs: DataFrame) -> Counted:
    """One pass over the texts, whose outcome is written."""
    at = dict(zip(("h", "n", "buckets", "counts", "u"), fresh(docs, "h", "n", "buckets", "counts", "u"), strict=True))
    kept = ["`" + c.replace("`", "``") + "`" for c in docs.columns if c.lower() != "text"]
    low = F.lower(whole_text())
    vector = F.arrow_udf(vectors, VECTOR)(low)
    rows = docs.select(*kept, F.xxhash64(low).alias(at["h"]), vector.alias(at["n"]), draw().alias(at["u"]))
    return Counted(written(rows.select(*kept, at["h"], *[F.col(at["n"])[k].alias(at[k]) for k in ("n", "buckets", "counts")], at["u"])), at)


def draw() -> Column:
    """At least 0 and under 1, by the doc_id or else the text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), whole_text())), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


#: Texts that are expected among the first for each start.
EARLY = 64


def learn_topics(docs: DataFrame | Counted, clusters: int = 8, rounds: int = 20) -> Topics:
    """From all texts: each start is drawn by its distance from those before (k-means++, by hashes); rounds end when no centroid changes."""
    seen = docs if isinstance(docs, Counted) else counted(docs.select(F.lit(0).alias("doc_id"), "text"))
    held = seen.rows.filter(seen["n"] > 0).select(*[seen[k].alias(k) for k in ("h", "buckets", "counts")])

    def summed(f: Callable, size: int) -> np.ndarray:
        """The sum of f's whole numbers over all parts."""

        def run(batches):
            out = np.zeros(-(-size // PIECE) * PIECE, np.int64)
            for x in _parts(batches):
                out[:size] += f(*x)
            some = np.flatnonzero(out.reshape(-1, PIECE).any(1))
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([out[i * PIECE : (i + 1) * PIECE].tobytes() for i in some], pa.binary())], ["i", "n"])

        def added(piece: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = np.zeros(PIECE, np.int64)
            for b in batches:
                for x in b["n"]:
                    n += np.frombuffer(x.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([piece[0].as_py()]), pa.array([n.tobytes()], pa.binary())], ["i", "n"])

        got = held.mapInArrow(run, "i long, n binary").groupBy("i").applyInArrow(added, "i long, n binary").toArrow()
        out = np.zeros((-(-size // PIECE), PIECE), np.int64)
        for i, n in zip(got["i"].to_pylist(), got["n"].to_pylist(), strict=True):
            out[i] = np.frombuffer(n, np.int64)
        return out.reshape(-1)[:size]

    texts = summed(lambda some, at, bucket, n: np.append(np.bincount(bucket, minlength=BUCKETS), len(some)), BUCKETS + 1)
    idf = np.log((1 + texts[-1]) / (1 + texts[:-1])) + 0.1
    centroids = np.zeros((0, BUCKETS))

    def scored(some: pa.RecordBatch, at: np.ndarray, bucket: np.ndarray, n: np.ndarray, now: np.ndarray) -> np.ndarray:
        """The text with the least of these is the next start; infinite for those like one of those now."""
        far = 1 - _likeness(at, bucket, _unit(at, bucket, n, idf), now).max(1) if len(now) else np.ones(len(some))
        return np.where(far > 1e-9, -np.log(_chance(some["h"].to_numpy(), len(now))) / np.maximum(far, 1e-9), np.inf)

    def start(now: np.ndarray) -> pa.RecordBatch | None:
        """The next start of all texts, one that is like none of those now; None if there is none."""

        def run(batches):
            for some, at, bucket, n in _parts(batches):
                score = scored(some, at, bucket, n, now)
                i = int(score.argmin())
                yield pa.RecordBatch.from_arrays([pa.array([score[i]]), *(c.slice(i, 1) for c in some.columns)], ["score", *some.schema.names])

        first = held.mapInArrow(run, f"score double, {VECTORS}").filter("score < double('Infinity')").orderBy("score", "h").limit(1).toArrow()
        return next(iter(first.drop_columns("score").to_batches()), None)

    least = EARLY / max(int(texts[-1]), 1)

    def early(batches):
        """A text's score is at least -log of its chance, since none is farther than 1: the distinct texts for which that is under `least` for some start."""
        for some, *_ in _parts(batches):
            h = some["h"].to_numpy()
            hit = np.flatnonzero(np.any([-np.log(_chance(h, turn)) < least for turn in range(clusters)], axis=0))
            yield some.take(pa.array(hit[np.unique(h[hit], return_index=True)[1]]))

    first = held.mapInArrow(early, VECTORS).dropDuplicates(["h"]).orderBy("h").toArrow() if clusters else None
    while len(centroids) < clusters:
        tried = [(score[i], some.slice(i, 1)) for some, *v in _parts(first.to_batches()) for score in [scored(some, *v, centroids)] for i in [int(score.argmin())]]
        score, best = min(tried, key=lambda x: x[0], default=(np.inf, None))
        if not score < least:  # a text that is not among the first may have less
            best = start(centroids)
        if best is None:
            break
        _, at, bucket, n = next(_parts([best]))
        centroids = np.vstack([centroids, np.zeros(BUCKETS)])
        centroids[-1, bucket] = _unit(at, bucket, n, idf)
    for _ in range(rounds if len(centroids) else 0):

        def members(some, at, bucket, n, now=centroids):
            x = _unit(at, bucket, n, idf)
            mine = np.repeat(_likeness(at, bucket, x, now).argmax(1), np.diff(at))
            return np.bincount(mine * BUCKETS + bucket, np.rint(x * UNIT), now.size).astype(np.int64)

        sums = summed(members, centroids.size).reshape(-1, BUCKETS) / UNIT
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        old, centroids = centroids, np.where(length > 0, sums / np.maximum(length, 1e-9), centroids)
        if np.array_equal(old, centroids):
            break
    return Topics(idf.astype(np.float32), centroids.astype(np.float32))


def tempered(share: dict[str, float], temper: float, rate: float) -> dict[str, float]:
    """Targets in proportion to the shares to a power, none above what its category has at that rate."""
    names = [k for k, v in share.items() if v > 0]
    if not names:
        return {}
    have = np.array([share[k] for k in names])
    bound, want = have / rate, have**temper
    out = np.zeros(len(names))
    free = np.ones(len(names), bool)
    while True:
        out[free] = want[free] * (1 - out[~free].sum()) / want[free].sum() if free.any() else 0
        over = free & (out > bound)
        if not over.any():
            return dict(zip(names, out.tolist(), strict=True))
        out[over] = bound[over]
        free &= ~over


def scale(w: np.ndarray, most: np.ndarray, want: float) -> float:
    """The factor f with sum(min(f * w, most)) = want; without one, that at which every cell is at its bound."""
    order = np.argsort(most / w, kind="stable")
    w, most = w[order], most[order]
    full = np.append(0.0, np.cumsum(most))[:-1]
    rest = np.cumsum(w[::-1])[::-1]
    f = (want - full) / rest  # if the cells before are at their bounds
    fits = np.flatnonzero(f * w <= most)
    return float(max(f[fits[0]], 0.0)) if len(fits) else float((most / w).max())


def rake(cells: dict[tuple, float], targets: list[dict[str, float]], rate: float, rounds: int, tolerance: float) -> tuple[dict[tuple, float], list[dict[str, float]], list[dict[str, float]]]:
    """Probability by cell such that each dimension's expected tokens are in proportion to its targets and `rate` of all; wanted and reached shares.

    targets: of the cells' first dimensions, in their order. This minimises the divergence from equal probabilities under the marginals and the bound of 1.
    """
    keys = [k for k, v in cells.items() if v > 0]
    if not keys:
        return {}, [{} for _ in targets], [{} for _ in targets]
    most = np.array([cells[k] for k in keys], float)
    most /= most.sum()
    dims, wanted = [], []
    for d, target in enumerate(targets):
        names = sorted({k[d] for k in keys})
        want = np.array([target.get(n, 0.0) for n in names])
        if want.sum() <= 0:
            raise ValueError("no target category has tokens")
        want = want / want.sum()
        dims.append(([np.flatnonzero([k[d] == n for k in keys]) for n in names], want * rate))
        wanted.append(dict(zip(names, want.tolist(), strict=True)))
    w = most * rate
    for _ in range(rounds):
        worst = 0.0
        for at, want in dims:
            for rows, x in zip(at, want, strict=True):
                live = rows[w[rows] > 0]
                worst = max(worst, abs(float(np.minimum(w[rows], most[rows]).sum()) - min(x, float(most[live].sum()))))
                if len(live):
                    w[live] *= scale(w[live], most[live], x)
        if worst < tolerance or (w > 1e12 * most).any():  # beyond that no weights can meet the targets together
            break
    x = np.minimum(w, most)
    reached = [dict(zip(names, [float(x[rows].sum() / max(x.sum(), 1e-300)) for rows in at], strict=True)) for names, (at, _) in zip(wanted, dims, strict=True)]
    return dict(zip(keys, (x / most).tolist(), strict=True)), wanted, reached


def attainable(cells: dict[tuple, float], before: list[dict[str, float]], targets: Targets, steps: int = 8) -> dict[str, float]:
    """Shares of the next dimension, from what the ones before leave it towards the tempered wish, as far as all are met."""
    d, every = len(before), max(sum(cells.values()), 1.0)
    chance = rake(cells, before, targets.rate, targets.rounds, targets.tolerance)[0] if before else {k: targets.rate for k in cells}
    have, left = {}, {}
    for k, v in cells.items():
        have[k[d]] = have.get(k[d], 0.0) + v / every
        left[k[d]] = left.get(k[d], 0.0) + v * chance.get(k, targets.rate)
    drawn = sum(left.values())
    wish = tempered(have, targets.temper, targets.rate)
    for step in range(steps, 0, -1):
        aim = {k: (1 - step / steps) * left[k] / drawn + step / steps * x for k, x in wish.items()}
        _, wanted, reached = rake(cells, [*before, aim], targets.rate, targets.rounds // 4, 1e-6)
        if all(abs(w[k] - r[k]) < 1e-4 for w, r in zip(wanted, reached, strict=True) for k in w):
            return aim
    return {k: x / drawn for k, x in left.items() if x > 0} if drawn else {}


def tokens(docs: DataFrame | Counted) -> Column:
    return docs["n"] if isinstance(docs, Counted) else F.regexp_count(whole_text(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def known(c: Column, categories) -> Column:
    return F.when(c.isin(*categories), c).otherwise(F.lit(OTHER)) if categories else F.lit(OTHER)


#: Topics by plain phrases, the first that occurs: for runs that can spare no Python workers.
PHRASES = {"legal": ("licensed under", "rights reserved", "Copyright"), "credentials": ("[SECRET]", "password=", "AKIA", "api_key"), "contact": ("@",)}


def topic_column(docs: DataFrame | Counted, topics: Topics | dict[str, tuple[str, ...]]) -> Column:
    """The cluster of a text, or the first topic of which a phrase occurs in it ("general" if none does; phrases ask for texts)."""
    if isinstance(docs, Counted):
        if isinstance(topics, dict):
            raise ValueError("counted rows have no texts to look for phrases in")
        return F.arrow_udf(topics.of_vectors, "string")(docs["buckets"], docs["counts"])
    if isinstance(topics, dict):
        out = F.lit("general")
        for name, phrases in reversed(topics.items()):
            hit = F.lit(False)
            for p in phrases:
                hit = hit | whole_text().contains(p)
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out
    return F.arrow_udf(topics.of, "string")(F.lower(whole_text()))


def fit(docs: DataFrame | Counted, targets: Targets, topics: Topics | dict[str, tuple[str, ...]]) -> Mixture:
    """One pass over the tokens by source, language and topic."""
    rows = docs.rows if isinstance(docs, Counted) else docs
    dims = rows.select(tokens(docs).alias("n"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic_column(docs, topics).alias("topic"))
    given = [getattr(targets, d) for d in DIMENSIONS]
    counts = dims.groupBy(*DIMENSIONS).agg(F.sum("n").alias("n"))
    if any(g is None for g in given[:2]):  # as many rows as there are sources, languages and topics together
        counts = counts.persist()
    categories = []
    for d, g in zip(DIMENSIONS, given, strict=True):
        top = [r[0] for r in counts.filter(F.col(d).isNotNull()).groupBy(d).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), d).limit(targets.most).collect()] if g is None else list(g)
        categories.append(tuple(c for c in top if c != OTHER))
    if (bound := np.prod([len(c) + 1 for c in categories])) > 100_000:
        raise ValueError(f"{bound} cells: use fewer target categories")
    placed = counts.select(*[known(F.col(d), c).alias(d) for d, c in zip(DIMENSIONS, categories, strict=True)], "n").groupBy(*DIMENSIONS).agg(F.sum("n").alias("n"))
    cells = {tuple(r[d] for d in DIMENSIONS): float(r.n) for r in placed.collect()}
    counts.unpersist()
    wants: list[dict[str, float]] = []
    for g in given:
        wants.append(attainable(cells, wants, targets) if g is None else g)
    chance, wanted, reached = rake(cells, wants, targets.rate, targets.rounds, targets.tolerance)
    return Mixture(tuple(categories), {k: chance.get(k, targets.rate) for k in cells}, tuple(wanted), tuple(reached))


def mixed(docs: DataFrame | Counted, targets: Targets | None = None, topics: Topics | dict[str, tuple[str, ...]] | None = None, mixture: Mixture | None = None) -> DataFrame:
    """docs with _tokens, _source, _lang, _topic, _probability, _drawn; of counted ones, their rows."""
    targets = targets or Targets()
    rows, own = (docs.rows, docs.names.values()) if isinstance(docs, Counted) else (docs, ())
    seen = docs
    if not topics:
        seen = docs if own else counted(docs.select(*[F.col(c).cast("string").alias(c) for c in ("doc_id", "source", "lang", "text")]))
        topics = learn_topics(seen)
    mixture = mixture or fit(seen, targets, topics)
    kept = [c for c in rows.columns if c.lower() not in ADDED and c not in own]
    key = fresh(rows, "s", "l", "t", "p", "r")
    cells = [(*k, p) for k, p in mixture.probability.items()]
    table_ = rows.sparkSession.createDataFrame(cells, ", ".join(f"{k} string" for k in key[:3]) + f", {key[3]} double")
    marked = rows.select(*["`" + c.replace("`", "``") + "`" for c in kept], tokens(docs).alias("_tokens"), known(F.col("source").cast("string"), mixture.categories[0]).alias("_source"), known(F.col("lang").cast("string"), mixture.categories[1]).alias("_lang"), topic_column(docs, topics).alias("_topic"), (docs["u"] if own else draw()).alias(key[4]))
    marked = marked.withColumn("_topic", known(F.col("_topic"), mixture.categories[2]))
    joined = marked.join(F.broadcast(table_), [F.col("_source") == F.col(key[0]), F.col("_lang") == F.col(key[1]), F.col("_topic") == F.col(key[2])], "left")  # at most as many rows as cells
    out = joined.withColumn("_probability", F.coalesce(key[3], F.lit(targets.rate))).withColumn("_drawn", F.col(key[4]) < F.col("_probability"))
    return out.drop(*key)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with its cell, its probability and its draw; by dimension, the share of tokens wanted and reached for its category."""
    docs = counted(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    targets, topics = Targets(), learn_topics(docs)
    mixture = fit(docs, targets, topics)
    out = mixed(docs, targets, topics, mixture).select("doc_id", F.col("_tokens").alias("n_tokens"), F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_probability").alias("probability"), F.col("_drawn").alias("drawn"))
    for d, wanted, reached in zip(DIMENSIONS, mixture.wanted, mixture.reached, strict=True):
        for name, shares in (("wanted", wanted), ("reached", reached)):
            pairs = [F.lit(x) for k, v in shares.items() for x in (k, v)]
            out = out.withColumn(f"{name}_{d}", F.create_map(*pairs)[F.col(d)] if pairs else F.lit(None).cast("double"))
    return out


QUERIES = {"op3_mixing": op3_mixing}
ORACLE_SQL: dict[str, str] = {}
