"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with block-max inverted indexes.

Terms are words and their beginnings of 4 and 5 characters. Examples are training documents: a sample of at most `examples`, half of them
toxic where there are enough (the least by a hash of their doc_id), none of over `longest` characters. The vocabulary is every term of the
examples; how many documents of either label hold a term is counted in Spark over all labelled training documents. A term's weight is
(1 + log tf) x idf x relevance, and vectors have length 1. relevance is the z-score of the term's log odds between the labels, with `prior` pseudo-documents
in the proportion of the labels; with relevance off it is 1, plain TF-IDF.

The index has for each term a posting list (example, weight) in the order of blocks of like examples, and for each block in it the list's greatest weight there.
A query's terms give from those maxima an upper bound on any cosine in each block. The blocks of the greatest bounds
are scored first; then only those whose bound reaches the k-th best cosine. So the neighbours are exact. Distance-weighted votes are
mapped to rates by a monotone step function fitted on the examples' own votes without themselves. Evidence is the list of the nearest examples' doc_ids.

Defined results: null text is empty; texts without a term of the vocabulary get the training rate of toxic documents. With labels of
one value only, or none, every score is that value, or 0. Ties of similarity go to the example that comes first in the index. Rows that repeat a doc_id get one row
each, and count each as a training document, toxic if any label of the doc_id says so. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, checkpoint, held_out, real_id, small, table, whole_text

WORD = re.compile(r"[^\W\d_]+")
#: Examples of a block.
BLOCK = 128
#: Terms of queries that are searched for at once; a single query may have more.
AT_ONCE = 20_000
#: Words whose terms a worker remembers; beyond it, it starts anew.
MEMORY = 500_000


def terms_of(word: str) -> tuple[str, ...]:
    if len(word) > 5:
        return word, word[:4] + "*", word[:5] + "*"
    return (word, word[:4] + "*") if len(word) > 4 else (word,)


def terms(text: str) -> dict[str, int]:
    """How often each word and, as separate terms, each beginning of a word occurs."""
    out: dict[str, int] = {}
    for w, c in Counter(WORD.findall(text.lower())).items():
        for t in terms_of(w):
            out[t] = out.get(t, 0) + c
    return out


def relevance_of(a: np.ndarray, m: np.ndarray, n0: float, n1: float, prior: float) -> np.ndarray:
    """|z| of each term's log odds; a of the m documents that hold it are toxic."""
    p1 = n1 / (n0 + n1)
    u, w = a + prior * p1, m - a + prior * (1 - p1)
    return np.abs(np.log(u / p1 / (w / (1 - p1)))) / np.sqrt(1 / u + 1 / w)


def expanded(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 ... of each slice, one slice after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Index:
    """Postings of the examples' terms with block maxima."""

    def __init__(self, vocabulary: list[str], weight: np.ndarray, ids: np.ndarray, labels: np.ndarray, example: np.ndarray, term: np.ndarray, tf: np.ndarray, k: int) -> None:
        """weight: of each term without its frequency. example, term, tf: the entries of the examples' vectors."""
        self.at = {t: i for i, t in enumerate(vocabulary)}
        self.weight, self.k, self.n = weight, k, len(ids)
        w = (1 + np.log(tf)) * weight[term]
        size = np.sqrt(np.bincount(example, w * w, self.n))
        w = w / np.maximum(size[example], 1e-300)
        # like examples stand together: by the term that is heaviest over the examples, then by the next
        worth = w * np.bincount(term, minlength=len(vocabulary))[term]
        heavy = np.lexsort((-worth, example))
        first = np.searchsorted(example[heavy], np.arange(self.n))
        lead = np.zeros((2, self.n), np.int64)
        for i in (0, 1):
            there = (first + i < len(heavy)) & (np.bincount(example, minlength=self.n) > i)
            lead[i, there] = term[heavy[first[there] + i]]
        order = np.lexsort((ids, lead[1], lead[0]))
        self.place = place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        self.ids, self.labels = ids[order], labels[order]
        example = place[example]
        by_term = np.lexsort((example, term))
        self.example, term, self.w = example[by_term], term[by_term], w[by_term]
        new = np.append(True, (term[1:] != term[:-1]) | (self.example[1:] // BLOCK != self.example[:-1] // BLOCK))[: len(term)]
        self.begin = np.append(np.flatnonzero(new), len(term))  # of each (term, block) in the postings
        self.block = self.example[self.begin[:-1]] // BLOCK
        self.most = np.maximum.reduceat(self.w, self.begin[:-1]) if len(term) else np.zeros(0)
        self.blocks_of = np.searchsorted(term[self.begin[:-1]], np.arange(len(vocabulary) + 1))
        self.forget()
        self.rate, self.steps, self.rates = 0.0, np.zeros(0), np.zeros(0)

    def vectors(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Term numbers and weights of each text, of length 1."""
        words = [Counter(WORD.findall(t.lower())) for t in texts]
        number = self.numbers([w for ws in words for w in ws])
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        times = np.fromiter((c for w in words for c in w.values()), np.int64, len(number))
        size = self.sizes[number]
        term = self.terms[expanded(self.begins[number], size)]
        width = max(len(self.weight), 1)
        pair, back = np.unique(np.repeat(owner, size) * width + term, return_inverse=True)
        tf = np.bincount(back, np.repeat(times, size), len(pair))
        ends = np.searchsorted(pair, np.arange(len(texts) + 1) * width)
        i = pair % width
        w = (1 + np.log(np.maximum(tf, 1))) * self.weight[i]
        return [self.unit(i[x:y], w[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def numbers(self, words: list[str]) -> np.ndarray:
        """A number for each word, under which its terms stand in begins, sizes and terms; new words are added."""
        got = list(map(self.known.get, words))
        if None in got:
            new = list(dict.fromkeys(w for w, n in zip(words, got, strict=True) if n is None))
            lists = [[self.at[t] for t in terms_of(w) if t in self.at] for w in new]
            # words without a term share number 0
            some = [(w, x) for w, x in zip(new, lists, strict=True) if x]
            self.known.update((w, 0) for w, x in zip(new, lists, strict=True) if not x)
            self.known.update((w, len(self.sizes) + i) for i, (w, _) in enumerate(some))
            self.begins = np.append(self.begins, len(self.terms) + np.cumsum([0] + [len(x) for _, x in some])[:-1])
            self.sizes = np.append(self.sizes, [len(x) for _, x in some]).astype(np.int64)
            self.terms = np.append(self.terms, [i for _, x in some for i in x]).astype(np.int64)
            got = list(map(self.known.get, words))
        return np.array(got, np.int64)

    def forget(self) -> None:
        """Starts the words that are remembered anew."""
        self.known: dict[str, int] = {}
        self.begins, self.sizes, self.terms = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def unit(i: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Without zeros and of length 1."""
        size = np.sqrt((w * w).sum())
        return (i[w > 0], w[w > 0] / size) if size > 0 else (i[:0], w[:0])

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], leave: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query (terms, weights) the k nearest examples with a cosine above 0: query numbers, example numbers and cosines, the nearest first; leave: for each query an example to pass over."""
        found, base, size = [], 0, 0
        for n in range(len(queries)):
            size += len(queries[n][0])
            if n + 1 == len(queries) or size + len(queries[n + 1][0]) > AT_ONCE:
                owner, which, cosine = self._nearest(queries[base : n + 1], leave[base : n + 1] if leave is not None else None)
                found.append((owner + base, which, cosine))
                base, size = n + 1, 0
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def _nearest(self, queries, leave):
        n, n_blocks = len(queries), max(-(-self.n // BLOCK), 1)
        i, w = (np.concatenate([q[x] for q in queries]) for x in (0, 1))
        owner = np.repeat(np.arange(n), [len(q[0]) for q in queries])
        size = self.blocks_of[i + 1] - self.blocks_of[i]
        lists = expanded(self.blocks_of[i], size)
        q, cell = np.repeat(w, size), np.repeat(owner * n_blocks, size) + self.block[lists]
        bound = np.bincount(cell, q * self.most[lists], n * n_blocks).reshape(n, n_blocks)

        def scored(visit: np.ndarray) -> np.ndarray:
            """The parts of the cosines that come from the blocks to visit, which are the whole cosines of their examples."""
            mine = np.flatnonzero(visit.reshape(-1)[cell])
            begin = self.begin[lists[mine]]
            many = self.begin[lists[mine] + 1] - begin
            at = expanded(begin, many)
            return np.bincount(np.repeat(cell[mine] // n_blocks * self.n, many) + self.example[at], np.repeat(q[mine], many) * self.w[at], n * self.n).reshape(n, self.n)

        def kth(cosine: np.ndarray) -> np.ndarray:
            return np.partition(cosine, -self.k, axis=1)[:, -self.k] if self.n > self.k else np.zeros(n)

        best = np.zeros((n, n_blocks), bool)
        best[np.arange(n), bound.argmax(1)] = True
        cosine = scored(best)
        if leave is not None:
            cosine[np.arange(n), leave] = 0
        cosine += scored(~best & (bound > 0) & (bound + 1e-6 >= kth(cosine)[:, None]))  # sums may be rounded
        if leave is not None:
            cosine[np.arange(n), leave] = 0
        row, which = np.nonzero((cosine > 0) & (cosine >= kth(cosine)[:, None]))
        got = cosine[row, which]
        order = np.lexsort((which, -got, row))
        row, which, got = row[order], which[order], got[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[keep], which[keep], got[keep]

    def votes(self, queries, leave=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query the share of weight that votes toxic (nan without a neighbour); and the neighbours."""
        row, which, cosine = self.nearest(queries, leave)
        weight = 1 / (1.05 - np.minimum(cosine, 1))
        total = np.bincount(row, weight, len(queries))
        return np.divide(np.bincount(row, weight * self.labels[which], len(queries)), total, out=np.full(len(queries), np.nan), where=total > 0), row, which

    def calibrate(self, rate: float, weights: np.ndarray, example: np.ndarray, term: np.ndarray, tf: np.ndarray, without: tuple[np.ndarray, np.ndarray]) -> None:
        """Pool-adjacent-violators over the examples' own votes, as if they were not among the training documents.

        weights, by label, undo the sample's balance; without: by the example's label, the terms' weights from counts without it.
        """
        self.rate = rate
        ends = np.searchsorted(example, np.arange(self.n + 1))
        labels, queries = self.labels[self.place], []
        for e in range(self.n):
            i = term[ends[e] : ends[e + 1]]
            w = (1 + np.log(tf[ends[e] : ends[e + 1]])) * without[labels[e]][i]
            queries.append(self.unit(i, w))
        vote = self.votes(queries, self.place.tolist())[0]
        votes = [(float(v), float(y), float(weights[y])) for v, y in zip(vote, labels, strict=True) if v == v]
        pools: list[list[float]] = []  # least vote, sum of labels, weight
        for v, label, weight in sorted(votes):
            pools.append([v, label * weight, weight])
            while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
                _, a, b = pools.pop()
                pools[-1] = [pools[-1][0], pools[-1][1] + a, pools[-1][2] + b]
        self.steps, self.rates = np.array([p[0] for p in pools]), np.array([(p[1] + 0.02) / (p[2] + 0.04) for p in pools])

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[int]]]:
        """A rate from 0 to 1 for each text, and its five nearest examples."""
        if not len(self.steps):
            return np.full(len(texts), self.rate), [[] for _ in texts]
        if len(self.known) > MEMORY:
            self.forget()
        vote, row, which = self.votes([v for lo in range(0, len(texts), 256) for v in self.vectors(texts[lo : lo + 256])])
        step = np.maximum(np.searchsorted(self.steps, vote, "right") - 1, 0)
        # a small share of the raw vote keeps the order within a step
        rated = np.clip(0.98 * self.rates[np.minimum(step, len(self.rates) - 1)] + 0.02 * vote, 0, 1)
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        return np.where(np.isnan(vote), self.rate, rated), [self.ids[which[a : min(a + 5, b)]].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def counted(labelled: DataFrame) -> DataFrame:
    """term, m: documents that hold it, a: toxic ones among them; over all rows."""

    def split(batches):
        sums: dict[str, list[int]] = {}

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([x[0] for x in sums.values()], pa.int64()), pa.array([x[1] for x in sums.values()], pa.int64())], ["term", "a", "m"])

        for b in batches:
            for toxic, text in zip(b["toxic"].to_pylist(), b["text"].to_pylist(), strict=True):
                for x in terms(text):
                    got = sums.setdefault(x, [0, 0])
                    got[0] += toxic
                    got[1] += 1
                if len(sums) > 100_000:
                    yield emit()
                    sums.clear()
        yield emit()

    return labelled.select("toxic", "text").mapInArrow(split, "term string, a long, m long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("m").alias("m"))


def fit(docs: DataFrame, labels: DataFrame, examples: int = 600, longest: int = 20_000, prior: float = 5.0, relevance: bool = True, k: int = 9) -> Index:
    """The index, from labelled rows of the training folds. The driver gets the vectors of at most `examples` texts of at most `longest` characters, and a row for each term of theirs."""
    here = docs.filter(~held_out() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    truth = labels.filter(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    labelled = here.join(small(checkpoint(truth)), "doc_id")  # read anew for each use: no text is shuffled or kept if the labels are few enough to broadcast
    totals = dict(labelled.groupBy("toxic").count().collect())
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    none = np.zeros(0, np.int64)
    if not n1 or not n0:
        index = Index([], np.zeros(0), none, none, none, none, none, k)
        index.rate = 1.0 if n1 else 0.0
        return index

    def weigh(batches):
        for b in batches:
            found = [terms(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["toxic"], pa.array([list(x) for x in found], pa.list_(pa.string())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "tf"])

    fitting = labelled.filter(F.length("text") <= longest)
    sides = [fitting.filter(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(examples // 2) for x in (0, 1)]
    drawn = checkpoint(sides[0].unionByName(sides[1]).mapInArrow(weigh, "doc_id long, toxic int, terms array<string>, tf array<int>"))
    got = drawn.toArrow().sort_by("doc_id").combine_chunks()
    wanted = drawn.select(F.explode("terms").alias("term")).distinct()
    stats = counted(labelled).join(wanted, "term", "left_semi").toArrow().sort_by("term").combine_chunks()
    a, m = (stats[c].to_numpy().astype(float) for c in ("a", "m"))
    vocabulary = stats["term"].to_pylist()

    def weight(a, m):
        w = (np.log((1 + n0 + n1) / (1 + m)) + 1) * (relevance_of(a, m, n0, n1, prior) if relevance else 1.0)
        return np.where(m > 0, w, 0.0)

    lists = got["terms"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.string()))
    sizes = np.nan_to_num(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    number = pa.compute.index_in(lists.flatten(), value_set=stats["term"]).to_numpy(zero_copy_only=False).astype(np.int64)
    tf = got["tf"].combine_chunks().flatten().to_numpy() if got.num_rows else none
    ids, toxic = got["doc_id"].to_numpy(), got["toxic"].to_numpy().astype(np.int64)
    entries = np.repeat(np.arange(len(ids)), sizes), number, tf
    index = Index(vocabulary, weight(a, m), ids, toxic, *entries, k)
    # a term that no example of a label holds is not asked for that label's weights
    index.calibrate(n1 / (n0 + n1), np.array([n0, n1]) / np.maximum(np.bincount(toxic, minlength=2), 1), *entries, (weight(a, np.maximum(m - 1, a)), weight(np.maximum(a - 1, 0), m - 1)))
    return index


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **kw) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from the threshold on), evidence (doc_ids of the nearest examples)."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **kw))  # bounded by examples x longest

    def run(batches):
        ix = index.value
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                score, evidence = ix.score(b["text"].slice(lo, 1024).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [b["did"].slice(lo, 1024), b["held_out"].slice(lo, 1024), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(evidence, pa.list_(pa.int64()))],
                    ["did", "held_out", "score", "predicted", "evidence"],
                )

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), held_out().alias("held_out"), whole_text().alias("text"))
    out = rows.mapInArrow(run, "did long, held_out boolean, score double, predicted int, evidence array<long>")
    return out.withColumn("did", real_id()).withColumnRenamed("did", "doc_id")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
