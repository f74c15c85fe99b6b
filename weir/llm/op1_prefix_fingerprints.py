"""Document fingerprints from prefix polynomial hashes.

One modular prefix array of a text answers the equality of any two spans: the hash of [a, b) is
(S[b] - S[a]) / BASE**a modulo the Mersenne prime 2**31 - 1, under two bases, so equal spans have equal pairs of values wherever they stand.
Binary search over the span length gives longest common extensions. The fingerprint is a one-permutation minimum
sketch of all spans of `width` code points: the least hash in each of `bins` ranges. The share of equal bins of two
fingerprints estimates the Jaccard likeness of their sets of spans.

Defined results: null text is empty. An empty text has the fingerprint of zeros, like only itself. A text under
`width` code points is one span. Rows are ordered by doc_id, then 128 bits of the text's hash; a null doc_id comes first. Rows that repeat a doc_id
each follow one another in that order. A single row is followed by itself. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, parts, real_id, table, whole_text

P = np.uint64(2**31 - 1)
BASES = (1_103_515_245, 1_566_083_941)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1, for x under 2**62."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.minimum(x, x - P)  # x - P wraps around to a large value where x is under P


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) <= n:
        out = []
        for b in (base, pow(base, -1, int(P))):
            p = np.ones(1, np.uint64)
            while len(p) <= n:
                p = np.concatenate([p, reduced(p * np.uint64(pow(b, len(p), int(P))))])
            out.append(p)
        _POWERS[base] = have = (out[0], out[1])
    return have


class Prefix:
    """Prefix hashes of one text's code points under two bases."""

    def __init__(self, codes: np.ndarray, like: Prefix | None = None, same: int = 0) -> None:
        """like: the prefix hashes of a text whose first `same` code points are those of this one."""
        self.n = len(codes)
        self.sums = []
        for i, base in enumerate(BASES):
            power, _ = powers(base, self.n)
            s = np.zeros(self.n + 1, np.uint64)
            if like is not None:
                s[: same + 1] = like.sums[i][: same + 1]
            tail = reduced((codes[same:].astype(np.uint64) + np.uint64(1)) * power[same : self.n])
            np.cumsum(tail, out=s[same + 1 :])
            s[same + 1 :] = reduced(s[same + 1 :] + s[same])
            self.sums.append(s)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        out = np.zeros(len(start), np.uint64)
        for s, base in zip(self.sums, BASES, strict=True):
            inverse = powers(base, self.n)[1]
            out = (out << np.uint64(31)) | reduced(reduced(s[end] + P - s[start]) * inverse[start])
        return out

    def span(self, start: int, end: int) -> tuple[int, ...]:
        """The same for one span, in plain integers."""
        p = int(P)
        return tuple((int(s[end]) - int(s[start])) * int(powers(base, self.n)[1][start]) % p for s, base in zip(self.sums, BASES, strict=True))

    def windows(self, width: int, first: int = 0) -> np.ndarray:
        """Hashes of all spans of that width from `first` on, or of the whole text if it is shorter."""
        w = min(width, self.n)
        stop = self.n - w + 1 if self.n else 0
        first = min(first, stop)
        out = np.zeros(stop - first, np.uint64)
        for s, base in zip(self.sums, BASES, strict=True):
            out = (out << np.uint64(31)) | reduced(reduced(s[first + w : stop + w] + P - s[first:stop]) * powers(base, self.n)[1][first:stop])
        return out

    def common_suffix(self, other: Prefix) -> int:
        """Length of the longest common suffix, by the same search from the ends."""
        lo, hi = 0, min(self.n, other.n)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(self.n - mid, self.n) == other.span(other.n - mid, other.n):
                lo = mid
            else:
                hi = mid - 1
        return lo

    def common_extension(self, at: int, other: Prefix, there: int) -> int:
        """Length of the longest common extension of two places, by binary search over equal spans."""
        lo, hi = 0, min(self.n - at, other.n - there)
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if self.span(at, at + mid) == other.span(there, there + mid):
                lo = mid
            else:
                hi = mid - 1
        return lo


def sketch(windows: np.ndarray, bins: int) -> np.ndarray:
    """Least hash of each bin, as 16 bits; an empty bin takes the next full one's."""
    if not len(windows):
        return np.zeros(bins, ">u2")
    x = windows * np.uint64(0x9E3779B97F4A7C15)
    x = np.sort((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
    edges = np.arange(bins, dtype=np.uint64) * np.uint64(2**64 // bins)
    at = np.searchsorted(x, edges)
    at[at == len(x)] = 0  # after the last comes the first
    least = x[at]
    return ((least ^ (least >> np.uint64(24)) ^ (least >> np.uint64(41))) & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray, empty_a: bool, empty_b: bool) -> float:
    return float(empty_a == empty_b and np.mean(a == b))


#: Ranges that a doc_id (or the lack of one) with a great share of the rows is split into, by the hash of their texts: a power of 2.
SPLIT = 64


def range_number(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by two looks into arrays: over every n-th bound, then over those from there on."""
    if not bounds:
        return F.lit(0)
    step = max(1, round(len(bounds) ** 0.5))
    below = lambda a: F.size(F.filter(a, lambda x: x <= value))
    held = lambda some: F.array(*[F.lit(b).cast("long") for b in some])
    coarse = below(held(bounds[step - 1 :: step]))
    return coarse * step + below(F.slice(held(bounds), coarse * step + 1, F.lit(step)))


def neighbours(docs: DataFrame) -> DataFrame:
    """bucket, did, h, g, text, copy: documents in ranges of (did, h); each range ends with a copy of its successor's first rows.

    h, g: 128 bits of the text's hash. Ranges come from quantiles of did; a did that fills a range alone is split by h. Only one row for each range (their number is bounded by that of the
    shuffle partitions times 4 times SPLIT) is joined by broadcast.
    """
    spark = docs.sparkSession
    n = parts(spark)
    text = whole_text()
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"), text.alias("text"))
    m = 4 * n
    places = [int(b) for b in keyed.approxQuantile("did", [i / m for i in range(1, m)], 0.25 / m)]
    bounds = sorted(set(places))
    hot = sorted({b for b in bounds if places.count(b) > 1})
    number = range_number(F.col("did"), bounds) * (SPLIT + 1)
    if hot:  # a bound begins its range: of a hot one the texts' hashes tell further ranges, then come greater dids
        by_hash = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(NULL_ID)), 64 - SPLIT.bit_length() + 1).cast("int")
        number = number + F.when(F.col("did").isin(hot), by_hash).otherwise(F.when(range_number(F.col("did"), hot) > 0, F.lit(SPLIT)).otherwise(F.lit(0)))
    rows = keyed.withColumn("bucket", number)
    first = rows.groupBy("bucket").agg(F.min(F.struct("did", "h", "g")).alias("k")).select("bucket", "k.*")
    heads = sorted(tuple(r) for r in first.collect())  # a row for each range
    if not heads:
        return rows.withColumn("copy", F.lit(False))
    follow = spark.createDataFrame([(*k, heads[i - 1][0]) for i, (_, *k) in enumerate(heads)], "did long, h long, g long, before int")
    marked = rows.join(F.broadcast(follow), ["did", "h", "g"], "left")
    here = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("copy"))
    both = F.when(F.col("before").isNull(), F.array(here)).otherwise(F.array(here, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("copy"))))
    return marked.select("did", "h", "g", "text", F.explode(both).alias("place")).select("place.bucket", "did", "h", "g", "text", "place.copy")


RESULT = "did long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, same_prefix long, same_suffix long"


def fingerprints(docs: DataFrame, width: int = 12, bins: int = 128) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness to each other and to the next document's.

    same_prefix, same_suffix: code points that text and edited text share from their start and before their end.
    width: code points of a span; bins: size of a fingerprint.
    """

    def measured(did, text, follower, known):
        prefix, grams, mark = known if known is not None else first_look(text)
        same = len(text) - len(text) // 4
        edited = text[:same] + follower[: len(text) // 4]
        other = Prefix(np.frombuffer(edited.encode("utf-32-le"), np.uint32), prefix, same)
        kept = max(0, same - width + 1) if min(prefix.n, other.n) >= width else 0  # spans that the edit leaves alone
        other_mark = sketch(np.concatenate([grams[:kept], other.windows(width, kept)]), bins)
        after = first_look(follower)
        return (
            did, len(text), hashlib.sha256(edited.encode()).hexdigest(), mark.tobytes().hex(), other_mark.tobytes().hex(),
            likeness(mark, other_mark, not text, not edited), likeness(mark, after[2], not text, not follower),
            prefix.common_extension(0, other, 0), prefix.common_suffix(other),
        ), after

    def first_look(text):
        prefix = Prefix(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        grams = prefix.windows(width)
        return prefix, grams, sketch(grams, bins)

    def run(batches):
        waiting = None  # bucket, did, text, what is known of it
        for b in batches:
            out = []
            for bucket, did, text, copy in zip(*(b[c].to_pylist() for c in ("bucket", "did", "text", "copy")), strict=True):
                after = None
                if waiting is not None and waiting[0] == bucket:
                    row, after = measured(waiting[1], waiting[2], text, waiting[3])
                    out.append(row)
                waiting = None if copy else (bucket, did, text, after)
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    names = [x.split()[0] for x in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in RESULT.split(", ")])
    placed = neighbours(docs)
    dealt = placed.repartitionByRange(parts(docs.sparkSession), "bucket").sortWithinPartitions("bucket", "copy", "did", "h", "g")
    return dealt.select("bucket", "did", "text", "copy").mapInArrow(run, RESULT).withColumn("did", real_id()).withColumnRenamed("did", "doc_id")


def op1_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {"op1_prefix_fingerprints": op1_prefix_fingerprints}
ORACLE_SQL: dict[str, str] = {}
