"""A full-text index as a table of postings: searches read the rows of their tokens and leave the texts alone.

Postings hold one row for each token of a column of a document, with the token's positions. They are made where the texts are read, without an exchange:
documents that are looked at together (up to SLICE tokens, or one longer document) give a run of rows sorted by token, so that a search for a few tokens skips
most pages of each run. The number of a document's tokens is the posting of an empty token, which no text has. A stored index is made when a
search first reads it. Patterns are methods that give the keys of the documents found; they combine like other requests, by joins and sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..sources.storage import exists, removed_at_exit, shared_folder, state_of
from . import search

#: The token whose only position is the number of a document's tokens.
LENGTH = ""
#: Tokens of documents that are inverted together.
SLICE = 1 << 21


@dataclass(frozen=True)
class Tokenizer:
    """kind: unicode or ascii. diacritics: keep or remove. categories: Unicode categories of token characters, to which token_characters are added
    and from which separators are taken. stem: Porter's stems. synonyms: further tokens at the place of a token."""

    kind: str = "unicode"
    diacritics: str = "remove"
    categories: tuple[str, ...] = ("L", "M", "N")
    token_characters: str = ""
    separators: str = ""
    stem: bool = False
    synonyms: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def tokens(self, text: Column) -> Column:
        if self.kind == "ascii":
            out = search.ascii_tokens(text)
        else:
            escaped = lambda s: "".join(f"\\x{{{ord(c):X}}}" for c in s)
            inside = "".join(f"\\p{{{c}}}" for c in self.categories) + escaped(self.token_characters)
            held = f"[{inside}&&[^{escaped(self.separators)}]]" if self.separators else f"[{inside}]"
            plain = F.lower(text)
            if self.diacritics == "remove":
                plain = F.regexp_replace(F.translate(plain, *search._latin()), r"[\x{300}-\x{36F}]", "")
            elif self.diacritics != "keep":
                raise ValueError("diacritics are kept or removed")
            out = F.filter(F.split(plain, f"[^{held}]+"), lambda t: t != "")
        return search.stems(out) if self.stem else out

    def query(self, word: str) -> str:
        """A search word as the tokenizer would store it, if it is one token."""
        return search.stem(word.lower()) if self.stem else word.lower()


def inverted(rows: pa.RecordBatch, stem: bool = False, synonyms: dict[str, tuple[str, ...]] | None = None) -> pa.RecordBatch:
    """The postings of rows of key, column, tokens, in the order of token, row and position."""
    n = pc.list_value_length(rows["tokens"]).to_numpy(zero_copy_only=False).astype(np.int64)
    more = {t: tuple(m for m in dict.fromkeys(m) if m != t) for t, m in (synonyms or {}).items()}
    named = sorted({w for t, m in more.items() for w in (t, *m)})
    words = pc.dictionary_encode(rows["tokens"].flatten())
    codes, held = words.indices.to_numpy(), words.dictionary
    if stem:
        stems = pa.array([search.stem(w) for w in held.to_pylist()], held.type).dictionary_encode()
        codes, held = stems.indices.to_numpy()[codes], stems.dictionary
    held = pc.unique(pa.concat_arrays([held, pa.array(named, held.type)]))  # those before keep their places
    order = pc.sort_indices(held)
    rank = np.empty(len(held), np.int64)
    rank[order.to_numpy()] = np.arange(len(held))
    spot = np.arange(len(codes))
    found = [rank[codes] << 32 | spot]
    if named:
        place = dict(zip(named, rank[pc.index_in(pa.array(named, held.type), held).to_numpy()].tolist(), strict=True))
        ranks = rank[codes]
        for t, others in more.items():
            at = spot[ranks == place[t]]
            found += [place[m] << 32 | at for m in others]
    run = np.sort(np.concatenate(found))
    token, spot = run >> 32, run & 0xFFFFFFFF
    row = np.repeat(np.arange(len(n)), n)[spot]
    position = (spot - (np.cumsum(n) - n)[row]).astype(np.int32)
    first = np.flatnonzero((np.diff(token, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    at = np.concatenate([np.arange(len(n)), row[first]])  # the lengths come before
    ends = np.concatenate([np.arange(len(n)), len(n) + first, [len(n) + len(run)]]).astype(np.int32)
    tokens = pa.concat_arrays([pa.array([LENGTH], held.type), held.take(order)]).take(pa.array(np.concatenate([np.zeros(len(n), np.int64), token[first] + 1])))
    positions = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([n.astype(np.int32), position])))
    return pa.RecordBatch.from_arrays([rows["key"].take(pa.array(at)), rows["column"].take(pa.array(at)), tokens, positions], ["key", "column", "token", "positions"])


def slices(rows: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows in order, as many together as have up to `most` tokens, one at least."""
    ends = np.cumsum(pc.list_value_length(rows["tokens"]).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, most + (ends[lo - 1] if lo else 0), "right")))
        yield rows.slice(lo, hi - lo)
        lo = hi


@dataclass(frozen=True)
class TextIndex:
    """table: gives key, column, token, positions, of all columns; it is called when a search first needs it. content: the rows that the index is of."""

    key: str
    columns: tuple[str, ...]
    tokenizer: Tokenizer
    content: DataFrame
    table: Callable[[], DataFrame]

    @property
    def postings(self) -> DataFrame:
        """key, column, token, positions."""
        return self.table().filter((F.col("token") != LENGTH) & F.col("column").isin(*self.columns))

    @property
    def lengths(self) -> DataFrame:
        """key, column, n."""
        return self.table().filter((F.col("token") == LENGTH) & F.col("column").isin(*self.columns)).select("key", "column", F.col("positions")[0].alias("n"))

    @staticmethod
    def build(rows: DataFrame, key: str, columns: tuple[str, ...], tokenizer: Tokenizer | None = None) -> TextIndex:
        """columns: those that are searched; all others are unindexed."""
        tokenizer = tokenizer or Tokenizer()
        stem, synonyms, plain = tokenizer.stem, tokenizer.synonyms, replace(tokenizer, stem=False)
        each = [rows.select(F.col(key).alias("key"), F.lit(c).alias("column"), plain.tokens(F.coalesce(F.col(c), F.lit(""))).alias("tokens")) for c in columns]
        tokens = reduce(DataFrame.unionByName, each)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for some in slices(b, SLICE):
                    yield inverted(some, stem, synonyms)

        schema = StructType([tokens.schema["key"], StructField("column", StringType()), StructField("token", StringType()), StructField("positions", ArrayType(IntegerType()))])
        made = tokens.mapInArrow(run, schema)
        return TextIndex(key, tuple(columns), tokenizer, rows, lambda: made)

    @staticmethod
    def stored(rows: DataFrame, key: str, columns: tuple[str, ...], tokenizer: Tokenizer | None = None) -> TextIndex:
        """The index of a table of files. When a search first reads it, it is written, if this application has none of the table's present state yet; it is removed at the application's end."""
        spark = rows.sparkSession
        made = TextIndex.build(rows, key, columns, tokenizer)

        @cache
        def table() -> DataFrame:
            place = f"{shared_folder(spark)}/text-index-{spark.sparkContext.applicationId}-{state_of(rows)}-{key}-{'-'.join(columns)}-{hashlib.md5(repr(made.tokenizer).encode()).hexdigest()}"
            if not exists(spark, f"{place}/_SUCCESS"):
                removed_at_exit(spark, place)
                made.table().write.mode("overwrite").parquet(place)
            return spark.read.schema(made.table().schema).parquet(place)

        return replace(made, table=table)

    def within(self, *columns: str) -> TextIndex:
        """The same index, searched in some of its columns."""
        return replace(self, columns=columns)

    def updated(self, changed: DataFrame, removed: DataFrame | None = None) -> TextIndex:
        """After rows of the content table were inserted or changed, and rows of these keys deleted."""
        gone = changed.select(F.col(self.key).alias("key"))
        if removed is not None:
            gone = gone.unionByName(removed.select(F.col(self.key).alias("key")))
        gone = gone.distinct()
        new = TextIndex.build(changed, self.key, self.columns, self.tokenizer)
        return replace(self, table=lambda: self.table().join(gone, "key", "left_anti").select("key", "column", "token", "positions").unionByName(new.table()))

    # patterns
    def _of(self, words) -> DataFrame:
        return self.postings.filter(F.col("token").isin(*words))

    def _nothing(self) -> DataFrame:
        """No keys; the index is not read for them."""
        return self.content.select(self.key).filter(F.lit(False))

    def _words(self, words: list[str] | None) -> list[str]:
        return [self.tokenizer.query(w) for w in words or []]

    def _keys(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("key").alias(self.key)).distinct()

    def any_of(self, words: list[str] | None) -> DataFrame:
        """Keys of documents with any of the words; none without words."""
        words = self._words(words)
        return self._keys(self._of(words)) if words else self._nothing()

    def all_of(self, words: list[str] | None) -> DataFrame:
        words = sorted(set(self._words(words)))
        if not words:
            return self._nothing()
        return self._keys(self._of(words).groupBy("key").agg(F.count_distinct("token").alias("n")).filter(F.col("n") == len(words)))

    def all_prefixes(self, prefixes: list[str] | None) -> DataFrame:
        prefixes = sorted({p.lower() for p in prefixes or []})
        if not prefixes:
            return self._nothing()
        tests = [F.col("token").startswith(p) for p in prefixes]
        bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(t, F.lit(1 << i)).otherwise(F.lit(0)) for i, t in enumerate(tests)])
        met = self.postings.filter(reduce(lambda a, b: a | b, tests)).groupBy("key").agg(F.bit_or(bits).alias("bits"))
        return self._keys(met.filter(F.col("bits") == (1 << len(prefixes)) - 1))

    def phrase(self, words: list[str] | None, first: bool = False) -> DataFrame:
        """Keys of documents with the words one after another in a column; first: at its beginning."""
        words = self._words(words)
        if not words:
            return self._nothing()
        offsets = {w: [i for i, x in enumerate(words) if x == w] for w in words}
        at = F.create_map(*[F.lit(x) for w, o in offsets.items() for x in (w, F.array(*map(F.lit, o)))])
        spots = self._of(sorted(offsets)).select("key", "column", "positions", F.explode(at[F.col("token")]).alias("o")).select("key", "column", "o", F.explode("positions").alias("p"))
        begun = spots.select("key", "column", "o", (F.col("p") - F.col("o")).alias("start")).filter("start = 0" if first else "start >= 0")
        return self._keys(begun.groupBy("key", "column", "start").agg(F.count_distinct("o").alias("n")).filter(F.col("n") == len(words)))

    def near(self, a: str, b: str, within: int = 10) -> DataFrame:
        """Both words in one column, with at most so many tokens between them."""
        one, two = (self._of([self.tokenizer.query(w)]).select("key", "column", F.col("positions").alias(n)) for w, n in ((a, "pa"), (b, "pb")))
        both = one.join(two, ["key", "column"])
        return self._keys(both.filter(F.exists("pa", lambda i: F.exists("pb", lambda j: (i != j) & (F.abs(i - j) <= within + 1)))))

    def ranked(self, words: list[str] | None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """key, rank of documents with any of the words by BM25: negative, so that the best sorts first."""
        words = sorted(set(self._words(words)))
        if not words:
            return self._nothing().withColumn("rank", F.lit(0.0))
        found = self._of(words).groupBy("token", "key").agg(F.sum(F.size("positions")).cast("double").alias("f"))
        sizes = self.lengths.groupBy("key").agg(F.sum("n").alias("n")) if len(self.columns) > 1 else self.lengths.select("key", "n")
        about = sizes.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
        held = found.groupBy("token").agg(F.count("*").alias("d"))  # a row for each word
        raw = F.log((F.col("docs") - F.col("d") + 0.5) / (F.col("d") + 0.5))
        idf = held.crossJoin(F.broadcast(about)).select("token", "mean", F.when(raw <= 0, 1e-6).otherwise(raw).alias("idf"))
        scored = found.join(F.broadcast(idf), "token").join(sizes, "key")
        part = F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
        return scored.groupBy(F.col("key").alias(self.key)).agg((-F.sum(part)).alias("rank"))
