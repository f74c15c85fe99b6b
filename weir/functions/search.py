"""Full-text search: tokenizers, patterns as conditions on token arrays, and BM25 relevance.

Patterns are built with functions and combine with &, | and ~ like other conditions.
"""

from __future__ import annotations

import unicodedata
from functools import cache, lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dialect import ascii_lower


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased."""
    return F.filter(F.split(ascii_lower(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda t: t != "")


@cache
def _latin() -> tuple[str, str]:
    """Lower-case Latin letters with diacritics, and the letters that they decompose to."""
    pairs = [(chr(i), unicodedata.normalize("NFD", chr(i))) for i in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    folded = [(c, d[0]) for c, d in pairs if c.islower() and len(d) > 1 and d[0].isascii()]
    return "".join(c for c, _ in folded), "".join(d for _, d in folded)


def unicode_tokens(text: Column) -> Column:
    """Runs of letters, marks and digits in lower case, without Latin diacritics or combining ones."""
    plain = F.regexp_replace(F.translate(F.lower(text), *_latin()), r"[\x{300}-\x{36F}]", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")


#: Fixed values of Porter's published algorithm: suffixes and what replaces them, in steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = dict.fromkeys(("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"), "")


def _shape(word: str) -> str:
    """v for each vowel and c for each consonant; y counts as a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or x == "y" and out[-1:] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return _shape(word).count("vc")


def _open_end(word: str) -> bool:
    """Consonant, vowel and a last consonant other than w, x and y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str], least: int) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            fits = _measure(rest) >= least and (suffix != "ion" or rest[-1:] in ("s", "t"))
            return rest + table[suffix] if fits else word
    return word


@lru_cache(1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a lower-case word of 3 to 64 bytes; others stay as they are."""
    if not 3 <= len(word.encode()) <= 64:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = next((n for end, n in (("eed", 0), ("ed", 2), ("ing", 3)) if w.endswith(end) and w != end), None)  # a suffix has something before it
    if cut == 0:
        w = w[:-1] if _measure(w[:-3]) else w
    elif cut and "v" in _shape(w[:-cut]):
        w = w[:-cut]
        if w.endswith(("at", "bl", "iz")) or _measure(w) == 1 and _open_end(w) and w[-1:] != w[-2:-1]:
            w += "e"
        elif w[-1:] == w[-2:-1] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replaced(_replaced(_replaced(w, STEP_2, 1), STEP_3, 1), STEP_4, 2)
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _open_end(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def stemmed(tokens: pa.Array) -> pa.Array:
    """Lists of words as lists of their stems; each distinct word is looked at once."""
    words = tokens.flatten().dictionary_encode()
    found = pa.array([stem(w) if w is not None else None for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)
    n = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), found, mask=tokens.is_null())


def stems(tokens: Column) -> Column:
    """The tokens' stems, in Arrow batches; words are kept in a bounded cache of each worker."""
    return F.arrow_udf(stemmed, "array<string>")(tokens)


def any_of(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words))) if words else F.lit(False)


def all_of(tokens: Column, words: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, words)), tokens)) == 0 if words else F.lit(False)


def all_prefixes(tokens: Column, prefixes: list[str]) -> Column:
    def one(prefix: str) -> Column:
        return F.exists(tokens, lambda t: t.startswith(prefix))

    return reduce(lambda a, b: a & b, map(one, prefixes)) if prefixes else F.lit(False)


def phrase(tokens: Column, words: list[str]) -> Column:
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(words)} ") if words else F.lit(False)


def first_phrase(tokens: Column, words: list[str]) -> Column:
    return F.slice(tokens, 1, len(words)) == F.array(*map(F.lit, words)) if words else F.lit(False)


def near(tokens: Column, a: str, b: str, within: int = 10) -> Column:
    """Both words, with at most so many tokens between them."""
    spots = lambda w: F.filter(F.transform(tokens, lambda t, i: F.when(t == w, i)), lambda i: i.isNotNull())
    return F.exists(spots(a), lambda i: F.exists(spots(b), lambda j: F.abs(i - j) <= within + 1))


def bm25(docs: DataFrame, key: str, tokens: Column, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, rank for documents with any of the words: negative, so that the best sorts first. Without words there are none."""
    words = sorted(set(words))
    if not words:
        return docs.select(F.col(key), F.lit(0.0).alias("rank")).filter(F.lit(False))

    def times(word: str) -> Column:
        return F.size("_t") - F.size(F.array_remove("_t", word))

    def counted(some: DataFrame) -> DataFrame:  # the tokens stand in a column of their own, so that each text is split once
        return some.select(F.col(key), tokens.alias("_t")).select(key, F.size("_t").alias("_n"), *[times(w).alias(f"_f{i}") for i, w in enumerate(words)])

    stats = counted(docs).agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"_d{i}") for i in range(len(words))])
    scored = counted(docs.filter(any_of(tokens, words))).crossJoin(F.broadcast(stats))  # one row of statistics
    parts = []
    for i in range(len(words)):
        raw = F.log((F.col("_docs") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        idf = F.when(raw <= 0, 1e-6).otherwise(raw)
        f = F.col(f"_f{i}")
        parts.append(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("_n") / F.col("_avg"))))
    return scored.select(key, (-reduce(lambda x, y: x + y, parts)).alias("rank"))
