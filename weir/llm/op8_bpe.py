"""BPE encoding by speculation and verification, and exact decoding.

Texts are cut into words by the tokenizer's pattern. Greedy longest match proposes tokens for each distinct word. A
sequence of tokens is the BPE encoding exactly if every two neighbours are what BPE makes of their joined text, so
all adjacent pairs of a batch are tested at once against the sorted pairs already known; a new pair is merged once. Words with
a failing pair are merged exactly. Decoding joins the tokens' bytes.

The vocabulary file is a parameter and is read where the tasks run; every executor must have it at that path.

Defined results: null text is empty, with no tokens. Special tokens in a text become their ids, as the file's library does
by default. Rows that repeat a doc_id, or have none, get one row each. Other columns are ignored by encode().
"""

from __future__ import annotations

import json
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, real_id, table, whole_text

#: Fixed value: the pattern of byte-level BPE files that split by it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words and pairs that a worker remembers; beyond it, it starts anew.
MEMORY = 1_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabulary files: itself if printable Latin-1, else from 256 upwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return out


class Tokenizer:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = {c: b for b, c in byte_letters().items()}
        model = spec["model"]
        self.ids = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        code = lambda t: bytes(letters[c] for c in t)
        self.ranks = {(code(a), code(b)): r for r, (a, b) in enumerate(merges)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.pair_ranks = {self.ids[a] << 20 | self.ids[b]: r for (a, b), r in self.ranks.items()}
        self.joined = [self.ids[a + b] for a, b in self.ranks]  # by rank
        plain = set(self.bytes) - set(self.special.values())
        self.tokens = {t: i for t, i in self.ids.items() if i in plain}
        self.longest = max(map(len, self.tokens))
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words: dict[str, tuple[int, ...]] = {}
        self.good = self.bad = np.zeros(0, np.int64)
        # a token that merging its own bytes does not give back can't be proposed
        self.proposals = {t: i for t, i in self.tokens.items() if len(t) == 1 or self.merge(t) == (i,)}

    def merge(self, word: bytes) -> tuple[int, ...]:
        """Exact BPE: the pair of the lowest rank joins, leftmost first, until none is left."""
        if len(word) > 400:
            return self.merge_long([word[i : i + 1] for i in range(len(word))])
        rank, none = self.pair_ranks.get, len(self.joined)
        ids = [self.single[b] for b in word]
        ranks = [rank(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [self.joined[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] << 20 | ids[i], none)
            if i < len(ranks):
                ranks[i] = rank(ids[i] << 20 | ids[i + 1], none)
        return tuple(ids)

    def merge_long(self, parts: list[bytes]) -> tuple[int, ...]:
        """The same by a heap over a linked list, for long words."""
        import heapq

        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        part: list[bytes | None] = list(parts)
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := self.ranks.get((part[x], part[y]))) is not None:
                    heapq.heappush(heap, (r, x, part[x], part[y]))
        return tuple(self.ids[p] for p in part if p is not None)

    def propose(self, word: bytes) -> tuple[int, ...]:
        """Greedy longest match."""
        whole = self.proposals.get(word)
        if whole is not None:
            return (whole,)
        out, at, n = [], 0, len(word)
        while at < n:
            end = min(n, at + self.longest)
            while (i := self.proposals.get(word[at:end])) is None:
                end -= 1
            out.append(i)
            at = end
        return tuple(out)

    def learn(self, words: list[str]) -> None:
        """Encodings of new words: proposals, one test of all adjacent pairs, exact merging where a pair fails."""
        raw = [w.encode() for w in words]
        proposed = [self.propose(w) for w in raw]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter((i for p in proposed for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs = flat[inner] << 32 | flat[inner + 1]
        distinct, back = np.unique(pairs, return_inverse=True)
        ok = member(self.good, distinct)
        unknown = np.flatnonzero(~ok & ~member(self.bad, distinct))
        for u in unknown.tolist():
            a, b = int(distinct[u]) >> 32, int(distinct[u]) & 0xFFFFFFFF
            ok[u] = self.merge(self.bytes[a] + self.bytes[b]) == (a, b)
        if len(self.good) + len(self.bad) > 4 * MEMORY:
            self.good = self.bad = np.zeros(0, np.int64)
        if len(unknown):
            self.good = np.sort(np.concatenate([self.good, distinct[unknown][ok[unknown]]]), kind="stable")
            self.bad = np.sort(np.concatenate([self.bad, distinct[unknown][~ok[unknown]]]), kind="stable")
        failing = set(owner[inner[~ok[back]]].tolist())
        if len(self.words) > MEMORY:
            self.words.clear()
        for n, (w, p) in enumerate(zip(words, proposed, strict=True)):
            self.words[w] = self.merge(raw[n]) if n in failing else p

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        cut = [[(x, i % 2 == 1) for i, x in enumerate(self.cut.split(t))] if self.cut else [(t, False)] for t in texts]
        split = [[[x] if special else self.split.findall(x) for x, special in c if x] for c in cut]
        marks = [[special for x, special in c if x] for c in cut]
        new = {w for t, m in zip(split, marks, strict=True) for ws, special in zip(t, m, strict=True) if not special for w in ws} - self.words.keys()
        if len(self.words) + len(new) > MEMORY:
            self.words.clear()
            new = {w for t, m in zip(split, marks, strict=True) for ws, special in zip(t, m, strict=True) if not special for w in ws}
        if new:
            self.learn(list(new))
        known = self.words
        for t, m in zip(split, marks, strict=True):
            ids: list[int] = []
            for ws, special in zip(t, m, strict=True):
                if special:
                    ids.append(self.special[ws[0]])
                else:
                    for w in ws:
                        ids += known[w]
            out.append(np.array(ids, "<u4"))
        return out

    def decode(self, ids) -> str:
        table_ = self.bytes
        return b"".join([table_[i] for i in ids.tolist()]).decode("utf-8", "replace")


def member(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


@cache
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None, chunk: int = 256) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (their text), for every row."""
    path = path or default_path()

    def run(batches):
        t = tokenizer(path)
        for b in batches:
            for lo in range(0, b.num_rows, chunk):
                ids = t.encode(b["text"].slice(lo, chunk).to_pylist())
                yield pa.RecordBatch.from_arrays([b["did"].slice(lo, chunk), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([t.decode(x) for x in ids], pa.string())], ["did", "ids", "decoded"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), whole_text().alias("text"))
    return rows.mapInArrow(run, "did long, ids binary, decoded string").select(real_id().alias("doc_id"), "ids", "decoded")


def digests(docs: DataFrame, path: str | None = None, chunk: int = 256) -> DataFrame:
    out = encode(docs, path, chunk)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLE_SQL: dict[str, str] = {}
