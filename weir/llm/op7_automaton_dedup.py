"""Substring dedup: words covered by a window of `length` words that also starts earlier go.

Reference shards are the regions whose anchors meet (repeats.py): each shard holds whole
anchors and a bounded number of words, so that its suffix automaton stays small. The regions of a shard
stream through its automaton in the order of (doc_id, start): matching statistics give, at each word, the longest
suffix that occurs in an earlier region; where it reaches `length`, the window that ends there starts earlier
too. If some window did not, the region itself joins the automaton, whose letters are the words themselves and not hashes of them.
Broadcasting the automata of all shards would grow with the corpus and would
read each document once for each shard, so the shards are dealt out by anchor and the regions go to them.

Defined results: null text has no words; texts under `length` words keep all; rows that repeat doc_id and text
count as one document, each returned; of equal doc_ids with differing texts, and of rows without one, 128 bits of the text's hash give the order; a
null doc_id sorts first. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import NULL_ID, parts, table, utf8
from .repeats import REPEATS, SALTS, Share, by_place, chunks_of, list_of, repeated_windows, repeats_batch, touching

SENT = "gram long, salt int, words binary, " + REPEATS


class Automaton:
    """Suffix automaton of several sequences, grown one sequence at a time."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]

    def extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        q = nxt[last].get(c)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._split(last, q, c)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, q, c)
        return cur

    def _split(self, p: int, q: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def add(self, words) -> None:
        last = 0
        for c in words:
            last = self.extend(last, c)

    def statistics(self, words) -> list[int]:
        """For each word, the length of the longest suffix ending there that the automaton holds."""
        nxt, link, length = self.next, self.link, self.len
        state = have = 0
        out = []
        for c in words:
            while state and c not in nxt[state]:
                state = link[state]
                have = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                have += 1
            else:
                have = 0
            out.append(have)
        return out


def resolver(length: int, shard_words: int):
    """Runs of windows to repeated windows, by automata over shards of whole anchors."""

    def sent_batch(rows: list[tuple], copied: list[tuple]) -> pa.RecordBatch:
        """rows: (gram, salt, words, did, tag, start, n); copied: (did, tag, start, n), whose windows are known to repeat."""
        rows = rows + [(None, None, None, *x) for x in copied]
        types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], t) for i, t in enumerate(types)], ["gram", "salt", "words", "did", "tag", "start", "n"])

    def firsts(rows: list[tuple]) -> pa.RecordBatch:
        """Of the rows with the same anchor and words the earliest goes on."""
        rows.sort(key=lambda x: (x[0], *x[2:]))
        kept, copied, last = [], [], (None,) * 7
        for x in rows:
            if x[0] != last[0] or x[2] != last[2]:
                kept.append(x)
                last = x
            elif x[3:] != last[3:]:
                copied.append(x[3:])
        return sent_batch(kept, touching(copied))

    def send(share: Share):
        def run(batches):
            for b in batches:
                data, offsets = utf8(b["text"])
                starts, ends, at = spans.word_bounds(data, offsets)
                did, tag = b["did"].to_pylist(), b["tag"].to_pylist()
                for row, start, n, gram, _ in chunks_of(b, "word", length, share):
                    first = at[row] + start
                    lo, hi = starts[first].tolist(), ends[first + n + length - 2].tolist()
                    salt = (did[row[0]] ^ tag[row[0]]) % SALTS
                    text = data[min(lo) : max(hi)].tobytes()
                    base = min(lo)
                    yield firsts([
                        (g, salt, b" ".join(text[x - base : y - base].split()), did[r], tag[r], s, m)
                        for r, s, m, g, x, y in zip(row.tolist(), start.tolist(), n.tolist(), gram.tolist(), lo, hi, strict=True)
                    ])

        return run

    def merge(batches):
        """Rows of one anchor and salt, in order: the earliest of each content goes on."""
        now, held = None, []
        for b in batches:
            for x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if x[:2] != now or x[0] is None:
                    if held:
                        yield firsts(held) if now[0] is not None else sent_batch([], [y[3:] for y in held])
                    now, held = x[:2], []
                held.append(x)
        if held:
            yield firsts(held) if now[0] is not None else sent_batch([], [y[3:] for y in held])

    def meet(batches):
        automaton, held, now, last = Automaton(), 0, None, None
        for b in batches:
            out = []
            for gram, words, did, tag, start, n in zip(*(b[c].to_pylist() for c in ("gram", "words", "did", "tag", "start", "n")), strict=True):
                if words is None:
                    out.append((did, tag, start, n))
                    continue
                if (gram, did, tag, start) == last:  # a repeated row of the same document
                    continue
                if gram != now and held >= shard_words:
                    automaton, held = Automaton(), 0
                now, last = gram, (gram, did, tag, start)
                words = words.split(b" ")
                run = found = 0
                if held:  # anchors in one shard have no window in common, so only this anchor's earlier regions match
                    for i, m in enumerate(automaton.statistics(words)):
                        if m >= length:
                            run += 1
                        elif run:
                            out.append((did, tag, start + i - run - length + 1, run))
                            found += run
                            run = 0
                    if run:
                        out.append((did, tag, start + len(words) - run - length + 1, run))
                        found += run
                if found < n:  # else the automaton holds all its windows
                    automaton.add(words)
                    held += len(words)
            yield repeats_batch(*(zip(*out, strict=True) if out else ((),) * 4))

    def resolve(docs: DataFrame, share: Share) -> DataFrame:
        n = parts(docs.sparkSession)
        sent = docs.mapInArrow(send(share), SENT)
        place = F.when(F.col("words").isNull(), by_place())
        if share.single:
            sent = sent.repartition(n, F.coalesce(place, F.xxhash64("gram", "salt"))).sortWithinPartitions("gram", "salt").mapInArrow(merge, SENT)
        return sent.repartition(n, F.coalesce(place, F.col("gram"))).sortWithinPartitions("gram", "did", "tag", "start").mapInArrow(meet, REPEATS)

    return resolve


def remove_repeats(docs: DataFrame, length: int = 20, anchor: int = 8, shard_words: int = 20_000, hot: int = 8_000) -> DataFrame:
    """doc_id, kept (the remaining words, joined by one space), n_words, n_removed.

    anchor: words of an anchor, at most half of length. shard_words: words at which a reference shard is full.
    hot: regions of an anchor, counted once for each map task's batch, beyond which its windows are sent one by one, dealt out by their contents, to the same automata.
    """
    keyed, runs = repeated_windows(docs, "word", length, anchor, resolver(length, shard_words), hot)

    def cut(batches):
        for b in batches:
            data, offsets = utf8(b["text"])
            starts, ends, at = spans.word_bounds(data, offsets)
            row, start, n = list_of(b["runs"])
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, at[row] + start, 1)
            np.add.at(edge, at[row] + start + n - 1 + length, -1)
            keep = np.cumsum(edge[:-1]) == 0
            total = np.append(0, np.cumsum(keep))
            kept = []
            for i in range(b.num_rows):
                words = np.flatnonzero(keep[at[i] : at[i + 1]]) + at[i]
                kept.append(b" ".join([data[x:y].tobytes() for x, y in zip(starts[words].tolist(), ends[words].tolist(), strict=True)]))
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [b["did"], pa.array(kept, pa.binary()).cast(pa.string()), pa.array(size.astype(np.int64)), pa.array(size - np.diff(total[at]))], ["did", "kept", "n_words", "n_removed"]
            )

    out = keyed.join(runs, ["did", "tag"], "left").select("did", "text", "runs").mapInArrow(cut, "did long, kept string, n_words long, n_removed long")
    return out.select(F.when(F.col("did") != NULL_ID, F.col("did")).alias("doc_id"), "kept", "n_words", "n_removed")


def op7_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_automaton_dedup": op7_automaton_dedup}
ORACLE_SQL: dict[str, str] = {}
