"""Windows that also start earlier in the corpus: what both substring removers share.

1. Each document gives the anchors of its windows (spans.py), one row for a run of windows with one anchor. Equal windows have
   equal anchors, so an anchor that occurs at one place only has no repeated window. Hashes of the anchors are used for this
   filter alone: they tell what can't repeat, never what does.
2. The regions of all other runs go to the caller's resolver, which compares their contents.
3. Anchors with over `hot` differing regions, which one task should not hold, are split: each window of theirs travels by itself, dealt out by its
   own content and first among the rows of a salt, to the same resolver. Equal regions are not many rows in a task: a map task sends one for all that it holds.

A place is (did, tag, start): the key of common.doc_key and the start of a window or run.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import spans
from .common import doc_key, parts, utf8, written

RUNS = "gram long, did long, tag long, start long, n int, off int, load int, known boolean, spare boolean"
#: Of an anchor under which too many regions would meet, a row with n = 0 says so.
FOUND = "gram long, did long, tag long, start long, n int, off int"
REPEATS = "did long, tag long, start long, n int"
#: Salts of hot windows: so many tasks first merge what is under one window.
SALTS = 32
#: Crowded anchors up to which they are broadcast as 8 bytes each; beyond it, runs are joined with them.
CROWDED = 500_000
#: Runs that are handled at once in a task.
CHUNK = 32_768


def symbols_of(unit: str, text: pa.Array):
    """symbols(a, b) and where each document starts, counted in bytes or words."""
    data, offsets = utf8(text)
    if unit == "byte":
        return lambda a, b: spans.BYTE_VALUES[data[a:b]], offsets
    starts, ends, at = spans.word_bounds(data, offsets)
    values = spans.word_values(data, starts, ends)
    return lambda a, b: values[a:b], at


def anchors(docs: DataFrame, unit: str, length: int, k: int) -> DataFrame:
    """The runs of windows. known: the batch holds its anchor at several places; spare: and this is not the first of them; load: differing regions of the anchor in the batch, in the first."""

    def run(batches):
        for b in batches:
            symbols, offsets = symbols_of(unit, b["text"])
            doc, start, last, off, gram, whole = spans.runs_of(symbols, offsets, length, k)
            order = np.lexsort((whole, gram))
            gram, start, n, off, doc, whole = gram[order], start[order], (last - start + 1)[order], off[order], doc[order], whole[order]
            did, tag = b["did"].to_numpy()[doc], b["tag"].to_numpy()[doc]
            new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
            head = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
            elsewhere = (did != did[head]) | (tag != tag[head]) | (start != start[head])
            group = np.cumsum(new) - 1
            known = (np.bincount(group, weights=elsewhere) > 0)[group] if len(gram) else new
            keep = new | known  # a row of the same place again says nothing
            other = new | np.append(True, whole[1:] != whole[:-1])[: len(gram)]
            load = np.where(new, np.bincount(group, weights=other)[group], 0) if len(gram) else new
            columns = (gram.view(np.int64), did, tag, start, n.astype(np.int32), off.astype(np.int32), load.astype(np.int32), known, ~new)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns], ["gram", "did", "tag", "start", "n", "off", "load", "known", "spare"])

    return docs.mapInArrow(run, RUNS)


def by_place() -> Column:
    return F.xxhash64("did", "tag", "start")


def sift(rows: DataFrame, hot: int) -> DataFrame:
    """The runs whose anchors occur at several places. Rows of which a batch has told this already are dealt out by their places."""

    def found_batch(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in zip(columns, (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32), strict=True)], ["gram", "did", "tag", "start", "n", "off"])

    def run(batches):
        gram0, place0, several0, load0, pending = None, (0, 0, 0), False, 0, None  # of the anchor that the last batch ended in
        for b in batches:
            if not b.num_rows:
                continue
            gram, did, tag, start, n, off, load, known = (b[c].to_numpy(zero_copy_only=False) for c in ("gram", "did", "tag", "start", "n", "off", "load", "known"))
            new = np.append(gram0 is None or gram[0] != gram0, gram[1:] != gram[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(gram)), -1))
            elsewhere = np.zeros(len(gram), bool)
            for x, x0 in zip((did, tag, start), place0, strict=True):
                elsewhere |= x != np.where(head >= 0, x[head], x0)
            group = np.cumsum(new)
            several = np.bincount(group, weights=elsewhere | known, minlength=group[-1] + 1) > 0
            several[0] |= several0
            out = [x[several[group]] for x in (gram, did, tag, start, n, off)]
            loads = np.bincount(group, weights=load, minlength=group[-1] + 1)
            loads[0] += load0
            names = np.append(gram0 or 0, gram[new])  # of the groups
            crowded = names[:-1][loads[:-1] > hot]
            if len(crowded):
                out = [np.append(x, crowded if i == 0 else np.zeros(len(crowded), np.int64)) for i, x in enumerate(out)]
            load0 = loads[-1]
            if pending is not None and (several[0] or new[0]):
                if several[0]:
                    out = [np.append(x, y) for x, y in zip(out, pending, strict=True)]
                pending = None
            i = head[-1]
            if i >= 0:
                place0, several0 = (did[i], tag[i], start[i]), bool(several[-1])
                pending = None if several0 else (gram[i], did[i], tag[i], start[i], n[i], off[i])
            else:
                several0 = bool(several[-1])
            gram0 = gram[-1]
            yield found_batch(out)
        if load0 > hot:
            yield found_batch([[gram0], *([[0]] * 5)])

    dealt = rows.repartition(parts(rows.sparkSession), F.when(F.col("spare"), by_place()).otherwise(F.col("gram"))).sortWithinPartitions("gram")
    return dealt.mapInArrow(run, FOUND)


def gathered(rows: DataFrame, *fields: str) -> DataFrame:
    """The rows of each document in one array; a document bounds its length."""
    return rows.groupBy("did", "tag").agg(F.collect_list(F.struct(*fields)).alias("runs"))


def list_of(column: pa.Array):
    """Row index and fields of an array column of gathered(), nulls as empty."""
    lens = np.nan_to_num(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), lens), *(flat.field(i).to_numpy() for i in range(flat.type.num_fields))


class Share:
    """The runs that one resolver takes: those of crowded anchors (single: each of their windows travels by itself), or the others.

    crowded: the anchors as a sorted broadcast array; None where the runs are all its own.
    """

    def __init__(self, total: int, single: bool, crowded=None) -> None:
        self.total, self.single, self.crowded = total, single, crowded

    def mine(self, gram: np.ndarray) -> np.ndarray:
        return np.ones(len(gram), bool) if self.crowded is None else np.isin(gram, self.crowded.value) == self.single


def chunks_of(batch: pa.RecordBatch, unit: str, length: int, share: Share):
    """The share's runs of a batch of documents: row, start, n, gram, off, some at a time; with `single`, each window as a run of its own, its gram the window's hash."""
    columns = list_of(batch["runs"])
    mine = share.mine(columns[3])
    row, start, n, gram, off = (x[mine] for x in columns)
    single = share.single
    if not single:
        for lo in range(0, len(row), CHUNK):  # none without runs
            yield tuple(x[lo : lo + CHUNK] for x in (row, start, n, gram, off))
        return
    symbols, offsets = symbols_of(unit, batch["text"])
    for lo in range(0, len(row), CHUNK // 64):
        r, s, m = (x[lo : lo + CHUNK // 64] for x in (row, start, n))
        each = np.repeat(np.arange(len(r)), m)
        at = np.arange(len(each)) - np.repeat(np.cumsum(m) - m, m)
        h = np.concatenate([span_hashes(symbols, offsets[x] + y, z, length) for x, y, z in zip(r, s, m, strict=True)])
        yield r[each], s[each] + at, np.ones(len(each), np.int32), h.view(np.int64), np.zeros(len(each), np.int32)


def span_hashes(symbols, at: int, n: int, length: int) -> np.ndarray:
    s = spans.prefix(symbols(at, at + n + length - 1))  # a run has at most `length` windows
    i = np.arange(n)
    return spans.span(s, i, i + length)


def repeats_batch(did, tag, start, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(t)) for x, t in zip((did, tag, start, n), (np.int64, np.int64, np.int64, np.int32), strict=True)], ["did", "tag", "start", "n"])


def touching(places: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Runs (did, tag, start, n) in order, those that follow one another in a document made one."""
    out: list[tuple[int, int, int, int]] = []
    for did, tag, start, n in sorted(places):
        if out and out[-1][0] == did and out[-1][1] == tag and start <= out[-1][2] + out[-1][3]:
            out[-1] = (did, tag, out[-1][2], max(out[-1][3], start + n - out[-1][2]))
        else:
            out.append((did, tag, start, n))
    return out


def repeated_windows(docs: DataFrame, unit: str, length: int, k: int, resolver: Callable[[DataFrame, Share], DataFrame], hot: int) -> tuple[DataFrame, DataFrame]:
    """Documents (did, tag, text) and, for each with repeats, an array `runs` of (start, n): windows that start earlier elsewhere.

    resolver(docs with an array of runs, its share of them) -> columns of REPEATS.
    """
    keyed = doc_key(docs)
    found = written(sift(anchors(keyed, unit, length, k), hot))
    runs, crowded = found.filter("n > 0"), found.filter("n = 0").select("gram")
    total = runs.count()
    with_runs = lambda rows: keyed.join(gathered(rows, "start", "n", "gram", "off"), ["did", "tag"])
    some = crowded.limit(CROWDED + 1).toArrow()["gram"].to_numpy()
    if not len(some):
        results = resolver(with_runs(runs), Share(total, False))
    elif len(some) <= CROWDED:
        listed = docs.sparkSession.sparkContext.broadcast(np.sort(some))
        results = resolver(with_runs(runs), Share(total, False, listed)).unionByName(resolver(with_runs(runs), Share(total, True, listed)))
    else:
        results = resolver(with_runs(runs.join(crowded, "gram", "left_anti")), Share(total, False))
        results = results.unionByName(resolver(with_runs(runs.join(crowded, "gram", "left_semi")), Share(total, True)))
    return keyed, gathered(results, "start", "n")
