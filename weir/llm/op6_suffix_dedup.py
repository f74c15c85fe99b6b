"""Suffix-array dedup: bytes covered by a string of `length` bytes that also starts earlier go.

Suffixes are sorted sparsely: at the anchors of windows (spans.py), wherever an anchor occurs at several places (repeats.py). Map
tasks sort the suffixes that start at their anchors and send them as front-coded runs, so that shared beginnings travel once; what
a batch holds twice stays behind as a copy. Each reducer merges its runs with a loser tree that carries, for each run, the length
of the prefix shared with the last suffix put out, and compares bytes only beyond it. The merged order with its common-prefix
lengths tells which windows are equal to the right of the anchor; the bytes to its left are sorted backwards in the same way. Bytes decide, not hashes.

Defined results: null text is empty; texts under `length` bytes keep all; rows that repeat doc_id and text count
as one document, each returned; of equal doc_ids with differing texts, and of rows without one, 128 bits of the text's hash give the order; a null
doc_id sorts first. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, parts, table, utf8
from .repeats import REPEATS, SALTS, Share, by_place, chunks_of, list_of, repeated_windows, repeats_batch, touching

#: left: bytes of the left context, or SAME if it is that of the row before.
HEAD = np.dtype([("lcp", "<u2"), ("rest", "<u2"), ("left", "<u2"), ("n", "<u2"), ("did", "<i8"), ("tag", "<i8"), ("start", "<i8")])
SAME = 0xFFFF
#: Rows that a bucket of the merge should hold.
BUCKET = 10_000
SENT = "bucket long, salt int, run binary, " + REPEATS


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, given that the first `known` bytes agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n
    while hi - lo > 8:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    while a[lo] == b[lo]:
        lo += 1
    return lo


def front_coded(rows: list[tuple[bytes, bytes, int, int, int, int]]) -> bytes:
    """Sorted rows (suffix, left context, n, did, tag, start): a count, heads, what each suffix adds to the one before, lefts; compressed."""
    heads, rests, lefts, last, last_left = [], [], [], b"", None
    for suffix, left, n, did, tag, start in rows:
        lcp = common_prefix(last, suffix, 0)
        if left == last_left:
            heads.append((lcp, len(suffix) - lcp, SAME, n, did, tag, start))
        else:
            heads.append((lcp, len(suffix) - lcp, len(left), n, did, tag, start))
            lefts.append(left)
        rests.append(suffix[lcp:])
        last, last_left = suffix, left
    return zstandard.compress(b"".join([len(rows).to_bytes(4, "little"), np.array(heads, HEAD).tobytes(), *rests, *lefts]), 3)


def decoded(blob: bytes):
    """(lcp with the one before, suffix, left, n, did, tag, start), one after another."""
    blob = zstandard.decompress(blob)
    m = int.from_bytes(blob[:4], "little")
    heads = np.frombuffer(blob, HEAD, m, 4)
    at = 4 + heads.nbytes
    left_at = at + int(heads["rest"].sum(dtype=np.int64))
    last = last_left = b""
    for lcp, rest, left, n, did, tag, start in heads.tolist():
        if rest or lcp != len(last):
            last = last[:lcp] + blob[at : at + rest]
            at += rest
        if left != SAME:
            last_left = blob[left_at : left_at + left]
            left_at += left
        yield lcp, last, last_left, n, did, tag, start


def merged(runs: list):
    """All items of sorted runs in order, each with its common-prefix length to the one before.

    A node of the tree keeps the run that lost there and the prefix that it shares with the winner that passed.
    A contender with the longer known prefix to the last output is smaller without any comparison; only equal
    lengths compare bytes, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    runs = [iter(r) for r in runs]
    items: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    shared = [0] * size  # prefix of the run's item with the last item put out
    lost = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's shared prefix is from then on with the winner."""
        if items[a] is None or items[b] is None:
            return (b, a) if items[a] is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = items[a][1], items[b][1]
        lcp = common_prefix(x, y, shared[a])
        if x[lcp:] <= y[lcp:]:
            shared[b] = lcp
            return a, b
        shared[a] = lcp
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size
        w, lo = play(build(2 * node), build(2 * node + 1))
        lost[node] = lo
        return w

    winner = build(1) if size > 1 else 0
    while items[winner] is not None:
        item = items[winner]
        yield (shared[winner], *item[1:])
        items[winner] = new = next(runs[winner], None) if winner < len(runs) else None
        if new is not None:
            shared[winner] = new[0]
        node = (winner + size) // 2
        while node:
            winner, lost[node] = play(winner, lost[node])
            node //= 2


def heads_and_copies(rows: list[tuple]) -> tuple[list[tuple], list[tuple[int, int, int, int]]]:
    """Merged rows (lcp, suffix, left, n, did, tag, start), of each distinct region the earliest place, lcp being with the head before; and the places (did, tag, start, n) of the others."""
    heads: list[list] = []
    copied = []
    now: dict[bytes, list] = {}  # by left context, the heads of the suffix at hand
    suffix = None
    for lcp, s, left, n, did, tag, start in rows:
        if suffix is not None and lcp == len(suffix) == len(s):
            old = now.get(left)
            if old is not None:
                place = [did, tag, start]
                if place < old[4:]:
                    copied.append((*old[4:], n))
                    old[4:] = place
                elif place != old[4:]:
                    copied.append((did, tag, start, n))
                continue
        else:
            now, suffix = {}, s
        head = [lcp if not now else len(s), s, left, n, did, tag, start]
        now[left] = head
        heads.append(head)
    return heads, copied


def repeats_among(heads: list[tuple], length: int, k: int) -> tuple:
    """Runs of windows (did, tag, start, n) that start earlier, from distinct regions in the order of their suffixes."""
    lcp = np.array([x[0] for x in heads], np.int64)
    anchor = np.cumsum(lcp < k)
    live = np.flatnonzero(np.bincount(anchor)[anchor] > 1) if len(heads) else np.zeros(0, np.int64)
    if not len(live):
        return (np.zeros(0, np.int64),) * 4
    # in the order of documents and anchors: of equal windows with equal offsets the first is the earliest
    place = np.array([(heads[i][4], heads[i][5], heads[i][6] + len(heads[i][2]), len(heads[i][2]), heads[i][3]) for i in live], np.int64)
    order = np.lexsort((place[:, 2], place[:, 1], place[:, 0]))
    rows, (did, tag, at, off, n) = live[order], place[order].T
    width = int(off.max())
    backwards = np.array([heads[i][2][::-1].ljust(width, b"\0") for i in rows], f"S{max(width, 1)}")
    by_left = np.argsort(backwards, kind="stable")
    letters = np.ascontiguousarray(backwards[by_left]).view(np.uint8).reshape(len(rows), -1)
    unlike = letters[1:] != letters[:-1]
    common = np.append(0, np.where(unlike.any(1), unlike.argmax(1), letters.shape[1]))
    rank = np.empty(len(rows), np.int64)
    rank[by_left] = np.arange(len(rows))
    hit = np.zeros((len(rows), length - k + 3), bool)  # window number w of a run in column w + 1
    for o in range(length - k + 1):  # windows that start o bytes before the anchor
        r = np.flatnonzero((o <= off) & (o > off - n))
        if len(r) < 2:
            continue
        right = np.cumsum(lcp < length - o)[rows[r]]  # equal where length - o bytes from the anchor on agree
        left = np.cumsum(common < o)[rank[r]]  # equal where o bytes before it agree
        key = left * (len(heads) + 1) + right
        by_key = np.argsort(key, kind="stable")
        again = np.append(False, key[by_key[1:]] == key[by_key[:-1]])
        again = r[by_key[again]]
        hit[again, off[again] - o + 1] = True
    step = np.diff(hit.astype(np.int8), axis=1)
    row, first = np.nonzero(step == 1)
    stop = np.nonzero(step == -1)[1]
    return did[row], tag[row], at[row] - off[row] + first, stop - first


def resolver(length: int, k: int):
    """Runs of windows to repeated windows, by exchanged suffix runs and their merge."""

    def sent_batch(runs: list[tuple[int, bytes]], copied: list[tuple[int, int, int, int]], salt: int) -> pa.RecordBatch:
        a, b = len(runs), len(copied)
        columns = [[x[0] for x in runs] + [None] * b, [salt] * (a + b), [x[1] for x in runs] + [None] * b, *([0] * a + [x[i] for x in copied] for i in range(4))]
        types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["bucket", "salt", "run", "did", "tag", "start", "n"])

    def send(buckets: int, share: Share):
        def run(batches):
            for b in batches:
                data, offsets = utf8(b["text"])
                did, tag = b["did"].to_pylist(), b["tag"].to_pylist()
                for row, start, n, gram, off in chunks_of(b, "byte", length, share):
                    runs: dict[int, list] = {}
                    begin = offsets[row] + start
                    for r, s, m, g, x, y, z in zip(row.tolist(), start.tolist(), n.tolist(), (gram % buckets).tolist(), begin.tolist(), (begin + off).tolist(), (begin + n - 1 + length).tolist(), strict=True):
                        runs.setdefault(g, []).append((data[y:z].tobytes(), data[x:y].tobytes(), m, did[r], tag[r], s))
                    out, copied = [], []
                    for g, rows in runs.items():
                        rows.sort()
                        kept, last = [], (None,) * 6
                        for x in rows:
                            if x[:2] != last[:2]:
                                kept.append(x)
                                last = x
                            elif x[3:] != last[3:]:
                                copied.append((*x[3:], x[2]))
                        out.append((g, front_coded(kept)))
                    yield sent_batch(out, touching(copied), (did[row[0]] ^ tag[row[0]]) % SALTS)

        return run

    def meet(last: bool):
        """Merges each bucket's runs; if not `last`, sends what is left of them on."""

        def settled(bucket, runs, salt):
            heads, copied = heads_and_copies(merged([decoded(x) for x in runs]))
            if last:
                more = repeats_among(heads, length, k)
                return repeats_batch(*(np.concatenate([np.array([x[i] for x in copied], np.int64), more[i]]) for i in range(4)))
            heads.sort(key=lambda x: x[1:3])
            return sent_batch([(bucket, front_coded([tuple(x[1:]) for x in heads]))], copied, salt)

        def run(batches):
            now, runs, salt = None, [], 0
            for b in batches:
                known = b.filter(pa.compute.is_null(b["bucket"]))
                if known.num_rows:
                    yield known.select(["did", "tag", "start", "n"] if last else known.schema.names)
                b = b.filter(pa.compute.is_valid(b["bucket"]))
                for bucket, s, x in zip(b["bucket"].to_pylist(), b["salt"].to_pylist(), b["run"].to_pylist(), strict=True):
                    if (bucket, s if not last else 0) != now and runs:
                        yield settled(now[0], runs, salt)
                        runs = []
                    now, salt = (bucket, s if not last else 0), s
                    runs.append(x)
            if runs:
                yield settled(now[0], runs, salt)

        return run

    def resolve(docs: DataFrame, share: Share) -> DataFrame:
        n = parts(docs.sparkSession)
        buckets = max(4 * n, -(-share.total // BUCKET))
        sent = docs.mapInArrow(send(buckets, share), SENT)
        place = F.when(F.col("bucket").isNull(), by_place())
        if share.single:
            sent = sent.repartition(n, F.coalesce(place, F.xxhash64("bucket", "salt"))).sortWithinPartitions("bucket", "salt").mapInArrow(meet(False), SENT)
        return sent.repartition(n, F.coalesce(place, F.col("bucket"))).sortWithinPartitions("bucket").mapInArrow(meet(True), REPEATS)

    return resolve


def remove_repeats(docs: DataFrame, length: int = 100, anchor: int = 32, hot: int = 100_000) -> DataFrame:
    """doc_id, kept (binary: the remaining bytes), n_bytes, n_removed, n_spans.

    anchor: bytes of an anchor, at most half of length. hot: regions of an anchor, counted once for each map task's batch, beyond which its
    windows are sent one by one, dealt out by their contents, to the same merge.
    """
    if not 0 < 2 * anchor <= length <= 30_000:
        raise ValueError("length must be at most 30,000 and at least twice the anchor")
    keyed, runs = repeated_windows(docs, "byte", length, anchor, resolver(length, anchor), hot)

    def cut(batches):
        for b in batches:
            data, offsets = utf8(b["text"])
            row, start, n = list_of(b["runs"])
            order = np.lexsort((start, row))
            row, start, end = row[order], start[order], start[order] + n[order] - 1 + length
            at = np.searchsorted(row, np.arange(b.num_rows + 1))
            kept, removed, spans_ = [], [], []
            for i in range(b.num_rows):
                text = data[offsets[i] : offsets[i + 1]]
                if at[i] == at[i + 1]:
                    kept.append(text.tobytes())
                    removed.append(0)
                    spans_.append(0)
                    continue
                s, e = start[at[i] : at[i + 1]], np.maximum.accumulate(end[at[i] : at[i + 1]])
                new = np.append(True, s[1:] > e[:-1])
                lo, hi = s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]
                kept.append(b"".join(text[x:y].tobytes() for x, y in zip(np.append(0, hi), np.append(lo, len(text)), strict=True)))
                removed.append(int((hi - lo).sum()))
                spans_.append(len(lo))
            yield pa.RecordBatch.from_arrays(
                [b["did"], pa.array(kept, pa.binary()), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64())],
                ["did", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    out = keyed.join(runs, ["did", "tag"], "left").select("did", "text", "runs").mapInArrow(cut, "did long, kept binary, n_bytes long, n_removed long, n_spans long")
    return out.select(F.when(F.col("did") != NULL_ID, F.col("did")).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
