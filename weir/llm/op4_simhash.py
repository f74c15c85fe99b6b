"""SimHash near-dedup by deletion-variant signatures.

At most `distance` = 4 differing bits over 3 segments leave one segment with at most one. Each fingerprint is indexed
under its 64 one-wildcard variants: a segment with one bit struck out. Fingerprints that meet under a key are
verified. Equal fingerprints are one row from the start. Two passes keep a crowded key from giving all its pairs:

1. Each fingerprint under a key is verified against the least and the greatest one there; components of these stars.
2. Under keys with several components, all rows outside the key's largest component meet the rows of other
   components. What is in one component already needs no link.

Both passes are exact, and together they join what any chain of links joins.

Chance meetings under a key grow with the square of the number of distinct fingerprints over 2^20. With `pieces` 5 (or 6) keys are pairs (or
triples) of segments, of which one again differs by at most one bit: 260 (640) rows of 25 (31) bits for a fingerprint in place of 64 of 20.

Defined results: null and blank texts have fingerprint zero and link like any other. Rows that repeat a doc_id, or
have none, each get a row; component_id is the least doc_id of the component's rows that have one, null if none has. Other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, checkpoint, parts, real_id, table, utf8, whole_text
from .components import components

#: By number of pieces: first bits and sizes of the segments, and how many make a key.
SEGMENTS = {
    3: (((0, 21), (21, 21), (42, 22)), 1),
    5: (((0, 13), (13, 13), (26, 13), (39, 13), (52, 12)), 2),
    6: (((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)), 3),
}
#: The greatest distance at which the segments of some key differ by at most one bit together.
REACH = {3: 5, 5: 4, 6: 4}
#: Salts of a component's rows where they look up its least doc_id.
SALTS = 16


def simhash(text: bytes, words: int, seed: int = 42) -> int:
    w = text.lower().split()  # of bytes: A-Z, and the words [^\x20\x09-\x0D]+
    if not w:
        return 0
    joined, size = b" ".join(w), np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = (end - size).tolist()
    if len(w) < words:
        h = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        h = [xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(start, end[words - 1 :].tolist(), strict=False)]
    bits = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        bits += np.unpackbits(np.array(h[i : i + (1 << 14)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame, words: int) -> DataFrame:
    """did, h (a hash of the text), fp for every row."""

    def run(batches):
        for b in batches:
            data, offsets = utf8(b["text"])
            raw = data.tobytes()
            fp = np.fromiter((simhash(raw[x:y], words) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b["did"], b["h"], pa.array(fp.view(np.int64))], ["did", "h", "fp"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(whole_text()).alias("h"), whole_text().alias("text"))
    return keyed.mapInArrow(run, "did long, h long, fp long")


def variants(fp: Column, pieces: int = 3) -> Column:
    """Keys: the number of the segments and the struck bit above the segments' bits without it."""
    segments, together = SEGMENTS[pieces]
    keys, number = [], 0
    for chosen in combinations(segments, together):
        part, bits = F.lit(0).cast("long"), 0
        for first, size in chosen:
            part = part.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << size) - 1)), bits))
            bits += size
        for j in range(bits):
            keys.append(F.lit(number << 33).bitwiseOR(part.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << j)))))
            number += 1
    return F.array(*keys)


def near(a: str, b: str, distance: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance


def linked(fps: DataFrame, distance: int = 4, pieces: int = 3) -> DataFrame:
    """(fp, component): distinct fingerprints with the label of all that chains of links reach."""
    if distance > REACH[pieces]:
        raise ValueError(f"keys of {pieces} segments find all pairs up to a distance of {REACH[pieces]}")
    n = parts(fps.sparkSession)
    fps = checkpoint(fps.repartition(n, F.xxhash64("fp")))  # many rows each come next: many tasks, though the fingerprints are few bytes
    index = fps.select("fp", F.explode(variants(F.col("fp"), pieces)).alias("key")).repartition(n, "key")
    crowd = index.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    met = index.join(crowd, "key")
    stars = met.filter((F.col("fp") != F.col("lo")) & near("fp", "lo", distance)).select(F.col("fp").alias("u"), F.col("lo").alias("v"))
    stars = stars.unionByName(met.filter((F.col("fp") != F.col("hi")) & near("fp", "hi", distance)).select(F.col("fp").alias("u"), F.col("hi").alias("v")))
    first = checkpoint(components(stars))

    label = F.coalesce("component", "fp")
    rows = checkpoint(fps.join(first, F.col("fp") == F.col("node"), "left").select("fp", label.alias("comp")).repartition(n, F.xxhash64("fp")))
    index = rows.select("fp", "comp", F.explode(variants(F.col("fp"), pieces)).alias("key")).repartition(n, "key")
    sizes = index.groupBy("key", "comp").count()
    mains = sizes.groupBy("key").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    others = index.join(mains, "key", "left").filter("NOT (comp <=> main)").select("key", F.col("fp").alias("fp1"), F.col("comp").alias("u"))
    pairs = others.join(index.select("key", F.col("fp").alias("fp2"), F.col("comp").alias("v")), "key").filter((F.col("u") != F.col("v")) & near("fp1", "fp2", distance))
    again = checkpoint(components(pairs.select("u", "v")))
    return rows.join(again, F.col("comp") == F.col("node"), "left").select("fp", F.coalesce("component", "comp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, pieces: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id of the component), for every row."""
    marked = checkpoint(fingerprinted(docs, words).select("did", "fp"))
    classes = marked.groupBy("fp").agg(F.min(real_id()).alias("rep"))
    labelled = classes.join(linked(classes.select("fp"), distance, pieces), "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    several = labelled.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n")).filter("n > 1")
    several = several.select("component", "least", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    named = labelled.join(several, ["component", "salt"], "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return marked.join(named, "fp").select(real_id().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, words: int = 4, distance: int = 4, pieces: int = 3) -> DataFrame:
    """One row of docs for each component: the least doc_id (null only if no row has one), then the least 64-bit hash of the text.

    Rows equal in both count as one; of those the least in the other columns stays.
    """
    marked = checkpoint(fingerprinted(docs, words))
    classes = marked.groupBy("fp").agg(F.min(F.struct((F.col("did") == NULL_ID).alias("none"), "did", "h")).alias("rep"))
    kept = classes.join(linked(classes.select("fp"), distance, pieces), "fp").groupBy("component").agg(F.min("rep").alias("rep")).select("rep.did", "rep.h")
    row = F.struct(*(c for c in docs.columns if c != "text"), "text")
    keys = [F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(whole_text()).alias("h")]
    rows = docs.select(*keys, row.alias("row")).groupBy("did", "h").agg(F.min("row").alias("row"))  # partly on the map side: a crowd of equal rows meets as few
    return rows.join(kept, ["did", "h"], "left_semi").select(*(F.col("row")[c].alias(c) for c in docs.columns))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
