"""Joins beyond keys: the latest earlier row, values in ranges, overlapping intervals; each is an equality join or a window at heart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, time: str, right_time: str, by: dict[str, str], key: str = "latest") -> DataFrame:
    """left with the struct column `key`: of the right rows of equal `by` columns (left name: right name) the last at or before left's time, null if there is none.

    Both sides are merged in the order of time within each `by` group, which a group's rows are sorted for once; no pairs are made. Of right rows
    of one time the greatest in all columns counts. A null time or key finds nothing.
    """
    keys = list(by)
    mine = left.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(keys)], F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.schema.simpleString()).alias("_r"))
    other = right.dropna(subset=[right_time, *by.values()]).select(*[F.col(by[c]).alias(f"_b{i}") for i, c in enumerate(keys)], F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema.simpleString()).alias("_l"), F.struct(*right.columns).alias("_r"))
    w = Window.partitionBy(*[f"_b{i}" for i in range(len(keys))]).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = mine.unionByName(other).withColumn("_last", F.last("_r", ignorenulls=True).over(w))
    known = F.lit(True)
    for c in ["_t", *[f"_b{i}" for i in range(len(keys))]]:
        known = known & F.col(c).isNotNull()
    return both.filter("_side = 1").select("_l.*", F.when(known, F.col("_last")).alias(key))


def in_range(left: DataFrame, right: DataFrame, value: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """left joined with the right rows whose [low, high] holds left's value.

    Ranges are cut into cells of `width`, on which the sides meet by equality; a width near the ranges' own gives few rows for each.
    """
    cell = lambda c: F.floor(c.cast("double") / width)
    cells = right.filter(F.col(low) <= F.col(high)).withColumn("_cell", F.explode(F.sequence(cell(F.col(low)), cell(F.col(high)))))
    mine = left.withColumn("_cell", cell(F.col(value)))
    on = (mine["_cell"] == cells["_cell"]) & mine[value].between(cells[low], cells[high])
    return mine.join(cells, on, how).drop("_cell")


def overlapping(left: DataFrame, right: DataFrame, mine: tuple[str, str], other: tuple[str, str], width: float) -> DataFrame:
    """Pairs of rows whose closed intervals meet, each pair once: in the cell where the later of the two begins."""
    cell = lambda c: F.floor(c.cast("double") / width)
    cut = lambda df, ends, name: df.filter(F.col(ends[0]) <= F.col(ends[1])).withColumn(name, F.explode(F.sequence(cell(F.col(ends[0])), cell(F.col(ends[1])))))
    a, b = cut(left, mine, "_ca"), cut(right, other, "_cb")
    once = F.greatest(cell(a[mine[0]]), cell(b[other[0]])) == F.col("_ca")
    on = (F.col("_ca") == F.col("_cb")) & (a[mine[0]] <= b[other[1]]) & (b[other[0]] <= a[mine[1]]) & once
    return a.join(b, on).drop("_ca", "_cb")


def above_cells(left: DataFrame, right: DataFrame, high: Column, low: Column, mine: str, other: str, cells: int = 64) -> tuple[DataFrame, DataFrame]:
    """left with a column `mine` and right with a column `other`, on whose equality each pair with high > low meets, once; few others do.

    high: of left. Its rows come once for each cell up to their own, at most `cells` times; right's rows are in one cell each. Cells are cut at about equal shares of
    right's values, so no outlier makes many. Right's rows are dealt out evenly, for a broadcast of left leaves each to where it stands. Left rows above no value of right and right rows under none of left find no partner and are left out.
    """
    top = left.agg(F.max(high)).first()[0]
    about = right.filter(low < F.lit(top)).agg(F.min(low), F.percentile_approx(low, [i / cells for i in range(1, cells)], 10_000)).first()
    cuts = sorted({x for x in about[1] or () if x == x})

    def cell(c: Column, lo: int = 0, hi: int = len(cuts)) -> Column:
        """The number of cuts at or under c, by halves."""
        if lo == hi:
            return F.lit(lo)
        at = (lo + hi) // 2
        return F.when(c < F.lit(cuts[at]), cell(c, lo, at)).otherwise(cell(c, at + 1, hi))

    a = left.filter(high > F.lit(about[0])).withColumn(mine, F.explode(F.sequence(F.lit(0), cell(high))))
    return a, right.filter(low < F.lit(top)).withColumn(other, cell(low)).repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
