"""Users' functions and aggregates, and aggregates that depend on an order."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DataType, StructField, StructType


def user_function(f: Callable[..., Any], returns: DataType, pure: bool = True) -> Callable[..., Column]:
    """A function of values as a function of columns, any number of them, run over Arrow batches. Not pure: never moved or called less often."""
    kind = to_arrow_type(returns)

    def run(rows: pa.Array) -> pa.Array:
        return pa.array([f(*values) for values in zip(*(c.to_pylist() for c in rows.flatten()), strict=True)], kind)

    def call(*columns: str | Column) -> Column:
        if not columns:
            raise ValueError("a user's function needs a column")
        udf = F.arrow_udf(run, returns)
        packed = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns)])
        return (udf if pure else udf.asNondeterministic())(packed)

    return call


@dataclass(frozen=True)
class Aggregate:
    """A user's aggregate: init() makes a state, step(state, *values) and merge(state, state) give the next, finish(state) the result. States are pickled."""

    init: Callable[[], Any]
    step: Callable[..., Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Any]


def aggregated(df: DataFrame, keys: tuple[str, ...], values: tuple[str, ...], aggregate: Aggregate, name: str, returns: DataType, groups: int = 50_000) -> DataFrame:
    """keys and the aggregate's result for each group.

    Each task folds its rows into one state for a group (of at most `groups` at once) before the shuffle; states of a group then stream through one merge, never
    held together. No group's rows are gathered.
    """
    states = StructType([*(df.schema[k] for k in keys), StructField("state", BinaryType())])
    result = StructType([*(df.schema[k] for k in keys), StructField(name, returns)])
    n = len(keys)

    def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    def partial(batches):
        held: dict[tuple, Any] = {}
        schema = None
        for b in batches:
            schema = pa.schema([*[b.schema.field(i) for i in range(n)], pa.field("state", pa.binary())])
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key = row[:n]
                held[key] = aggregate.step(held[key] if key in held else aggregate.init(), *row[n:])
            if len(held) > groups:
                yield batch([(*k, pickle.dumps(s)) for k, s in held.items()], schema)
                held = {}
        if held:
            yield batch([(*k, pickle.dumps(s)) for k, s in held.items()], schema)

    def final(batches):
        now, state, schema = None, None, None
        for b in batches:
            schema = pa.schema([*[b.schema.field(i) for i in range(n)], pa.field(name, returned)])
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = pickle.loads(row[n])  # noqa: S301  written by the tasks before
                if now is not None and row[:n] == now:
                    state = aggregate.merge(state, new)
                    continue
                if now is not None:
                    out.append((*now, aggregate.finish(state)))
                now, state = row[:n], new
            if out:
                yield batch(out, schema)
        if now is not None:
            yield batch([(*now, aggregate.finish(state))], schema)

    returned = to_arrow_type(returns)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = df.select(*keys, *values).mapInArrow(partial, states)
    return sent.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(final, result)


def concatenated(value: Column, order: Column | None = None, separator: str = ",", where: Column | None = None) -> Column:
    """Texts of a group joined in an order (by default their own), nulls passed over."""
    value = value if where is None else F.when(where, value)
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct((order if order is not None else value).alias("o"), value.alias("v"))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(F.sort_array(pairs), lambda p: p["v"].cast("string")), separator))


def ordered_array(value: Column, order: Column, descending: bool = False) -> Column:
    """The values of a group as an array in an order, nulls included."""
    return F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), value.alias("v"))), asc=not descending), lambda p: p["v"])


def of_greatest(value: Column, by: Column, *ties: Column) -> Column:
    """The value in the group's row where `by` is greatest, then the ties: what a bare column beside max() gives."""
    return F.max_by(value, F.struct(by, *ties))


def of_least(value: Column, by: Column, *ties: Column) -> Column:
    return F.min_by(value, F.struct(by, *ties))


def about_distinct(value: Column, error: float = 0.02) -> Column:
    """The number of distinct values, by a sketch of bounded size."""
    return F.approx_count_distinct(value, error)


def about_quantile(value: Column, share: float, accuracy: int = 10_000) -> Column:
    """A value whose rank is within 1 / accuracy of the share."""
    return F.percentile_approx(value, share, accuracy)


def rank_of(rows: DataFrame, value: str, found: DataFrame, which: str) -> DataFrame:
    """found, a table of one row, with counts over all rows: _below and _upto, the values under and up to its value in the column `which`, and _n, all values.

    Counts add up in every task, where exact percentiles would hold each distinct value in one.
    """
    v, m = F.col(value), F.col(which)
    one = F.broadcast(found)  # one row
    counts = rows.filter(v.isNotNull()).crossJoin(one.select(which)).agg(F.count_if(v < m).alias("_below"), F.count_if(v <= m).alias("_upto"), F.count("*").alias("_n"))
    return found.crossJoin(F.broadcast(counts))


def within_shares(low: float, high: float) -> Column:
    """Whether a value of the table lies between its exact percentiles (interpolated, as percentile() gives them), by the counts of rank_of; null without values.

    The value has the ranks _below to _upto - 1 of _n - 1: it reaches a percentile if its last rank does, and passes none that its first rank does not.
    """
    last = F.col("_n") - 1
    return F.when(F.col("_n") > 0, (F.col("_upto") - 1 >= low * last) & (F.col("_below") <= high * last))
