"""Immutable requests: what to read, join, filter, group, order and limit, lowered to one DataFrame.

A request differs from a DataFrame in when things apply: filters and having conditions add up, while select, order, group
and limit replace what was said before, and a limit holds after all filters whatever the order of the calls.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.sql import SQL
from .associations import AggregateExpression, Association
from .schema import Catalog, SchemaError


class NotFound(LookupError):
    pass


class NotSupported(ValueError):
    pass


@dataclass(frozen=True)
class Join:
    association: Association
    how: str  # inner or left
    shown: bool  # as a struct column named by the association's key
    flat: tuple[str, ...] = ()  # columns shown beside the origin's


@dataclass(frozen=True)
class Sort:
    expression: Column
    descending: bool = False
    nulls_first: bool | None = None  # None: nulls count as least

    def column(self) -> Column:
        first = (not self.descending) if self.nulls_first is None else self.nulls_first
        name = ("desc" if self.descending else "asc") + ("_nulls_first" if first else "_nulls_last")
        return getattr(self.expression, name)()

    def reversed(self) -> Sort:
        return Sort(self.expression, not self.descending, None if self.nulls_first is None else not self.nulls_first)


def asc(c) -> Sort:
    return Sort(col(c))


def desc(c) -> Sort:
    return Sort(col(c), True)


def asc_nulls_last(c) -> Sort:
    return Sort(col(c), False, False)


def desc_nulls_first(c) -> Sort:
    return Sort(col(c), True, True)


#: A string of this form is a column's name; any other is SQL.
NAME = re.compile(r"(\w+|`[^`]+`)(\.(\w+|`[^`]+`))*")


def col(c: str | Column | SQL) -> Column:
    """A column of a name, of SQL text, or of SQL with bound values."""
    if isinstance(c, SQL):
        return c.column()
    return c if isinstance(c, Column) else F.col(c) if NAME.fullmatch(c) else F.expr(c)


def all_that(*conditions: Column) -> Column:
    """True without any."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True)) if conditions else F.lit(True)


def any_that(*conditions: Column) -> Column:
    """False without any."""
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


@dataclass(frozen=True)
class Request:
    db: Catalog
    table: str
    source: DataFrame | None = None
    filters: tuple[Any, ...] = ()
    selected: tuple[Any, ...] | None = None
    added: tuple[Any, ...] = ()
    orders: tuple[Sort, ...] = ()
    groups: tuple[Column, ...] | None = None
    conditions: tuple[Any, ...] = ()
    bounds: tuple[int | None, int] | None = None
    is_distinct: bool = False
    joins: dict[str, Join] = field(default_factory=dict)
    prefetched: dict[str, Association] = field(default_factory=dict)
    alias: str | None = None
    sets: tuple[tuple[str, ...], ...] | None = None  # grouping sets

    # building
    def filter(self, condition: Column | str | SQL | AggregateExpression | Callable) -> Request:
        return replace(self, filters=(*self.filters, condition))

    def aliased(self, name: str) -> Request:
        """The request's own columns can be called name.column, beside the columns of associations."""
        return replace(self, alias=name)

    # subqueries
    def filter_in(self, columns, other: Request | DataFrame) -> Request:
        """Rows whose values of these columns are a row of the other request; a semi join."""
        return self.filter(lambda df: df.join(*self._matched(df, columns, other), "left_semi"))

    def filter_not_in(self, column: str | Column, other: Request | DataFrame) -> Request:
        """NOT IN with its three-valued logic: no row if the other holds a null; a null value only passes if the other is empty.

        An anti join on distinct values that either side may shuffle, and one row about the other's nulls.
        """

        def keep(df: DataFrame) -> DataFrame:
            rows = other.to_df() if isinstance(other, Request) else other
            value = F.col(rows.columns[0])
            about = rows.agg(F.count("*").alias("_rows"), F.count_if(value.isNull()).alias("_nulls"))
            left = df.join(*self._matched(df, (column,), rows.filter(value.isNotNull())), "left_anti")
            checked = left.crossJoin(F.broadcast(about))  # one row
            return checked.filter((F.col("_rows") == 0) | ((F.col("_nulls") == 0) & col(column).isNotNull())).select(df["*"])

        return self.filter(keep)

    def _matched(self, df: DataFrame, columns, other: Request | DataFrame):
        rows = other.to_df() if isinstance(other, Request) else other
        columns = (columns,) if isinstance(columns, str | Column) else tuple(columns)
        keys = rows.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(rows.columns)]).distinct()
        return keys, [col(c) == keys[f"_in{i}"] for i, c in enumerate(columns)]

    def filter_exists(self, other: Request | DataFrame, on: Callable[[DataFrame, DataFrame], Column] | None = None, negated: bool = False) -> Request:
        """Rows for which the other has a row, on a condition over both, or at all."""

        def keep(df: DataFrame) -> DataFrame:
            rows = other.to_df() if isinstance(other, Request) else other
            return df.join(rows if on else rows.limit(1), on(df, rows) if on else F.lit(True), "left_anti" if negated else "left_semi")

        return self.filter(keep)

    def scalar(self) -> Column:
        """The single value of a request of one row and column, as an expression; outer columns may be named by .outer()."""
        return self.to_df().scalar()

    def with_table(self, name: str, rows: Request | DataFrame, key: tuple[str, ...] = (), columns: tuple[str, ...] = ()) -> Request:
        """A common table expression: rows that this request, and requests made from its db, can read and join under a name."""
        df = rows.to_df() if isinstance(rows, Request) else rows
        return replace(self, db=self.db.with_view(name, df.toDF(*columns) if columns else df, key))

    # sets of rows
    def union(self, other: Request, every: bool = False) -> Request:
        return self._combined("union all" if every else "union", other)

    def intersect(self, other: Request, every: bool = False) -> Request:
        return self._combined("intersect all" if every else "intersect", other)

    def subtract(self, other: Request, every: bool = False) -> Request:
        return self._combined("except all" if every else "except", other)

    def _combined(self, how: str, other: Request) -> Request:
        """What follows (filters, orders, limits) holds for the combined rows."""
        one, two = self.to_df(), other.to_df()
        f = {"union all": one.union, "union": lambda x: one.union(x).distinct(), "intersect": one.intersect, "intersect all": one.intersectAll, "except": one.subtract, "except all": one.exceptAll}
        return Request(self.db, self.table, f[how](two))

    # rows of groups
    def first_of_each(self, *columns: str, order) -> Request:
        """Of the rows with equal values of these columns the first in an order: a partial aggregate where all orders ascend or descend alike by plain values, a window otherwise."""
        sorts = [k if isinstance(k, Sort) else asc(k) for k in (order if isinstance(order, list | tuple) else (order,))]

        def keep(df: DataFrame) -> DataFrame:
            w = Window.partitionBy(*columns).orderBy(*[s.column() for s in sorts])
            return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")

        return self.filter(keep)

    def annotated_over(self, partition: tuple[str, ...] | str, order, frame: tuple[int, int] | None = None, **expressions: Column) -> Request:
        """Columns of window functions or aggregates over the partition's rows in an order, or those from frame[0] to frame[1] around each row."""
        partition = (partition,) if isinstance(partition, str) else partition
        sorts = [k if isinstance(k, Sort) else asc(k) for k in (order if isinstance(order, list | tuple) else (order,))]
        w = Window.partitionBy(*partition).orderBy(*[s.column() for s in sorts])
        w = w.rowsBetween(*frame) if frame else w
        return self.annotated(*[x.over(w).alias(name) for name, x in expressions.items()])

    def rollup(self, *columns: str) -> Request:
        return self.grouping_sets(*[columns[:i] for i in range(len(columns), -1, -1)])

    def cube(self, *columns: str) -> Request:
        return self.grouping_sets(*[tuple(c for i, c in enumerate(columns) if bits >> i & 1) for bits in range(2 ** len(columns))])

    def grouping_sets(self, *sets: tuple[str, ...]) -> Request:
        """Groups by each set of columns in turn; a column that a set lacks is null there."""
        names = list(dict.fromkeys(c for s in sets for c in s))
        return replace(self, groups=tuple(map(F.col, names)), sets=sets)

    def none(self) -> Request:
        return self.filter(F.lit(False))

    def all(self) -> Request:
        return self

    def filter_key(self, *values) -> Request:
        """Rows of these primary keys: values, or tuples for a compound key. A null finds nothing."""
        pk = self.db.meta(self.table).pk
        if not pk:
            raise NotSupported(f"{self.table} has no primary key")
        rows = [v if isinstance(v, tuple) else (v,) for v in values]
        if len(pk) == 1:
            return self.filter(F.col(pk[0]).isin([r[0] for r in rows if r[0] is not None])) if rows else self.none()
        tests = [reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(pk, r, strict=True)]) for r in rows]
        return self.filter(reduce(lambda a, b: a | b, tests)) if tests else self.none()

    def filter_unique(self, *keys: dict[str, Any]) -> Request:
        """Rows of these values of a primary or unique key; others are refused."""
        known = {frozenset(k) for k in self.db.unique_keys(self.table)}
        for k in keys:
            if frozenset(k) not in known:
                raise SchemaError(f"{', '.join(k)} is no unique key of {self.table}")
        tests = [reduce(lambda a, b: a & b, [F.col(c).isNull() if v is None else F.col(c) == v for c, v in k.items()]) for k in keys]
        return self.filter(reduce(lambda a, b: a | b, tests)) if tests else self.none()

    def select(self, *columns) -> Request:
        return replace(self, selected=columns, added=())

    def select_key(self) -> Request:
        return self.select(*self.db.meta(self.table).pk)

    def all_columns(self, excluding: tuple[str, ...] = ()) -> list[str]:
        out = {x.lower() for x in excluding}
        return [c for c in self.base().columns if c.lower() not in out]

    def annotated(self, *columns) -> Request:
        return replace(self, added=(*self.added, *columns))

    def distinct(self) -> Request:
        return replace(self, is_distinct=True)

    def group(self, *columns) -> Request:
        return replace(self, groups=tuple(map(col, columns)))

    def group_by_key(self) -> Request:
        return self.group(*self.db.meta(self.table).pk)

    def having(self, condition) -> Request:
        return replace(self, conditions=(*self.conditions, condition))

    def order(self, *keys) -> Request:
        return replace(self, orders=tuple(k if isinstance(k, Sort) else asc(k) for k in keys))

    def order_by_key(self) -> Request:
        return self.order(*self.db.meta(self.table).pk)

    def stable_order(self) -> Request:
        """The key, or all columns of a table without one, after the keys given."""
        return replace(self, orders=(*self.orders, *(asc(c) for c in self.db.meta(self.table).pk or self.base().columns)))

    def reversed(self) -> Request:
        """All orders the other way round, those of joined associations too; the key's without any."""
        own = self.orders or (() if self._joined_orders() else tuple(asc(c) for c in self.db.meta(self.table).pk))
        return replace(self._with_associations(Association.reversed), orders=tuple(s.reversed() for s in own))

    def unordered(self) -> Request:
        return replace(self._with_associations(Association.unordered), orders=())

    def _with_associations(self, f: Callable[[Association], Association]) -> Request:
        return replace(self, joins={k: replace(j, association=f(j.association)) for k, j in self.joins.items()})

    def _joined_orders(self) -> tuple[Sort, ...]:
        return tuple(replace(s, expression=F.col(f"_order_{key}.o{i}")) for key, j in self.joins.items() for i, s in enumerate(j.association.orders))

    def limit(self, n: int | None, offset: int = 0) -> Request:
        return replace(self, bounds=(n, offset))

    def _join(self, a: Association, how: str, shown: bool, flat: tuple[str, ...] = ()) -> Request:
        """The same key joined again is one join: its conditions add up and inner wins."""
        if how == "left" and any(j.how == "inner" for j in a.destination.joins.values()):
            raise NotSupported(f"{a.key} is optional, but requires an association of its own")
        old = self.joins.get(a.key)
        if old is not None:
            if not old.association.same_path(a):
                raise NotSupported(f"two different associations with the key {a.key}")
            a = old.association.narrowed(a)
            how, shown, flat = "inner" if "inner" in (how, old.how) else "left", shown or old.shown, (*old.flat, *flat)
        return replace(self, joins=self.joins | {a.key: Join(a, how, shown, flat)})

    def including_required(self, a: Association) -> Request:
        return self._join(a, "inner", True)

    def including_optional(self, a: Association) -> Request:
        return self._join(a, "left", True)

    def joining_required(self, a: Association) -> Request:
        return self._join(a, "inner", False)

    def joining_optional(self, a: Association) -> Request:
        return self._join(a, "left", False)

    def annotated_with_required(self, a: Association, *columns: str) -> Request:
        return self._join(a, "inner", False, columns)

    def annotated_with_optional(self, a: Association, *columns: str) -> Request:
        return self._join(a, "left", False, columns)

    def including_all(self, a: Association) -> Request:
        return replace(self, prefetched=self.prefetched | {a.key: a})

    def having_any(self, a: Association) -> Request:
        """Rows with at least one associated row, by a semi join."""
        return self.filter(lambda df: a.semi(df, "left_semi"))

    def having_no(self, a: Association) -> Request:
        return self.filter(lambda df: a.semi(df, "left_anti"))

    # lowering
    def base(self) -> DataFrame:
        df = self.source if self.source is not None else self.db.df(self.table)
        return df.alias(self.alias) if self.alias else df

    def to_df(self) -> DataFrame:
        df = self.base()
        own = list(self.db.meta(self.table).selection) or df.columns
        for key, j in self.joins.items():
            df = j.association.attach(df, key, j.how)
        needs = [x for x in (*self.filters, *self.added, *self.conditions, *(self.selected or ())) if isinstance(x, AggregateExpression)]
        df = AggregateExpression.prepare(df, needs)
        for f in self.filters:  # Catalyst moves them below the joins
            if isinstance(f, AggregateExpression):
                df = df.filter(f.column())
            elif isinstance(f, Column | str | SQL):
                df = df.filter(f.column() if isinstance(f, SQL) else f)
            else:
                df = f(df)
        flat = [F.col(f"{key}.{c}").alias(c) for key, j in self.joins.items() for c in j.flat]
        shown = [F.col(key) for key, j in self.joins.items() if j.shown]
        added = [x.named() if isinstance(x, AggregateExpression) else col(x) for x in self.added]
        if self.groups is not None:
            names = [f"_g{i}" for i in range(len(self.groups))]
            keys = [g.alias(n) for g, n in zip(self.groups, names, strict=True)]
            chosen = list(self.selected if self.selected is not None else self.groups) + added
            checks = [c for c in self.conditions if not isinstance(c, AggregateExpression)]
            if self.sets is not None:
                grouped = df.groupingSets([[F.col(c) for c in s] for s in self.sets], *self.groups)
                out = grouped.agg(*[c for c in chosen if not isinstance(c, str) and all(c is not g for g in self.groups)], *[col_(c).alias(f"_h{i}") for i, c in enumerate(checks)])
            else:
                out = df.groupBy(*keys).agg(*[c if isinstance(c, Column) else col(c) if isinstance(c, SQL) or not NAME.fullmatch(c) else F.first(F.col(c)).alias(c.rpartition(".")[2].strip("`")) for c in chosen], *[col_(c).alias(f"_h{i}") for i, c in enumerate(checks)])
            for i in range(len(checks)):
                out = out.filter(f"_h{i}")
            df = out.drop(*names, *[f"_h{i}" for i in range(len(checks))])
            orders = [s.column() for s in self.orders]
        else:
            for c in self.conditions:
                df = df.filter(c.column() if isinstance(c, AggregateExpression) else c)
            for key, a in self.prefetched.items():
                df = a.prefetch(df, key)
            wanted = [x.named() if isinstance(x, AggregateExpression) else col(x) for x in self.selected] if self.selected is not None else [F.col(c) for c in own]
            sorts = (*self.orders, *self._joined_orders())  # joined tables' orders come last
            if sorts and not self.is_distinct:  # ordering may use columns that are not selected
                df = df.orderBy(*[s.column() for s in sorts])
                df = self._bounded(df)
                return df.select(*wanted, *added, *flat, *shown, *[F.col(k) for k in self.prefetched])
            df = df.select(*wanted, *added, *flat, *shown, *[F.col(k) for k in self.prefetched])
            orders = [s.column() for s in self.orders]
        if self.is_distinct:
            df = df.distinct()
        if orders:
            df = df.orderBy(*orders)
        return self._bounded(df)

    def _bounded(self, df: DataFrame) -> DataFrame:
        if self.bounds is None:
            return df
        n, offset = self.bounds
        df = df.offset(offset) if offset else df
        return df if n is None else df.limit(n)

    # fetching
    def fetch_all(self) -> list:
        return self.to_df().collect()

    def fetch_cursor(self):
        return self.to_df().toLocalIterator()

    def fetch_one(self):
        return self.to_df().first()

    def fetch_set(self) -> set:
        return set(self.to_df().distinct().collect())

    def width(self) -> int:
        """The number of columns that the request selects."""
        return len(self.to_df().columns)

    def counted(self) -> Request:
        """What has as many rows: without orders and prefetched rows, and without optional to-one joins that no condition can refer to."""
        r = replace(self.unordered(), prefetched={})
        if r.groups is not None or r.is_distinct or r.filters or r.conditions:
            return r
        joins = {k: j for k, j in r.joins.items() if j.how == "inner" or j.association.many or j.association.on is not None}
        return replace(r, joins=joins, selected=() if r.bounds is None and not r.added else r.selected)

    def fetch_count(self) -> int:
        return self.counted().to_df().count()

    def is_empty(self) -> bool:
        return self.unordered().to_df().isEmpty()

    def exists(self, *key) -> bool:
        return not self.filter_key(key if len(key) > 1 else key[0]).is_empty()

    def exists_unique(self, **key) -> bool:
        return not self.filter_unique(key).is_empty()

    def find_unique(self, **key):
        row = self.filter_unique(key).fetch_one()
        if row is None:
            raise NotFound(f"{self.table} has no row of {key}")
        return row

    def find(self, *key):
        row = self.filter_key(key if len(key) > 1 else key[0]).fetch_one()
        if row is None:
            raise NotFound(f"{self.table} has no row of the key {key}")
        return row


def col_(c) -> Column:
    return c.column() if isinstance(c, SQL) else F.expr(c) if isinstance(c, str) else c
