"""Associations between tables: belongs-to, has-one, has-many, through a pivot, and on any condition.

Joined rows stand in a struct column named by the association's key, so that columns of several tables never clash.
To-many aggregates are computed on the child first and joined after, so two of them do not multiply each other's rows.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import above_cells
from .schema import SchemaError, plural, singular

if TYPE_CHECKING:
    from .request import Request


@dataclass(frozen=True)
class Association:
    origin: str
    destination: Request
    left: tuple[str, ...]  # of the origin
    right: tuple[str, ...]  # of the destination, or of the pivot
    key: str
    many: bool
    pivot: Association | None = None  # origin to pivot
    target: Association | None = None  # pivot to destination
    on: Callable[[DataFrame, DataFrame], Column] | None = None
    above: tuple[Callable[[DataFrame], Column], Callable[[DataFrame], Column]] | None = None  # values of the origin and of the destination: only pairs whose first is greater are asked for
    most: int | None = None  # rows of each origin, the first in the destination's order

    # refinement, before the join
    def _with(self, f: Callable[[Request], Request]) -> Association:
        if self.target is not None:
            return replace(self, target=self.target._with(f), destination=f(self.destination))
        return replace(self, destination=f(self.destination))

    def filter(self, condition) -> Association:
        return self._with(lambda r: r.filter(condition))

    def select(self, *columns) -> Association:
        return self._with(lambda r: r.select(*columns))

    def annotated(self, *columns) -> Association:
        return self._with(lambda r: r.annotated(*columns))

    def order(self, *keys) -> Association:
        return self._with(lambda r: r.order(*keys))

    def distinct(self) -> Association:
        return self._with(lambda r: r.distinct())

    def group(self, *columns) -> Association:
        """The destination's rows grouped before the join; select aggregates and the key columns."""
        return self._with(lambda r: r.group(*columns))

    def having(self, condition) -> Association:
        return self._with(lambda r: r.having(condition))

    def limit(self, n: int) -> Association:
        """At most n rows of each origin, the first in the association's order."""
        return replace(self, most=n)

    @property
    def present(self) -> Column:
        """Whether a row was found, where the association is joined optionally."""
        return F.col(self.key).isNotNull()

    def including_required(self, a: Association) -> Association:
        return self._with(lambda r: r.including_required(a))

    def including_optional(self, a: Association) -> Association:
        return self._with(lambda r: r.including_optional(a))

    def unordered(self) -> Association:
        return self._with(lambda r: r.unordered())

    def reversed(self) -> Association:
        return self._with(lambda r: r.reversed() if r.orders else r)

    def for_key(self, key: str) -> Association:
        return replace(self, key=key)

    def same_path(self, other: Association) -> bool:
        return (self.origin, self.destination.table, self.left, self.right) == (other.origin, other.destination.table, other.left, other.right)

    def population(self) -> tuple:
        """What rows it leads to: equal for equal paths with the same conditions, limits and refinements."""
        r = self.destination
        same = lambda conditions: tuple(c if isinstance(c, str) else id(c) for c in conditions)  # noqa: E731  columns can't be compared
        own = (self.origin, r.table, self.left, self.right, self.most, self.on, same(r.filters), same(r.conditions), same(r.groups or ()), r.bounds, r.is_distinct, id(r.source) if r.source is not None else None)
        joins = tuple((k, j.how, j.association.population()) for k, j in r.joins.items())
        return (*own, joins, self.pivot and self.pivot.population(), self.target and self.target.population())

    def narrowed(self, other: Association) -> Association:
        """With the other's filters as well."""
        out = self
        for f in other.destination.filters:
            if all(f is not g for g in self.destination.filters):
                out = out.filter(f)
        return out

    # lowering
    @property
    def orders(self):
        return (self.target or self).destination.orders

    def rows(self) -> DataFrame:
        """_k0 ...: values that the origin's columns must equal; _row: the destination's row; _order: what the destination is ordered by."""
        if self.pivot is not None and self.target is not None:
            middle = self.pivot.rows().drop("_order")
            far = self.target.rows()
            n = len(self.target.left)
            far = far.select(*[F.col(f"_k{i}").alias(f"_f{i}") for i in range(n)], F.col("_row").alias("_far"), "_order")
            on = [F.col(f"_row.{c}") == F.col(f"_f{i}") for i, c in enumerate(self.target.left)]
            return self._limited(middle.join(far, on).select(*[F.col(f"_k{i}") for i in range(len(self.left))], F.col("_far").alias("_row"), "_order"))
        r = replace(self.destination, orders=())
        orders = [s.expression.alias(f"_h_o{i}") for i, s in enumerate(self.destination.orders)] if r.groups is None and not r.is_distinct else []
        names = r.to_df().columns
        hidden = [c for c in self.right if c not in names]  # keys that a narrower selection left out still join
        if hidden or orders:
            r = replace(r, added=(*r.added, *[F.col(c).alias(f"_h_{c}") for c in hidden], *orders))
        d = r.to_df()
        if self.destination.orders and not orders:  # what a grouping or distinct rows are ordered by is among their columns
            d = d.withColumns({f"_h_o{i}": s.expression for i, s in enumerate(self.destination.orders)})
        shown = [F.col(c) for c in names]
        order = [F.col(f"_h_o{i}").alias(f"o{i}") for i in range(len(self.destination.orders))] or [F.lit(None).cast("int").alias("none")]
        return self._limited(d.select(*[F.col(c if c not in hidden else f"_h_{c}").alias(f"_k{i}") for i, c in enumerate(self.right)], F.struct(*shown).alias("_row"), F.struct(*order).alias("_order")))

    def _limited(self, rows: DataFrame) -> DataFrame:
        if self.most is None:
            return rows
        keys = [c for c in rows.columns if c.startswith("_k")]
        sorts = [replace(s, expression=F.col(f"_order.o{i}")).column() for i, s in enumerate(self.orders)] or [F.lit(0)]
        ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*sorts)))
        return ranked.filter(F.col("_n") <= self.most).drop("_n")

    def attach(self, df: DataFrame, key: str, how: str) -> DataFrame:
        """df with the row in the column `key`, and in _order_<key> what it is ordered by."""
        if self.on is not None:
            d = replace(self.destination, orders=()).to_df()
            order = [s.expression.alias(f"o{i}") for i, s in enumerate(self.orders)] or [F.lit(None).cast("int").alias("none")]
            packed = d.select(F.struct(*d.columns).alias(key), F.struct(*order).alias(f"_order_{key}"))
            if self.above is not None and how == "inner":
                cells = [f"_cell_{key}", f"_far_cell_{key}"]
                df, packed = above_cells(df, packed, self.above[0](df), self.above[1](packed), *cells)
                return df.join(packed, self.on(df, packed) & (df[cells[0]] == packed[cells[1]]), how).drop(*cells)
            return df.join(packed, self.on(df, packed), how)
        rows = self.rows().withColumnsRenamed({"_row": key, "_order": f"_order_{key}"})
        on = [df[c] == rows[f"_k{i}"] for i, c in enumerate(self.left)]
        return df.join(rows, on, how).drop(*[f"_k{i}" for i in range(len(self.left))])

    def semi(self, df: DataFrame, how: str) -> DataFrame:
        rows = self.rows().drop("_row", "_order")
        return df.join(rows, [df[c] == rows[f"_k{i}"] for i, c in enumerate(self.left)], how)

    def of(self, origins: DataFrame) -> Request:
        """Request for the destination's rows that belong to these rows of the origin, each once."""
        if self.on is not None:
            raise ValueError("an association on any condition has no key to look rows up by")
        if self.pivot is not None and self.target is not None:
            return self.target.of(self.pivot.of(origins).to_df())
        keys = origins.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(self.left)]).distinct()
        found = lambda df: df.join(keys, [df[c] == keys[f"_k{i}"] for i, c in enumerate(self.right)], "left_semi")
        return self.destination.filter(found)

    def prefetch(self, df: DataFrame, key: str) -> DataFrame:
        """An array of the associated rows, in the association's order; empty where there are none."""
        rows = self.rows()
        keys = [f"_k{i}" for i in range(len(self.left))]
        rows = rows.dropna(subset=keys)
        marks = [(f"o{i}", s) for i, s in enumerate(self.orders)]
        packed = rows.groupBy(*keys).agg(F.collect_list(F.struct(*[F.col(f"_order.{m}").alias(m) for m, _ in marks], "_row")).alias("_all"))
        if marks:

            def compare(a, b):
                out = F.lit(0)
                for m, s in reversed(marks):
                    x, y = a[m], b[m]
                    less = F.lit(1 if s.descending else -1)
                    more = F.lit(-1 if s.descending else 1)
                    first = (not s.descending) if s.nulls_first is None else s.nulls_first
                    out = (
                        F.when(x.isNull() & y.isNull(), out)
                        .when(x.isNull(), F.lit(-1 if first else 1))
                        .when(y.isNull(), F.lit(1 if first else -1))
                        .when(x < y, less)
                        .when(x > y, more)
                        .otherwise(out)
                    )
                return out

            packed = packed.withColumn("_all", F.array_sort("_all", compare))
        packed = packed.withColumn(key, F.transform("_all", lambda x: x["_row"])).drop("_all")
        out = df.join(packed, [df[c] == packed[f"_k{i}"] for i, c in enumerate(self.left)], "left").drop(*keys)
        return out.withColumn(key, F.coalesce(F.col(key), F.array().cast(packed.schema[key].dataType)))

    # aggregates
    def _aggregate(self, name: str, f: Callable[[], Column], default: Any = None) -> AggregateExpression:
        return AggregateExpression(((self, name, f, default),), lambda: F.col(f"`{name}`"), name)

    @property
    def count(self) -> AggregateExpression:
        name = f"{singular(self.key)}Count"
        pk = self.destination.db.meta(self.destination.table).pk
        if self.pivot is not None and pk:  # reached over several pivots, a row counts once
            return self._aggregate(name, lambda: F.count_distinct(*[F.col(f"_row.{c}") for c in pk]), 0)
        return self._aggregate(name, lambda: F.count(F.lit(1)), 0)

    @property
    def is_empty(self) -> AggregateExpression:
        return (self.count == 0).for_key(f"hasNo{self.key[0].upper()}{singular(self.key)[1:] if not self.many else self.key[1:]}")

    def _of(self, what: str, f, column: str, default=None) -> AggregateExpression:
        one = singular(self.key)
        return self._aggregate(f"{what}{one[0].upper()}{one[1:]}{column[0].upper()}{column[1:]}", lambda: f(F.col(f"_row.{column}")), default)

    def average(self, column: str) -> AggregateExpression:
        return self._of("average", F.avg, column)

    def min(self, column: str) -> AggregateExpression:
        return self._of("min", F.min, column)

    def max(self, column: str) -> AggregateExpression:
        return self._of("max", F.max, column)

    def sum(self, column: str) -> AggregateExpression:
        return self._of("sum", F.sum, column)

    def total(self, column: str) -> AggregateExpression:
        return self._of("total", lambda c: F.sum(c.cast("double")), column, 0.0)


@dataclass(frozen=True)
class AggregateExpression:
    """An expression over association aggregates; equal needs are computed once."""

    needs: tuple[tuple[Association, str, Callable[[], Column], Any], ...]
    build: Callable[[], Column]
    name: str

    def column(self) -> Column:
        return self.build()

    def named(self) -> Column:
        return self.build().alias(self.name)

    def for_key(self, name: str) -> AggregateExpression:
        return replace(self, name=name)

    def map(self, f: Callable[[Column], Column]) -> AggregateExpression:
        return replace(self, build=lambda: f(self.build()))

    def _two(self, f, other) -> AggregateExpression:
        if isinstance(other, AggregateExpression):
            return AggregateExpression((*self.needs, *other.needs), lambda: f(self.build(), other.build()), self.name)
        return replace(self, build=lambda: f(self.build(), other))

    def __add__(self, o):
        return self._two(operator.add, o)

    def __sub__(self, o):
        return self._two(operator.sub, o)

    def __mul__(self, o):
        return self._two(operator.mul, o)

    def __truediv__(self, o):
        return self._two(operator.truediv, o)

    def __eq__(self, o):
        return self._two(operator.eq, o)

    def __ne__(self, o):
        return self._two(operator.ne, o)

    def __lt__(self, o):
        return self._two(operator.lt, o)

    def __le__(self, o):
        return self._two(operator.le, o)

    def __gt__(self, o):
        return self._two(operator.gt, o)

    def __ge__(self, o):
        return self._two(operator.ge, o)

    def __and__(self, o):
        return self._two(operator.and_, o)

    def __or__(self, o):
        return self._two(operator.or_, o)

    def __invert__(self):
        return self.map(operator.invert)

    __hash__ = None

    def if_null(self, value) -> AggregateExpression:
        return self.map(lambda c: F.coalesce(c, F.lit(value)))

    @staticmethod
    def prepare(df: DataFrame, expressions: list[AggregateExpression]) -> DataFrame:
        """df with a column for each need: one grouping and one left join for each association key.

        One key means one population: differing ones under one key are refused, as their columns would have one name. Association.for_key tells them apart.
        """
        by_key: dict[str, tuple[Association, dict]] = {}
        for e in expressions:
            for a, name, f, default in e.needs:
                first, wanted = by_key.setdefault(a.key, (a, {}))
                if first.population() != a.population():
                    raise SchemaError(f"aggregates of differing rows under the association key {a.key}: give one of them a key of its own")
                wanted[name] = (f, default)
        for a, wanted in by_key.values():
            keys = [f"_k{i}" for i in range(len(a.left))]
            grouped = a.rows().groupBy(*keys).agg(*[f().alias(n) for n, (f, _) in wanted.items()])
            df = df.join(grouped, [df[c] == grouped[k] for c, k in zip(a.left, keys, strict=True)], "left").drop(*keys)
            df = df.withColumns({n: F.coalesce(F.col(n), F.lit(d)) for n, (_, d) in wanted.items() if d is not None})
        return df


def belongs_to(origin: Request, destination: Request, *columns: str, key: str | None = None) -> Association:
    left, right = origin.db.infer(origin.table, destination.table, columns)
    return Association(origin.table, destination, left, right, key or singular(destination.table), False)


def has_many(origin: Request, destination: Request, *columns: str, key: str | None = None) -> Association:
    right, left = origin.db.infer(destination.table, origin.table, columns)
    return Association(origin.table, destination, left, right, key or plural(destination.table), True)


def has_one(origin: Request, destination: Request, *columns: str, key: str | None = None) -> Association:
    right, left = origin.db.infer(destination.table, origin.table, columns)
    return Association(origin.table, destination, left, right, key or singular(destination.table), False)


def through(pivot: Association, target: Association, key: str | None = None) -> Association:
    """From pivot's origin over pivot to target's destination."""
    many = pivot.many or target.many
    name = key or (plural if many else singular)(target.destination.table)
    return Association(pivot.origin, target.destination, pivot.left, pivot.right, name, many, pivot, target)


def associated_on(origin: Request, destination: Request, key: str, on: Callable[[DataFrame, DataFrame], Column], above: tuple[Callable[[DataFrame], Column], Callable[[DataFrame], Column]] | None = None) -> Association:
    """Any condition between the origin and the destination's struct column.

    above: a further condition, that the first value (of the origin) is greater than the second (of the struct column). Where the association is required, rows then meet in
    cells of these values, which deals out what a condition on few keys would leave to a few tasks.
    """
    met = on if above is None else lambda df, o: on(df, o) & (above[0](df) > above[1](o))
    return Association(origin.table, destination, (), (), key, True, on=met, above=above)
