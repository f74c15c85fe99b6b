"""Mutations as DataFrames: each returns the table as it is after them, and the rows that they touched.

A table of files has no row updates, so the new state is a declared query over the old one; publish() writes it as a new
version beside the old ones, which readers of those keep.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schema import Catalog, SchemaError, TableMeta


class Conflict(ValueError):
    """A row of the same key is there already."""


@dataclass(frozen=True)
class Hooks:
    """Calls around mutations. will: takes the kind and the incoming or doomed rows, and returns the rows to go on with, or raises
    to stop; did: takes the kind and the touched rows. Both get DataFrames, so that what they do stays declared. kind: insert, update or delete."""

    will: Callable[[str, DataFrame], DataFrame] = lambda kind, rows: rows
    did: Callable[[str, DataFrame], None] = lambda kind, rows: None


@dataclass(frozen=True)
class Assignments:
    """Operators on a column's stored value: to("c_acctbal").plus(5)."""

    column: str

    def _new(self, value) -> dict[str, Column]:
        return {self.column: value}

    def set(self, value) -> dict[str, Column]:
        return self._new(value if isinstance(value, Column) else F.lit(value))

    def plus(self, value) -> dict[str, Column]:
        return self._new(F.col(self.column) + value)

    def minus(self, value) -> dict[str, Column]:
        return self._new(F.col(self.column) - value)

    def times(self, value) -> dict[str, Column]:
        return self._new(F.col(self.column) * value)

    def over(self, value) -> dict[str, Column]:
        """Divided, whole numbers by whole numbers towards zero."""
        value = value if isinstance(value, Column) else F.lit(value)
        whole = (F.typeof(self.column).isin("tinyint", "smallint", "int", "bigint")) & (F.typeof(value).isin("tinyint", "smallint", "int", "bigint"))
        by = F.nullif(value, F.lit(0))
        quotient = F.col(self.column).cast("double") / by
        return self._new(F.when(whole, F.when(quotient < 0, F.ceil(quotient)).otherwise(F.floor(quotient)).cast("double")).otherwise(quotient))

    def bits_and(self, value) -> dict[str, Column]:
        return self._new(F.col(self.column).bitwiseAND(value))

    def bits_or(self, value) -> dict[str, Column]:
        return self._new(F.col(self.column).bitwiseOR(value))


to = Assignments


@dataclass(frozen=True)
class Mutable:
    """A table in change. meta: keys and rules that every new state holds; without one only the key is looked at."""

    df: DataFrame
    key: tuple[str, ...]
    hooks: Hooks = field(default_factory=Hooks)
    meta: TableMeta | None = None

    @staticmethod
    def of(db: Catalog, table: str, hooks: Hooks | None = None) -> Mutable:
        return Mutable(db.df(table), db.meta(table).pk, hooks or Hooks(), db.meta(table))

    def _on(self, other: DataFrame) -> DataFrame:
        return other.select(*self.key).distinct()

    def _one_of_each(self, rows: DataFrame, last: bool, order: Column | None, key: tuple[str, ...] | None = None) -> DataFrame:
        """Of the rows of one key the first or last in the given order, else by all their columns: a partial aggregate, no row of a key meets another's."""
        key = key or self.key
        fields = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        rank = F.struct(order.alias("o"), fields.alias("r")) if order is not None else fields
        pick = (F.max_by if last else F.min_by)(fields, rank).alias("_kept")
        return rows.groupBy(*key).agg(pick).select("_kept.*")

    def _hold(self, rows: DataFrame) -> None:
        """Raises Conflict if new rows break a rule of the table on their own."""
        if self.meta is None:
            return
        needed = {c: F.col(c).isNotNull() for c in (*self.key, *self.meta.required)}
        rules = {f"{c} is null": test for c, test in needed.items()} | {n: F.coalesce(F.expr(sql), F.lit(True)) for n, sql in self.meta.checks.items()}
        if rules:
            broken = rows.agg(*[F.count_if(~test).alias(f"b{i}") for i, test in enumerate(rules.values())]).first()
            found = [n for n, count in zip(rules, broken, strict=True) if count]
            if found:
                raise Conflict("; ".join(found))

    def _unique(self, df: DataFrame) -> None:
        for u in self.meta.unique if self.meta else ():
            rows = df.dropna(subset=list(u))
            if not rows.groupBy(*u).count().filter("count > 1").isEmpty():
                raise Conflict(f"{', '.join(u)} not unique")

    def insert(self, rows: DataFrame, on_conflict: str = "abort", defaults: dict[str, Column] | None = None, order: Column | None = None) -> tuple[Mutable, DataFrame]:
        """on_conflict: abort, fail or rollback raise Conflict, at keys that repeat within the new rows too. ignore keeps the row that is there, or of the new
        rows of one key the first; replace the last. The rows come in the order of an expression, else of all their columns.

        ignore passes over, and replace removes, rows of other unique keys alike. Rules of the table are checked after defaults are filled in.
        """
        rows = self.hooks.will("insert", rows)
        filled = ({c: F.expr(sql) for c, sql in self.meta.defaults.items()} if self.meta else {}) | (defaults or {})
        for c, v in filled.items():
            rows = rows.withColumn(c, F.coalesce(F.col(c), v) if c in rows.columns else v)
        ordered = rows.withColumn("_order", order if order is not None else F.lit(0))
        types = self.df.schema
        rows = ordered.select(*[F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in types.fields], "_order")
        if on_conflict == "ignore" and self.meta is not None:  # rows that break a rule are passed over as well
            tests = [F.col(c).isNotNull() for c in (*self.key, *self.meta.required)] + [F.coalesce(F.expr(sql), F.lit(True)) for sql in self.meta.checks.values()]
            rows = rows.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))
        else:
            self._hold(rows)
        keys = [k for k in (self.key, *(self.meta.unique if self.meta else ())) if k]
        if on_conflict in ("ignore", "replace"):
            kept = rows
            for k in keys:
                lone = kept.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in k]))
                kept = self._one_of_each(kept.dropna(subset=list(k)), on_conflict == "replace", F.col("_order"), k).unionByName(lone)
            new, old = kept.drop("_order"), self.df
            for k in keys:
                if on_conflict == "ignore":
                    new = new.join(self.df.select(*k).distinct(), list(k), "left_anti").select(*self.df.columns)
                else:
                    old = old.join(new.select(*k).distinct(), list(k), "left_anti").select(*self.df.columns)
            return self._done("insert", old.unionByName(new), new)
        rows = rows.drop("_order")
        for k in keys:
            mine = rows.dropna(subset=list(k))
            if not mine.groupBy(*k).count().filter("count > 1").isEmpty() or not mine.join(self.df.select(*k).distinct(), list(k), "left_semi").isEmpty():
                raise Conflict(f"a row with the same {', '.join(k)}")
        return self._done("insert", self.df.unionByName(rows), rows)

    def upsert(self, rows: DataFrame, assign: dict[str, Column] | None = None, order: Column | None = None) -> tuple[Mutable, DataFrame]:
        """Rows of new keys are inserted; others update. assign: by column, an expression over the old columns and new.column; default: all new values.

        Of rows of one key the last counts, in the order of an expression, else of all columns.
        """
        rows = self.hooks.will("update", rows)
        columns = rows.columns
        ordered = rows.withColumn("_order", order if order is not None else F.lit(0))
        rows = self._one_of_each(ordered, True, F.col("_order")).select(*columns)
        old = self.df.select(*self.key, F.struct(*self.df.columns).alias("old"))
        new = rows.select(*self.key, F.struct(*rows.columns).alias("new"))
        both = old.join(new, list(self.key), "full")
        out = []
        for c in self.df.columns:
            changed = assign[c] if assign and c in assign else (F.col(f"new.{c}") if c in rows.columns and not assign else F.col(f"old.{c}"))
            fresh = F.col(f"new.{c}") if c in rows.columns else F.lit(None)
            out.append(F.when(F.col("new").isNull(), F.col(f"old.{c}")).when(F.col("old").isNull(), fresh).otherwise(changed).cast(self.df.schema[c].dataType).alias(c))
        touched = both.filter("new IS NOT NULL").select(*out)
        self._hold(touched)
        after = both.select(*out)
        self._unique(after)
        return self._done("update", after, touched)

    def save(self, rows: DataFrame) -> tuple[Mutable, DataFrame]:
        """Updates the rows whose keys are there, in the columns that rows has, and inserts the others."""
        return self.upsert(rows)

    def changed_values(self, rows: DataFrame) -> DataFrame:
        """key, and a map from column name to old value as text, for the rows that differ from the stored ones of their keys."""
        values = [c for c in rows.columns if c not in self.key]
        new = rows.select(*self.key, F.struct(*values).alias("_new"))
        pairs = [F.when(~F.col(c).eqNullSafe(F.col(f"_new.{c}")), F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value"))) for c in values]
        both = self.df.join(new, list(self.key))
        return both.select(*self.key, F.map_from_entries(F.filter(F.array(*pairs), lambda p: p.isNotNull())).alias("changed")).filter(F.size("changed") > 0)

    def update(self, condition: Column, **assignments: Column) -> tuple[Mutable, DataFrame] | None:
        """None without an assignment. The hook sees the changed rows, and may stop the update or let fewer or other rows through; these must keep their keys."""
        if not assignments:
            return None
        types = self.df.schema
        new = {c: v.cast(types[c].dataType) for c, v in assignments.items()}
        touched = self.df.filter(condition).select(*[new[c].alias(c) if c in new else F.col(c) for c in self.df.columns])
        passed = self.hooks.will("update", touched)
        self._hold(passed)
        if passed is touched:
            after = self.df.select(*[F.when(condition, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in self.df.columns])
        elif set(new) & set(self.key):
            raise SchemaError("a hook that passes other rows on can't be met by an update of the key")
        else:
            after = self.df.join(self._on(passed), list(self.key), "left_anti").select(*self.df.columns).unionByName(passed)
        if self.meta and any(set(new) & set(u) for u in self.meta.unique):
            self._unique(after)
        return self._done("update", after, passed)

    def delete(self, condition: Column) -> tuple[Mutable, DataFrame]:
        doomed = self.df.filter(condition)
        passed = self.hooks.will("delete", doomed)
        if passed is doomed:
            return self._done("delete", self.df.filter(~F.coalesce(condition, F.lit(False))), doomed)
        keys = self._on(passed)
        return self._done("delete", self.df.join(keys, list(self.key), "left_anti").select(*self.df.columns), self.df.join(keys, list(self.key), "left_semi").select(*self.df.columns))

    def delete_rows(self, rows: DataFrame) -> tuple[Mutable, DataFrame]:
        """Rows of the keys that a request gives."""
        rows = self._on(self.hooks.will("delete", rows))
        return self._done("delete", self.df.join(rows, list(self.key), "left_anti").select(*self.df.columns), self.df.join(rows, list(self.key), "left_semi").select(*self.df.columns))

    def changes(self, newer: DataFrame) -> DataFrame:
        """key, kind (insert, update or delete) against a later state: what an observer of rows would see."""
        values = [c for c in self.df.columns if c not in self.key]
        a = self.df.select(*self.key, F.struct(*values).alias("_a"))
        b = newer.select(*self.key, F.struct(*values).alias("_b"))
        kind = F.when(F.col("_a").isNull(), "insert").when(F.col("_b").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "update")
        return a.join(b, list(self.key), "full").select(*self.key, kind.alias("kind")).filter("kind IS NOT NULL")

    def check(self, unique: tuple[str, ...] = (), conditions: dict[str, Column] | None = None) -> None:
        if unique and not self.df.groupBy(*unique).count().filter("count > 1").isEmpty():
            raise Conflict(f"{', '.join(unique)} not unique")
        if conditions and not self.df.filter(~reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(True)) for c in conditions.values()])).isEmpty():
            raise Conflict(f"check failed: {', '.join(conditions)}")

    def publish(self, folder: str, version: int, then: Callable[[str], None] | None = None) -> str:
        """Writes the state as a new version; then: called with its path once it is wholly written."""
        path = f"{folder}/version={version}"
        self.df.write.parquet(path)
        if then is not None:
            then(path)
        return path

    def _done(self, kind: str, df: DataFrame, touched: DataFrame) -> tuple[Mutable, DataFrame]:
        self.hooks.did(kind, touched)
        return replace(self, df=df), touched


def delete_cascading(db: Catalog, table: str, doomed: DataFrame, defaults: dict[str, Column] | None = None) -> Catalog:
    """The catalog without the doomed rows of a table, after what its foreign keys say of the rows that refer to them.

    cascade removes those too, and so on; set null and set default change their columns; restrict raises Conflict if any are
    left. Each table is joined once for each foreign key, with the keys that are gone. Tables that refer to each other in a
    circle by cascades are refused: each round would be a job of its own.
    """
    key = db.meta(table).pk
    left = {table: db.df(table).join(doomed.select(*key).distinct(), list(key), "left_anti").select(*db.df(table).columns)}
    gone = {table: db.df(table).join(doomed.select(*key).distinct(), list(key), "left_semi").select(*db.df(table).columns)}
    for child in _children_first(db, table):
        rows, lost = db.df(child), []
        columns, guarded = rows.columns, []
        for fk in sorted(db.meta(child).fks, key=lambda fk: fk.on_delete != "cascade"):
            if fk.table not in gone:
                continue
            keys = gone[fk.table].select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(fk.to)]).distinct()
            on = [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(fk.columns)]
            if fk.on_delete == "cascade":
                lost.append(rows.join(keys, on, "left_semi"))
                rows = rows.join(keys, on, "left_anti")
            elif fk.on_delete == "restrict":
                guarded.append((fk, keys, on))
            else:
                hit = rows.join(keys, on, "left")
                new = {c: (defaults or {}).get(c, F.lit(None)) if fk.on_delete == "set default" else F.lit(None) for c in fk.columns}
                rows = hit.select(*[F.when(F.col("_p0").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in columns])
        for fk, keys, on in guarded:
            if not rows.join(keys, on, "left_semi").isEmpty():
                raise Conflict(f"rows of {child} refer to deleted rows of {fk.table}")
        left[child] = rows
        if lost:
            gone[child] = reduce(DataFrame.unionByName, lost)
    return db.with_tables(**left)


def _children_first(db: Catalog, table: str) -> list[str]:
    """Tables that a deletion can reach, each after all those that it refers to among them."""
    reached, todo = {table}, [table]
    while todo:
        parent = todo.pop()
        for m in db.metas.values():
            rules = [fk.on_delete for fk in m.fks if fk.table == parent]
            if rules and m.name not in reached:
                reached.add(m.name)
                if "cascade" in rules:
                    todo.append(m.name)
    out, rest = [table], reached - {table}
    if any(fk.table == table and fk.on_delete == "cascade" for fk in db.meta(table).fks):
        raise SchemaError(f"{table} refers to itself by a cascade")
    while rest:
        ready = sorted(t for t in rest if all(fk.table not in rest for fk in db.meta(t).fks))
        if not ready:
            raise SchemaError(f"{', '.join(sorted(rest))} refer to each other")
        out += ready
        rest -= set(ready)
    return out[1:]
