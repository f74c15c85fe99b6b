"""Tables with their keys, and the names that associations derive from them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaError(ValueError):
    pass


class AmbiguousForeignKey(SchemaError):
    pass


class NoForeignKey(SchemaError):
    pass


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    table: str
    to: tuple[str, ...]
    on_delete: str = "restrict"  # or cascade, set null, set default


@dataclass(frozen=True)
class TableMeta:
    """pk: primary key columns, empty if the table has none. unique: further keys, in which nulls are distinct. required: columns without nulls besides the
    primary key's. checks: by name, SQL that no row may make false. defaults: by column, SQL for a value that a new row lacks."""

    name: str
    pk: tuple[str, ...] = ()
    fks: tuple[ForeignKey, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    required: tuple[str, ...] = ()
    checks: dict[str, str] = field(default_factory=dict)
    defaults: dict[str, str] = field(default_factory=dict)
    #: Columns that a request selects if nothing else is said; empty: all.
    selection: tuple[str, ...] = ()


def _meta(name, pk=(), unique=(), **fks):
    return TableMeta(name, tuple(pk), tuple(ForeignKey((c,), t, (to,)) for c, (t, to) in fks.items()), unique)


#: Keys of the driver's tables; the files themselves hold none.
METAS = {
    m.name: m
    for m in (
        _meta("region", ["r_regionkey"]),
        _meta("nation", ["n_nationkey"], (("n_name",),), n_regionkey=("region", "r_regionkey")),
        _meta("customer", ["c_custkey"], (("c_name",),), c_nationkey=("nation", "n_nationkey")),
        _meta("supplier", ["s_suppkey"], s_nationkey=("nation", "n_nationkey")),
        _meta("part", ["p_partkey"]),
        _meta("orders", ["o_orderkey"], o_custkey=("customer", "c_custkey")),
        _meta("lineitem", [], l_orderkey=("orders", "o_orderkey"), l_partkey=("part", "p_partkey"), l_suppkey=("supplier", "s_suppkey")),
        _meta("events", ["event_id"]),
        _meta("documents", ["doc_id"]),
        _meta("labels", ["doc_id"], doc_id=("documents", "doc_id")),
        _meta("embeddings", ["vec_id"]),
        _meta("pages", ["page_id"]),
        _meta("benchmark", ["item_id"]),
        _meta("conversations", ["conv_id", "turn"]),
    )
}


class Catalog:
    """The tables of a folder, or given DataFrames, with their keys."""

    def __init__(self, spark: SparkSession, folder: str | None = None, tables: dict[str, DataFrame] | None = None, metas: dict[str, TableMeta] | None = None) -> None:
        self.spark, self.folder, self.tables = spark, folder, dict(tables or {})
        self.metas = METAS if metas is None else metas

    def df(self, name: str) -> DataFrame:
        if name not in self.tables:
            self.tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.tables[name]

    def meta(self, name: str) -> TableMeta:
        return self.metas.get(name, TableMeta(name))

    def exists(self, name: str) -> bool:
        return name in self.tables or name in self.metas

    def columns(self, name: str) -> list[tuple[str, str]]:
        return [(f.name, f.dataType.simpleString()) for f in self.df(name).schema.fields]

    def unique_keys(self, name: str) -> tuple[tuple[str, ...], ...]:
        m = self.meta(name)
        return ((m.pk,) if m.pk else ()) + m.unique

    def with_tables(self, **tables: DataFrame) -> Catalog:
        """Another catalog with these tables in the place of those of the same names."""
        return Catalog(self.spark, self.folder, self.tables | tables, self.metas)

    def created(self, name: str, schema: str, meta: TableMeta | None = None) -> Catalog:
        """With an empty table of these columns (a DDL string)."""
        if name in self.tables:
            raise SchemaError(f"there is a table {name}")
        return Catalog(self.spark, self.folder, self.tables | {name: self.spark.createDataFrame([], schema)}, self.metas | {name: meta or TableMeta(name)})

    def dropped(self, name: str) -> Catalog:
        """Without the table; others must not refer to it."""
        children = sorted(m.name for m in self.metas.values() if m.name != name and any(fk.table == name for fk in m.fks))
        if children:
            raise SchemaError(f"{', '.join(children)} refer to {name}")
        rest = lambda d: {k: v for k, v in d.items() if k != name}
        return Catalog(self.spark, self.folder, rest(self.tables), rest(self.metas))

    def with_view(self, name: str, df: DataFrame, key: tuple[str, ...] = ()) -> Catalog:
        """A named query with the key that its rows have; it is read like a table."""
        return Catalog(self.spark, self.folder, self.tables | {name: df}, self.metas | {name: TableMeta(name, key)})

    def renamed(self, old: str, new: str) -> Catalog:
        """The table under another name; foreign keys to it follow."""
        metas = {m.name: replace(m, fks=tuple(replace(fk, table=new if fk.table == old else fk.table) for fk in m.fks)) for m in self.metas.values()}
        metas[new] = replace(metas.pop(old, TableMeta(old)), name=new)
        tables = self.tables | {new: self.df(old)}
        return Catalog(self.spark, self.folder, {t: d for t, d in tables.items() if t != old}, metas)

    def altered(self, name: str, rename: dict[str, str] | None = None, add: dict[str, Column] | None = None, drop: tuple[str, ...] = ()) -> Catalog:
        """Columns renamed, then added (defaults, or generated from the others), then dropped. Keys follow renamed columns; key columns can't be dropped."""
        rename, df, m = rename or {}, self.df(name), self.meta(name)
        held = {c for k in self.unique_keys(name) for c in k} | {c for fk in m.fks for c in fk.columns}
        if held & set(drop):
            raise SchemaError(f"a key of {name} has {', '.join(sorted(held & set(drop)))}")
        new = lambda columns: tuple(rename.get(c, c) for c in columns)
        metas = {
            t: replace(
                o,
                pk=new(o.pk) if t == name else o.pk,
                unique=tuple(map(new, o.unique)) if t == name else o.unique,
                fks=tuple(replace(fk, columns=new(fk.columns) if t == name else fk.columns, to=new(fk.to) if fk.table == name else fk.to) for fk in o.fks),
            )
            for t, o in self.metas.items()
        }
        return Catalog(self.spark, self.folder, self.tables | {name: df.withColumnsRenamed(rename).withColumns(add or {}).drop(*drop)}, metas)

    def infer(self, child: str, parent: str, columns: tuple[str, ...] = ()) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Child and parent columns of the only foreign key between them; explicit child columns meet the parent's key."""
        found = [fk for fk in self.meta(child).fks if fk.table == parent and (not columns or fk.columns == columns)]
        if len(found) == 1:
            return found[0].columns, found[0].to
        if len(found) > 1:
            raise AmbiguousForeignKey(f"several foreign keys from {child} to {parent}")
        if columns and len(columns) == len(self.meta(parent).pk):
            return columns, self.meta(parent).pk
        raise NoForeignKey(f"no foreign key from {child} to {parent}")

    def violations(self, child: str) -> DataFrame:
        """Rows whose foreign keys have no parent: child's columns, and the table that they miss."""
        out = None
        for fk in self.meta(child).fks:
            parent = self.df(fk.table).select(*[F.col(c).alias(f"_p{i}") for i, c in enumerate(fk.to)])
            rows = self.df(child).dropna(subset=list(fk.columns))
            bad = rows.join(parent, [F.col(c) == F.col(f"_p{i}") for i, c in enumerate(fk.columns)], "left_anti").withColumn("missing", F.lit(fk.table))
            out = bad if out is None else out.unionByName(bad)
        return self.df(child).withColumn("missing", F.lit("")).limit(0) if out is None else out


IRREGULAR = {"people": "person", "children": "child", "men": "man", "women": "woman", "mice": "mouse", "news": "news", "series": "series", "data": "data"}


def singular(word: str) -> str:
    if word in IRREGULAR:
        return IRREGULAR[word]
    if word.endswith("ies") and len(word) > 4:
        return word[:-3] + "y"
    if word.endswith(("sses", "shes", "ches", "xes")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith(("ss", "us", "is")) else word


def plural(word: str) -> str:
    for many, one in IRREGULAR.items():
        if word in (one, many):
            return many
    if word != singular(word):
        return word
    if word.endswith("y") and word[-2:-1] not in tuple("aeiou"):
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("s", "x", "sh", "ch")) else "s")
