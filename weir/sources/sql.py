"""Raw SQL with bound values: fragments that combine, and dumps of what they return."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Quoted text, which stays, or a named parameter; a cast's :: is none.
QUOTED_OR_NAMED = re.compile(r"'(?:[^'\\\\]|\\\\.)*'|\"[^\"]*\"|`[^`]*`|::|:(\w+)", re.S)


def positional(spark: SparkSession, text: str, *values: Any, **tables: DataFrame) -> DataFrame:
    """Text with a ? for each value, in their order; outside of quotes a ? is a parameter."""
    return spark.sql(text, args=list(values), **tables)


def script(spark: SparkSession, text: str, values: dict[str, Any] | None = None, **tables: DataFrame) -> list[DataFrame]:
    """The results of statements divided by semicolons outside of quotes, run in their order; each gets those of the values that it names."""
    statements, at = [], 0
    for m in re.finditer(QUOTED_OR_NAMED.pattern + "|(;)", text, re.S):
        if m[2]:
            statements.append(text[at : m.start()])
            at = m.end()
    named = lambda s: {m[1] for m in QUOTED_OR_NAMED.finditer(s) if m[1]}
    out = []
    for s in (*statements, text[at:]):
        if s.strip():
            mine = {k: v for k, v in (values or {}).items() if k in named(s)}
            out.append(spark.sql(s, args=mine or None, **{t: d for t, d in tables.items() if "{" + t + "}" in s}))
    return out


def literal(value: Any) -> str:
    """Spark SQL for a value."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, float):
        return f"double('{value!r}')"
    if isinstance(value, int | Decimal):
        return str(value)
    if isinstance(value, datetime):
        return f"TIMESTAMP_NTZ '{value.isoformat(' ')}'" if value.tzinfo is None else f"TIMESTAMP '{value.isoformat(' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, bytes):
        return f"X'{value.hex()}'"
    if isinstance(value, list | tuple | set | frozenset):
        return "(" + ", ".join(map(literal, value)) + ")" if value else "(NULL)"  # no value is in it
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> SQL:
    """A column's name as a fragment, whatever letters it has."""
    return SQL("`" + column.replace("`", "``") + "`")


@dataclass(frozen=True)
class SQL:
    """Text with :named parameters and their values. Joining two keeps both; equal names must have equal values."""

    text: str
    values: dict[str, Any] = field(default_factory=dict)

    def __add__(self, other: SQL | str) -> SQL:
        other = SQL(other) if isinstance(other, str) else other
        clash = [k for k in self.values.keys() & other.values.keys() if self.values[k] != other.values[k]]
        if clash:
            raise ValueError(f"two values for {', '.join(clash)}")
        return SQL(self.text + other.text, self.values | other.values)

    def overridden(self, **values: Any) -> SQL:
        """The same text; these values replace those of the same names."""
        return SQL(self.text, self.values | values)

    def column(self) -> Column:
        """A column expression; each :name outside of quotes becomes its value as a literal, a list a row of them in parentheses."""

        def put(m: re.Match) -> str:
            if m[1] is None:
                return m[0]
            if m[1] not in self.values:
                raise ValueError(f"no value for {m[1]}")
            return literal(self.values[m[1]])

        return F.expr(QUOTED_OR_NAMED.sub(put, self.text))

    def run(self, spark: SparkSession, **tables: DataFrame) -> DataFrame:
        """tables: DataFrames that the text names in braces, as in SELECT * FROM {t}."""
        return spark.sql(self.text, args=self.values or None, **tables)


def dumped_schema(db, *tables: str) -> list[str]:
    """A CREATE TABLE statement for each table: columns, types and keys."""
    out = []
    for t in tables:
        m = db.meta(t)
        lines = [f"{c} {kind}" + (" NOT NULL" if c in m.pk or c in m.required else "") for c, kind in db.columns(t)]
        lines += [f"PRIMARY KEY ({', '.join(m.pk)})"] if m.pk else []
        lines += [f"UNIQUE ({', '.join(u)})" for u in m.unique]
        lines += [f"FOREIGN KEY ({', '.join(fk.columns)}) REFERENCES {fk.table} ({', '.join(fk.to)})" for fk in m.fks]
        out.append(f"CREATE TABLE {t} (" + ", ".join(lines) + ")")
    return out


def dumped_tables(db, *tables: str, style: str = "list") -> DataFrame:
    """The lines of several tables, each with its table's name."""
    out = None
    for t in tables:
        lines = dumped(db.df(t), style).select(F.lit(t).alias("table"), "line")
        out = lines if out is None else out.unionByName(lines)
    return out


def joined(parts: list[SQL], separator: str) -> SQL:
    out = SQL("")
    for i, p in enumerate(parts):
        out = out + (separator if i else "") + p
    return out


def dumped(df: DataFrame, style: str = "list") -> DataFrame:
    """One string column `line`: list (|), quote (SQL literals), debug (quoted values between |), json or line (name = value)."""
    if style == "json":
        return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("line"))
    if style == "line":
        return df.select(F.concat_ws("\n", *[F.concat(F.lit(f"{c} = "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]).alias("line"))
    if style in ("quote", "debug"):
        cells = []
        for f in df.schema.fields:
            kind, c = f.dataType.simpleString(), F.col(f"`{f.name}`")
            text = c.cast("string")
            if kind == "binary":
                quoted = F.concat(F.lit("X'"), F.hex(c), F.lit("'"))
            elif kind == "boolean":
                quoted = c.cast("int").cast("string")
            elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
                quoted = text
            else:  # texts, and dates and times as texts
                quoted = F.concat(F.lit("'"), F.regexp_replace(text if kind in ("string", "date") or kind.startswith("timestamp") else F.to_json(c), "'", "''"), F.lit("'"))
            cells.append(F.coalesce(quoted, F.lit("NULL")))
        return df.select(F.concat_ws("," if style == "quote" else "|", *cells).alias("line"))
    return df.select(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("line"))
