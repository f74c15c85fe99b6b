"""Scalar and aggregate functions with embedded-database semantics, as Column expressions.

Integer division truncates and gives null on zero, LIKE ignores ASCII case, scalar MAX and MIN give null on any null, casts take a
leading number and never fail, and month arithmetic lets days overflow into the next month.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def divide_int(a: Column, b: Column) -> Column:
    a, b = a.cast("long"), b.cast("long")
    return F.when(b != 0, (a - F.try_mod(a, b)) / b).cast("long")


def divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def like(c: Column, pattern: str, escape: str = "\\") -> Column:
    folded = "".join(x.lower() if x in UPPER else x for x in pattern)
    return F.like(ascii_lower(c), F.lit(folded), F.lit(escape))


def glob(c: Column, pattern: str) -> Column:
    """Case-sensitive match of the whole text: * any run, ? one character, [...] one of a set, [^...] one outside it."""
    out, i = "", 0
    while i < len(pattern):
        x = pattern[i]
        end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "^")) if x == "[" else -1
        if x == "[" and end < 0:  # a set without an end matches nothing
            return F.when(c.isNotNull(), F.lit(False))
        if x == "[":
            members = pattern[i + 1 : end]
            outside = members.startswith("^")
            out += "[" + "^" * outside + re.sub(r"([\\\[\]&^])", r"\\\1", members[outside:]) + "]"
            i = end
        else:
            out += {"*": "(?s:.*)", "?": "(?s:.)"}.get(x) or re.sub(r"(\W)", r"\\\1", x)
        i += 1
    return c.rlike(f"^{out}\\z")


def substr(c: Column, start: int, length: int | None = None) -> Column:
    """From 1; a negative start counts from the end, a negative length takes what stands before the start."""
    n = F.length(c)
    at = F.lit(start) if start >= 0 else n + F.lit(start) + 1
    if length is None:
        low, high = at, n + 1
    elif length >= 0:
        low, high = at, at + F.lit(length)
    else:
        low, high = at + F.lit(length), at
    if start == 0 and length is not None and length < 0:
        return F.when(c.isNotNull(), F.lit(""))
    low = F.greatest(low, F.lit(1))
    return c.substr(low, F.greatest(high - low, F.lit(0)))


#: Collations by what they compare: bytes, ASCII and other letters of either case alike, bytes without blanks at the end, Unicode's order, and that without case.
COLLATIONS = {"binary": "UTF8_BINARY", "nocase": "UTF8_LCASE", "rtrim": "UTF8_BINARY_RTRIM", "unicode": "UNICODE", "unicode_nocase": "UNICODE_CI"}


def collated(c: Column, by: str) -> Column:
    """The text with a collation of COLLATIONS, or of a locale as in "de" or "tr"."""
    return F.collate(c, COLLATIONS.get(by, by))


#: Languages whose i keeps or lacks its dot in either case.
DOTTED = ("tr", "az")


def upper_in(c: Column, locale: str) -> Column:
    """Upper case by a locale's rules."""
    return F.upper(F.translate(c, "iı", "İI") if locale[:2] in DOTTED else c)


def lower_in(c: Column, locale: str) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi") if locale[:2] in DOTTED else c)


def capitalized(c: Column) -> Column:
    """Each word's first letter in upper case, its others in lower."""
    return F.initcap(c)


def iif(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(condition, yes).otherwise(no)


def char(*codes: int) -> Column:
    return F.lit("".join(map(chr, codes)))


def unicode(c: Column) -> Column:
    """Code point of the first character; null for an empty text."""
    return F.when(c != "", F.ascii(c).cast("long"))


def instr(c: Column, part: Column) -> Column:
    return F.when(part == "", F.when(c.isNotNull(), 1)).otherwise(F.call_function("instr", c, part))


def quote(c: Column, kind: str) -> Column:
    """The value as an SQL literal; kind: its Spark type."""
    if kind == "string":
        return F.coalesce(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    if kind == "binary":
        return F.coalesce(F.concat(F.lit("X'"), F.hex(c), F.lit("'")), F.lit("NULL"))
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def type_of(c: Column, kind: str) -> Column:
    """Storage class of a column of that Spark type: null, integer, real, text or blob."""
    name = {"string": "text", "binary": "blob", "double": "real", "float": "real"}.get(kind, "integer")
    return F.when(c.isNull(), F.lit("null")).otherwise(F.lit(name))


def zero_blob(n: int) -> Column:
    return F.lit(bytes(n))


def greatest(*cs: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in cs]), None).otherwise(F.greatest(*cs))


def least(*cs: Column) -> Column:
    return F.when(reduce(lambda a, b: a | b, [c.isNull() for c in cs]), None).otherwise(F.least(*cs))


def cast_integer(text: Column) -> Column:
    found = F.regexp_extract(F.trim(text), r"^[+-]?\d+", 0)
    return F.when(text.isNotNull(), F.coalesce(found.try_cast("long"), F.lit(0).cast("long")))


def cast_real(text: Column) -> Column:
    found = F.regexp_extract(F.trim(text), r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0)
    return F.when(text.isNull(), None).otherwise(F.coalesce(found.try_cast("double"), F.lit(0.0)))


def truthy(c: Column, kind: str) -> Column:
    """A value of that Spark type as a condition."""
    if kind == "boolean":
        return c
    return (cast_real(c) if kind == "string" else c) != 0


def shift_left(a: Column, n: Column) -> Column:
    """Past 63 bits nothing is left; a negative count shifts the other way."""
    a = a.cast("long")
    right = F.when(-n > 63, F.when(a < 0, F.lit(-1)).otherwise(F.lit(0))).otherwise(F.call_function("shiftright", a, (-n).cast("int")))
    return F.when(n < 0, right).when(n > 63, F.lit(0)).otherwise(F.call_function("shiftleft", a, n.cast("int"))).cast("long")


def shift_right(a: Column, n: Column) -> Column:
    return shift_left(a, -n)


def concat(*cs: Column) -> Column:
    return F.concat(*cs) if cs else F.lit("")


def coalesce(*cs: Column) -> Column:
    return F.coalesce(*cs) if cs else F.lit(None)


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))


def where(aggregate, c: Column, condition: Column) -> Column:
    """An aggregate over the rows that meet the condition."""
    return aggregate(F.when(condition, c))


# dates


def add_days(t: Column, n: int) -> Column:
    return t + F.make_dt_interval(F.lit(n))


def add_seconds(t: Column, n: int) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(n))


def add_months(t: Column, n: int) -> Column:
    """A day that the month lacks runs over into the next."""
    start = F.date_trunc("month", t)
    return start + F.make_ym_interval(F.lit(0), F.lit(n)) + (t - start)


def start_of(t: Column, unit: str) -> Column:
    return F.date_trunc(unit, t)


def weekday(t: Column, n: int) -> Column:
    """The date itself if it falls on weekday n (0: Sunday), else the next that does."""
    return F.date_add(t.cast("date"), F.pmod(F.lit(n) - (F.dayofweek(t) - 1), F.lit(7)))


def from_unix(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def to_local(t: Column, zone: str) -> Column:
    return F.from_utc_timestamp(t, zone)


def to_utc(t: Column, zone: str) -> Column:
    return F.to_utc_timestamp(t, zone)


def date_time(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd HH:mm:ss")


def julian_day(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp")) / F.lit(86400000000.0) + F.lit(2440587.5)
