"""JSON functions over JSON text in string columns; VARIANT is the binary form.

All but merge_patch and error_position are built-in expressions. A change inside nested values rewrites them with sorted keys.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType


def is_valid(c: Column) -> Column:
    return F.try_parse_json(c).isNotNull()


def minified(c: Column) -> Column:
    return F.to_json(F.parse_json(c))


def quote(c: Column) -> Column:
    """A value as JSON; null becomes the text null."""
    return F.when(c.isNull(), F.lit("null")).otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))


def array(*parts: Column) -> Column:
    """JSON array of values of any types."""
    return F.concat(F.lit("["), F.concat_ws(",", *[quote(p) for p in parts]), F.lit("]"))


def object_(**parts: Column) -> Column:
    """JSON object; nulls stay as null."""
    pieces = [F.concat(quote(F.lit(k)), F.lit(":"), quote(v)) for k, v in parts.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}"))


def extract(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def represent(c: Column, path: str) -> Column:
    """The value at the path as JSON: strings keep their quotes."""
    return F.to_json(F.try_variant_get(F.try_parse_json(c), path, "variant"))


def extract_many(c: Column, *paths: str) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.coalesce(represent(c, p), F.lit("null")) for p in paths]), F.lit("]"))


def array_length(c: Column, path: str = "$") -> Column:
    return F.coalesce(F.json_array_length(F.get_json_object(c, path)), F.lit(0))


def type_name(c: Column, path: str = "$") -> Column:
    """null, true, false, integer, real, text, array or object; null without a value at the path."""
    value = F.try_variant_get(F.try_parse_json(c), path, "variant")
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "VOID", "null").when(kind == "BOOLEAN", F.to_json(value)).when(kind == "STRING", "text").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object")
        .when(kind.isin("BIGINT"), "integer").when(kind.isNotNull(), "real")
    )


def _fields(c: Column) -> Column:
    return F.from_json(c, "map<string,variant>")


def _joined(entries: Column) -> Column:
    piece = F.transform(entries, lambda e: F.concat(quote(e["key"]), F.lit(":"), F.coalesce(F.to_json(e["value"]), F.lit("null"))))
    return F.concat(F.lit("{"), F.array_join(piece, ","), F.lit("}"))


def remove(c: Column, *keys: str) -> Column:
    """An object without these top-level keys."""
    return _joined(F.filter(F.map_entries(_fields(c)), lambda e: ~e["key"].isin(*keys)))


def _put(c: Column, key: str, value: Column, present: bool, absent: bool) -> Column:
    entries, has = F.map_entries(_fields(c)), F.map_contains_key(_fields(c), key)
    new = F.struct(F.lit(key).alias("key"), F.parse_json(quote(value)).alias("value"))
    changed = F.transform(entries, lambda e: F.when(e["key"] == key, new).otherwise(e)) if present else entries
    return F.when(has, _joined(changed)).otherwise(_joined(F.concat(entries, F.array(new)) if absent else entries))


def insert(c: Column, key: str, value: Column) -> Column:
    return _put(c, key, value, False, True)


def replace(c: Column, key: str, value: Column) -> Column:
    return _put(c, key, value, True, False)


def set_(c: Column, key: str, value: Column) -> Column:
    return _put(c, key, value, True, True)


def patch(c: Column, with_: Column) -> Column:
    """Merge patch of top-level keys: null removes, anything else replaces or adds."""
    old, new = F.map_entries(_fields(c)), F.map_entries(_fields(with_))
    names = F.transform(new, lambda e: e["key"])
    kept = F.filter(old, lambda e: ~F.array_contains(names, e["key"]))
    return _joined(F.concat(kept, F.filter(new, lambda e: ~F.coalesce(F.is_variant_null(e["value"]), F.lit(True)))))


def group_array(c: Column, where: Column | None = None, order: Column | None = None) -> Column:
    """Aggregate to a JSON array, nulls included, in the values' order or that of an expression; where: of the rows that meet a condition."""
    pair = F.struct((order if order is not None else quote(c)).alias("o"), quote(c).alias("v"))
    rows = F.collect_list(pair if where is None else F.when(where, pair))
    return F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(rows), lambda p: p["v"]), ","), F.lit("]"))


def group_object(key: Column, value: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(F.concat(quote(key.cast("string")), F.lit(":"), quote(value)))), ","), F.lit("}"))


def binary(c: Column) -> Column:
    """The binary form of JSON text, or null if it is malformed; any function of text has its binary twin by this."""
    return F.try_parse_json(c)


def text(v: Column) -> Column:
    return F.to_json(v)


def binary_extract(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


# changes at any depth


def _steps(path: str) -> list[str | int | None]:
    """Keys, array indexes, and None for the place after an array's last value."""
    if not re.fullmatch(r"""\$(\."[^"]*"|\.[^."\[\]]+|\[(\d+|#)\])*""", path):
        raise ValueError(f"not a path: {path}")
    return [(key.strip('"') if key else None if at == "#" else int(at)) for key, at in re.findall(r"""\.("[^"]*"|[^."\[\]]+)|\[(\d+|#)\]""", path)]


def _nested(steps: list, leaf: Column) -> Column | None:
    """JSON text of new containers around the leaf; an array can only begin at index 0."""
    for step in reversed(steps):
        if isinstance(step, str):
            leaf = F.concat(F.lit("{" + json.dumps(step) + ":"), leaf, F.lit("}"))
        elif step == 0:
            leaf = F.concat(F.lit("["), leaf, F.lit("]"))
        else:
            return None
    return leaf


def _bound(c: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def _edited(c: Column, steps: list, leaf: Column | None, present: bool, absent: bool) -> Column:
    """leaf: JSON text to put, or None to remove. Text that is not of the container that a step needs stays."""
    if not steps:
        return F.when(c.isNotNull(), leaf) if leaf is not None and present else c
    step, rest = steps[0], steps[1:]
    new = _nested(rest, leaf) if leaf is not None and absent else None
    removed = leaf is None and not rest

    def one(value: Column, here: Column) -> Column:
        old = F.coalesce(F.to_json(value), F.lit("null"))
        return F.when(here, _edited(old, rest, leaf, present, absent)).otherwise(old)

    def in_object(entries: Column) -> Column:
        kept = F.filter(entries, lambda e: e["key"] != step) if removed else entries
        pieces = F.transform(kept, lambda e: F.concat(quote(e["key"]), F.lit(":"), one(e["value"], e["key"] == step)))
        if new is not None:
            piece = F.array(F.concat(F.lit(json.dumps(step) + ":"), new))
            pieces = F.when(F.exists(entries, lambda e: e["key"] == step), pieces).otherwise(F.concat(pieces, piece))
        return F.concat(F.lit("{"), F.array_join(pieces, ","), F.lit("}"))

    def in_array(values: Column) -> Column:
        kept = F.filter(values, lambda v, i: i != step) if removed and step is not None else values
        pieces = F.transform(kept, lambda v, i: one(v, F.lit(False) if step is None or removed else i == step))
        if new is not None:
            here = F.lit(True) if step is None else F.size(values) == step
            pieces = F.when(here, F.concat(pieces, F.array(new))).otherwise(pieces)
        return F.concat(F.lit("["), F.array_join(pieces, ","), F.lit("]"))

    def body(x: Column) -> Column:
        if isinstance(step, str):
            whole, opening = _bound(F.map_entries(_fields(x)), in_object), "{"
        else:
            whole, opening = _bound(F.from_json(x, "array<variant>"), in_array), "["
        return F.when(F.ltrim(x).startswith(opening), F.coalesce(whole, x)).otherwise(x)

    return _bound(c, body)


def insert_at(c: Column, path: str, value: Column) -> Column:
    """Only where the path leads to nothing yet; missing objects on the way are made."""
    return _edited(c, _steps(path), quote(value), False, True)


def replace_at(c: Column, path: str, value: Column) -> Column:
    return _edited(c, _steps(path), quote(value), True, False)


def set_at(c: Column, path: str, value: Column) -> Column:
    return _edited(c, _steps(path), quote(value), True, True)


def remove_at(c: Column, *paths: str) -> Column:
    """Without what the paths lead to, one after the other; the path $ leaves null."""
    for path in paths:
        steps = _steps(path)
        c = _edited(c, steps, None, False, False) if steps else F.lit(None).cast("string")
    return c


def _merged(old, new):
    if not isinstance(new, dict):
        return new
    out = dict(old) if isinstance(old, dict) else {}
    for k, v in new.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = _merged(out.get(k), v)
    return out


@F.pandas_udf(StringType())
def merge_patch(c: pd.Series, with_: pd.Series) -> pd.Series:
    """Merge patch at every depth: null removes, objects merge, anything else replaces. Null text gives null; malformed text fails."""

    def one(a, b):
        return None if a is None or b is None else json.dumps(_merged(json.loads(a), json.loads(b)), separators=(",", ":"), ensure_ascii=False)

    return pd.Series([one(a, b) for a, b in zip(c, with_, strict=True)], dtype=object)


@F.pandas_udf(LongType())
def error_position(c: pd.Series) -> pd.Series:
    """1-based place of the first character that is not JSON, 0 for well-formed text."""

    def one(a):
        if a is None:
            return None
        try:
            json.loads(a)
        except json.JSONDecodeError as e:
            return e.pos + 1
        return 0

    return c.map(one).astype("Int64")
