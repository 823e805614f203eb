"""Filters over schemaless attributes: a conjunction of typed equalities and IN lists, as a Column predicate.

Keys that are stored as typed columns too are compared there, so that the predicate reaches the Parquet scan; the others
are looked up in the JSON text as a variant, by value and type ("1", 1 and true never match one another; 1 equals 1.0).
"""

from __future__ import annotations

import json
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _canonical(value: Any) -> Any:
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        return int(value) if float(value).is_integer() else float(value)
    if isinstance(value, dict):
        return {k: _canonical(value[k]) for k in sorted(value)}
    return [_canonical(v) for v in value]


def _path(key: str) -> str:
    if "'" in key and '"' in key:
        raise ValueError(f"a key can't hold both kinds of quotes: {key}")
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


def _json_equals(attributes: Column, key: str, value: Any) -> Column:
    variant = F.try_parse_json(attributes)
    found = F.try_variant_get(variant, _path(key), "variant")
    kind = F.schema_of_variant(found)
    if value is None:
        return F.coalesce(F.is_variant_null(found), F.lit(False))
    if isinstance(value, bool):
        hit = (kind == "BOOLEAN") & (F.try_variant_get(variant, _path(key), "boolean") == value)
    elif isinstance(value, (int, float)):
        hit = (kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")) & (F.try_variant_get(variant, _path(key), "double") == float(value))
    elif isinstance(value, str):
        hit = (kind == "STRING") & (F.try_variant_get(variant, _path(key), "string") == value)
    else:
        hit = F.to_json(found) == json.dumps(_canonical(value), separators=(",", ":"), ensure_ascii=False)
    return F.coalesce(hit, F.lit(False))


def _typed_equals(column: Column, kind: str, value: Any) -> Column:
    if value is None:
        return column.isNull()
    fits = {"boolean": bool, "string": str}.get(kind, (int, float))
    if not isinstance(value, fits) or (isinstance(value, bool) and kind != "boolean"):
        return F.lit(False)
    return F.coalesce(column == value, F.lit(False)) if kind == "boolean" else column == value


def predicate(filters: dict[str, Any] | None, attributes: Column | None = None, typed: dict[str, tuple[Column, str]] | None = None) -> Column:
    """True where all keys match: a scalar or object by equality, a list by any of its items. No filter: all rows; an
    empty list: none; a key that a row lacks: not that row. typed: columns by key, with their simple type."""
    terms = []
    for key, value in (filters or {}).items():
        options = value if isinstance(value, list) else [value]
        if typed and key in typed:
            tests = [_typed_equals(*typed[key], v) for v in options]
        else:
            tests = [_json_equals(attributes, key, v) for v in options]
        terms.append(reduce(lambda a, b: a | b, tests, F.lit(False)) if len(tests) != 1 else tests[0])
    return reduce(lambda a, b: a & b, terms) if terms else F.lit(True)


def entries(attributes: Column) -> Column:
    """The scalar attributes as a map from key to their JSON text, which tells "1" from 1; null values, arrays and objects
    are left out, as no filter index holds them."""
    raw = F.from_json(attributes, "map<string,variant>")
    kinds = F.map_filter(raw, lambda k, v: v.isNotNull() & ~F.is_variant_null(v) & ~F.schema_of_variant(v).rlike("^(ARRAY|OBJECT)"))
    return F.transform_values(kinds, lambda k, v: F.to_json(v))


def attribute_index(rows: DataFrame) -> DataFrame:
    """(key, value, n) of (id, attributes): how many rows each equality filter keeps, a row a key and value, texts as JSON."""
    return rows.select(F.explode(entries(F.col("attributes"))).alias("key", "value")).groupBy("key", "value").agg(F.count("*").alias("n"))
