"""The boolean attribute-filter language, compiled to one column expression that Catalyst pushes and simplifies.

A filter is a flat map of equalities, or a tree {"type": "and" | "or", "filters": [...]} over comparisons {"type", "key", "value"} of
eq, ne, in, nin, gt, gte, lt, lte. Comparisons tell JSON types apart: numbers meet numbers, strings strings, booleans booleans;
another type, or a missing key, matches nothing - `ne` and `nin` too need the key to exist.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

COLUMN_KEYS = frozenset({"document_id", "knowledge_base_id", "classification", "acl_bucket"})
MAX_ALTERNATIVES = 32
_RANGES: dict[str, Callable] = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
Value = str | int | float | bool


class FilterError(ValueError):
    pass


class JsonAttributes:
    """Typed access to the members of a JSON text column."""

    def __init__(self, column: Column):
        self.value = F.try_parse_json(column)

    def kind(self, key: str) -> Column:
        return F.schema_of_variant(self._get(key, "variant"))

    def _get(self, key: str, kind: str) -> Column:
        return F.try_variant_get(self.value, "$[" + json.dumps(key) + "]", kind)

    def exists(self, key: str) -> Column:
        return self._get(key, "variant").isNotNull()

    def typed(self, key: str, like: Value) -> Column:
        """The member, null where it is of another JSON type than `like`."""
        kind = self.kind(key)
        if isinstance(like, bool):
            return F.when(kind == "BOOLEAN", self._get(key, "boolean"))
        if isinstance(like, (int, float)):
            return F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), self._get(key, "double"))
        return F.when(kind == "STRING", self._get(key, "string"))

    def equals(self, key: str, value: Value) -> Column:
        return F.coalesce(self.typed(key, value) == F.lit(value), F.lit(False))


def _check(key: Any, value: Any) -> None:
    if not isinstance(key, str) or not key:
        raise FilterError("a filter needs a key")
    if not isinstance(value, (str, int, float, bool)):
        raise FilterError(f"the value for {key} must be a string, a number or a boolean")


def _values(key: Any, values: Any) -> list[Value]:
    if not isinstance(values, list) or not values:
        raise FilterError(f"{key} needs a list of values")
    for v in values:
        _check(key, v)
    return values


def _same(a: Value, b: Value) -> bool:
    return a == b and isinstance(a, bool) == isinstance(b, bool)


def alternatives(tree: dict) -> list[dict[str, Value]]:
    """The tree as a list of conjunctions of equalities; at most MAX_ALTERNATIVES, contradictory ones dropped."""
    kind = str(tree.get("type", "")).lower()
    if "type" not in tree:
        out = [dict(tree)]
    elif kind == "eq":
        out = [{tree["key"]: tree["value"]}]
    elif kind == "in":
        out = [{tree["key"]: v} for v in _values(tree.get("key"), tree.get("value"))]
    elif kind == "or":
        out = [a for t in tree["filters"] for a in alternatives(t)]
    elif kind == "and":
        out = [{}]
        for t in tree["filters"]:
            out = [{**a, **b} for a in out for b in alternatives(t) if all(_same(a[k], b[k]) for k in a.keys() & b.keys())]
        if not out:
            raise FilterError("the filters contradict each other")
    else:
        raise FilterError(f"{kind} can't be an alternative of an or filter")
    once = list({json.dumps(a, sort_keys=True): a for a in out if a}.values())
    if len(once) > MAX_ALTERNATIVES:
        raise FilterError(f"more than {MAX_ALTERNATIVES} alternatives")
    return once


def compile_filter(tree: dict | None, attributes: Column, columns: dict[str, Column] | None = None) -> Column:
    """A predicate for rows with JSON text `attributes`; `columns` holds those of COLUMN_KEYS that the table has."""
    attrs, columns = JsonAttributes(attributes), columns or {}

    def equal(key: str, value: Value) -> Column:
        _check(key, value)
        if key in COLUMN_KEYS:
            if key not in columns:
                raise FilterError(f"the table has no {key}")
            return columns[key] == F.lit(value)
        return attrs.equals(key, value)

    def walk(t: dict) -> Column:
        if not isinstance(t, dict):
            raise FilterError("a filter is an object")
        if "type" not in t:
            return reduce(operator.and_, (equal(k, v) for k, v in t.items()), F.lit(True))
        kind, key, value = str(t["type"]).lower(), t.get("key"), t.get("value")
        if kind in ("and", "or"):
            parts = t.get("filters")
            if not isinstance(parts, list) or not parts:
                raise FilterError(f"{kind} needs a list of filters")
            if kind == "or":
                return reduce(operator.or_, (reduce(operator.and_, (equal(k, v) for k, v in a.items())) for a in alternatives(t)))
            _no_contradiction(parts)
            return reduce(operator.and_, map(walk, parts))
        if "value" not in t:
            raise FilterError(f"{kind} needs a value")
        if kind == "eq":
            return equal(key, value)
        if kind == "in":
            return reduce(operator.or_, (attrs.equals(key, v) for v in _values(key, value)))
        if key in COLUMN_KEYS:
            raise FilterError(f"{kind} works on attributes only")
        if kind == "ne":
            _check(key, value)
            return attrs.exists(key) & ~attrs.equals(key, value)
        if kind == "nin":
            return attrs.exists(key) & ~reduce(operator.or_, (attrs.equals(key, v) for v in _values(key, value)))
        if kind in _RANGES:
            _check(key, value)
            if isinstance(value, bool):
                raise FilterError("a range needs a number or a string")
            return F.coalesce(_RANGES[kind](attrs.typed(key, value), F.lit(value)), F.lit(False))
        raise FilterError(f"{kind} is no filter")

    return walk(tree) if tree else F.lit(True)


def _no_contradiction(parts: list[dict]) -> None:
    seen: dict[str, Value] = {}
    for t in parts:
        flat = t if "type" not in t else {t["key"]: t["value"]} if str(t["type"]).lower() == "eq" and "value" in t else {}
        for k, v in flat.items():
            if k in seen and not _same(seen[k], v):
                raise FilterError(f"contradictory values for {k}")
            seen[k] = v


def merge_filters(base: dict | None, planned: dict | None) -> dict:
    """Flat filters together; what the caller said wins over what the planner found."""
    return {**(planned or {}), **(base or {})}


def optional_equals(df_column: Column, value: Value | None) -> Column:
    """No condition where nothing is asked for (P20)."""
    return F.lit(True) if value is None else df_column == F.lit(value)


def blocked_page(html: Column) -> Column:
    """A challenge or error page: its words, and no sign of content."""
    t = F.lower(F.coalesce(html, F.lit("")))
    marks = reduce(operator.or_, (F.contains(t, F.lit(m)) for m in ("captcha", "access denied", "verify you are human", "cf-challenge", "request blocked")))
    return (F.length(t) == 0) | (marks & ~F.contains(t, F.lit("<article")))
