"""Equality predicates on JSON tags."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.model import InvalidTagFilter


def tag_equals(tags: Column, key: str, value: Any) -> Column:
    """``tags[key] = value`` by type: strings equal only strings, numbers compare by value, true is 1 and
    false is 0, null means missing or JSON null (also where there are no tags at all)."""
    if not key or not all(c.isalnum() or c == "_" for c in key):
        raise InvalidTagFilter(f"key {key!r}")
    node = F.try_variant_get(F.try_parse_json(tags), f"$.{key}", "variant")
    kind = F.schema_of_variant(node)
    if value is None:
        return kind.isNull() | (kind == "VOID")
    if isinstance(value, str):
        return F.coalesce((kind == "STRING") & (F.try_variant_get(node, "$", "string") == value), F.lit(False))
    if not isinstance(value, bool | int | float):
        raise InvalidTagFilter(f"value of {key!r} must be a scalar")
    number = int(value) if isinstance(value, bool | int) else value
    same = F.try_variant_get(node, "$", "double") == float(number)
    if isinstance(number, int):
        same = F.when(kind == "BIGINT", F.try_variant_get(node, "$", "long") == F.lit(number).cast("long")).otherwise(F.when(kind == "BOOLEAN", F.try_variant_get(node, "$", "boolean").cast("int") == number).otherwise(same))
    else:
        same = F.when(kind == "BOOLEAN", F.try_variant_get(node, "$", "boolean").cast("int").cast("double") == number).otherwise(same)
    return F.coalesce((kind != "STRING") & same, F.lit(False))


def tags_match(tags: Column, wanted: Any) -> Column:
    """All of ``wanted``'s pairs; a filter that is no mapping selects everything."""
    out = F.lit(True)
    if isinstance(wanted, Mapping):
        for key, value in wanted.items():
            out = out & tag_equals(tags, key, value)
    return out
