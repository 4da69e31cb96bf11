"""Row and byte budgets over ordered reads, and opaque resume cursors.

A budget keeps the longest prefix, in order, that fits: row n + 1 is cut, and so is the first row (after
the first) with which the running bytes exceed the limit. The prefix sum is made in two levels: totals
of coarse buckets, few and summed by a window over themselves, then a window inside each bucket. No
task ever sorts the whole input.
"""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.model import InvalidCursor, ReadOutcome


def resolve(call: int | None, store: int | None) -> int | None:
    """A call's own limit, else the store's, else none."""
    return store if call is None else call


def encode_cursor(kind: str, **state) -> str:
    return base64.b64encode(json.dumps({"kind": kind} | state).encode()).decode()


def decode_cursor(cursor: str | None, kind: str) -> dict | None:
    """The state of a cursor of ``kind``; None for no cursor."""
    if cursor is None:
        return None
    try:
        state = json.loads(base64.b64decode(cursor))
    except ValueError as e:
        raise InvalidCursor("unreadable cursor") from e
    if not isinstance(state, dict) or state.get("kind") != kind:
        raise InvalidCursor(f"not a {kind} cursor")
    return state


def payload_bytes(payload: Column) -> Column:
    """What a row counts against a byte budget: its payload as UTF-8 JSON text."""
    return F.octet_length(payload).cast("long")


def running(df: DataFrame, order: list[Column], bucket: Column, size: Column) -> DataFrame:
    """``df`` with ``_rn`` and ``_bytes``: place and running bytes in the order; ``bucket`` must be monotone in it."""
    rows = df.withColumns({"_bucket": bucket, "_size": size})
    sums = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_s0"))
    inside = W.partitionBy("_bucket").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    whole = rows.join(offsets, "_bucket")
    return whole.withColumns({"_rn": F.row_number().over(inside) + F.col("_n0"), "_bytes": F.sum("_size").over(upto) + F.col("_s0")}).drop("_bucket", "_size", "_n0", "_s0")


def within(max_rows: int | None, max_bytes: int | None) -> Column:
    """Which rows of ``running`` fit the budget. The first row passes any byte budget, but no row budget of 0."""
    ok = F.lit(True)
    if max_rows is not None:
        ok = ok & (F.col("_rn") <= max_rows)
    if max_bytes is not None:
        ok = ok & ((F.col("_rn") == 1) | (F.col("_bytes") <= max_bytes))
    return ok


def cut(df: DataFrame, order: list[Column], bucket: Column, size: Column, max_rows: int | None, max_bytes: int | None) -> DataFrame:
    """The longest prefix of ``df`` within the budget, unordered."""
    if max_rows is None and max_bytes is None:
        return df
    return running(df, order, bucket, size).where(within(max_rows, max_bytes)).drop("_rn", "_bytes")


def outcome(df: DataFrame, order: list[Column], bucket: Column, size: Column, max_rows: int | None, max_bytes: int | None, cursor) -> ReadOutcome:
    """A budgeted read with its reason and cursor; ``cursor(first cut row, last kept row)`` makes the token.

    Only the two rows at the cut come to the driver. Where both limits are passed the count is the reason.
    """
    if max_rows is None and max_bytes is None:
        return ReadOutcome(df.orderBy(*order))
    rows = running(df, order, bucket, size)
    ok = within(max_rows, max_bytes)
    first = rows.where(~ok).orderBy("_rn").limit(1).collect()
    kept = rows.where(ok).orderBy(*order)
    if not first:
        return ReadOutcome(kept.drop("_rn", "_bytes"))
    last = kept.orderBy(F.desc("_rn")).limit(1).collect()
    reason = "count" if max_rows is not None and first[0]["_rn"] > max_rows else "bytes"
    return ReadOutcome(kept.drop("_rn", "_bytes"), reason, cursor(first[0], last[0] if last else None))
