"""Schema evolution: upcasters on read, payload transforms on write.

Both take either a Column function (payload text in, payload text out), which stays in code generation,
or a Python function on decoded payloads, which runs in Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.glob import matching
from sediment.model import TransformFailed, UpcasterChainGap


@dataclass(frozen=True)
class Step:
    """One upcaster: from a version to a later one."""

    start: int
    to: int
    fn: Callable
    native: bool = False


def _python_step(fn: Callable[[dict], dict]) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda t: None if t is None else json.dumps(fn(json.loads(t)), separators=(",", ":"), ensure_ascii=False))

    return run


class Upcasters:
    """Chains of upcasters by event type. Types without one pass through."""

    def __init__(self):
        self.chains: dict[str, dict[int, Step]] = {}

    def register(self, event_type: str, start: int, to: int, fn: Callable, native: bool = False) -> None:
        """``native``: ``fn`` maps a payload Column to a payload Column; else it maps a dict to a dict."""
        if to <= start:
            raise ValueError(f"an upcaster goes up: {start} to {to}")
        self.chains.setdefault(event_type, {})[start] = Step(start, to, fn, native)

    def path(self, event_type: str, version: int) -> list[Step]:
        """The steps that a stored version goes through; a gap before a later step is an error."""
        chain, steps = self.chains.get(event_type, {}), []
        while version in chain:
            steps.append(chain[version])
            version = steps[-1].to
        if any(s > version for s in chain):
            raise UpcasterChainGap(f"{event_type}: no step from {version}")
        return steps

    def check(self, events: DataFrame) -> None:
        """Raise if any stored (type, version) has a gap, whether or not its payload is read."""
        for row in events.where(F.col("event_type").isin(list(self.chains))).select("event_type", "type_version").distinct().toLocalIterator():
            self.path(row["event_type"], row["type_version"])

    def apply(self, events: DataFrame) -> DataFrame:
        """``events`` with payloads of the latest version; type_version and id stay as stored.

        One pass over the steps by rising start; each changes the rows whose running version it starts
        from. A row that ends before a later step raises when its payload is read.
        """
        if not self.chains:
            return events
        names = events.columns
        rows = events.withColumn("_v", F.col("type_version"))
        for event_type, chain in sorted(self.chains.items()):
            mine = F.col("event_type") == event_type
            for start in sorted(chain):
                step = chain[start]
                due = mine & (F.col("_v") == start)
                fn = step.fn if step.native else _python_step(step.fn)
                value = fn(F.col("payload")) if step.native else fn(F.when(due, F.col("payload")))
                rows = rows.withColumns({"payload": F.when(due, value).otherwise(F.col("payload")), "_v": F.when(due, F.lit(step.to)).otherwise(F.col("_v"))})
            last = max(chain)
            gap = mine & (F.col("_v") <= last)
            rows = rows.withColumn("payload", F.when(gap, F.raise_error(F.concat(F.lit(f"UpcasterChainGap: {event_type}: no step from "), F.col("_v").cast("string")))).otherwise(F.col("payload")))
        return rows.select(*names)


class Transforms:
    """Payload rewrites before an event gets its id; all that match a stream apply, in order of registration."""

    def __init__(self):
        self.steps: list[tuple[str, Callable, bool]] = []

    def register(self, pattern: str, fn: Callable, native: bool = False) -> None:
        """``native``: ``fn(event_type, payload)`` on Columns; else on a string and a dict."""
        self.steps.append((pattern, fn, native))

    def apply(self, incoming: DataFrame) -> DataFrame:
        rows = incoming
        for pattern, fn, native in self.steps:
            due = matching(F.col("stream_id"), pattern)
            value = fn(F.col("event_type"), F.col("payload")) if native else _transform(fn)(F.col("event_type"), F.when(due, F.col("payload")))
            rows = rows.withColumn("payload", F.when(due, value).otherwise(F.col("payload")))
        return rows


def _transform(fn: Callable[[str, dict], dict]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf("string")
    def run(kind: pd.Series, payload: pd.Series) -> pd.Series:
        def one(k, t):
            if t is None:
                return None
            try:
                return json.dumps(fn(k, json.loads(t)), separators=(",", ":"), ensure_ascii=False)
            except Exception as e:
                raise TransformFailed(f"{k}: {e}") from e

        return pd.Series([one(k, t) for k, t in zip(kind, payload, strict=True)])

    return run
