"""Filtered folds over many streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.glob import matching, validate_pattern
from sediment.functions.tags import tags_match
from sediment.model import MAIN, ReadOutcome
from sediment.plans.budget import cut, outcome, payload_bytes
from sediment.plans.reads import MICROS


@dataclass(frozen=True)
class AggregateQuery:
    """Which events an aggregate sees; time bounds are inclusive."""

    stream_pattern: str = "*"
    branch: str = MAIN
    event_type: str | None = None
    from_ts: int | None = None
    to_ts: int | None = None
    tags: Any = None


def selected(events: DataFrame, q: AggregateQuery) -> DataFrame:
    """The events of a query, unordered. Comparisons come first and are pushed to the scan."""
    validate_pattern(q.stream_pattern)
    rows = events.where(F.col("branch") == q.branch)
    if q.event_type is not None:
        rows = rows.where(F.col("event_type") == q.event_type)
    if q.from_ts is not None:
        rows = rows.where(F.col("timestamp_us") >= q.from_ts)
    if q.to_ts is not None:
        rows = rows.where(F.col("timestamp_us") <= q.to_ts)
    rows = rows.where(matching(F.col("stream_id"), q.stream_pattern))
    return rows.where(tags_match(F.col("indexed_tags"), q.tags)) if q.tags is not None else rows


ORDER = ("timestamp_us", "stream_id", "branch", "version")


def collect_all(events: DataFrame, q: AggregateQuery) -> DataFrame:
    """The events themselves, in fold order."""
    return selected(events, q).orderBy(*ORDER)


def aggregate(events: DataFrame, q: AggregateQuery, *aggs: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Built-in aggregates of the selected events: partial before the shuffle, final after."""
    rows = selected(events, q)
    return (rows.groupBy(*by) if by else rows).agg(*aggs)


class Aggregate:
    """A fold in event order. With ``merge`` it runs in parallel: each task folds a range of time, and
    the states meet on the driver in order of time."""

    def initial(self) -> Any:
        raise NotImplementedError

    def fold(self, state: Any, event: dict) -> Any:
        raise NotImplementedError

    def finalize(self, state: Any) -> Any:
        return state

    merge: Callable[[Any, Any, Any], Any] | None = None


def fold_aggregate(events: DataFrame, q: AggregateQuery, agg: Aggregate) -> Any:
    """Fold the selected events in order and finalise once.

    A mergeable aggregate is folded inside each partition of a global sort and only its states are
    collected, one a partition. Without ``merge`` the order is one chain: rows stream to the driver.
    """
    return _fold(collect_all(events, q), agg)


def _fold(rows: DataFrame, agg: Aggregate) -> Any:
    if agg.merge is None:
        state = agg.initial()
        for row in rows.toLocalIterator(prefetchPartitions=True):
            state = agg.fold(state, row.asDict())
        return agg.finalize(state)
    import pickle

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        state, any_row = agg.initial(), False
        for batch in batches:
            for event in batch.to_pylist():
                state, any_row = agg.fold(state, event), True
        if any_row:
            yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "state": [pickle.dumps(state)]})

    from sediment.session import ship

    ship(rows.sparkSession)
    parts = rows.mapInArrow(run, "part long, state binary").collect()
    state = agg.initial()
    for row in sorted(parts, key=lambda r: r["part"]):
        state = agg.merge(state, pickle.loads(bytes(row["state"])))
    return agg.finalize(state)


def _order() -> list[Column]:
    return [F.col(c) for c in ORDER]


def bounded(events: DataFrame, q: AggregateQuery, max_events: int | None, max_bytes: int | None) -> DataFrame:
    """The longest prefix of the selected events, in fold order, within the budget."""
    return cut(selected(events, q), _order(), F.floor(F.col("timestamp_us") / MICROS), payload_bytes(F.col("payload")), max_events, max_bytes)


def aggregate_bounded(events: DataFrame, q: AggregateQuery, agg: Aggregate, max_events: int | None = None, max_bytes: int | None = None) -> ReadOutcome:
    """A fold that stops before the event that exceeds the budget; its partial state is finalised. No cursor."""
    out = outcome(selected(events, q), _order(), F.floor(F.col("timestamp_us") / MICROS), payload_bytes(F.col("payload")), max_events, max_bytes, lambda first, last: None)
    return ReadOutcome(_fold(out.data.orderBy(*ORDER), agg), out.reason)
