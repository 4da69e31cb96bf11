"""Reducers: ordered left folds of each (stream, branch), with snapshots.

A reducer that is algebraic (sums, counts, latest value) should be a built-in aggregate; see
``algebraic``. Opaque reducers run in Python over rows sorted by key and version inside partitions: a
state is carried from row to row across Arrow batches, so memory holds one state whatever a stream's
length, and snapshots enter the same order as rows that set the state.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.functions.glob import matches, overlap, specificity, validate_pattern
from sediment.model import ReducerFailed, ReducerNotFound, ReducerPatternAmbiguous
from sediment.session import ship


class Reducer:
    """``apply`` gets the state and the decoded payload; with ``whole_event`` the event as well."""

    name = "reducer"
    version = 1
    state_schema_version = 1
    whole_event = False

    def initial_state(self) -> Any:
        raise NotImplementedError

    def apply(self, state: Any, payload: Any, *event: Any) -> Any:
        raise NotImplementedError


@dataclass(frozen=True)
class SnapshotPolicy:
    """When a fold's state is kept: never by itself, every ``n`` events, every ``n`` seconds, or when
    at least ``min_events`` were replayed and replaying cost ``n`` microseconds or more."""

    kind: str = "manual"
    n: int = 0
    min_events: int = 1

    def due(self, events_since: int, seconds_since: float, cost_us: float) -> bool:
        match self.kind:
            case "every_n_events":
                return events_since >= max(1, self.n)
            case "every_n_seconds":
                return events_since > 0 and seconds_since >= max(1, self.n)
            case "state_adaptive":
                return events_since >= self.min_events and cost_us >= self.n
        return False


@dataclass
class Reducers:
    """Reducers by stream pattern. The most specific pattern wins, the earlier one among equals."""

    entries: list[tuple[str, Reducer, SnapshotPolicy]] = field(default_factory=list)

    def register(self, pattern: str, reducer: Reducer, policy: SnapshotPolicy = SnapshotPolicy()) -> None:
        validate_pattern(pattern)
        for other, _, _ in self.entries:
            if specificity(other) == specificity(pattern) and overlap(other, pattern):
                raise ReducerPatternAmbiguous(f"{pattern} and {other}")
        self.entries.append((pattern, reducer, policy))

    def entry(self, stream_id: str) -> tuple[str, Reducer, SnapshotPolicy]:
        found = [e for e in self.entries if matches(e[0], stream_id)]
        if not found:
            raise ReducerNotFound(stream_id)
        return max(found, key=lambda e: specificity(e[0]))

    def for_stream(self, stream_id: str) -> Reducer:
        return self.entry(stream_id)[1]

    def named(self, name: str) -> Reducer:
        for _, reducer, _ in self.entries:
            if reducer.name == name:
                return reducer
        raise ReducerNotFound(name)


def latest_snapshots(snapshots: DataFrame, reducer: Reducer, max_version: int | None = None) -> DataFrame:
    """The last snapshot of each (stream, branch) that fits the reducer's name and state schema."""
    rows = snapshots.where((F.col("reducer_name") == reducer.name) & (F.col("state_schema_version") == reducer.state_schema_version))
    if max_version is not None:
        rows = rows.where(F.col("version") <= max_version)
    best = rows.groupBy("stream_id", "branch").agg(F.max_by(F.struct("version", "state"), F.struct("version", "created_at")).alias("s"))
    return best.select("stream_id", "branch", F.col("s.version").alias("version"), F.col("s.state").alias("state"))


def fold_states(events: DataFrame, reducer: Reducer, snapshots: DataFrame | None = None, at_version: int | None = None) -> DataFrame:
    """Rows (stream_id, branch, version, n_events, state): each key's state after its last event, as JSON.

    ``at_version`` stops at that version, inclusive. With ``snapshots`` a key starts from its latest
    fitting one and only later events are read into the fold. A failing reducer names stream, reducer
    and event. Payloads are those stored; upcast ``events`` first if the reducer wants that.
    """
    rows = events if at_version is None else events.where(F.col("version") <= at_version)
    kinds = {"stream_id": "string", "branch": "string", "version": "long", "payload": "string", "event": "string"}
    whole = F.to_json(F.struct(*[c for c in events.columns if c != "payload" and dict(events.dtypes)[c] != "binary"])) if reducer.whole_event else F.lit(None)
    keyed = rows.select("stream_id", "branch", F.col("version").cast("long").alias("version"), "payload", whole.cast("string").alias("event"), F.lit(True).alias("live"))
    if snapshots is not None:
        base = latest_snapshots(snapshots, reducer, at_version)
        since = base.select("stream_id", "branch", F.col("version").alias("_from"))
        keyed = keyed.join(since, ["stream_id", "branch"], "left").where("_from IS NULL OR version > _from").drop("_from")
        keyed = keyed.unionByName(base.select("stream_id", "branch", "version", F.col("state").alias("payload"), F.lit(None).cast("string").alias("event"), F.lit(False).alias("live")))
    # By a hash of the key: Spark drops a repartition by columns that its input claims to be dealt by already,
    # and then deals the parts of a union, or of a skewed join, anew without regard to keys.
    ordered = keyed.repartition(F.xxhash64("stream_id", "branch")).sortWithinPartitions("stream_id", "branch", "version", "live")
    ship(events.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, version, n, state = None, -1, 0, None
        names = ["stream_id", "branch", "version", "n_events", "state"]

        def flush(done: list) -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=names)

        for batch in batches:
            done = []
            for stream, branch, at, payload, event, live in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (stream, branch) != key:
                    if key is not None:
                        done.append((*key, version, n, json.dumps(state)))
                    key, n, state = (stream, branch), 0, reducer.initial_state()
                version = at
                if not live:
                    state = json.loads(payload)
                    continue
                try:
                    more = (json.loads(event),) if reducer.whole_event else ()
                    state = reducer.apply(state, json.loads(payload), *more)
                except Exception as e:
                    raise ReducerFailed(f"{reducer.name} on {stream} ({branch}) at version {at}: {e}") from e
                n += 1
            if done:
                yield flush(done)
        if key is not None:
            yield flush([(*key, version, n, json.dumps(state))])

    assert list(kinds) == keyed.columns[:5]
    return ordered.mapInArrow(run, "stream_id string, branch string, version long, n_events long, state string")


def algebraic(events: DataFrame, *aggs: Column, at_version: int | None = None) -> DataFrame:
    """States of reducers that are built-in aggregates: partial before the shuffle, no order needed."""
    rows = events if at_version is None else events.where(F.col("version") <= at_version)
    return rows.groupBy("stream_id", "branch").agg(F.max("version").alias("version"), *aggs)


def algebraic_with_snapshots(events: DataFrame, snapshots: DataFrame, value: Column, name: str) -> DataFrame:
    """A running sum continued from snapshots (stream_id, branch, version, state): the snapshot plus later events."""
    since = snapshots.select("stream_id", "branch", F.col("version").alias("_from"), F.col("state").cast("double").alias("_base"))
    late = events.join(since.select("stream_id", "branch", "_from"), ["stream_id", "branch"], "left").where("_from IS NULL OR version > _from")
    tail = late.select("stream_id", "branch", "version", value.alias("_v"))
    base = since.select("stream_id", "branch", F.col("_from").alias("version"), F.col("_base").alias("_v"))
    return tail.unionByName(base).groupBy("stream_id", "branch").agg(F.max("version").alias("version"), F.sum("_v").alias(name))


def take_snapshots(events: DataFrame, reducer: Reducer, snapshots: DataFrame | None = None, created_at: int | None = None) -> DataFrame:
    """Snapshot rows of every key that has events beyond its latest one."""
    states = fold_states(events, reducer, snapshots).where("n_events > 0")
    now = created_at if created_at is not None else time.time_ns() // 1000
    return states.select("stream_id", "branch", "version", F.lit(reducer.name).alias("reducer_name"), F.lit(reducer.version).alias("reducer_version"), F.lit(reducer.state_schema_version).alias("state_schema_version"), "state", F.lit(now).cast("long").alias("created_at"))


def live_snapshots(snapshots: DataFrame, reducers: Reducers) -> DataFrame:
    """What garbage collection leaves: snapshots whose reducer name and state schema are registered."""
    keys = {(r.name, r.state_schema_version) for _, r, _ in reducers.entries}
    ok = F.lit(False)
    for name, schema in sorted(keys):
        ok = ok | ((F.col("reducer_name") == name) & (F.col("state_schema_version") == schema))
    return snapshots.where(ok)
