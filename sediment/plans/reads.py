"""Reads of one stream, by id, by external id and by correlation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sediment.model import MAIN, ReadOutcome
from sediment.plans.budget import cut, decode_cursor, encode_cursor, outcome, payload_bytes

#: Versions and microseconds that one bucket of a running budget spans.
VERSIONS, MICROS = 100_000, 3_600_000_000


def one_stream(events: DataFrame, stream_id: str, branch: str = MAIN, from_version: int | None = None, to_version: int | None = None, event_type: str | None = None) -> DataFrame:
    """Rows of one stream and branch, bounds inclusive. Every predicate is a comparison with a literal, so scans prune by it."""
    rows = events.where((F.col("stream_id") == stream_id) & (F.col("branch") == branch))
    if from_version is not None:
        rows = rows.where(F.col("version") >= from_version)
    if to_version is not None:
        rows = rows.where(F.col("version") <= to_version)
    return rows if event_type is None else rows.where(F.col("event_type") == event_type)


def read_range(events: DataFrame, stream_id: str, branch: str = MAIN, from_version: int | None = None, to_version: int | None = None, limit: int | None = None, event_type: str | None = None) -> DataFrame:
    """A stream in version order; ``limit`` counts after all filters."""
    rows = one_stream(events, stream_id, branch, from_version, to_version, event_type).orderBy("version")
    return rows if limit is None else rows.limit(limit)


def read_range_bounded(events: DataFrame, stream_id: str, branch: str = MAIN, from_version: int | None = None, to_version: int | None = None, event_type: str | None = None, max_results: int | None = None, max_bytes: int | None = None, cursor: str | None = None) -> ReadOutcome:
    """A stream's prefix within the budget, with a cursor to the next version."""
    state = decode_cursor(cursor, "range")
    start = from_version if state is None else state["next_version"]
    rows = one_stream(events, stream_id, branch, start, to_version, event_type)

    def token(first: Row, last: Row | None) -> str:
        return encode_cursor("range", stream_id=stream_id, branch=branch, next_version=first["version"])

    return outcome(rows, [F.col("version")], F.floor(F.col("version") / VERSIONS), payload_bytes(F.col("payload")), max_results, max_bytes, token)


def bounded_rows(events: DataFrame, stream_id: str, max_results: int | None, max_bytes: int | None, branch: str = MAIN, from_version: int | None = None) -> DataFrame:
    """As ``read_range_bounded``, as one lazy plan without reason and cursor."""
    rows = one_stream(events, stream_id, branch, from_version)
    return cut(rows, [F.col("version")], F.floor(F.col("version") / VERSIONS), payload_bytes(F.col("payload")), max_results, max_bytes)


def read_one(events: DataFrame, event_id) -> DataFrame:
    """The event of an id, or no row."""
    return events.where(F.col("id") == F.lit(event_id))


#: Ids up to this number go into the predicate itself; more become a join.
MOST_LITERALS = 1000


def read_batch(events: DataFrame, ids: Iterable | DataFrame) -> DataFrame:
    """Events of the given ids, by time. Unknown ids are left out, repeated ones count once.

    A short list becomes a pushed-down IN; a DataFrame (column ``id``) or a long list a semi join.
    """
    if not isinstance(ids, DataFrame):
        ids = list(dict.fromkeys(ids))
        if len(ids) <= MOST_LITERALS:
            return _by_time(events.where(F.col("id").isin(ids)) if ids else events.limit(0))
        ids = events.sparkSession.createDataFrame([(i,) for i in ids], events.select("id").schema)
    return _by_time(events.join(ids.select("id"), "id", "left_semi"))


def _by_time(rows: DataFrame) -> DataFrame:
    return rows.orderBy("timestamp_us", "stream_id", "branch", "version")


def read_by_external_id(events: DataFrame, stream_id: str, external_id: str) -> DataFrame:
    """The event with a caller's key in a stream, on any branch: the first by branch and version."""
    return events.where((F.col("stream_id") == stream_id) & (F.col("external_id") == external_id)).orderBy("branch", "version").limit(1)


def read_by_correlation(events: DataFrame, correlation_id) -> DataFrame:
    """All events of a group, over all streams and branches, by time."""
    return _by_time(events.where(F.col("correlation_id") == F.lit(correlation_id)))


def _first_byte(col: Column) -> Column:
    return F.substring(F.hex(col), 1, 4)


def read_by_correlation_bounded(events: DataFrame, correlation_id, max_results: int | None = None, max_bytes: int | None = None, cursor: str | None = None) -> ReadOutcome:
    """A group's prefix in order of id within the budget, with a cursor after the last id."""
    rows = events.where(F.col("correlation_id") == F.lit(correlation_id))
    state = decode_cursor(cursor, "correlation")
    binary = dict(events.dtypes)["id"] == "binary"
    if state and state["last_seen"] is not None:
        rows = rows.where(F.col("id") > F.lit(bytes.fromhex(state["last_seen"]) if binary else state["last_seen"]))

    def token(first: Row, last: Row | None) -> str:
        seen = last["id"] if last else (state or {}).get("last_seen")
        return encode_cursor("correlation", last_seen=bytes(seen).hex() if binary and last else seen)

    return outcome(rows, [F.col("id")], _first_byte(F.col("id")) if binary else F.floor(F.col("id") / VERSIONS), payload_bytes(F.col("payload")), max_results, max_bytes, token)


def iterate(rows: DataFrame) -> Iterator[Row]:
    """Rows of an ordered read one by one; a partition at a time is on the driver."""
    return rows.toLocalIterator(prefetchPartitions=True)
