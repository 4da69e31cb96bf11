"""Data model of the event log: schemas, identifiers, errors, outcomes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAIN = "main"
#: First segment of streams that the engine writes itself.
SYSTEM = "_system"

EVENT_SCHEMA = T.StructType([
    T.StructField("id", T.BinaryType(), False),
    T.StructField("stream_id", T.StringType(), False),
    T.StructField("branch", T.StringType(), False),
    T.StructField("version", T.LongType(), False),
    T.StructField("timestamp_us", T.LongType(), False),
    T.StructField("causation_id", T.BinaryType()),
    T.StructField("correlation_id", T.BinaryType()),
    T.StructField("event_type", T.StringType(), False),
    T.StructField("type_version", T.IntegerType(), False),
    T.StructField("payload", T.StringType(), False),
    T.StructField("external_id", T.StringType()),
    T.StructField("indexed_tags", T.StringType()),
])
STREAM_SCHEMA = "id string, declared_by string, declared_at long, description string"
BRANCH_SCHEMA = "id string, stream_id string, parent_id string, parent_version long, description string, created_at long, lifecycle string, closed_at long, closed_reason string, alternatives string"
SNAPSHOT_SCHEMA = "stream_id string, branch string, version long, reducer_name string, reducer_version int, state_schema_version int, state string, created_at long"
CURSOR_SCHEMA = "consumer_id string, stream_id string, branch string, version long, updated_at long"


class EventLogError(Exception):
    """Base of all errors of the engine."""


class StoreNotFound(EventLogError): ...


class InvalidStreamId(EventLogError): ...


class InvalidBranchId(EventLogError): ...


class StreamNotDeclared(EventLogError): ...


class InvalidIndexedTags(EventLogError): ...


class InvalidTagFilter(EventLogError): ...


class ReservedBranch(EventLogError): ...


class BranchExists(EventLogError): ...


class BranchNotFound(EventLogError): ...


class BranchLifecycleError(EventLogError): ...


class EventNotFound(EventLogError): ...


class PurgeConfirmationError(EventLogError): ...


class UpcasterChainGap(EventLogError): ...


class TransformFailed(EventLogError): ...


class ReducerNotFound(EventLogError): ...


class ReducerPatternAmbiguous(EventLogError): ...


class ReducerFailed(EventLogError): ...


class NoEventsToSnapshot(EventLogError): ...


class InvalidCursor(EventLogError): ...


class InvalidPattern(EventLogError): ...


class EncodingError(EventLogError): ...


class DimensionMismatch(EventLogError): ...


class NoSharedFolder(EventLogError): ...


_SEGMENT = re.compile(r"[\w-]+\Z")


def validate_stream_id(stream_id: str) -> str:
    """A path of one to four segments of letters, digits, ``-`` or ``_``, at most 256 bytes in all."""
    parts = stream_id.split("/")
    if not stream_id or len(stream_id.encode()) > 256 or len(parts) > 4 or not all(_segment(p) for p in parts):
        raise InvalidStreamId(stream_id)
    return stream_id


def _segment(part: str) -> bool:
    return bool(part) and all(c.isalnum() or c in "-_" for c in part)


def validate_branch_id(branch: str) -> str:
    """At most 128 bytes of letters, digits and ``-_/``; no slash at an edge or doubled; ``main`` is reserved."""
    if branch == MAIN:
        raise ReservedBranch(branch)
    if not branch or len(branch.encode()) > 128 or branch[0] == "/" or branch[-1] == "/" or "//" in branch or not all(_segment(p) for p in branch.split("/")):
        raise InvalidBranchId(branch)
    return branch


def valid_stream_id(col: Column) -> Column:
    """Column form of ``validate_stream_id``, for whole tables."""
    return (F.octet_length(col) <= 256) & col.rlike(r"^[\p{L}\p{N}_-]+(?:/[\p{L}\p{N}_-]+){0,3}$")


def hex_id(col: Column) -> Column:
    """An id as 64 lower-case hex digits."""
    return F.lower(F.hex(col))


def parse_id(text: str) -> bytes:
    """The 32 bytes of an id given as hex in either case."""
    if not re.fullmatch(r"[0-9A-Fa-f]{64}", text):
        raise EventLogError(f"not an event id: {text!r}")
    return bytes.fromhex(text)


@dataclass(frozen=True)
class Append:
    """One event to be written."""

    stream_id: str
    event_type: str
    payload: Any
    branch: str = MAIN
    type_version: int = 1
    causation_id: bytes | None = None
    correlation_id: bytes | None = None
    external_id: str | None = None
    indexed_tags: dict | None = None
    timestamp_us: int | None = None


@dataclass
class ReadOutcome:
    """Rows of a bounded read; ``reason`` is None if complete, else ``count`` or ``bytes``."""

    data: DataFrame | Any
    reason: str | None = None
    cursor: str | None = None

    @property
    def complete(self) -> bool:
        return self.reason is None


@dataclass(frozen=True)
class Sampling:
    """How many nodes of each level of a walk go on: all, a number, or a share of a target."""

    mode: str = "exhaustive"
    n: int = field(default=0)

    def per_level(self, max_depth: int) -> int | None:
        if self.mode == "breadth_first":
            return self.n
        if self.mode == "adaptive":
            return max(1, self.n // max(1, max_depth))
        return None
