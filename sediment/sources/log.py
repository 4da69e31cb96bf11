"""The event log as a folder of Parquet tables, and its whole API.

Layout: ``events`` is partitioned by branch and by the first segment of the stream, and sorted by
(stream_id, version) inside files, so reads of one stream prune partitions, then row groups. The side
tables (streams, branches, snapshots, cursors) are append-only: the current state of a key is its last
row. Plain files give no compare-and-swap: one writer at a time, any number of readers.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.functions import glob, identity
from sediment.model import (
    BRANCH_SCHEMA, CURSOR_SCHEMA, EVENT_SCHEMA, MAIN, SNAPSHOT_SCHEMA, STREAM_SCHEMA, SYSTEM,
    Append, BranchExists, BranchLifecycleError, BranchNotFound, EventNotFound, InvalidIndexedTags, NoEventsToSnapshot,
    InvalidStreamId, PurgeConfirmationError, ReadOutcome, Sampling, StoreNotFound, StreamNotDeclared, valid_stream_id, validate_branch_id, validate_stream_id,
)
from sediment.operators import branches as lineage
from sediment.operators import fold
from sediment.operators.evolve import Transforms, Upcasters
from sediment.operators.similarity import KnnIndex
from sediment.plans import aggregate, graph, reads
from sediment.plans.budget import resolve
from sediment.session import ship
from sediment.storage import exists, few, move, recover, remove, replace_folder, stored

#: What ``purge_event`` must be told. Fixed value.
CONFIRM_PURGE = "I understand this breaks replay-from-zero"
SYSTEM_STREAM = f"{SYSTEM}/log"

_TABLES = {
    "streams": STREAM_SCHEMA + ", seq long",
    "branches": BRANCH_SCHEMA + ", seq long",
    "snapshots": SNAPSHOT_SCHEMA,
    "cursors": CURSOR_SCHEMA + ", seq long",
}


@dataclass(frozen=True)
class Options:
    """``create``: make a log where there is none; the rest are defaults of bounded reads and monitors."""

    create: bool = True
    default_max_results: int | None = None
    default_max_bytes: int | None = None
    state_large_threshold: int = 1 << 20
    domain: bytes = identity.DOMAIN


def now_us() -> int:
    return time.time_ns() // 1000


class EventLog:
    """One log. Reads are lazy DataFrames unless they return a single value."""

    def __init__(self, spark: SparkSession, path: str, options: Options = Options()):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options
        self.upcasters, self.transforms, self.reducers = Upcasters(), Transforms(), fold.Reducers()
        self.index: KnnIndex | None = None
        ship(spark)
        recover(spark, f"{self.path}/snapshots")
        if not exists(spark, f"{self.path}/events"):
            if not options.create:
                raise StoreNotFound(path)
            self._write_events(spark.createDataFrame([], EVENT_SCHEMA))
            for name, schema in _TABLES.items():
                spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")
            self.declare_stream(SYSTEM_STREAM, "engine", None)

    def close(self) -> None:
        """Nothing is held open."""

    # Tables

    @property
    def raw(self) -> DataFrame:
        """All events as stored."""
        names = [f.name for f in EVENT_SCHEMA]
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT_SCHEMA) + ", root string"
        return self.spark.read.schema(schema).parquet(f"{self.path}/events").select(*names)

    @property
    def events(self) -> DataFrame:
        """All events with payloads of their latest version."""
        return self.upcasters.apply(self.raw)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.path}/{name}")

    def _add(self, name: str, *rows: tuple) -> None:
        self.spark.createDataFrame(list(rows), _TABLES[name]).coalesce(1).write.mode("append").parquet(f"{self.path}/{name}")

    def _write_events(self, df: DataFrame) -> None:
        """Range partitions split a hot stream, branch or root over files; each file is sorted."""
        rows = df.withColumn("root", F.split("stream_id", "/")[0])
        rows.repartitionByRange("branch", "root", "stream_id", "version").sortWithinPartitions("branch", "root", "stream_id", "version").write.mode("append").partitionBy("branch", "root").parquet(f"{self.path}/events")

    # Streams

    def declare_stream(self, stream_id: str, declared_by: str, description: str | None = None) -> None:
        """The first declaration of a stream counts."""
        validate_stream_id(stream_id)
        self._add("streams", (stream_id, declared_by, now_us(), description, time.time_ns()))

    def declare_frame(self, ids: DataFrame, declared_by: str) -> None:
        """Declare every stream in column ``stream_id`` at once."""
        new = ids.select("stream_id").distinct()
        bad = new.where(~valid_stream_id(F.col("stream_id"))).first()
        if bad is not None:
            raise InvalidStreamId(bad["stream_id"])
        row = [F.col("stream_id").alias("id"), F.lit(declared_by).alias("declared_by"), F.lit(now_us()).alias("declared_at"), F.lit(None).cast("string").alias("description"), F.lit(time.time_ns()).alias("seq")]
        new.select(*row).write.mode("append").parquet(f"{self.path}/streams")

    def _declared(self) -> DataFrame:
        first = self._table("streams").groupBy("id").agg(F.min_by(F.struct("declared_by", "declared_at", "description"), "seq").alias("s"))
        return first.select("id", "s.*")

    def streams(self) -> DataFrame:
        """Declared streams but the engine's own, by id."""
        return self._declared().where(~glob.is_system(F.col("id"))).orderBy("id")

    def stream_exists(self, stream_id: str) -> bool:
        return not self._table("streams").where(F.col("id") == stream_id).limit(1).isEmpty()

    # Writes

    def _incoming(self, appends: Iterable[Append]) -> DataFrame:
        now, rows = now_us(), []
        for i, a in enumerate(appends):
            if a.indexed_tags is not None and not isinstance(a.indexed_tags, dict):
                raise InvalidIndexedTags(f"{a.indexed_tags!r} is no object")
            tags = None if a.indexed_tags is None else json.dumps(a.indexed_tags, ensure_ascii=False)
            ids = [None if x is None else bytearray(x) for x in (a.causation_id, a.correlation_id)]
            rows.append((i, a.stream_id, a.branch, now if a.timestamp_us is None else a.timestamp_us, *ids, a.event_type, a.type_version, json.dumps(a.payload, ensure_ascii=False, separators=(",", ":")), a.external_id, tags))
        schema = "ordinal long, stream_id string, branch string, timestamp_us long, causation_id binary, correlation_id binary, event_type string, type_version int, payload string, external_id string, indexed_tags string"
        return self.spark.createDataFrame(rows, schema)

    def append(self, a: Append) -> bytes:
        """Write one event; one that is there already is not written again and gives the same id."""
        return self.append_batch([a])[0]

    def append_batch(self, appends: Iterable[Append]) -> list[bytes]:
        """Write events in order, all or none; the ids in order."""
        rows = self.append_frame(self._incoming(appends)).orderBy("ordinal").collect()
        return [bytes(r["id"]) for r in rows]

    def append_if(self, a: Append, condition: Callable[[DataFrame], bool]) -> bytes | None:
        """Write one event if ``condition`` holds for the log's events now."""
        if not self.stream_exists(a.stream_id):
            raise StreamNotDeclared(a.stream_id)
        return self.append(a) if condition(self.raw) else None

    def append_frame(self, incoming: DataFrame) -> DataFrame:
        """Write a DataFrame of events (columns of the log but id and version, and ``ordinal``); rows (ordinal, id, is_new).

        Transforms come before ids. Of equal ids the lowest ordinal stays; ids already in the log are
        left out; versions go on from each (stream, branch)'s last. The first pass is written to the shared
        folder, as ids cost Python time. The log is only scanned, for ids and keys that the batch names;
        a batch of more than ``storage.MOST_SENT`` rows meets it by a shuffle.
        """
        rows = self.transforms.apply(incoming)
        bad = F.col("indexed_tags").isNotNull() & ~F.coalesce(F.schema_of_variant(F.try_parse_json("indexed_tags")).startswith("OBJECT"), F.lit(False))
        rows = rows.withColumn("indexed_tags", F.when(bad, F.raise_error(F.lit("InvalidIndexedTags"))).otherwise(F.col("indexed_tags")))
        rows = stored(rows.withColumn("id", identity.event_ids(F.col("event_type"), F.col("type_version"), F.col("causation_id"), F.col("payload"), self.options.domain)), "incoming")
        lost = rows.select("stream_id").distinct().join(self._table("streams").select(F.col("id").alias("stream_id")), "stream_id", "left_anti").first()
        if lost is not None:
            raise StreamNotDeclared(lost["stream_id"])
        first = rows.groupBy("id").agg(F.min("ordinal").alias("ordinal"))
        known = stored(self.raw.select("id").join(few(rows.select("id")), "id", "left_semi"), "known")
        fresh = rows.join(first, ["id", "ordinal"], "left_semi").join(known, "id", "left_anti")
        keys = stored(rows.select("stream_id", "branch").distinct(), "keys")
        last = self.raw.select("stream_id", "branch", "version").join(few(keys), ["stream_id", "branch"], "left_semi").groupBy("stream_id", "branch").agg(F.max("version").alias("last"))
        place = F.row_number().over(W.partitionBy("stream_id", "branch").orderBy("ordinal"))
        new = fresh.join(last, ["stream_id", "branch"], "left").withColumn("version", F.coalesce("last", F.lit(-1)) + place)
        new = stored(new.select("ordinal", *[F.col(f.name).cast(f.dataType) for f in EVENT_SCHEMA]), "fresh")
        self._write_events(new.select(*[f.name for f in EVENT_SCHEMA]))
        return rows.select("ordinal", "id").join(new.select("ordinal", F.lit(True).alias("is_new")), "ordinal", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))

    def purge_event(self, event_id: bytes, confirm: str, reason: str, purged_by: str) -> None:
        """Remove one event for good and record that; snapshots stay.

        Only the file that holds the event is written anew, aside; it is put in place before the old one
        goes, so a crash loses nothing (at worst the file's events stand twice until the purge is repeated).
        """
        if confirm != CONFIRM_PURGE:
            raise PurgeConfirmationError(confirm)
        row = self.raw.where(F.col("id") == F.lit(event_id)).first()
        if row is None:
            raise EventNotFound(event_id.hex())
        facts = {"event_id": event_id.hex(), "stream_id": row["stream_id"], "branch": row["branch"], "version": row["version"], "event_type": row["event_type"], "reason": reason, "purged_by": purged_by}
        self.emit("Purged", facts)
        here = (F.col("branch") == row["branch"]) & (F.col("root") == row["stream_id"].split("/")[0])
        files = self.spark.read.parquet(f"{self.path}/events").where(here & (F.col("id") == F.lit(event_id))).select(F.input_file_name().alias("f")).distinct().collect()
        for file in (unquote(r["f"]) for r in files):
            aside = f"{self.path}/_purge-{uuid.uuid4().hex}"
            kept = self.spark.read.parquet(file).where(F.col("id") != F.lit(event_id))
            kept.coalesce(1).sortWithinPartitions("stream_id", "version").write.parquet(aside)
            for part in self.spark.read.schema(kept.schema).parquet(aside).inputFiles():
                move(self.spark, part, f"{file.rpartition('/')[0]}/part-{uuid.uuid4().hex}.parquet")
            remove(self.spark, file)
            remove(self.spark, aside)

    def shred_stream(self, stream_id: str, reason: str) -> None:
        raise NotImplementedError("streams are not encrypted")

    def emit(self, event_type: str, payload: dict, tags: dict | None = None) -> None:
        """Record a system event; payloads carry the time, so that equal facts are events of their own."""
        self.append(Append(SYSTEM_STREAM, event_type, payload | {"at_us": now_us()}, indexed_tags=tags))

    def emit_project_registered(self, source_store: str, local_store_path: str, subscribe_pattern: str, project_description: str) -> None:
        self.emit("ProjectRegistered", {"source_store": source_store, "local_store_path": local_store_path, "subscribe_pattern": subscribe_pattern, "project_description": project_description}, {"source_store": source_store})

    def emit_relay_heartbeat(self, source_store: str, last_event_version: int, queue_lag: int, uptime_us: int) -> None:
        self.emit("RelayHeartbeat", {"source_store": source_store, "last_event_version": last_event_version, "queue_lag": queue_lag, "uptime_us": uptime_us}, {"source_store": source_store})

    # Reads

    def _limits(self, max_results: int | None, max_bytes: int | None) -> dict:
        return {"max_results": resolve(max_results, self.options.default_max_results), "max_bytes": resolve(max_bytes, self.options.default_max_bytes)}

    def _upcast(self, out: ReadOutcome) -> ReadOutcome:
        """Budgets count stored bytes, so payloads are upcast after the cut."""
        return ReadOutcome(self.upcasters.apply(out.data), out.reason, out.cursor)

    def read_range(self, stream_id: str, **query) -> DataFrame:
        return reads.read_range(self.events, stream_id, **query)

    def read_range_bounded(self, stream_id: str, max_results: int | None = None, max_bytes: int | None = None, **query) -> ReadOutcome:
        return self._upcast(reads.read_range_bounded(self.raw, stream_id, **query, **self._limits(max_results, max_bytes)))

    def read_range_iter(self, stream_id: str, **query) -> Iterator[Row]:
        return reads.iterate(self.read_range(stream_id, **query))

    def read_one(self, event_id: bytes) -> Row | None:
        return reads.read_one(self.events, event_id).first()

    def read_batch(self, ids: Iterable[bytes] | DataFrame) -> DataFrame:
        return reads.read_batch(self.events, ids)

    def read_by_external_id(self, stream_id: str, external_id: str) -> Row | None:
        return reads.read_by_external_id(self.events, stream_id, external_id).first()

    def read_by_correlation(self, correlation_id: bytes) -> DataFrame:
        return reads.read_by_correlation(self.events, correlation_id)

    def read_by_correlation_bounded(self, correlation_id: bytes, max_results: int | None = None, max_bytes: int | None = None, cursor: str | None = None) -> ReadOutcome:
        return self._upcast(reads.read_by_correlation_bounded(self.raw, correlation_id, cursor=cursor, **self._limits(max_results, max_bytes)))

    def read_by_correlation_iter(self, correlation_id: bytes) -> Iterator[Row]:
        return reads.iterate(self.read_by_correlation_bounded(correlation_id).data)

    def walk_causation(self, start: bytes, direction: str = graph.FORWARD, max_depth: int = 100) -> DataFrame:
        return graph.walk_causation(self.events, start, direction, max_depth)

    def walk_causation_bounded(self, start: bytes, direction: str = graph.FORWARD, max_depth: int = 100, sampling: Sampling = Sampling(), max_results: int | None = None, max_bytes: int | None = None, cursor: str | None = None) -> ReadOutcome:
        return self._upcast(graph.walk_causation_bounded(self.raw, start, direction, max_depth, sampling, cursor=cursor, **self._limits(max_results, max_bytes)))

    def walk_causation_iter(self, start: bytes, direction: str = graph.FORWARD, max_depth: int = 100, sampling: Sampling = Sampling()) -> Iterator[Row]:
        return reads.iterate(self.walk_causation_bounded(start, direction, max_depth, sampling).data)

    def aggregate(self, query: aggregate.AggregateQuery, *agg: Column | aggregate.Aggregate, by: tuple[str, ...] = ()) -> Any:
        """Without an aggregate the events; with Columns a grouped DataFrame; with an ``Aggregate`` its value."""
        if not agg:
            return aggregate.collect_all(self.events, query)
        if isinstance(agg[0], aggregate.Aggregate):
            return aggregate.fold_aggregate(self.events, query, agg[0])
        return aggregate.aggregate(self.events, query, *agg, by=by)

    def aggregate_bounded(self, query: aggregate.AggregateQuery, agg: aggregate.Aggregate, max_events: int | None = None, max_bytes: int | None = None) -> ReadOutcome:
        limits = self._limits(max_events, max_bytes)
        return aggregate.aggregate_bounded(self.events, query, agg, limits["max_results"], limits["max_bytes"])

    # Evolution

    def register_upcaster(self, event_type: str, start: int, to: int, fn: Callable, native: bool = False) -> None:
        self.upcasters.register(event_type, start, to, fn, native)

    def register_payload_transform(self, pattern: str, fn: Callable, native: bool = False) -> None:
        self.transforms.register(pattern, fn, native)

    # Consumer cursors

    def get_cursor(self, consumer_id: str, stream_id: str, branch: str = MAIN) -> int | None:
        mine = self._table("cursors").where((F.col("consumer_id") == consumer_id) & (F.col("stream_id") == stream_id) & (F.col("branch") == branch))
        return mine.agg(F.max_by("version", "seq")).first()[0]

    def set_cursor(self, consumer_id: str, stream_id: str, version: int, branch: str = MAIN) -> None:
        """The last value set counts; it may be lower than the one before."""
        self._add("cursors", (consumer_id, stream_id, branch, version, now_us(), time.time_ns()))

    # Branches

    @property
    def branches(self) -> DataFrame:
        """The current row of every branch."""
        names = [x.split()[0] for x in BRANCH_SCHEMA.split(", ")]
        last = self._table("branches").groupBy("stream_id", "id").agg(F.max_by(F.struct(*names), "seq").alias("b"))
        return last.select("b.*")

    def _branch(self, stream_id: str, branch_id: str) -> Row | None:
        return self.branches.where((F.col("stream_id") == stream_id) & (F.col("id") == branch_id)).first()

    def create_branch(self, stream_id: str, branch_id: str, parent_id: str = MAIN, parent_version: int = 0, description: str | None = None, alternatives: list | None = None) -> None:
        """A new ephemeral branch. Neither the parent nor its version is looked up."""
        validate_branch_id(branch_id)
        if alternatives is not None and not isinstance(alternatives, list):
            raise ValueError("alternatives must be a list")
        if self._branch(stream_id, branch_id):
            raise BranchExists(f"{stream_id}: {branch_id}")
        self._add("branches", (branch_id, stream_id, parent_id, parent_version, description, now_us(), "ephemeral", None, None, None if alternatives is None else json.dumps(alternatives), time.time_ns()))

    def _move(self, stream_id: str, branch_id: str, to: str, never: str, reason: str | None) -> None:
        row = self._branch(stream_id, branch_id)
        if row is None:
            raise BranchNotFound(f"{stream_id}: {branch_id}")
        if row["lifecycle"] == never:
            raise BranchLifecycleError(f"{branch_id} is {never}")
        if row["lifecycle"] != to:
            self._add("branches", tuple((row.asDict() | {"lifecycle": to, "closed_at": now_us(), "closed_reason": reason}).values()) + (time.time_ns(),))

    def promote_branch(self, stream_id: str, branch_id: str, reason: str | None = None) -> None:
        self._move(stream_id, branch_id, "promoted", "dead_end", reason)

    def mark_branch_dead_end(self, stream_id: str, branch_id: str, reason: str | None = None) -> None:
        self._move(stream_id, branch_id, "dead_end", "promoted", reason)

    def list_branches(self, stream_id: str) -> DataFrame:
        return self.branches.where(F.col("stream_id") == stream_id).orderBy("created_at", "id")

    def resolve_chain(self, stream_id: str, branch_id: str) -> list[tuple[str, int | None]]:
        return lineage.resolve_chain(self.branches, stream_id, branch_id)

    def read_lineage(self, stream_id: str, branch_id: str) -> DataFrame:
        return lineage.read_lineage(self.events, self.branches, stream_id, branch_id)

    # Reducers and snapshots

    def register_reducer(self, pattern: str, reducer: fold.Reducer, policy: fold.SnapshotPolicy = fold.SnapshotPolicy()) -> None:
        self.reducers.register(pattern, reducer, policy)

    @property
    def snapshots(self) -> DataFrame:
        """The latest row of each (stream, branch, reducer, schema, version)."""
        names = [x.split()[0] for x in SNAPSHOT_SCHEMA.split(", ")]
        key = ["stream_id", "branch", "reducer_name", "state_schema_version", "version"]
        return self._table("snapshots").groupBy(*key).agg(F.max_by(F.struct(*names), "created_at").alias("s")).select("s.*")

    def _key(self, df: DataFrame, stream_id: str, branch: str) -> DataFrame:
        return df.where((F.col("stream_id") == stream_id) & (F.col("branch") == branch))

    def read_state(self, stream_id: str, branch: str = MAIN, at_version: int | None = None, reducer_name: str | None = None) -> Any:
        """The reducer's state of one stream, from the latest fitting snapshot on; the policy may keep it."""
        if reducer_name is None:
            _, reducer, policy = self.reducers.entry(stream_id)
        else:
            reducer, policy = self.reducers.named(reducer_name), fold.SnapshotPolicy()
        began = time.perf_counter()
        snapshots = self._key(self.snapshots, stream_id, branch)
        row = fold.fold_states(self._key(self.raw, stream_id, branch), reducer, snapshots, at_version).first()
        if row is None:
            return reducer.initial_state()
        if at_version is None and policy.kind != "manual":
            last = fold.latest_snapshots(snapshots, reducer).first()
            made = snapshots.where(F.col("version") == (last["version"] if last else -1)).agg(F.max("created_at")).first()[0]
            if policy.due(row["n_events"], (now_us() - (made or 0)) / 1e6, (time.perf_counter() - began) * 1e6):
                self._snapshot(row, reducer)
        if len(row["state"].encode()) > self.options.state_large_threshold:
            self.emit("ReducerStateLarge", {"stream_id": stream_id, "branch": branch, "reducer": reducer.name, "state_bytes": len(row["state"].encode())})
        return json.loads(row["state"])

    def states(self, pattern: str, reducer: fold.Reducer, branch: str = MAIN, at_version: int | None = None) -> DataFrame:
        """States of all streams that match, in one job."""
        rows = self.raw.where((F.col("branch") == branch) & glob.matching(F.col("stream_id"), pattern))
        base = self.snapshots.where((F.col("branch") == branch) & glob.matching(F.col("stream_id"), pattern))
        return fold.fold_states(rows, reducer, base, at_version)

    def _snapshot(self, row: Row, reducer: fold.Reducer) -> None:
        self.write_snapshot_state(row["stream_id"], row["branch"], row["version"], reducer.name, reducer.version, reducer.state_schema_version, row["state"])

    def take_snapshot(self, stream_id: str, branch: str = MAIN) -> Row:
        """Keep the current state; without new events the snapshot there is, without any an error."""
        reducer = self.reducers.for_stream(stream_id)
        row = fold.fold_states(self._key(self.raw, stream_id, branch), reducer, self._key(self.snapshots, stream_id, branch)).first()
        if row is None:
            raise NoEventsToSnapshot(f"{stream_id} ({branch})")
        if row["n_events"]:
            self._snapshot(row, reducer)
        return self.snapshot_info(stream_id, branch, reducer.name)

    def snapshot_info(self, stream_id: str, branch: str, reducer_name: str) -> Row | None:
        """The latest snapshot of a reducer by version, whatever its state schema."""
        return self._key(self.snapshots, stream_id, branch).where(F.col("reducer_name") == reducer_name).orderBy(F.desc("version"), F.desc("created_at")).first()

    def gc_orphaned_snapshots(self) -> int:
        """Drop snapshots of reducers that are not registered (all of them where none is); how many."""
        whole = self._table("snapshots")
        kept = fold.live_snapshots(whole, self.reducers)
        gone = whole.count() - kept.count()
        if gone:
            aside = f"{self.path}/_snapshots-{uuid.uuid4().hex}"
            kept.write.parquet(aside)
            replace_folder(self.spark, aside, f"{self.path}/snapshots")
        return gone

    def get_snapshot_state(self, stream_id: str, branch: str, reducer_name: str, state_schema_version: int) -> tuple[int, str] | None:
        rows = self._key(self.snapshots, stream_id, branch).where((F.col("reducer_name") == reducer_name) & (F.col("state_schema_version") == state_schema_version))
        row = rows.orderBy(F.desc("version")).first()
        return None if row is None else (row["version"], row["state"])

    def write_snapshot_state(self, stream_id: str, branch: str, version: int, reducer_name: str, reducer_version: int, state_schema_version: int, state: str) -> None:
        self._add("snapshots", (stream_id, branch, version, reducer_name, reducer_version, state_schema_version, state, now_us()))

    # Similarity

    def set_index(self, index: KnnIndex) -> None:
        self.index = index

    def similarity_query(self, vector, k: int, stream_pattern: str | None = None) -> DataFrame:
        if self.index is None:
            raise NotImplementedError("no similarity index is set")
        return self.index.query(vector, k, stream_pattern)

    def remove_log(self) -> None:
        """Delete every file of the log."""
        remove(self.spark, self.path)
