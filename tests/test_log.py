"""The log's API: what the reference's own tests hold it to, in words and data of this repository."""

import json

import pytest
from pyspark.sql import functions as F

from sediment.model import (
    MAIN, Append, BranchExists, BranchLifecycleError, BranchNotFound, EventNotFound, InvalidCursor, InvalidIndexedTags, NoEventsToSnapshot,
    PurgeConfirmationError, ReducerFailed, ReducerNotFound, ReducerPatternAmbiguous, Sampling, StoreNotFound, StreamNotDeclared, UpcasterChainGap,
)
from sediment.operators import fold
from sediment.operators.evolve import Upcasters
from sediment.operators.similarity import KnnIndex
from sediment.model import DimensionMismatch
from sediment.plans.aggregate import Aggregate, AggregateQuery
from sediment.sources.log import CONFIRM_PURGE, EventLog, Options
from sediment.streaming import subscribe as streaming


@pytest.fixture
def log(spark, tmp_path):
    made = EventLog(spark, f"file://{tmp_path}/log")
    made.declare_stream("s/a", "test")
    made.declare_stream("s/b", "test")
    return made


def ev(n, stream="s/a", **more):
    return Append(stream, more.pop("event_type", "T"), {"n": n}, timestamp_us=more.pop("timestamp_us", 1000 + n), **more)


def ns(df):
    return [json.loads(r["payload"])["n"] for r in df.collect()]


def test_open_and_streams(spark, tmp_path, log):
    with pytest.raises(StoreNotFound):
        EventLog(spark, f"file://{tmp_path}/none", Options(create=False))
    again = EventLog(spark, log.path, Options(create=False))
    assert [r["id"] for r in again.streams().collect()] == ["s/a", "s/b"]
    log.declare_stream("s/a", "later", "second")
    assert log.streams().first()["declared_by"] == "test"
    assert log.stream_exists("s/a") and not log.stream_exists("s/z")


def test_append_is_idempotent_and_versions_go_on(log):
    ids = log.append_batch([ev(0), ev(1), ev(0), ev(2, branch="x")])
    assert ids[0] == ids[2] and len(set(ids)) == 3
    assert log.append(ev(1)) == ids[1]
    log.append_batch([ev(3), ev(4, "s/b")])
    rows = {(r["stream_id"], r["branch"], r["version"]) for r in log.raw.where("stream_id like 's/%'").collect()}
    assert rows == {("s/a", "main", 0), ("s/a", "main", 1), ("s/a", "x", 0), ("s/a", "main", 2), ("s/b", "main", 0)}
    with pytest.raises(StreamNotDeclared):
        log.append(ev(9, "s/none"))
    with pytest.raises(InvalidIndexedTags):
        log.append(ev(9, indexed_tags=[1]))
    count = lambda n: lambda e: e.where("stream_id = 's/a' AND branch = 'main'").count() == n
    assert log.append_if(ev(7), count(99)) is None and log.append_if(ev(7), count(3)) is not None


def test_reads_budgets_and_cursors(log):
    group = bytes([7]) * 32
    ids = log.append_batch([ev(i, correlation_id=group, external_id=f"x{i}", event_type="E" if i % 2 else "O") for i in range(10)])
    assert ns(log.read_range("s/a", from_version=2, to_version=5)) == [2, 3, 4, 5]
    assert ns(log.read_range("s/a", event_type="E", limit=2)) == [1, 3]
    assert json.loads(log.read_one(ids[4])["payload"]) == {"n": 4} and log.read_one(bytes(32)) is None
    assert ns(log.read_batch([ids[5], ids[1], ids[5], bytes(32)])) == [1, 5] and log.read_batch([]).count() == 0
    assert json.loads(log.read_by_external_id("s/a", "x3")["payload"])["n"] == 3
    assert ns(log.read_by_correlation(group)) == list(range(10))
    seen, cursor = [], None
    while True:
        page = log.read_range_bounded("s/a", max_results=4, cursor=cursor)
        seen += ns(page.data)
        if page.complete:
            break
        assert page.reason == "count"
        cursor = page.cursor
    assert seen == list(range(10))
    assert log.read_range_bounded("s/a", max_results=10).complete
    none = log.read_range_bounded("s/a", max_results=0)
    assert none.reason == "count" and none.data.count() == 0
    one = log.read_range_bounded("s/a", max_bytes=1)
    assert one.reason == "bytes" and ns(one.data) == [0]
    assert log.read_range_bounded("s/a", max_results=3, max_bytes=1).reason == "bytes"
    seen, cursor = [], None
    while True:
        page = log.read_by_correlation_bounded(group, max_results=3, cursor=cursor)
        seen += [bytes(r["id"]) for r in page.data.collect()]
        if page.complete:
            break
        cursor = page.cursor
    assert seen == sorted(ids)
    with pytest.raises(InvalidCursor):
        log.read_range_bounded("s/a", max_results=1, cursor=cursor)
    assert [json.loads(r["payload"])["n"] for r in log.read_range_iter("s/a")] == list(range(10))


def test_walks(log):
    root = log.append(ev(0))
    kids = log.append_batch([ev(i, causation_id=root) for i in (1, 2, 3)])
    deep = log.append(ev(4, "s/b", causation_id=kids[0]))
    assert [(json.loads(r["payload"])["n"], r["depth"]) for r in log.walk_causation(root).collect()] == [(1, 1), (2, 1), (3, 1), (4, 2)]
    assert ns(log.walk_causation(root, max_depth=1)) == [1, 2, 3] and ns(log.walk_causation(root, max_depth=0)) == []
    assert ns(log.walk_causation(deep, "backward")) == [1, 0]
    assert ns(log.walk_causation(kids[0], "both")) == [4, 0]
    assert sorted(ns(log.walk_causation_bounded(kids[0], "both").data)) == [0, 2, 3, 4]
    page = log.walk_causation_bounded(root, max_results=3)
    assert page.reason == "count" and sorted(ns(page.data)) == [1, 2, 3]
    rest = log.walk_causation_bounded(root, max_results=3, cursor=page.cursor)
    assert rest.complete and ns(rest.data) == [4]
    with pytest.raises(InvalidCursor):
        log.walk_causation_bounded(root, "backward", cursor=page.cursor)
    assert log.walk_causation_bounded(root, max_depth=1, sampling=Sampling("breadth_first", 2)).data.count() == 2
    assert Sampling("adaptive", 7).per_level(3) == 2 and Sampling("adaptive", 1).per_level(9) == 1


def test_wide_levels_join_as_narrow_ones_do(log, monkeypatch):
    from sediment.plans import graph

    root = log.append(ev(0))
    kids = log.append_batch([ev(i, causation_id=root) for i in range(1, 6)])
    log.append_batch([ev(10 + i, causation_id=k) for i, k in enumerate(kids)])
    narrow = ns(log.walk_causation(root))
    monkeypatch.setattr(graph, "MOST_LITERALS", 3)
    assert ns(log.walk_causation(root)) == narrow == [1, 2, 3, 4, 5, 10, 11, 12, 13, 14]


class Sum(Aggregate):
    def initial(self):
        return 0

    def fold(self, state, event):
        return state + json.loads(event["payload"])["n"]


class ParallelSum(Sum):
    def merge(self, a, b):
        return a + b


def test_aggregates(log):
    log.append_batch([ev(i, "s/a" if i % 3 else "s/b", indexed_tags={"g": i % 2}) for i in range(1, 8)])
    everything = AggregateQuery("s/*")
    assert log.aggregate(everything, Sum()) == log.aggregate(everything, ParallelSum()) == 28
    assert log.aggregate(AggregateQuery("s/*", tags={"g": 1}), Sum()) == 16
    assert ns(log.aggregate(AggregateQuery("s/b"))) == [3, 6]
    assert log.aggregate(AggregateQuery("s/*", from_ts=1002, to_ts=1004), Sum()) == 9
    part = log.aggregate_bounded(everything, Sum(), max_events=3)
    assert (part.data, part.reason, part.cursor) == (6, "count", None)
    assert log.aggregate_bounded(everything, Sum(), max_events=7).complete
    assert log.aggregate(AggregateQuery(), Sum()) == 0
    rows = log.aggregate(everything, F.count(F.lit(1)).alias("n"), by=("stream_id",)).collect()
    assert {r["stream_id"]: r["n"] for r in rows} == {"s/a": 5, "s/b": 2}


def test_branches(log):
    log.append_batch([ev(0), ev(1), ev(2)])
    log.create_branch("s/a", "b1", MAIN, 1)
    log.append_batch([ev(10, branch="b1"), ev(11, branch="b1")])
    log.create_branch("s/a", "b1/c", "b1", 0, alternatives=["x"])
    log.append(ev(20, branch="b1/c"))
    assert log.resolve_chain("s/a", "b1/c") == [("main", 1), ("b1", 0), ("b1/c", None)] and log.resolve_chain("s/a", MAIN) == [("main", None)]
    assert ns(log.read_lineage("s/a", "b1/c")) == [0, 1, 10, 20] and ns(log.read_range("s/a", branch="b1")) == [10, 11]
    with pytest.raises(BranchExists):
        log.create_branch("s/a", "b1")
    log.promote_branch("s/a", "b1", "good")
    log.promote_branch("s/a", "b1")
    with pytest.raises(BranchLifecycleError):
        log.mark_branch_dead_end("s/a", "b1")
    with pytest.raises(BranchNotFound):
        log.promote_branch("s/a", "zz")
    with pytest.raises(BranchNotFound):
        log.resolve_chain("s/a", "zz")
    assert [(r["id"], r["lifecycle"]) for r in log.list_branches("s/a").collect()] == [("b1", "promoted"), ("b1/c", "ephemeral")]


class Total(fold.Reducer):
    name = "total"

    def initial_state(self):
        return {"count": 0, "items": []}

    def apply(self, state, payload):
        return {"count": state["count"] + 1, "items": [*state["items"], payload["n"]]}


class Broken(Total):
    def apply(self, state, payload):
        raise RuntimeError("boom")


def test_reducers_and_snapshots(log):
    log.register_reducer("s/*", Total())
    with pytest.raises(NoEventsToSnapshot):
        log.take_snapshot("s/a")
    log.append_batch([ev(i) for i in range(6)])
    whole = log.read_state("s/a")
    assert whole == {"count": 6, "items": list(range(6))} and log.read_state("s/a", at_version=2)["items"] == [0, 1, 2]
    info = log.take_snapshot("s/a")
    assert info["version"] == 5 and log.take_snapshot("s/a")["version"] == 5
    assert log.read_state("s/a") == whole and log.read_state("s/a", at_version=2)["count"] == 3
    log.append(ev(6))
    assert log.read_state("s/a")["items"] == list(range(7)) and log.read_state("s/a", reducer_name="total")["count"] == 7
    assert log.get_snapshot_state("s/a", MAIN, "total", 1)[0] == 5 and log.get_snapshot_state("s/a", MAIN, "total", 9) is None
    assert log.read_state("s/b") == {"count": 0, "items": []}
    with pytest.raises(ReducerNotFound):
        log.read_state("other/x")
    with pytest.raises(ReducerPatternAmbiguous):
        log.register_reducer("s/*", Total())
    log.reducers = fold.Reducers()
    assert log.gc_orphaned_snapshots() == 1 and log.snapshots.count() == 0


def test_reducer_errors_and_policies(spark, log):
    log.append_batch([ev(i) for i in range(3)])
    log.register_reducer("s/**", Broken())
    with pytest.raises(Exception, match="boom"):
        log.read_state("s/a")
    log.reducers = fold.Reducers()
    log.register_reducer("s/a", Total(), fold.SnapshotPolicy("every_n_events", 3))
    log.read_state("s/a")
    assert log.snapshot_info("s/a", MAIN, "total")["version"] == 2
    assert not fold.SnapshotPolicy("every_n_events", 3).due(2, 0, 0) and fold.SnapshotPolicy("every_n_seconds", 5).due(1, 6, 0)
    assert fold.SnapshotPolicy("state_adaptive", 100, 5).due(5, 0, 100) and not fold.SnapshotPolicy().due(9, 9, 9)
    assert ReducerFailed is not None


def test_evolution(log):
    log.append_batch([Append("s/a", "score", {"n": 1, "score": 80}, timestamp_us=1), Append("s/a", "score", {"n": 2, "raw": 40}, type_version=2, timestamp_us=2), ev(3)])
    log.register_upcaster("score", 1, 2, lambda p: {"n": p["n"], "raw": p["score"]})
    log.register_upcaster("score", 2, 3, lambda p: p | {"label": "high" if p["raw"] >= 50 else "low"})
    got = [json.loads(r["payload"]) for r in log.read_range("s/a").collect()]
    assert got == [{"n": 1, "raw": 80, "label": "high"}, {"n": 2, "raw": 40, "label": "low"}, {"n": 3}]
    assert [r["type_version"] for r in log.read_range("s/a").collect()] == [1, 2, 1]
    gap = Upcasters()
    gap.register("score", 1, 2, lambda p: p)
    gap.register("score", 3, 4, lambda p: p)
    with pytest.raises(UpcasterChainGap):
        gap.check(log.raw)
    with pytest.raises(Exception, match="UpcasterChainGap"):
        gap.apply(log.raw).select("payload").collect()


def test_transforms_come_before_ids(log):
    plain = log.append(ev(1))
    log.register_payload_transform("s/*", lambda kind, p: p | {"seen": [*p.get("seen", []), 1]})
    log.register_payload_transform("s/a", lambda kind, p: p | {"seen": [*p["seen"], 2]})
    other = log.append(ev(1))
    assert other != plain and json.loads(log.read_one(other)["payload"]) == {"n": 1, "seen": [1, 2]}


def test_purge(log):
    ids = log.append_batch([ev(i) for i in range(3)])
    with pytest.raises(PurgeConfirmationError):
        log.purge_event(ids[1], "yes", "r", "me")
    with pytest.raises(EventNotFound):
        log.purge_event(bytes(32), CONFIRM_PURGE, "r", "me")
    log.purge_event(ids[1], CONFIRM_PURGE, "asked", "me")
    assert ns(log.read_range("s/a")) == [0, 2]
    audit = log.raw.where("event_type = 'Purged'").collect()
    assert len(audit) == 1 and json.loads(audit[0]["payload"])["version"] == 1
    with pytest.raises(NotImplementedError):
        log.shred_stream("s/a", "r")


def test_cursors(log):
    assert log.get_cursor("c", "s/a") is None
    log.set_cursor("c", "s/a", 5)
    log.set_cursor("c", "s/a", 3)
    assert log.get_cursor("c", "s/a") == 3 and log.get_cursor("c", "s/b") is None


def test_similarity(spark, log):
    rows = spark.createDataFrame([(1, "e/a", [1.0, 0.0]), (2, "e/b", [0.0, 1.0]), (3, None, [1.0, 1.0])], "key long, stream_id string, embedding array<float>")
    index = KnnIndex(rows, 2)
    assert [r["key"] for r in index.query([1.0, 0.1], 2).collect()] == [1, 3]
    assert [r["key"] for r in index.query([1.0, 0.1], 5, "e/*").collect()] == [1, 2] and index.query([1, 0], 0).count() == 0
    with pytest.raises(DimensionMismatch):
        index.query([1.0], 1)
    assert [r["key"] for r in index.remove(spark.createDataFrame([(1,)], "key long")).query([1, 0], 1).collect()] == [3]
    with pytest.raises(NotImplementedError):
        log.similarity_query([1, 0], 1)
    log.set_index(index)
    index.save(f"{log.path}/knn")
    assert KnnIndex.load(spark, f"{log.path}/knn", 2, "l2").query([0, 0.9], 1).first()["key"] == 2


def test_batch_search_equals_brute_force(spark, monkeypatch):
    import numpy as np

    from sediment.operators import similarity

    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (60, 4)).astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "key long, embedding array<double>").repartition(3)
    queries = rows.where("key < 7").withColumnRenamed("key", "query")
    monkeypatch.setattr(similarity, "BLOCK", 3)
    monkeypatch.setattr(similarity, "CHUNK", 8)
    for metric, kind in similarity.METRICS.items():
        d = similarity._block_distances(x[:7], x, kind)
        want = {(q, int(i)) for q in range(7) for i in np.lexsort((np.arange(60), d[q]))[:5]}
        assert {(r["query"], r["key"]) for r in similarity.knn_batch(rows, queries, 5, metric).collect()} == want
    assert similarity.knn_batch(rows, queries.limit(0), 5).count() == 0


def test_subscription_is_live_only_and_resumes(log, tmp_path):
    log.append_batch([ev(0), ev(1)])
    got = []
    handler = lambda batch, _: got.extend(ns(batch.orderBy("version")))
    again = lambda: streaming.Subscription(log, "s/*", f"file://{tmp_path}/sub").drain(handler)
    again()
    assert got == []
    log.append_batch([ev(2), ev(0), ev(9, "s/b")])
    log.emit("Note", {})
    again()
    assert sorted(got) == [2, 9]
    log.append(ev(3))
    again()
    log.append(ev(4))
    again()
    assert sorted(got) == [2, 3, 4, 9]


def test_relay(spark, tmp_path, log):
    hub = EventLog(spark, f"file://{tmp_path}/hub")
    root = log.append(ev(0, indexed_tags={"t": 1}))
    log.append(ev(1, causation_id=root))
    log.append(ev(2, "s/b", event_type="Skip"))
    for _ in range(2):
        streaming.relay_batch(log.raw.where("stream_id like 's/%'"), hub, "src", {"T"})
    rows = hub.raw.where("stream_id like 'src/%'").orderBy("version").collect()
    assert [(r["stream_id"], json.loads(r["payload"])["n"]) for r in rows] == [("src/s/a", 0), ("src/s/a", 1)]
    assert bytes(rows[1]["causation_id"]) == bytes(rows[0]["id"]) and rows[0]["external_id"] == root.hex()
    assert json.loads(rows[0]["indexed_tags"]) == {"t": 1, "source_store": "src"}


def test_stateful_fold_goes_on_over_batches(log, tmp_path):
    rows = streaming.event_stream(log).where("stream_id like 's/%'")
    out = f"file://{tmp_path}/states"
    for batch in ([ev(0), ev(1)], [ev(2)]):
        log.append_batch(batch)
        query = streaming.stateful_fold(rows, Total()).writeStream.outputMode("update").foreachBatch(streaming.keep_batches(out))
        query.option("checkpointLocation", f"{tmp_path}/cs").trigger(availableNow=True).start().awaitTermination()
    state = streaming.latest_of(log.spark, out).collect()
    assert len(state) == 1 and json.loads(state[0]["state"]) == {"count": 3, "items": [0, 1, 2]}


def test_stateful_fold_waits_for_versions_that_come_late(spark, tmp_path):
    rows = [("s/a", "main", v, json.dumps({"n": v})) for v in range(5)]
    schema = "stream_id string, branch string, version long, payload string"
    out = f"file://{tmp_path}/states"
    for part in ([2, 4], [1, 4, 0], [3, 0]):
        spark.createDataFrame([rows[v] for v in part], schema).write.mode("append").parquet(f"{tmp_path}/in")
        query = streaming.stateful_fold(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), Total()).writeStream.outputMode("update")
        query.foreachBatch(streaming.keep_batches(out)).option("checkpointLocation", f"{tmp_path}/cs").trigger(availableNow=True).start().awaitTermination()
    assert json.loads(streaming.latest_of(spark, out).first()["state"]) == {"count": 5, "items": [0, 1, 2, 3, 4]}


def test_shared_folder_is_asked_for_off_local_masters():
    from types import SimpleNamespace as Some

    from sediment.model import NoSharedFolder
    from sediment.storage import shared_dir

    def session(master, folder):
        conf = Some(get=lambda key, default=None: folder)
        return Some(conf=conf, sparkContext=Some(master=master, applicationId="x", getConf=lambda: Some(get=lambda key, default=None: None)))

    assert shared_dir(session("local[4]", None)).endswith("sediment-x") and shared_dir(session("yarn", "hdfs:///c/")) == "hdfs:///c"
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(NoSharedFolder):
            shared_dir(session(master, None))


def test_nearest_neighbours_of_dirty_vectors(spark):
    from sediment.operators.similarity import knn_batch

    schema = "key long, stream_id string, embedding array<double>"
    rows = spark.createDataFrame([(1, "e/a", [1.0, 0.0]), (2, "e/a", None), (3, "e/a", [0.0, 1.0])], schema)
    assert [r["key"] for r in KnnIndex(rows, 2).query([1, 0], 2).collect()] == [1, 3]
    bad = rows.union(spark.createDataFrame([(4, "e/a", [1.0]), (5, "e/a", [1.0, 0.0, 0.0])], schema)).coalesce(1)
    with pytest.raises(Exception, match="DimensionMismatch"):
        KnnIndex(bad, 2).query([1, 0], 2).collect()
    with pytest.raises(Exception, match="DimensionMismatch"):
        knn_batch(bad, rows.select(F.col("key").alias("query"), "embedding"), 2).collect()


def test_folds_from_snapshots_keep_keys_together(spark):
    """Snapshots and events that are dealt by key already meet in one task, whatever sizes the parts have."""
    from pyspark.sql import Window

    from sediment.catalogue import _Tags
    from sediment.storage import stored

    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        key = F.concat(F.lit("s/"), (F.col("id") % 500).cast("string"))
        rows = spark.range(20_000).select(key.alias("stream_id"), F.when(F.col("id") % 7 == 0, "alt").otherwise("main").alias("branch"), "id", F.concat(F.lit('{"k":'), F.col("id").cast("string"), F.lit("}")).alias("payload"))
        events = rows.withColumn("version", F.row_number().over(Window.partitionBy("stream_id", "branch").orderBy("id")).cast("long") - 1)
        snaps = stored(fold.take_snapshots(events.where("version <= 2"), _Tags(), created_at=0), "snapshots")
        whole = {(r["stream_id"], r["branch"]): r["state"] for r in fold.fold_states(events, _Tags()).collect()}
        states = fold.fold_states(events, _Tags(), snaps).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert len(states) == len(whole) == 1000
    assert {(r["stream_id"], r["branch"]): r["state"] for r in states} == whole


def test_chains_of_any_number_and_depth(spark):
    """More pointers than a recursive query may return, and a chain deeper than its levels, against a walk in Python."""
    from sediment.operators.branches import chains

    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    own = [(f"s/{i}", f"b{k}", f"b{k - 1}" if k else "main", k) for i in range(30) for k in range(5)]
    own += [("deep", f"b{k}", f"b{k - 1}" if k else "main", k) for k in range(1100)] + [("root", "main", None, None), ("lost", "a", "gone", 3)]
    parents = {(s, b): (p, v) for s, b, p, v in own}
    want = set()
    for s, b, _, _ in own:
        at, last, n = b, None, 0
        while at is not None:
            want.add((s, b, n, at, last))
            (at, last), n = parents.get((s, at), (None, None)), n + 1
    schema = "stream_id string, id string, parent_id string, parent_version long"
    table = spark.createDataFrame(own, schema)
    try:
        spark.conf.set(limit, "200")
        got = chains(table).collect()
    finally:
        spark.conf.set(limit, before)
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    with pytest.raises(BranchNotFound, match="own ancestor"):
        chains(spark.createDataFrame([("s", "a", "b", 0), ("s", "b", "c", 0), ("s", "c", "b", 0)], schema)).collect()


def test_lineages_of_many_branches(spark):
    """Histories of all branches where the pointers are more than a recursive query may return."""
    from sediment.operators.branches import lineages

    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    table = spark.createDataFrame([(f"s/{i}", b, p, v) for i in range(100) for b, p, v in (("b1", "main", 0), ("b2", "b1", 2))], "stream_id string, id string, parent_id string, parent_version long")
    events = spark.createDataFrame([("s/3", b, v, k + v) for b, k in (("main", 0), ("b1", 10)) for v in range(4)], "stream_id string, branch string, version long, n long")
    try:
        spark.conf.set(limit, "200")
        got = lineages(events, table).select("leaf", "branch", "n").collect()
    finally:
        spark.conf.set(limit, before)
    assert sorted(map(tuple, got)) == [("b1", "b1", n) for n in range(10, 14)] + [("b1", "main", 0)] + [("b2", "b1", n) for n in range(10, 13)] + [("b2", "main", 0)]
