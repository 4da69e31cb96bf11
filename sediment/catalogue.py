"""Registered queries over the driver's tables, and the same queries as SQL.

``events`` becomes an event log: a stream for each event type and user, a tenth of the events on branch
``alt``, versions by time, a causation tree for each user, correlation by user and day, tags from
``props``. Every query runs over whole tables; a stream, an id or a range is part of the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.functions import glob, identity
from sediment.operators import branches, evolve, fold
from sediment.operators.similarity import CellIndex, KnnIndex, knn_batch
from sediment.plans import aggregate, graph, reads
from sediment.plans.aggregate import AggregateQuery
from sediment.session import ship

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_LOG_SQL = """
log0 AS (
  SELECT event_id AS id, 'app/' || event_type || '/' || user_id AS stream_id,
    CASE WHEN event_id % 10 = 0 THEN 'alt' ELSE 'main' END AS branch, epoch_us(ts) AS timestamp_us,
    user_id * 1000 + dayofyear(ts) AS correlation_id, event_type, 1 + event_id % 3 AS type_version,
    'ext-' || event_id AS external_id, props AS indexed_tags, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value, user_id
  FROM events),
log AS (SELECT *, row_number() OVER (PARTITION BY stream_id, branch ORDER BY timestamp_us, id) - 1 AS version FROM log0),
rk AS (SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY timestamp_us, id) AS r FROM log0),
tree AS (SELECT a.id, b.id AS causation_id FROM rk a LEFT JOIN rk b ON a.user_id = b.user_id AND b.r = a.r // 3)
"""


def query(sql: str | None = None, raw: bool = False) -> Callable[[Query], Query]:
    """Register a query with its SQL; the event log's definitions come first unless ``raw``."""

    def put(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            text = sql.strip()
            if not raw:
                recursive = text.upper().startswith("RECURSIVE ")
                if recursive:
                    text = text[len("RECURSIVE ") :]
                text = ("WITH RECURSIVE " if recursive else "WITH ") + _LOG_SQL + ("," + text[5:] if text.upper().startswith("WITH ") else text)
            SQL[fn.__name__] = text
        return fn

    return put


def event_log(spark: SparkSession, sf_dir: str, causes: bool = False) -> DataFrame:
    """The ``events`` table as an event log with integer ids; ``causes`` adds the causation tree."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    rows = e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("app/"), "event_type", F.lit("/"), F.col("user_id").cast("string")).alias("stream_id"),
        F.when(F.col("event_id") % 10 == 0, "alt").otherwise("main").alias("branch"),
        micros.alias("timestamp_us"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("correlation_id"),
        "event_type",
        (1 + F.col("event_id") % 3).cast("int").alias("type_version"),
        F.concat(F.lit("ext-"), F.col("event_id").cast("string")).alias("external_id"),
        F.col("props").alias("indexed_tags"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "value",
        "user_id",
    )
    rows = rows.withColumn("version", F.row_number().over(W.partitionBy("stream_id", "branch").orderBy("timestamp_us", "id")).cast("long") - 1)
    rows = rows.withColumn("payload", F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.lit("}")))
    if not causes:
        return rows
    ranks = rows.select("id", "user_id", F.row_number().over(W.partitionBy("user_id").orderBy("timestamp_us", "id")).alias("r"))
    parent = ranks.select("user_id", F.col("id").alias("causation_id"), F.col("r").alias("pr"))
    tree = ranks.join(parent, (ranks["user_id"] == parent["user_id"]) & (F.floor(ranks["r"] / 3) == parent["pr"]), "left").select("id", "causation_id")
    return rows.join(tree, "id")


def _first_stream(log: DataFrame) -> str:
    """The stream of the first event: what the single-stream reads look at."""
    return log.orderBy("id").select("stream_id").first()[0]


_FIRST = "(SELECT stream_id FROM log ORDER BY id LIMIT 1)"
_COLS = ["id", "stream_id", "branch", "version", "timestamp_us", "event_type"]
_LIST = ", ".join(_COLS)


@query(f"SELECT {_LIST} FROM log")
def event_log_versions(spark, d):
    return event_log(spark, d).select(*_COLS)


@query(f"SELECT {_LIST} FROM log WHERE stream_id = {_FIRST} AND branch = 'main' AND version BETWEEN 1 AND 8")
def read_range(spark, d):
    log = event_log(spark, d)
    return reads.read_range(log, _first_stream(log), from_version=1, to_version=8).select(*_COLS)


@query("SELECT id, version FROM log WHERE stream_id = 'app/click/' || (SELECT min(user_id) FROM log) AND branch = 'main' AND event_type = 'click' ORDER BY version LIMIT 3")
def read_range_type_limit(spark, d):
    log = event_log(spark, d)
    user = log.agg(F.min("user_id")).first()[0]
    return reads.read_range(log, f"app/click/{user}", limit=3, event_type="click").select("id", "version")


@query(f"SELECT {_LIST} FROM log WHERE id = 17")
def read_one(spark, d):
    return reads.read_one(event_log(spark, d), 17).select(*_COLS)


@query(f"SELECT {_LIST} FROM log WHERE id IN (3, 5, 8, 13, 21, 999999999)")
def read_batch(spark, d):
    return reads.read_batch(event_log(spark, d), [13, 5, 8, 3, 21, 5, 999_999_999]).select(*_COLS)


@query(f"SELECT {_LIST} FROM log WHERE id % 20 = 0")
def read_batch_frame(spark, d):
    """A read by a table of ids: a semi join."""
    log = event_log(spark, d)
    ids = spark.read.parquet(f"{d}/events.parquet").where("event_id % 20 = 0").select(F.col("event_id").alias("id"))
    return reads.read_batch(log, ids).select(*_COLS)


@query(f"SELECT {_LIST} FROM log WHERE external_id = 'ext-0' AND stream_id = {_FIRST} ORDER BY branch, version LIMIT 1")
def read_external(spark, d):
    log = event_log(spark, d)
    return reads.read_by_external_id(log, _first_stream(log), "ext-0").select(*_COLS)


_CORR = "(SELECT correlation_id FROM log ORDER BY id LIMIT 1)"


def _first_correlation(log: DataFrame) -> int:
    return log.orderBy("id").select("correlation_id").first()[0]


@query(f"SELECT {_LIST} FROM log WHERE correlation_id = {_CORR}")
def by_correlation(spark, d):
    log = event_log(spark, d)
    return reads.read_by_correlation(log, _first_correlation(log)).select(*_COLS)


@query(f"SELECT {_LIST} FROM log WHERE correlation_id = {_CORR} ORDER BY id LIMIT 2")
def by_correlation_bounded(spark, d):
    log = event_log(spark, d)
    return reads.read_by_correlation_bounded(log, _first_correlation(log), max_results=2).data.select(*_COLS)


@query(f"SELECT {_LIST} FROM log WHERE stream_id = {_FIRST} AND branch = 'main' AND version < 4")
def range_bounded_rows(spark, d):
    log = event_log(spark, d)
    return reads.bounded_rows(log, _first_stream(log), 4, None).select(*_COLS)


@query(f"""WITH s AS (SELECT *, sum(length('{{"k":' || k || '}}')) OVER (ORDER BY version) AS b FROM log WHERE stream_id = {_FIRST} AND branch = 'main')
SELECT {_LIST} FROM s WHERE b <= 40 OR version = 0""")
def range_bounded_bytes(spark, d):
    log = event_log(spark, d)
    return reads.bounded_rows(log, _first_stream(log), None, 40).select(*_COLS)


@query(f"SELECT {_LIST} FROM log WHERE stream_id = {_FIRST} AND branch = 'main' AND version BETWEEN 4 AND 7")
def range_bounded_page2(spark, d):
    """The second page, by the cursor of the first."""
    log = event_log(spark, d)
    stream = _first_stream(log)
    page = reads.read_range_bounded(log, stream, max_results=4)
    if page.complete:
        return log.limit(0).select(*_COLS)
    return reads.read_range_bounded(log, stream, max_results=4, cursor=page.cursor).data.select(*_COLS)


_WALK = "t AS (SELECT tree.id, causation_id, timestamp_us FROM tree JOIN log USING (id)), start AS (SELECT id FROM t ORDER BY timestamp_us LIMIT 1 OFFSET 5)"


def _start(log: DataFrame) -> int:
    return log.orderBy("timestamp_us").select("id").limit(6).collect()[-1][0]


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """The log with causes, cut from its windows once, as walks read it level by level."""
    from sediment.storage import stored

    return stored(event_log(spark, d, causes=True), "tree")


@query(f"RECURSIVE WITH {_WALK}, w AS (SELECT id, 0 AS depth FROM start UNION ALL SELECT t.id, w.depth + 1 FROM w JOIN t ON t.causation_id = w.id) SELECT id, depth FROM w WHERE depth > 0")
def walk_forward(spark, d):
    log = _tree(spark, d)
    return graph.walk_causation(log, _start(log), graph.FORWARD).select("id", "depth")


_DEEP = "deep AS (SELECT id FROM t ORDER BY timestamp_us DESC LIMIT 1)"


def _deep(log: DataFrame) -> int:
    return log.orderBy(F.desc("timestamp_us")).select("id").first()[0]


@query(f"RECURSIVE WITH {_WALK}, {_DEEP}, w AS (SELECT t.id, t.causation_id, 0 AS depth FROM t JOIN deep USING (id) UNION ALL SELECT t.id, t.causation_id, w.depth + 1 FROM w JOIN t ON t.id = w.causation_id) SELECT id, depth FROM w WHERE depth > 0")
def walk_backward(spark, d):
    log = _tree(spark, d)
    return graph.walk_causation(log, _deep(log), graph.BACKWARD).select("id", "depth")


_MID = "mid AS (SELECT t.id FROM t WHERE causation_id IN (SELECT id FROM start) ORDER BY id LIMIT 1)"


def _mid(log: DataFrame) -> int:
    return log.where(F.col("causation_id") == _start(log)).agg(F.min("id")).first()[0]


@query(f"""RECURSIVE WITH {_WALK}, {_MID},
f AS (SELECT id, 0 AS depth FROM mid UNION ALL SELECT t.id, f.depth + 1 FROM f JOIN t ON t.causation_id = f.id),
b AS (SELECT t.id, t.causation_id, 0 AS depth FROM t JOIN mid USING (id) UNION ALL SELECT t.id, t.causation_id, b.depth + 1 FROM b JOIN t ON t.id = b.causation_id)
SELECT id, depth FROM f WHERE depth > 0 UNION ALL SELECT id, depth FROM b WHERE depth > 0""")
def walk_both(spark, d):
    log = _tree(spark, d)
    return graph.walk_causation(log, _mid(log), graph.BOTH).select("id", "depth")


_EDGES = "e AS (SELECT id AS a, causation_id AS b FROM t WHERE causation_id IS NOT NULL UNION ALL SELECT causation_id, id FROM t WHERE causation_id IS NOT NULL)"


@query(f"""WITH {_WALK}, {_MID}, {_EDGES},
l1 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM mid)),
l2 AS (SELECT DISTINCT b AS id FROM e WHERE a IN (SELECT id FROM l1) AND b NOT IN (SELECT id FROM l1) AND b NOT IN (SELECT id FROM mid))
SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2""")
def walk_both_bounded(spark, d):
    """Children and cause of every node: reaches siblings."""
    log = _tree(spark, d)
    return graph.sampled_levels(log, _mid(log), graph.BOTH, 2, graph.Sampling())


@query(f"""WITH {_WALK},
l1 AS (SELECT id FROM t WHERE causation_id IN (SELECT id FROM start) ORDER BY id LIMIT 2),
l2 AS (SELECT id FROM t WHERE causation_id IN (SELECT id FROM l1) ORDER BY id LIMIT 2)
SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2""")
def walk_sampled_bfs(spark, d):
    log = _tree(spark, d)
    return graph.sampled_levels(log, _start(log), graph.FORWARD, 2, graph.Sampling("breadth_first", 2))


@query(f"""WITH {_WALK},
l1 AS (SELECT id FROM t WHERE causation_id IN (SELECT id FROM start) ORDER BY id LIMIT 3),
l2 AS (SELECT id FROM t WHERE causation_id IN (SELECT id FROM l1) ORDER BY id LIMIT 3)
SELECT id, 1 AS depth FROM l1 UNION ALL SELECT id, 2 FROM l2""")
def walk_adaptive(spark, d):
    log = _tree(spark, d)
    return graph.sampled_levels(log, _start(log), graph.FORWARD, 2, graph.Sampling("adaptive", 7))


@query("""RECURSIVE WITH w AS (SELECT id, id AS root, 0 AS depth FROM tree WHERE causation_id IS NULL
UNION ALL SELECT tree.id, w.root, w.depth + 1 FROM w JOIN tree ON tree.causation_id = w.id)
SELECT id, root, CAST(depth AS BIGINT) AS depth FROM w""")
def causation_roots(spark, d):
    """Root and depth of every event by pointer doubling."""
    return graph.roots(_tree(spark, d))


_SUMS = "count(*) AS n, round(sum(value), 4) AS total"


def _aggs() -> tuple:
    return F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")




@query(f"SELECT event_type, {_SUMS} FROM log WHERE branch = 'main' GROUP BY event_type")
def agg_by_type(spark, d):
    return aggregate.aggregate(event_log(spark, d), AggregateQuery("app/*/*"), *_aggs(), by=("event_type",))


@query(f"SELECT stream_id, {_SUMS} FROM log WHERE branch = 'main' GROUP BY stream_id")
def agg_by_stream(spark, d):
    return aggregate.aggregate(event_log(spark, d), AggregateQuery("**"), *_aggs(), by=("stream_id",))


@query(f"SELECT event_type, {_SUMS} FROM log WHERE branch = 'main' AND k = 7 GROUP BY event_type")
def agg_tag_eq(spark, d):
    return aggregate.aggregate(event_log(spark, d), AggregateQuery("app/*/*", tags={"k": 7}), *_aggs(), by=("event_type",))


@query(f"SELECT event_type, {_SUMS} FROM log WHERE branch = 'main' AND json_extract(indexed_tags, '$.missing') IS NULL GROUP BY event_type")
def agg_tag_null(spark, d):
    return aggregate.aggregate(event_log(spark, d), AggregateQuery("**", tags={"missing": None}), *_aggs(), by=("event_type",))


_T0, _T1 = 1_704_200_000_000_000, 1_705_300_000_000_000


@query(f"SELECT event_type, {_SUMS} FROM log WHERE branch = 'alt' AND timestamp_us BETWEEN {_T0} AND {_T1} GROUP BY event_type")
def agg_time_range(spark, d):
    return aggregate.aggregate(event_log(spark, d), AggregateQuery("app/**", branch="alt", from_ts=_T0, to_ts=_T1), *_aggs(), by=("event_type",))


@query(f"SELECT {_LIST} FROM log WHERE branch = 'main' AND event_type = 'purchase'")
def agg_collect_all(spark, d):
    return aggregate.collect_all(event_log(spark, d), AggregateQuery("app/purchase/*", event_type="purchase")).select(*_COLS)


@query(f"SELECT {_SUMS} FROM (SELECT * FROM log WHERE branch = 'main' ORDER BY timestamp_us, stream_id, branch, version LIMIT 500)")
def agg_bounded(spark, d):
    """The fold stops after its row budget."""
    return aggregate.bounded(event_log(spark, d), AggregateQuery("**"), 500, None).agg(*_aggs())


@query(f"""WITH s AS (SELECT *, sum(length('{{"k":' || k || '}}')) OVER (ORDER BY timestamp_us, stream_id, branch, version) AS b FROM log WHERE branch = 'main')
SELECT {_SUMS} FROM s WHERE b <= 3000""")
def agg_bounded_bytes(spark, d):
    return aggregate.bounded(event_log(spark, d), AggregateQuery("**"), None, 3000).agg(*_aggs())


def _globbed(pattern: str) -> Query:
    def run(spark, d):
        return event_log(spark, d).where(glob.matching(F.col("stream_id"), pattern)).groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))

    return run


for _name, _pattern in {"glob_single": "app/click/*", "glob_double": "app/**", "glob_mid": "*/view/*", "glob_double_mid": "**/error/**", "glob_literal": "app/view/1"}.items():
    _fn = _globbed(_pattern)
    _fn.__name__ = _name
    query(f"SELECT stream_id, count(*) AS n FROM log WHERE regexp_matches('/' || stream_id, '{glob.to_regex(_pattern)}') GROUP BY stream_id")(_fn)

_PATTERNS = ("app/**", "app/click/*", "*/click/*", "**")


@query("""SELECT DISTINCT stream_id, CASE WHEN stream_id LIKE 'app/click/%' THEN 'app/click/*' ELSE 'app/**' END AS pattern FROM log""")
def glob_specificity(spark, d):
    """The most specific of several patterns for each stream."""
    streams = event_log(spark, d).select("stream_id").distinct()
    best = F.lit(None).cast("string")
    for p in sorted(_PATTERNS, key=glob.specificity):
        best = F.when(glob.matching(F.col("stream_id"), p), F.lit(p)).otherwise(best)
    return streams.withColumn("pattern", best)


def _branch_table(spark: SparkSession, d: str) -> DataFrame:
    """For every stream a branch ``alt`` off main at version 2 and ``alt/b`` off that at version 0."""
    streams = event_log(spark, d).select("stream_id").distinct()
    return streams.select("stream_id", F.explode(F.array(*[F.struct(F.lit(b).alias("id"), F.lit(p).alias("parent_id"), F.lit(v).cast("long").alias("parent_version")) for b, p, v in (("alt", "main", 2), ("alt/b", "alt", 0))])).alias("b")).select("stream_id", "b.*")


@query("""WITH s AS (SELECT DISTINCT stream_id FROM log)
SELECT stream_id, 'alt' AS branch, 0 AS segment, 'alt' AS source, NULL AS to_version FROM s
UNION ALL SELECT stream_id, 'alt', 1, 'main', 2 FROM s UNION ALL SELECT stream_id, 'alt/b', 0, 'alt/b', NULL FROM s
UNION ALL SELECT stream_id, 'alt/b', 1, 'alt', 0 FROM s UNION ALL SELECT stream_id, 'alt/b', 2, 'main', 2 FROM s""")
def branch_chain(spark, d):
    return branches.chains(_branch_table(spark, d))


@query("""SELECT 'alt' AS leaf, stream_id, branch, version, id FROM log WHERE branch = 'alt' OR (branch = 'main' AND version <= 2)
UNION ALL SELECT 'alt/b', stream_id, branch, version, id FROM log WHERE (branch = 'alt' AND version <= 0) OR (branch = 'main' AND version <= 2)""")
def lineage_read(spark, d):
    """Stitched histories of every branch of every stream."""
    return branches.lineages(event_log(spark, d), _branch_table(spark, d)).select("leaf", "stream_id", "branch", "version", "id")


@query("SELECT stream_id, branch, max(version) AS version, count(*) AS n, round(sum(value), 4) AS total FROM log GROUP BY stream_id, branch")
def state_sum(spark, d):
    return fold.algebraic(event_log(spark, d), *_aggs())


@query("SELECT stream_id, branch, max(version) AS version, count(*) AS n, round(sum(value), 4) AS total FROM log WHERE version <= 3 GROUP BY stream_id, branch")
def state_at_version(spark, d):
    return fold.algebraic(event_log(spark, d), *_aggs(), at_version=3)


@query("SELECT stream_id, branch, version, round(sum(value) OVER (PARTITION BY stream_id, branch ORDER BY version), 4) AS total FROM log")
def state_running(spark, d):
    """The state at every version."""
    w = W.partitionBy("stream_id", "branch").orderBy("version").rowsBetween(W.unboundedPreceding, 0)
    return event_log(spark, d).select("stream_id", "branch", "version", F.round(F.sum("value").over(w), 4).alias("total"))


@query("SELECT stream_id, branch, string_agg(CAST(k AS VARCHAR), ',' ORDER BY version) AS items FROM log GROUP BY stream_id, branch")
def state_cat(spark, d):
    """An order-dependent state, without Python."""
    rows = event_log(spark, d).groupBy("stream_id", "branch").agg(F.sort_array(F.collect_list(F.struct("version", "k"))).alias("s"))
    return rows.select("stream_id", "branch", F.concat_ws(",", F.transform("s", lambda x: x["k"].cast("string"))).alias("items"))


class _Tags(fold.Reducer):
    """Count, sum and last of ``k``: opaque Python, for the general path."""

    name = "tags"

    def initial_state(self):
        return [0, 0, None]

    def apply(self, state, payload):
        return [state[0] + 1, state[1] + payload["k"], payload["k"]]


_TAGS_SQL = "SELECT stream_id, branch, max(version) AS version, '[' || count(*) || ', ' || sum(k) || ', ' || max_by(k, version) || ']' AS state FROM log GROUP BY stream_id, branch"


@query(_TAGS_SQL)
def state_python_reducer(spark, d):
    return fold.fold_states(event_log(spark, d), _Tags()).select("stream_id", "branch", "version", "state")


@query(_TAGS_SQL)
def state_with_snapshot(spark, d):
    """Folding on from snapshots of version 2 gives the states of a whole replay."""
    from sediment.storage import stored

    log = event_log(spark, d)
    snaps = stored(fold.take_snapshots(log.where("version <= 2"), _Tags(), created_at=0), "snapshots")
    return fold.fold_states(log, _Tags(), snaps).select("stream_id", "branch", "version", "state")


@query("SELECT stream_id, branch, max(version) AS version, round(sum(value), 4) AS total FROM log GROUP BY stream_id, branch")
def state_sum_with_snapshot(spark, d):
    log = event_log(spark, d)
    snaps = log.where("version <= 2").groupBy("stream_id", "branch").agg(F.max("version").alias("version"), F.sum("value").alias("state"))
    return fold.algebraic_with_snapshots(log, snaps, F.col("value"), "total").withColumn("total", F.round("total", 4))


def _snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Every third version of every stream, under two reducers and two state schemas."""
    log = event_log(spark, d).where("version % 3 = 0")
    cols = [F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("reducer_name"), F.lit(1).alias("reducer_version"), (1 + F.col("version") % 2).cast("int").alias("state_schema_version")]
    return log.select("stream_id", "branch", "version", *cols, F.col("k").cast("string").alias("state"), F.col("timestamp_us").alias("created_at"))


_SNAPS = "s AS (SELECT stream_id, branch, version, CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS reducer_name, 1 + version % 2 AS state_schema_version, CAST(k AS VARCHAR) AS state FROM log WHERE version % 3 = 0)"


@query(f"WITH {_SNAPS} SELECT stream_id, branch, max(version) AS version, max_by(state, version) AS state FROM s WHERE reducer_name = 'a' AND state_schema_version = 1 AND version <= 9 GROUP BY stream_id, branch")
def snapshot_latest(spark, d):
    class A(fold.Reducer):
        name = "a"

    return fold.latest_snapshots(_snapshots(spark, d), A(), max_version=9)


@query(f"WITH {_SNAPS} SELECT stream_id, branch, version, reducer_name FROM s WHERE reducer_name = 'b' AND state_schema_version = 1")
def snapshot_gc(spark, d):
    class B(fold.Reducer):
        name = "b"

    known = fold.Reducers()
    known.register("**", B())
    return fold.live_snapshots(_snapshots(spark, d), known).select("stream_id", "branch", "version", "reducer_name")


@query("SELECT id, type_version, CASE type_version WHEN 1 THEN k + 111 WHEN 2 THEN k + 110 ELSE k END AS score FROM log")
def upcast_v1_v3(spark, d):
    """Two native steps, from 1 to 2 and from 2 to 3."""
    known = evolve.Upcasters()

    def plus(n: int) -> Callable:
        return lambda p: F.concat(F.lit('{"k":'), (F.get_json_object(p, "$.k").cast("long") + n).cast("string"), F.lit("}"))

    for kind in ("click", "view", "error", "signup", "purchase"):
        known.register(kind, 1, 2, plus(1), native=True)
        known.register(kind, 2, 3, plus(110), native=True)
    return known.apply(event_log(spark, d)).select("id", "type_version", F.get_json_object("payload", "$.k").cast("long").alias("score"))


@query("SELECT id, CASE WHEN event_type = 'click' AND type_version = 1 THEN k * 2 ELSE k END AS score FROM log")
def upcast_python(spark, d):
    known = evolve.Upcasters()
    known.register("click", 1, 2, lambda p: {"k": p["k"] * 2})
    return known.apply(event_log(spark, d)).select("id", F.get_json_object("payload", "$.k").cast("long").alias("score"))


@query("""SELECT id, CASE WHEN event_type = 'purchase' THEN '{"k":null}' ELSE '{"k":' || k || '}' END AS payload FROM log""")
def transform_redact(spark, d):
    rules = evolve.Transforms()
    rules.register("app/purchase/*", lambda kind, payload: F.lit('{"k":null}'), native=True)
    return rules.apply(event_log(spark, d)).select("id", "payload")



@query("""WITH f AS (SELECT event_type, type_version, k, min(id) AS id FROM log GROUP BY event_type, type_version, k)
SELECT external_id, stream_id, branch, row_number() OVER (PARTITION BY stream_id, branch ORDER BY log.id) - 1 AS version FROM log JOIN f ON log.id = f.id""")
def log_append(spark, d):
    """All events appended to a real log, twice: content ids make them one, and the second time adds nothing."""
    rows = event_log(spark, d)
    log = _new_log(spark, rows)
    none = F.lit(None).cast("binary")
    incoming = rows.select(F.col("id").alias("ordinal"), "stream_id", "branch", "timestamp_us", none.alias("causation_id"), none.alias("correlation_id"), "event_type", "type_version", "payload", "external_id", "indexed_tags")
    for _ in range(2):
        log.append_frame(incoming)
    return log.raw.where(~glob.is_system(F.col("stream_id"))).select("external_id", "stream_id", "branch", "version")


@query("""SELECT id, sha256(length(event_type) || ':' || event_type || '|' || length(CAST(type_version AS VARCHAR)) || ':' || type_version || '|0:|' || length('{"k":' || k || '}') || ':' || '{"k":' || k || '}') AS sha FROM log""")
def identity_sha256(spark, d):
    log = event_log(spark, d)
    return log.select("id", identity.sha_ids(F.col("event_type"), F.col("type_version"), F.lit(None).cast("string"), F.col("payload")).alias("sha"))


@query()
def identity_blake3(spark, d):
    """Content ids of all events; tests hold the hash against published vectors."""
    log = event_log(spark, d)
    return log.select("id", F.lower(F.hex(identity.event_ids(F.col("event_type"), F.col("type_version"), F.lit(None).cast("binary"), F.col("payload")))).alias("event_id"))


@query("SELECT id, CASE WHEN event_type = 'click' THEN stream_id ELSE 'app/click/' || stream_id END AS hub_stream, external_id FROM log WHERE event_type IN ('click', 'view')")
def relay_rename(spark, d):
    log = event_log(spark, d).where(F.col("event_type").isin("click", "view"))
    return log.select("id", glob.hub_name(F.col("stream_id"), "app/click").alias("hub_stream"), "external_id")



def _knn(metric: str, pattern: str | None = None) -> Query:
    def run(spark, d):
        rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.concat(F.lit("emb/"), F.col("label").cast("string")).alias("stream_id"), "embedding")
        q = [float(x) for x in rows.orderBy("key").select("embedding").first()[0]]
        return KnnIndex(rows, len(q), metric).query(q, 10, pattern).select("key", (F.round("score", 6) + 0.0).alias("score"))

    return run


_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1), x AS (SELECT vec_id AS key, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_KNN = {
    "knn_cosine": ("cosine", None, "1 - list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v)))"),
    "knn_l2": ("l2", None, "list_distance(e, v)"),
    "knn_ip": ("dot", None, "1 - list_dot_product(e, v)"),
    "knn_filtered": ("cosine", "emb/1", "1 - list_dot_product(e, v) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(v, v)))"),
}
for _name, (_metric, _pattern, _expr) in _KNN.items():
    _fn = _knn(_metric, _pattern)
    _fn.__name__ = _name
    _where = "WHERE label = 1 " if _pattern else ""
    query(f"WITH {_Q} SELECT key, round(score, 6) + 0 AS score FROM (SELECT key, {_expr} AS score FROM x, q {_where}) ORDER BY score, key LIMIT 10", raw=True)(_fn)


def _knn_batch(metric: str) -> Query:
    def run(spark, d):
        rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), "embedding")
        wanted = rows.where("key % 20 = 0").select(F.col("key").alias("query"), "embedding")
        return knn_batch(rows, wanted, 10, metric).withColumn("score", F.round("score", 6) + 0.0)

    return run


for _name, _like in {"knn_batch_cosine": "knn_cosine", "knn_batch_l2": "knn_l2", "knn_batch_ip": "knn_ip"}.items():
    _metric, _, _expr = _KNN[_like]
    _fn = _knn_batch(_metric)
    _fn.__name__ = _name
    query(
        f"""WITH x AS (SELECT vec_id AS key, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT key AS query, e AS v FROM x WHERE key % 20 = 0),
s AS (SELECT query, key, round({_expr}, 9) AS score FROM q, x)
SELECT query, key, round(score, 6) + 0 AS score FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY score, key) <= 10""",
        raw=True,
    )(_fn)


def _drained(rows: DataFrame, mode: str) -> DataFrame:
    """Run a stream to the end of its source and read back what its batches wrote."""
    import uuid

    from sediment.storage import ending, shared_dir
    from sediment.streaming.subscribe import keep_batches

    spark = rows.sparkSession
    home = ending(spark, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}")
    run = rows.writeStream.outputMode(mode).foreachBatch(keep_batches(f"{home}/out")).option("checkpointLocation", f"{home}/check").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{home}/out")


@query("SELECT id, stream_id FROM log WHERE branch = 'main' AND event_type = 'click'")
def stream_subscribe(spark, d):
    """What a subscription delivers, over a file stream."""
    from sediment.storage import is_folder
    from sediment.streaming.subscribe import delivered

    source = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema)
    # A file source watches a folder: the table itself, or the folder of a table that is one file.
    e = source.parquet(f"{d}/events.parquet") if is_folder(spark, f"{d}/events.parquet") else source.option("pathGlobFilter", "events.parquet").parquet(d)
    stream = F.concat(F.lit("app/"), "event_type", F.lit("/"), F.col("user_id").cast("string"))
    log = e.select(F.col("event_id").alias("id"), stream.alias("stream_id"), F.when(F.col("event_id") % 10 == 0, "alt").otherwise("main").alias("branch"))
    return _drained(delivered(log, "app/click/*").select("id", "stream_id"), "append").select("id", "stream_id")


@query(_TAGS_SQL)
def stream_stateful_fold(spark, d):
    """A reducer kept up by a stream of two batches, odd versions before even ones: states wait for what is late."""
    import uuid

    from sediment.storage import ending, shared_dir
    from sediment.streaming.subscribe import stateful_fold

    rows = event_log(spark, d).select("stream_id", "branch", "version", "payload")
    path = ending(spark, f"{shared_dir(spark)}/late-{uuid.uuid4().hex}")
    for part in (1, 0):
        rows.where(f"version % 2 = {part}").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = _drained(stateful_fold(source, _Tags()), "update")
    return out.groupBy("stream_id", "branch").agg(F.max_by(F.struct("version", "state"), "batch").alias("s")).select("stream_id", "branch", "s.version", "s.state")


@query("""WITH s AS (SELECT user_id, timestamp_us, CASE WHEN timestamp_us - lag(timestamp_us) OVER (PARTITION BY user_id ORDER BY timestamp_us) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM log),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY timestamp_us) AS session FROM s)
SELECT user_id, min(timestamp_us) AS first_us, count(*) AS n FROM g GROUP BY user_id, session""")
def ext_session_window(spark, d):
    """Sessions by a gap of an hour."""
    rows = event_log(spark, d).withColumn("at", F.timestamp_micros("timestamp_us"))
    found = rows.groupBy("user_id", F.session_window("at", "1 hour")).agg(F.min("timestamp_us").alias("first_us"), F.count(F.lit(1)).alias("n"))
    return found.select("user_id", "first_us", "n")


@query("SELECT event_type, (timestamp_us // 21600000000) * 21600000000 AS start_us, count(*) AS n FROM log GROUP BY 1, 2")
def ext_tumbling(spark, d):
    rows = event_log(spark, d).withColumn("at", F.timestamp_micros("timestamp_us"))
    found = rows.groupBy("event_type", F.window("at", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return found.select("event_type", F.unix_micros("window.start").alias("start_us"), "n")


# The log's own API, on logs made of the events table.

_FILLED: dict[tuple[str, str], str] = {}


def _new_log(spark: SparkSession, rows: DataFrame | None = None):
    """A log of its own, gone when the application ends; with ``rows`` their streams are declared."""
    import uuid

    from sediment.sources.log import EventLog
    from sediment.storage import ending, shared_dir

    log = EventLog(spark, ending(spark, f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"))
    if rows is not None:
        log.declare_frame(rows, "catalogue")
    return log


def _incoming(rows: DataFrame) -> DataFrame:
    """The events table as what ``append_frame`` takes; payloads name the event, so that none are equal."""
    payload = F.concat(F.lit('{"e":'), F.col("id").cast("string"), F.lit(',"k":'), F.col("k").cast("string"), F.lit("}"))
    group = F.unhex(F.sha2(F.col("correlation_id").cast("string"), 256))
    return rows.select(F.col("id").alias("ordinal"), "stream_id", "branch", "timestamp_us", F.lit(None).cast("binary").alias("causation_id"), group.alias("correlation_id"), "event_type", "type_version", payload.alias("payload"), "external_id", "indexed_tags")


def _filled(spark: SparkSession, d: str, own: bool = False):
    """A log of all events, in order of id. One is kept for all queries that only read; ``own`` makes another."""
    from sediment.sources.log import EventLog

    key = (spark.sparkContext.applicationId, d)
    if not own and key in _FILLED:
        return EventLog(spark, _FILLED[key])
    rows = event_log(spark, d)
    log = _new_log(spark, rows)
    log.append_frame(_incoming(rows))
    if not own:
        _FILLED[key] = log.path
    return log


def _made(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


#: The filled log in SQL: versions go by order of id.
_STORE = "st AS (SELECT *, row_number() OVER (PARTITION BY stream_id, branch ORDER BY id) - 1 AS v FROM log)"


def _event() -> Column:
    """The number of the event that a payload names."""
    return F.get_json_object("payload", "$.e").cast("long")


def _ours() -> Column:
    """Not the engine's own streams."""
    return ~glob.is_system(F.col("stream_id"))


@query(f"WITH {_STORE} SELECT external_id, stream_id, branch, v AS version FROM st WHERE id <> 42")
def purge_read(spark, d):
    """What is left after one event is purged: its audit record is a system event."""
    from sediment.sources.log import CONFIRM_PURGE

    log = _filled(spark, d, own=True)
    target = log.raw.where("external_id = 'ext-42'").first()
    if target is not None:
        log.purge_event(bytes(target["id"]), CONFIRM_PURGE, "asked", "catalogue")
    return log.raw.where(_ours()).select("external_id", "stream_id", "branch", "version")


@query("SELECT id, id IN (SELECT min(id) FROM log GROUP BY event_type, type_version, k) AS is_new FROM log")
def append_dedup(spark, d):
    """Which events of a batch are written: of those of equal content the first."""
    rows = event_log(spark, d)
    out = _new_log(spark, rows).append_frame(_incoming(rows).withColumn("payload", F.regexp_replace("payload", r'"e":\d+,', "")))
    return out.select(F.col("ordinal").alias("id"), "is_new")


@query("SELECT event_type AS consumer_id, count(*) - 1 AS version, NULL AS none FROM log GROUP BY event_type")
def consumer_cursors(spark, d):
    """The last cursor set by each consumer counts; it may have gone back."""
    log = _new_log(spark)
    counts = event_log(spark, d).groupBy("event_type").count().collect()
    for r in counts:
        log.set_cursor(r["event_type"], "app/x", r["count"])
        log.set_cursor(r["event_type"], "app/x", r["count"] - 1)
    return _made(spark, "consumer_id string, version long, none long", *[(r["event_type"], log.get_cursor(r["event_type"], "app/x"), log.get_cursor(r["event_type"], "app/y")) for r in counts])


@query("SELECT DISTINCT stream_id AS id, 'first' AS declared_by, TRUE AS known FROM log")
def stream_registry(spark, d):
    """Declared streams, the engine's own left out; the first declaration counts."""
    log = _new_log(spark)
    rows = event_log(spark, d)
    log.declare_frame(rows, "first")
    one = rows.agg(F.min("stream_id")).first()[0]
    log.declare_stream(one, "second")
    known = log.stream_exists(one) and not log.stream_exists("app/none")
    return log.streams().select("id", "declared_by", F.lit(known).alias("known"))


@query("SELECT * FROM (VALUES ('a', 'main', 2, 'promoted', 'good'), ('b', 'a', 0, 'dead_end', 'bad'), ('c', 'main', 1, 'ephemeral', NULL)) AS t(id, parent_id, parent_version, lifecycle, closed_reason)", raw=True)
def branch_lifecycle(spark, d):
    """Branches made, promoted and ended; a second end of another kind is refused."""
    from sediment.model import BranchExists, BranchLifecycleError

    log, stream = _new_log(spark), "app/x"
    for name, parent, at in (("a", "main", 2), ("b", "a", 0), ("c", "main", 1)):
        log.create_branch(stream, name, parent, at)
    log.promote_branch(stream, "a", "good")
    log.mark_branch_dead_end(stream, "b", "bad")
    for call, error in ((lambda: log.promote_branch(stream, "b"), BranchLifecycleError), (lambda: log.create_branch(stream, "a"), BranchExists)):
        try:
            call()
        except error:
            continue
        raise AssertionError(error)
    return log.list_branches(stream).select("id", "parent_id", "parent_version", "lifecycle", "closed_reason")


class _Counted(fold.Reducer):
    """Count and sum of ``k``."""

    name = "counted"

    def initial_state(self):
        return [0, 0]

    def apply(self, state, payload):
        return [state[0] + 1, state[1] + payload["k"]]


@query(f"""WITH {_STORE}, s AS (SELECT * FROM st WHERE stream_id = {_FIRST} AND branch = 'main'), j AS (SELECT '[' || count(*) || ', ' || sum(k) || ']' AS state, max(v) AS v FROM s)
SELECT 'state' AS what, state AS value FROM j UNION ALL SELECT 'state named', state FROM j UNION ALL SELECT 'state after snapshot', state FROM j
UNION ALL SELECT 'state at 1', '[' || count(*) || ', ' || sum(k) || ']' FROM s WHERE v <= 1
UNION ALL SELECT 'snapshot version', CAST(v AS VARCHAR) FROM j UNION ALL SELECT 'snapshot again', CAST(v AS VARCHAR) FROM j UNION ALL SELECT 'snapshot kept', v || ' ' || state FROM j
UNION ALL SELECT 'other schema', 'None' UNION ALL SELECT 'written', '7 [1, 2]' UNION ALL SELECT 'dropped', '2' UNION ALL SELECT 'left', '0'""")
def state_api(spark, d):
    """A registered reducer: state, state at a version, snapshots taken, looked up, written and dropped."""
    log = _filled(spark, d, own=True)
    stream = _first_stream(event_log(spark, d))
    log.register_reducer("app/**", _Counted())
    text = str
    out = [("state", text(log.read_state(stream))), ("state named", text(log.read_state(stream, reducer_name="counted"))), ("state at 1", text(log.read_state(stream, at_version=1)))]
    out += [("snapshot version", text(log.take_snapshot(stream)["version"])), ("snapshot again", text(log.take_snapshot(stream)["version"])), ("state after snapshot", text(log.read_state(stream)))]
    kept = log.get_snapshot_state(stream, "main", "counted", 1)
    out += [("snapshot kept", f"{kept[0]} {kept[1]}"), ("other schema", text(log.get_snapshot_state(stream, "main", "counted", 9)))]
    log.write_snapshot_state("app/w", "main", 7, "counted", 1, 1, "[1, 2]")
    info = log.snapshot_info("app/w", "main", "counted")
    out.append(("written", f"{info['version']} {info['state']}"))
    log.reducers = fold.Reducers()
    out += [("dropped", text(log.gc_orphaned_snapshots())), ("left", text(log.snapshots.count()))]
    return _made(spark, "what string, value string", *out)


class _Ordered(aggregate.Aggregate):
    """Number of events, sum of ``k`` and the last event, in fold order."""

    def initial(self):
        return [0, 0, None]

    def fold(self, state, event):
        import json

        payload = json.loads(event["payload"])
        return [state[0] + 1, state[1] + payload["k"], payload["e"]]

    def finalize(self, state):
        return tuple(state)


class _Merged(_Ordered):
    def merge(self, a, b):
        return [a[0] + b[0], a[1] + b[1], a[2] if b[2] is None else b[2]]


_FOLD_ORDER = "timestamp_us, stream_id, branch, v"


@query(f"""WITH {_STORE}, s AS (SELECT * FROM st WHERE branch = 'main'), w AS (SELECT count(*) AS n, sum(k) AS total, max_by(id, timestamp_us) AS last_id FROM s), p AS (SELECT * FROM s ORDER BY {_FOLD_ORDER} LIMIT 300)
SELECT 'merged' AS kind, n, total, last_id, NULL AS reason FROM w UNION ALL SELECT 'chain', n, total, last_id, NULL FROM w
UNION ALL SELECT 'bounded', count(*), sum(k), max_by(id, timestamp_us), 'count' FROM p""")
def agg_object(spark, d):
    """Folds given as objects: in parallel with a merge, as one chain without, and within a budget."""
    log, q = _filled(spark, d), AggregateQuery("app/**")
    part = log.aggregate_bounded(q, _Merged(), max_events=300)
    rows = [("merged", *log.aggregate(q, _Merged()), None), ("chain", *log.aggregate(q, _Ordered()), None), ("bounded", *part.data, part.reason)]
    return _made(spark, "kind string, n long, total long, last_id long, reason string", *rows)


@query(f"WITH {_STORE}, s AS (SELECT id, sha256(CAST(correlation_id AS VARCHAR)) AS c FROM st) SELECT id, 0 AS extra FROM s WHERE c = (SELECT sha256(CAST({_CORR} AS VARCHAR)))")
def correlation_pages(spark, d):
    """A group read two rows at a time, each page by the cursor of the one before; pages share no row."""
    log = _filled(spark, d)
    group = event_log(spark, d).orderBy("id").select(F.unhex(F.sha2(F.col("correlation_id").cast("string"), 256)).alias("c")).first()[0]
    cursor, found = None, []
    while True:
        page = log.read_by_correlation_bounded(bytes(group), max_results=2, cursor=cursor)
        found += [r[0] for r in page.data.select(_event()).collect()]
        if page.complete:
            break
        cursor = page.cursor
    again = [_event_of(r) for r in log.read_by_correlation_iter(bytes(group))]
    return _made(spark, "id long, extra long", *[(i, len(found) - len(again)) for i in set(found) | set(again)])


def _event_of(row) -> int:
    import json

    return json.loads(row["payload"])["e"]


@query(f"WITH {_STORE} SELECT id, v AS version FROM st WHERE stream_id = {_FIRST} AND branch = 'main'")
def range_pages(spark, d):
    """A stream read by byte budgets, page by page, against the iterator over all of it."""
    log = _filled(spark, d)
    stream = _first_stream(event_log(spark, d))
    cursor, found = None, []
    while True:
        page = log.read_range_bounded(stream, max_bytes=60, cursor=cursor)
        found += [(_event_of(r), r["version"]) for r in page.data.collect()]
        if page.complete:
            break
        if page.reason != "bytes":
            raise AssertionError(page.reason)
        cursor = page.cursor
    whole = [(_event_of(r), r["version"]) for r in log.read_range_iter(stream)]
    return _made(spark, "id long, version long", *(whole if whole == found else found + whole))


@query(f"RECURSIVE WITH {_WALK}, w AS (SELECT id, 0 AS depth FROM start UNION ALL SELECT t.id, w.depth + 1 FROM w JOIN t ON t.causation_id = w.id) SELECT id, depth FROM w WHERE depth > 0")
def walk_pages(spark, d):
    """A walk within a budget of rows, taken up again by its cursor until it is complete: whole levels, none twice."""
    log = _tree(spark, d)
    start, cursor, found = _start(log), None, []
    while True:
        page = graph.walk_causation_bounded(log, start, graph.FORWARD, max_results=5, cursor=cursor)
        found += [(r["id"], r["depth"]) for r in page.data.select("id", "depth").collect()]
        if page.complete:
            return _made(spark, "id long, depth int", *found)
        cursor = page.cursor


@query("SELECT * FROM (VALUES ('append', 0), ('again', 0), ('batch', 2), ('if not', -1), ('if', 3), ('undeclared', -2)) AS t(what, version)", raw=True)
def append_api(spark, d):
    """One event, the same again, a batch with a repeat, and conditional ones."""
    from sediment.model import Append, StreamNotDeclared

    log = _new_log(spark)
    log.declare_stream("app/x", "catalogue")
    at = lambda i: log.read_one(i)["version"]
    one = log.append(Append("app/x", "T", {"n": 0}))
    out = [("append", at(one)), ("again", at(log.append(Append("app/x", "T", {"n": 0}))))]
    ids = log.append_batch([Append("app/x", "T", {"n": n}) for n in (1, 0, 2)])
    out.append(("batch", max(at(i) for i in ids)))
    holds = lambda n: lambda events: events.where("stream_id = 'app/x'").count() == n
    out += [("if not", -1 if log.append_if(Append("app/x", "T", {"n": 3}), holds(9)) is None else 0), ("if", at(log.append_if(Append("app/x", "T", {"n": 3}), holds(3))))]
    try:
        log.append_if(Append("app/none", "T", {}), holds(0))
    except StreamNotDeclared:
        out.append(("undeclared", -2))
    return _made(spark, "what string, version long", *out)


@query("SELECT tree.id, causation_id AS cause, 'src/' || stream_id AS hub_stream FROM tree JOIN log USING (id)")
def relay_causation(spark, d):
    """All events go to a hub, twice; each copy's cause is the copy of its cause."""
    from sediment.streaming.subscribe import relay_batch

    log = event_log(spark, d, causes=True)
    name = lambda c: F.unhex(F.sha2(F.col(c).cast("string"), 256))
    place = F.row_number().over(W.partitionBy("stream_id").orderBy("timestamp_us", "id")).cast("long") - 1
    payload = F.concat(F.lit('{"e":'), F.col("id").cast("string"), F.lit("}"))
    batch = log.select(name("id").alias("id"), "stream_id", F.lit("main").alias("branch"), place.alias("version"), "timestamp_us", name("causation_id").alias("causation_id"), "event_type", "type_version", payload.alias("payload"), "indexed_tags")
    hub = _new_log(spark)
    for _ in range(2):
        relay_batch(batch, hub, "src")
    copies = hub.raw.where(_ours())
    causes = copies.select(F.col("id").alias("causation_id"), _event().alias("cause"))
    return copies.select("stream_id", "causation_id", _event().alias("id")).join(causes, "causation_id", "left").select("id", "cause", F.col("stream_id").alias("hub_stream"))


@query("SELECT * FROM (VALUES ('ProjectRegistered', 'src', 'a/**', NULL), ('RelayHeartbeat', 'src', NULL, 7)) AS t(event_type, source_store, pattern, version)", raw=True)
def system_events(spark, d):
    """What the engine records about itself."""
    log = _new_log(spark)
    log.emit_project_registered("src", "/x", "a/**", "a project")
    log.emit_relay_heartbeat("src", 7, 0, 1)
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return log.raw.where(~_ours()).select("event_type", F.get_json_object("indexed_tags", "$.source_store").alias("source_store"), field("subscribe_pattern").alias("pattern"), field("last_event_version").cast("long").alias("version"))


_NAMES = {
    "stream": ("a", "a/b/c/d", "a/b/c/d/e", "", "/a", "a//b", "a b", "a-1/_x"),
    "branch": ("alt", "main", "a/b", "a//b", "/a", ""),
    "pattern": ("**", "a/*", "", "/a", "a/", "a b"),
    "id": ("0" * 64, "F" * 64, "0" * 63, "g" * 64),
}
_GOOD = {"stream": ("a", "a/b/c/d", "a-1/_x"), "branch": ("alt", "a/b"), "pattern": ("**", "a/*"), "id": ("0" * 64, "F" * 64)}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{kind}', '{n}', {n in _GOOD[kind]})" for kind, names in _NAMES.items() for n in names) + ") AS t(kind, name, good)", raw=True)
def names_valid(spark, d):
    """Which stream ids, branch ids, patterns and event ids are accepted."""
    from sediment import model

    checks = {"stream": model.validate_stream_id, "branch": model.validate_branch_id, "pattern": glob.validate_pattern, "id": model.parse_id}

    def good(kind: str, name: str) -> bool:
        try:
            checks[kind](name)
        except model.EventLogError:
            return False
        return True

    return _made(spark, "kind string, name string, good boolean", *[(kind, n, good(kind, n)) for kind, names in _NAMES.items() for n in names])


@query("""SELECT DISTINCT stream_id, CASE WHEN stream_id LIKE 'app/click/%' THEN 'clicks' WHEN stream_id LIKE 'app/%' THEN 'rest' END AS reducer FROM log
UNION ALL SELECT 'overlap', CAST(TRUE AS VARCHAR) UNION ALL SELECT 'apart', CAST(FALSE AS VARCHAR)""")
def reducer_choice(spark, d):
    """The reducer of the most specific pattern for every stream, and whether patterns overlap."""

    class One(_Counted):
        def __init__(self, name: str):
            self.name = name

    known = fold.Reducers()
    for pattern, name in (("**", "all"), ("app/*/*", "rest"), ("app/click/*", "clicks")):
        known.register(pattern, One(name))
    streams = [r[0] for r in event_log(spark, d).select("stream_id").distinct().toLocalIterator()]
    rows = [(s, known.for_stream(s).name) for s in streams]
    return _made(spark, "stream_id string, reducer string", *rows, ("overlap", str(glob.overlap("a/*/c", "a/b/*")).lower()), ("apart", str(glob.overlap("a/b", "a/c")).lower()))


def _embedded(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("key"), F.concat(F.lit("emb/"), F.col("label").cast("string")).alias("stream_id"), "embedding")


@query(f"WITH {_Q} SELECT key, round(score, 6) + 0 AS score FROM (SELECT key, {_KNN['knn_cosine'][2]} AS score FROM x, q WHERE key % 7 <> 3) ORDER BY score, key LIMIT 10", raw=True)
def knn_dirty(spark, d):
    """Every seventh vector is null: it has no distance and is never a neighbour."""
    rows = _embedded(spark, d)
    q = [float(x) for x in rows.orderBy("key").select("embedding").first()[0]]
    dirty = rows.withColumn("embedding", F.when(F.col("key") % 7 != 3, F.col("embedding")))
    return KnnIndex(dirty, len(q)).query(q, 10).select("key", (F.round("score", 6) + 0.0).alias("score"))


@query(f"WITH {_Q} SELECT key, round(score, 6) + 0 AS score FROM (SELECT key, {_KNN['knn_l2'][2]} AS score FROM x, q WHERE key % 5 <> 2) ORDER BY score, key LIMIT 10", raw=True)
def knn_index(spark, d):
    """An index added to, removed from, saved, loaded, set on a log and asked there."""
    from sediment.storage import ending, shared_dir

    rows = _embedded(spark, d)
    q = [float(x) for x in rows.orderBy("key").select("embedding").first()[0]]
    index = KnnIndex(rows.where("key % 2 = 0"), len(q), "l2").add(rows).remove(rows.where("key % 5 = 2"))
    log = _new_log(spark)
    path = ending(spark, f"{log.path}-knn")
    index.save(path)
    log.set_index(KnnIndex.load(spark, path, len(q), "l2"))
    return log.similarity_query(q, 10).select("key", (F.round("score", 6) + 0.0).alias("score"))


@query("SELECT count(*) FILTER (vec_id % 20 = 0) AS queries, TRUE AS enough, count(*) AS indexed FROM embeddings", raw=True)
def knn_ann(spark, d):
    """Approximate neighbours by cells: every row is indexed, and recall at 10 against exact search is 0.9 or more."""
    rows = _embedded(spark, d)
    index = CellIndex.fit(rows, "cosine")
    wanted = rows.where("key % 20 = 0").select(F.col("key").alias("query"), "embedding")
    near, exact = index.query(wanted, 10), knn_batch(rows, wanted, 10)
    recall = exact.join(near.select("query", "key", F.lit(1).alias("hit")), ["query", "key"], "left").agg(F.count("hit") / F.count(F.lit(1))).first()[0]
    return _made(spark, "queries long, enough boolean, indexed long", (wanted.count(), recall >= 0.9, index.rows.count()))


@query("SELECT id, stream_id FROM log WHERE branch = 'main' AND event_type = 'click' AND id % 2 = 1")
def stream_resume(spark, d):
    """A live subscription made anew after each append gets what came since it began, once."""
    from sediment.storage import ending, shared_dir
    from sediment.streaming.subscribe import Subscription, keep_batches

    rows = event_log(spark, d)
    log = _new_log(spark, rows)
    home = ending(spark, f"{log.path}-sub")
    for part in ("id % 2 = 0", "id % 4 = 1", "id % 4 = 3"):
        log.append_frame(_incoming(rows.where(part)))
        Subscription(log, "app/click/*", home).drain(keep_batches(f"{home}/out"))
    return spark.read.parquet(f"{home}/out").select(_event().alias("id"), "stream_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A filtered fold: main branch, a time range, a tag; counts and sums by event type."""
    ship(spark)
    q = AggregateQuery("app/*/*", from_ts=_T0, tags={"missing": None})
    return aggregate.aggregate(event_log(spark, d), q, *_aggs(), by=("event_type",))


