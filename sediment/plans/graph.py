"""Walks of the causation forest: every event has at most one cause.

A walk goes level by level. A level is one join of the frontier with the (id, causation_id) columns;
each level is written to the shared folder, so a lost executor costs one level, and payloads are joined
once at the end. For whole forests ``roots`` uses pointer doubling: log2(depth) joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.model import InvalidCursor, ReadOutcome, Sampling
from sediment.plans.budget import decode_cursor, encode_cursor, payload_bytes
from sediment.storage import stored

FORWARD, BACKWARD, BOTH = "forward", "backward", "both"
UNBOUNDED = 2**31 - 1


def _links(events: DataFrame) -> DataFrame:
    return events.select("id", F.col("causation_id").alias("cause"))


def _step(links: DataFrame, frontier: DataFrame, direction: str) -> DataFrame:
    """Ids one step from the frontier; a cause that no event has drops out."""
    down = links.join(frontier.select(F.col("id").alias("cause")), "cause", "left_semi").select("id")
    if direction == FORWARD:
        return down
    causes = links.join(frontier.select("id"), "id", "left_semi").where("cause IS NOT NULL").select(F.col("cause").alias("id"))
    up = links.select("id").join(causes, "id", "left_semi")
    return up if direction == BACKWARD else down.union(up).distinct()


#: A frontier of up to this many ids goes into the next level's predicate, where file statistics can
#: use it; a larger one is a written table and a join.
MOST_LITERALS = 1000


def _levels(events: DataFrame, start, direction: str, max_depth: int) -> DataFrame:
    """Rows (id, depth) reached from ``start``, itself excluded.

    While a level is small it costs one filtered scan and a bounded collect; from the first level that
    is not, levels are joins, each written to the shared folder.
    """
    spark = events.sparkSession
    links = _links(events)
    kind = dict(events.dtypes)["id"]
    ids, found, depth = [start], [], 0
    if direction == BACKWARD:
        row = links.where(F.col("id") == F.lit(start).cast(kind)).first()
        ids = [row["cause"]] if row is not None and row["cause"] is not None else []
        while ids and depth < max_depth:
            depth += 1
            row = links.where(F.col("id") == F.lit(ids[0]).cast(kind)).first()
            if row is None:
                break
            found.append((row["id"], depth))
            ids = [] if row["cause"] is None else [row["cause"]]
        return spark.createDataFrame(found, f"id {kind}, depth int")
    while ids and depth < max_depth:
        more = links.where(F.col("cause").isin(ids)).select("id").limit(MOST_LITERALS + 1).collect()
        if len(more) > MOST_LITERALS:
            break
        depth += 1
        ids = [r["id"] for r in more]
        found += [(i, depth) for i in ids]
    near = spark.createDataFrame(found, f"id {kind}, depth int")
    if not ids or depth >= max_depth:
        return near
    frontier = spark.createDataFrame([(i,) for i in ids], f"id {kind}")
    while depth < max_depth:
        depth += 1
        frontier = stored(_step(links, frontier, direction), "level")
        if frontier.isEmpty():
            break
        near = near.union(frontier.withColumn("depth", F.lit(depth)))
    return near


_WALK = ("timestamp_us", "stream_id", "branch", "version")


def walk_causation(events: DataFrame, start, direction: str = FORWARD, max_depth: int = 100) -> DataFrame:
    """Descendants, ancestors, or descendants and then ancestors of ``start``, with ``depth``.

    Start itself is left out, and need not exist for a forward walk. Order: block (for both), depth
    (nearest first), time. Both directions reach pure ancestors and pure descendants only.
    """
    if direction == BOTH:
        down = _levels(events, start, FORWARD, max_depth).withColumn("_block", F.lit(0))
        up = _levels(events, start, BACKWARD, max_depth).withColumn("_block", F.lit(1))
        ids = down.union(up.join(down, "id", "left_anti"))
    else:
        ids = _levels(events, start, direction, max_depth).withColumn("_block", F.lit(0))
    return events.join(ids, "id").orderBy("_block", "depth", *_WALK).drop("_block")


def walk_causation_bounded(events: DataFrame, start, direction: str = FORWARD, max_depth: int = 100, sampling: Sampling = Sampling(), max_results: int | None = None, max_bytes: int | None = None, cursor: str | None = None) -> ReadOutcome:
    """Breadth-first walk with sampling and whole-level budgets.

    In both directions every node goes on to its children and its cause, so siblings are reached too.
    Sampling keeps the first ids of each level; what it leaves out is not gone on from. A level is
    taken whole or not at all, the first of a call always. The cursor names the folder of what was
    seen, so a resumed walk repeats nothing.
    """
    spark = events.sparkSession
    kind = dict(events.dtypes)["id"]
    links = _links(events)
    state = decode_cursor(cursor, "causation")
    if state is None:
        seen = spark.range(1).select(F.lit(start).cast(kind).alias("id"), F.lit(0).alias("depth"))
        depth = 0
    else:
        if state["direction"] != direction:
            raise InvalidCursor(f"cursor of a {state['direction']} walk")
        seen, depth = spark.read.schema(f"id {kind}, depth int").parquet(state["seen"]), state["depth"]
    first, rows, size, reason, token = depth, 0, 0, None, None
    quota = sampling.per_level(max_depth)
    while depth < max_depth:
        frontier = seen.where(F.col("depth") == depth)
        level = _step(links, frontier, direction).join(seen.select("id"), "id", "left_anti")
        if quota is not None:
            level = level.orderBy("id").limit(quota)
        level = stored(level.withColumn("depth", F.lit(depth + 1)), "level")
        if level.isEmpty():
            break
        if max_results is not None or max_bytes is not None:
            n, b = events.join(level.select("id"), "id", "left_semi").agg(F.count(F.lit(1)), F.sum(payload_bytes(F.col("payload")))).first()
            over = (max_results is not None and rows + n > max_results, max_bytes is not None and size + (b or 0) > max_bytes)
            if depth > first and any(over):
                reason = "count" if over[0] else "bytes"
                kept = stored(seen, "seen", keep=True)
                token = encode_cursor("causation", direction=direction, depth=depth, seen=kept.inputFiles()[0].rpartition("/")[0])
                break
            rows, size = rows + n, size + (b or 0)
        seen = seen.union(level)
        depth += 1
    data = events.join(seen.where(F.col("depth") > first), "id").orderBy("depth", "id")
    return ReadOutcome(data, reason, token)


def roots(events: DataFrame) -> DataFrame:
    """Rows (id, root, depth) of every event, by pointer doubling.

    Each round joins the pointers with themselves and doubles their reach, until none moves. The root
    of an event whose chain ends at an unknown cause is the last event known.
    """
    links = _links(events)
    known = links.select(F.col("id").alias("cause"))
    linked = links.join(known, "cause", "left_semi").select("id", F.col("cause").alias("up"), F.lit(1).cast("long").alias("depth"))
    tops = links.join(linked, "id", "left_anti").select("id", F.col("id").alias("up"), F.lit(0).cast("long").alias("depth"))
    at = stored(linked.union(tops), "pointers")
    while True:
        jump = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        new = stored(at.join(jump, "up").select("id", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "pointers")
        at = new.select("id", "up", "depth")
        if new.where("moved").isEmpty():
            return at.withColumnRenamed("up", "root")


def sampled_levels(events: DataFrame, start, direction: str, max_depth: int, sampling: Sampling) -> DataFrame:
    """Ids and depths of a sampled walk, as rows."""
    return walk_causation_bounded(events, start, direction, max_depth, sampling).data.select("id", "depth")
