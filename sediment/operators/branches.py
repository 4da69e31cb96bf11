"""Branch lineage: pointer table, chains, and reads stitched along a chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.model import MAIN, BranchNotFound
from sediment.storage import stored


def resolve_chain(branches: DataFrame, stream_id: str, branch: str) -> list[tuple[str, int | None]]:
    """(branch, last version inherited) from the root to ``branch``; the leaf has no bound.

    ``main`` is the root of every chain. Only this stream's pointers come to the driver.
    """
    rows = branches.where(F.col("stream_id") == stream_id).select("id", "parent_id", "parent_version")
    parents = {r["id"]: (r["parent_id"], r["parent_version"]) for r in rows.toLocalIterator()}
    chain: list[tuple[str, int | None]] = [(branch, None)]
    seen = {branch}
    while chain[-1][0] != MAIN:
        if chain[-1][0] not in parents:
            raise BranchNotFound(f"{stream_id}: {chain[-1][0]}")
        parent, version = parents[chain[-1][0]]
        if parent in seen:
            raise BranchNotFound(f"{stream_id}: {parent} is its own ancestor")
        seen.add(parent)
        chain.append((parent, version))
    return chain[::-1]


def chains(branches: DataFrame) -> DataFrame:
    """Rows (stream_id, branch, segment, source, to_version) of every branch's chain.

    ``segment`` counts from the leaf (0) to the root. Ancestors are found by doubling: each round joins
    those that are farthest so far with all found, so a chain of n branches costs log2(n) joins and the
    table may be of any size. Rounds are written to the shared folder.
    """
    links = branches.select("stream_id", F.col("id").alias("branch"), F.col("parent_id").alias("source"), F.col("parent_version").cast("long").alias("to_version"))
    found = stored(links.where("source IS NOT NULL").select("stream_id", "branch", F.lit(1).alias("segment"), "source", "to_version"), "chains")
    reach, more = 1, found
    while not more.isEmpty():
        loop = found.where("branch = source").first()
        if loop is not None:
            raise BranchNotFound(f"{loop['stream_id']}: {loop['branch']} is its own ancestor")
        far = found.where(F.col("segment") == reach).select("stream_id", "branch", F.col("source").alias("via"))
        on = found.withColumnsRenamed({"branch": "via", "segment": "further"})
        joined = far.join(on, ["stream_id", "via"]).select("stream_id", "branch", (F.col("further") + reach).cast("int").alias("segment"), "source", "to_version")
        more = stored(joined, "chains")
        found, reach = found.union(more), 2 * reach
    leaves = links.select("stream_id", "branch", F.lit(0).alias("segment"), F.col("branch").alias("source"), F.lit(None).cast("long").alias("to_version"))
    return leaves.union(found)


def read_lineage(events: DataFrame, branches: DataFrame, stream_id: str, branch: str) -> DataFrame:
    """A branch's history with what it inherits: each segment's events up to its fork, root first.

    The chain becomes a disjunction of literal ranges, so the scan prunes by branch and version.
    """
    wanted, place = F.lit(False), F.lit(None).cast("int")
    for i, (source, last) in enumerate(resolve_chain(branches, stream_id, branch)):
        here = F.col("branch") == source
        if last is not None:
            here = here & (F.col("version") <= last)
        wanted = wanted | here
        place = F.when(F.col("branch") == source, F.lit(i)).otherwise(place)
    rows = events.where((F.col("stream_id") == stream_id) & wanted)
    return rows.withColumn("segment", place).orderBy("segment", "version")


def lineages(events: DataFrame, branches: DataFrame) -> DataFrame:
    """Stitched histories of all branches at once: events joined with chains on stream and branch, cut by fork version."""
    c = chains(branches).withColumnsRenamed({"branch": "leaf"})
    on = (events["stream_id"] == c["stream_id"]) & (events["branch"] == c["source"]) & (c["to_version"].isNull() | (events["version"] <= c["to_version"]))
    return events.join(c, on).select(c["leaf"], c["segment"], *[events[x] for x in events.columns])
