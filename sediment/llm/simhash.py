"""SimHash near-duplicates by segment popcounts.

A fingerprint is mapped to the counts of set bits in its segments of two bits. The Manhattan distance
of two such vectors is never more than the Hamming distance of the fingerprints. The segments form
``groups``; within radius r at most r groups differ, so two linked fingerprints agree in all counts of
at least ``groups - r`` groups. Each choice of that many groups is a grid over their counts: links are
searched among fingerprints of equal cell, pruned by the Manhattan distance of the rest and verified
bit by bit, all as the condition of one join.

A cell of more than ``crowd`` distinct fingerprints is not joined pair by pair. Its fingerprints go the
exact way for crowds instead: two fingerprints are within distance 2r exactly if their balls of radius
r meet, so each emits the members of its ball of radius 1 (65 rows), and those that share a member are
linked through the least of them. That reaches distance 2, the radius of the contract.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import LOWER, UPPER, arrow_map, components, discard, stored
from sediment.storage import few

#: White space becomes a space, A-Z lower case.
WORDS = bytes(32 if b == 32 or 9 <= b <= 13 else ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b for b in range(256))
#: Hashes whose bits are added up at once.
_CHUNK = 65_536


def hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of seed 42 of every word shingle of a text, repeats included; of all words where they are fewer."""
    import xxhash

    words = text.translate(WORDS).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size).tolist()
    ends = ends.tolist()
    n = max(1, len(words) - shingle + 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts[:n], last, strict=True)), np.uint64, n)


def fingerprint(text: bytes, shingle: int) -> int:
    """64-bit SimHash, as a signed integer, over word shingles with repeats, by XXH64 of seed 42."""
    h = hashes(text, shingle)
    n = len(h)
    if not n:
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        bits = np.unpackbits(h[i : i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, fp long) for every row of ``docs``, with the long columns ``carry`` as they are."""

    def run(cols: dict, n: int) -> dict:
        return {k: cols[k] for k in ("doc_id", *carry)} | {"fp": [fingerprint(t or b"", shingle) for t in cols["text"]]}

    schema = ",".join(["doc_id long", *[f"{k} long" for k in carry], "fp long"])
    return arrow_map(docs.select("doc_id", *carry, "text"), run, schema, binary=("text",))


def _counts(fp: Column) -> Column:
    """The popcounts of the 32 two-bit segments, each in its own two bits of a long."""
    odd = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))


def _cells(fps: DataFrame, radius: int, groups: int) -> DataFrame:
    """Rows (cell, fp, counts): each fingerprint in every choice of ``groups - radius`` groups of segments."""
    edge = [round(i * 32 / groups) * 2 for i in range(groups + 1)]
    masks = [sum(1 << b for b in range(edge[g], edge[g + 1])) for g in range(groups)]
    choices = []
    for k, chosen in enumerate(itertools.combinations(range(groups), groups - radius)):
        mask = sum(masks[g] for g in chosen)
        mask -= (mask >> 63) << 64
        choices.append(F.struct(F.lit(k).alias("k"), F.col("counts").bitwiseAND(F.lit(mask)).alias("c")))
    return fps.withColumn("counts", _counts(F.col("fp"))).select("fp", "counts", F.explode(F.array(*choices)).alias("cell")).select("cell.k", "cell.c", "fp", "counts")


def _distance(a: str, b: str) -> Column:
    """Manhattan distance of two packed count vectors."""
    low = F.lit(0x3333333333333333)
    total = F.lit(0)
    for shift in (0, 2):
        x, y = F.shiftrightunsigned(F.col(a), shift).bitwiseAND(low), F.shiftrightunsigned(F.col(b), shift).bitwiseAND(low)
        # Counts are 0, 1 or 2 in four bits each: with 4 added no field borrows, then |d| by table of bits.
        d = x + F.lit(0x4444444444444444) - y
        one = d.bitwiseAND(F.lit(0x1111111111111111))
        two = F.shiftrightunsigned(d, 1).bitwiseAND(F.lit(0x1111111111111111)).bitwiseAND(F.bitwise_not(one))
        total = total + F.bit_count(one) + 2 * F.bit_count(two)
    return total


def links(fps: DataFrame, radius: int = 2, groups: int = 5, crowd: int = 64) -> DataFrame:
    """Rows (a, b) of linked distinct fingerprints whose components are those of all pairs within ``radius``."""
    if radius != 2:
        raise ValueError("the way for crowded cells is exact at radius 2")
    cells = _cells(fps, radius, groups)
    sizes = cells.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = stored(cells.join(sizes, ["k", "c"]), "cells")
    few = met.where(F.col("n") <= crowd)
    one, two = few.alias("x"), few.alias("y")
    near = (F.col("x.k") == F.col("y.k")) & (F.col("x.c") == F.col("y.c")) & (F.col("x.fp") < F.col("y.fp"))
    near = near & (_distance("x.counts", "y.counts") <= radius) & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
    pairs = one.join(two, near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = met.where(F.col("n") > crowd).select("fp").distinct()
    flips = [F.lit(0).cast("long"), *[F.lit((1 << b) - ((1 << b >> 63) << 64)) for b in range(64)]]
    balls = many.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(x) for x in flips])).alias("mid"))
    hub = balls.groupBy("mid").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("mid", "a")
    stars = balls.join(hub, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, groups: int = 5, crowd: int = 64, carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, carry..., fp, component_id) for every row of ``docs``.

    Equal fingerprints meet in one row before any search, so groups of copies of any size cost a
    partial aggregate. A null or empty text has fingerprint zero and links like any other; rows of a
    repeated id take part each with its own text; a null id names no component unless there is no other;
    long texts are read whole; extra columns are not read; an empty table gives an empty one.
    """
    made = stored(fingerprints(docs, shingle, carry), "fingerprints")
    nodes = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = stored(links(nodes.select("fp"), radius, groups, crowd), "links")
    whole = components(found)
    top = whole.join(nodes, whole["node"] == nodes["fp"]).groupBy("component").agg(F.min("least").alias("low"))
    linked = whole.join(top, "component").select(F.col("node").alias("fp"), "low")
    named = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("low", "least").alias("component_id")), "components")
    return made.join(named, "fp").select("doc_id", *carry, "fp", "component_id")


def distinct_documents(docs: DataFrame, shingle: int = 5, radius: int = 2, groups: int = 5, crowd: int = 64) -> DataFrame:
    """One row of ``docs`` for each component, that of the least id, all columns as they were.

    Null ids come after others. Of rows with equal id the one of least hash stays; of rows equal in
    every column one stays. Only ids and hashes are shuffled; whole rows move where rows are repeated
    or where more than ``storage.MOST_SENT`` rows go.
    """
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)), "__row": F.xxhash64(*docs.columns)})
    return one_of_each(docs, own, near_duplicates(own, shingle, radius, groups, crowd, carry=("__id", "__row")))


def one_of_each(docs: DataFrame, own: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component in ``found`` (__id, __row, component_id); ``own`` is ``docs`` with __id and __row."""
    names = docs.columns
    found = stored(found, "near")
    first = F.struct("__id", "__row")
    keep = found.groupBy("component_id").agg(F.min(first).alias("first"))
    each = found.groupBy("component_id", "__id", "__row").agg(F.count(F.lit(1)).alias("n"))
    marked = each.join(keep, each["component_id"].eqNullSafe(keep["component_id"])).select("__id", "__row", "n", (F.col("first") == first).alias("stays"))
    marked = stored(marked.groupBy("__id", "__row").agg(F.sum("n").alias("n"), F.max("stays").alias("stays")).where("n > 1 OR NOT stays"), "marked")
    discard(found)
    known = few(marked)
    once = own.join(known.select("__id", "__row"), ["__id", "__row"], "left_anti")
    again = own.join(known.where("stays").select("__id", "__row"), ["__id", "__row"], "left_semi").dropDuplicates(["__id", "__row"])
    return once.unionByName(again).select(*names)
