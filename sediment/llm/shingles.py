"""Near copies by Jaccard similarity of word-shingle sets, without loss.

A text is the set of its shingle hashes. Two sets of similarity 4/5 or more differ in at most a ninth of
the sum of their sizes. Segment popcounts bound that from below: hash space is cut into segments, a set
is mapped to the number of its hashes in each, modulo two, and the Manhattan distance of two such vectors
is never more than the number of hashes in which the sets differ. A short vector goes with every row; one
that grows with the set, in two widths so that sets of like size have one in common, is looked up for
pairs. Equal sets are one node from the start.

Candidates come first from SimHash fingerprints: those within two bits, by the grids over segment popcounts
of ``simhash``, verified like all others. Texts of similarity 4/5 mostly differ in more bits than a lossless
grid of fingerprints reaches; the rest of the candidates come from prefixes. Shingles are sorted in one global order, frequent ones last; of two similar
sets each has one of its ``n - ceil(4n/5) + 1`` first shingles in common with the other. Any order loses
nothing; frequencies, counted roughly and for a fixed number of shingles, only keep crowds small. Prefixes
are shuffled once, and what no other set shares goes no further.

Sets that share a prefix shingle are held against sizes, the places of the shingle and the Manhattan
bound; what is left is verified on whole sets. Sets that fingerprints linked aren't compared again. First each set meets the least set and the one before it
of each of its shingles; what is linked by then needs no comparison inside. Then sets of different
components meet their neighbours in an order by chance, which links most of a crowd of near copies at a
cost in proportion to its rows. Last all pairs of components still different meet, with the bounds as
the condition of one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sediment.llm.common import arrow_map, components, discard, prepare, stored, tidy
from sediment.llm.simhash import WORDS, fingerprint, links, one_of_each
from sediment.storage import few

#: Frequent shingles that the order knows, and occurrences in one task from which one is counted.
FREQUENT, SEEN = 262_144, 3
#: Hashes that a task holds while it counts.
_HELD = 2_000_000
#: Segments of hash space in the counts that go with every row, in longs of 64 each.
LONGS = 8
#: Rows of one shingle that a window holds, about; more are cut into stretches that overlap by half.
STRETCH = 1024


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted; of all words where they are fewer than a shingle."""
    import xxhash

    words = (text or b"").translate(WORDS).split()
    if not words:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(shingle, len(h))
    mix = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        mix = (mix ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mix ^= mix >> np.uint64(29)
    return np.unique(mix).view(np.int64)


def segment_counts(own: np.ndarray, longs: int) -> np.ndarray:
    """How many hashes of a set lie in each of ``64 * longs`` segments, modulo two, packed into longs."""
    segment = own.view(np.uint64) % np.uint64(64 * longs)
    odd = np.bincount(segment.astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def wide_counts(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment counts of a width of twice to four times the set's size, and of half that width."""
    longs = 2 << max(0, (len(own) - 1) // 64).bit_length()
    return segment_counts(own, longs), segment_counts(own, longs // 2)


def _frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles, and their counts as far as tasks saw them."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(sets: list[np.ndarray]) -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c >= SEEN]), pa.array(c[c >= SEEN].astype(np.int64))], names=["h", "c"])

        held, n = [], 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(shingle_set(text, shingle))
                n += len(held[-1])
                if n > _HELD:
                    yield rows(held)
                    held, n = [], 0
        if held:
            yield rows(held)

    top = docs.select("text").mapInArrow(tidy(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT).toArrow()
    h, c = top["h"].to_numpy(), top["c"].to_numpy()
    order = np.argsort(h)
    return h[order], c[order]


def prefix(own: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set in the global order, as many as similarity 4/5 needs."""
    if len(known):
        at = np.minimum(np.searchsorted(known, own), len(known) - 1)
        own = own[np.lexsort((own, np.where(known[at] == own, counts[at], 0)))]
    return own[: len(own) - -(-4 * len(own) // 5) + 1] if len(own) else own


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """Rows (__id, __row, fp, s, n, counts, wide, half, first): each text's fingerprint, a name of its set, the set's size, segment counts and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, shingle))

    def run(cols: dict, n: int) -> dict:
        import xxhash

        sets = [shingle_set(t, shingle) for t in cols["text"]]
        wide = [wide_counts(x) for x in sets]
        return {
            "__id": cols["__id"],
            "__row": cols["__row"],
            "fp": [fingerprint(t or b"", shingle) for t in cols["text"]],
            "s": np.array([xxhash.xxh64_intdigest(x.tobytes(), 3) for x in sets], np.uint64).view(np.int64),
            "n": [len(x) for x in sets],
            "counts": [segment_counts(x, LONGS) for x in sets],
            "wide": [x[0] for x in wide],
            "half": [x[1] for x in wide],
            "first": [prefix(x, *sent.value) for x in sets],
        }

    return arrow_map(docs.select("__id", "__row", "text"), run, "__id long,__row long,fp long,s long,n long,counts array<long>,wide array<long>,half array<long>,first array<long>", binary=("text",))


def _by_fingerprint(made: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of sets from rows (fp, s): of equal fingerprints with the least set, of linked ones the least sets of both."""
    prints = stored(made.select("fp", "s").distinct(), "prints")
    least = stored(prints.groupBy("fp").agg(F.min("s").alias("least")), "fingerprints")
    near = stored(links(least.select("fp")), "links")
    alike = prints.join(least, "fp").select(F.col("least").alias("x"), F.col("s").alias("y"))
    ends = near.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    out = stored(alike.union(ends.select("x", "y")).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "candidates")
    for df in (prints, least, near):
        discard(df)
    return out


_SHARED = ("h", "s", "n", "i", "hub", "prior")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (h, s, n, i, hub, prior) of the shingles that several sets have in their prefixes.

    ``hub`` is the first set of the shingle and ``prior`` the one before this, each null where sizes and
    places rule the pair out. One row is carried from batch to batch, however many sets share a shingle.
    """

    def fits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return 9 * np.minimum(x[:, 2] - x[:, 3], y[:, 2] - y[:, 3]) >= 4 * (x[:, 2] + y[:, 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row so far, the first row of its shingle, and the row before it, as far as there is one.
        last: tuple[np.ndarray, np.ndarray, np.ndarray | None] | None = None

        def made(own: np.ndarray, hub: np.ndarray, prior: np.ndarray, joined: np.ndarray) -> pa.RecordBatch:
            cols = [pa.array(own[:, k]) for k in range(4)]
            cols += [pa.array(x[:, 1], mask=~(joined & fits(own, x))) for x in (hub, prior)]
            return pa.RecordBatch.from_arrays(cols, names=list(_SHARED))

        for batch in batches:
            x = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            if last is not None:
                x = np.concatenate((last[0][None], x))
            if not len(x):
                continue
            x = x[np.concatenate(([True], np.any(x[1:, :2] != x[:-1, :2], axis=1)))]
            same = x[1:, 0] == x[:-1, 0]
            joined = np.concatenate(([last is not None and last[2] is not None], same))
            start = np.maximum.accumulate(np.where(np.concatenate(([True], ~same)), np.arange(len(x)), 0))
            hub, prior = x[start], np.concatenate((x[:1], x[:-1]))
            if last is not None:
                hub[start == 0] = last[1]
                prior[0] = last[2] if last[2] is not None else x[0]
            out = np.flatnonzero(joined[:-1] | same)
            if len(out):
                yield made(x[out], hub[out], prior[out], joined[out])
            last = (x[-1], hub[-1], prior[-1] if joined[-1] else None)
        if last is not None and last[2] is not None:
            yield made(last[0][None], last[1][None], last[2][None], np.array([True]))

    ordered = rows.select("h", "s", "n", "i").repartition("h").sortWithinPartitions("h", "s")
    return ordered.mapInArrow(tidy(run), ", ".join(f"{c} long" for c in _SHARED))


def _near(x: str | Column, y: str | Column) -> Column:
    """Whether two rows of a shingle can be of similar sets, still apart: by components, by sizes n and places i, and by segment counts."""
    of = lambda row, name: F.col(f"{row}.{name}") if isinstance(row, str) else row[name]
    fit = 9 * F.least(of(x, "n") - of(x, "i"), of(y, "n") - of(y, "i")) >= 4 * (of(x, "n") + of(y, "n"))
    return (of(x, "component") != of(y, "component")) & fit & _bound(*([of(r, "n"), of(r, "counts")] for r in (x, y)))


def _bound(x: list[Column], y: list[Column]) -> Column:
    """Whether two sets can be similar, by sizes and the Manhattan distance of their segment counts."""
    apart = F.lit(0)
    for k in range(LONGS):
        apart = apart + F.bit_count(F.get(x[1], F.lit(k)).bitwiseXOR(F.get(y[1], F.lit(k))))
    return (9 * apart <= x[0] + y[0]) & (5 * F.least(x[0], y[0]) >= 4 * F.greatest(x[0], y[0]))


def _wide_bound(x: str, y: str) -> Column:
    """As ``_bound``, by the widest segment counts that both sets have; no bound where they have none in common."""
    n, m = F.size(f"{x}.wide"), F.size(f"{y}.wide")
    one = F.when(n <= m, F.col(f"{x}.wide")).otherwise(F.col(f"{x}.half"))
    two = F.when(m <= n, F.col(f"{y}.wide")).otherwise(F.col(f"{y}.half"))
    apart = F.aggregate(F.zip_with(one, two, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, v: total + v)
    return (F.size(one) != F.size(two)) | (9 * apart <= F.col(f"{x}.n") + F.col(f"{y}.n"))


def _verified(pairs: DataFrame, own: DataFrame, sets: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) of similarity 4/5 or more: by wide segment counts, then by whole sets."""
    end = F.struct("n", "wide", "half")
    ends = pairs.distinct().join(sets.select(F.col("s").alias("a"), end.alias("x")), "a").join(sets.select(F.col("s").alias("b"), end.alias("y")), "b")
    pairs = stored(ends.where(_wide_bound("x", "y")).select("a", "b"), "pairs")
    used = pairs.select(F.explode(F.array("a", "b")).alias("s")).distinct()
    names = stored(sets.join(used, "s", "left_semi").select("__id", "__row", "s"), "names")
    picked = own.select("__id", "__row", "text").join(few(names), ["__id", "__row"]).select("s", "text")
    kept = stored(picked.dropDuplicates(["s"]), "texts")
    both = pairs.join(kept.select(F.col("s").alias("a"), "text"), "a").join(kept.select(F.col("s").alias("b"), F.col("text").alias("text2")), "b")

    def run(cols: dict, n: int) -> dict:
        good = []
        for a, b, t, u in zip(cols["a"], cols["b"], cols["text"], cols["text2"], strict=True):
            x, y = shingle_set(t, shingle), shingle_set(u, shingle)
            if 9 * len(np.intersect1d(x, y, assume_unique=True)) >= 4 * (len(x) + len(y)):
                good.append((a, b))
        return {"a": [g[0] for g in good], "b": [g[1] for g in good]}

    out = stored(arrow_map(both.select("a", "b", "text", "text2"), run, "a long,b long", binary=("text", "text2")), "verified")
    for df in (pairs, names, kept):
        discard(df)
    return out


def _open(rows: DataFrame, found: DataFrame, sets: DataFrame | None) -> DataFrame:
    """Those of ``rows`` (h, s, n, i) whose shingle is in several components of the links ``found``, with component, counts and how many the shingle has."""
    label = stored(components(found), "labels")
    rows = rows.select("h", "s", "n", "i") if sets is not None else rows.drop("component", "many")
    groups = stored(rows.join(label.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s")), "groups")
    mixed = groups.groupBy("h").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count(F.lit(1)).alias("many")).where("p <> q").select("h", "many")
    left = groups.join(mixed, "h")
    out = stored(left if sets is None else left.join(sets.select("s", "counts"), "s"), "open")
    discard(label)
    discard(groups)
    return out


def _beside(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbours, up to four places apart, among the rows of a shingle in an order by chance.

    The order of a shingle of many rows is cut into stretches and, half a stretch on, into stretches once
    more. Neighbours at an edge of the first are inside one of the second, so no task gets a whole crowd.
    """
    chance = F.xxhash64("s", F.lit(1))
    place = (F.shiftright(chance, 32) + F.lit(1 << 31)) * F.ceil(F.col("many") / STRETCH) / F.lit(float(1 << 32))
    stretches = F.when(F.col("many") <= STRETCH, F.array(F.lit(0))).otherwise(F.array(2 * F.floor(place), 2 * F.floor(place + 0.5) + 1))
    rows = rows.withColumn("stretch", F.explode(stretches))
    order = W.partitionBy("h", "stretch").orderBy(chance, "s")
    own = F.struct("n", "i", "component", "counts")
    other = F.array(*[F.lag(F.struct("s", "n", "i", "component", "counts"), k).over(order) for k in range(1, 5)])
    met = rows.select("s", own.alias("x"), other.alias("others"))
    near = F.filter("others", lambda y: y.isNotNull() & _near(F.col("x"), y))
    return met.select("s", F.explode(near).alias("y")).select(F.least("s", "y.s").alias("a"), F.greatest("s", "y.s").alias("b"))


def distinct_documents(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of ``docs`` for each component of texts linked at similarity 4/5 or more, that of the least id.

    All columns stay as they were, extra ones too; ids and rows as in ``simhash.distinct_documents``. A text
    of fewer words than a shingle is one shingle; null, empty and blank texts have the empty set and are
    equal; of rows equal in every column one stays; very long texts are compared whole; an empty table
    gives an empty one.
    """
    own = docs.withColumns({"__id": F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)), "__row": F.xxhash64(*docs.columns)})
    made = stored(_sets(own, shingle), "sets")
    same = [F.any_value(c).alias(c) for c in ("n", "counts", "wide", "half")]
    sets = stored(made.groupBy("s").agg(F.min(F.struct("__id", "__row")).alias("d"), *same).select("s", "d.*", "n", "counts", "wide", "half"), "least")
    candidates = _by_fingerprint(made)
    end = F.struct("n", "counts", "component")
    alike = _verified(candidates, own, sets, shingle)
    label = stored(components(alike), "labels")
    known = stored(sets.select("s", "n", "counts").join(label.withColumnRenamed("node", "s"), "s", "left").withColumn("component", F.coalesce("component", "s")), "known")
    shared = stored(_shared(made.select("s", "n", F.posexplode("first").alias("i", "h")).withColumn("i", F.col("i").cast("long"))), "shared")
    stars = shared.select(F.explode(F.array("hub", "prior")).alias("a"), F.col("s").alias("b")).where("a IS NOT NULL").distinct()
    ends = stars.join(known.select(F.col("s").alias("a"), end.alias("x")), "a").join(known.select(F.col("s").alias("b"), end.alias("y")), "b")
    bound = _bound(*([F.col(f"{r}.n"), F.col(f"{r}.counts")] for r in "xy"))
    starred = _verified(ends.where((F.col("x.component") != F.col("y.component")) & bound).select("a", "b"), own, sets, shingle)
    found = alike.union(starred)
    rows = _open(shared, found, sets)
    more = _verified(_beside(rows), own, sets, shingle)
    left = _open(rows, found.union(more), None)
    x, y = left.alias("x"), left.alias("y")
    pairs = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.s") < F.col("y.s")) & _near("x", "y"))
    last = _verified(pairs.select(F.col("x.s").alias("a"), F.col("y.s").alias("b")), own, sets, shingle)
    whole = stored(components(found.union(more).union(last)), "whole")
    marked = made.select("__id", "__row", "s").join(whole.withColumnRenamed("node", "s"), "s", "left")
    out = one_of_each(docs, own, marked.select("__id", "__row", F.coalesce("component", "s").alias("component_id")))
    for df in (made, sets, candidates, alike, label, known, shared, starred, rows, more, left, last, whole):
        discard(df)
    return out
