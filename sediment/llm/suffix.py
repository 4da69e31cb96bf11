"""Repeated passages by equal contexts of minimisers.

Words are lower-cased runs between white space. A window of ``length`` words is anchored at the leftmost
of the least k-grams among its first ``window`` ones, so equal windows are anchored alike and hold the
anchor's key: the ``length - window + 1`` words from there on. The windows of one anchor start in a row;
all their words together are the anchor's context.

Anchors whose key is met twice are sorted by 64-bit hash of the whole context. Those of equal context have
all windows in common: each is compared with its neighbours from other texts. Of every such group the
anchors of the least and the greatest text, and all anchors whose context no other text has, go on:
where a key has several contexts, every window of theirs is hashed and windows of equal hash are compared
with their neighbours in the same way. So each window that stands in another text is proposed with a
text that has it. Neighbours on one diagonal of the same two texts are put together, then both texts are
read once and the match is extended word by word to the left and to the right. Only matches verified
that way, of ``length`` words or more, are reported.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import arrow_map, discard, prepare, stored

#: White space becomes a space, A-Z lower case.
_TABLE = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
#: Rows of one group that are sorted together; a group with more is dealt out by document.
CROWD = 4096


class _Hashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = xxhash.xxh64_intdigest(word, 7)
        if len(self) < 400_000:
            self[word] = value
        return value


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    return x ^ (x >> np.uint64(29))


class Prefixes:
    """Hashes of any word range of one text, equal for equal ranges of any texts.

    A polynomial prefix sum modulo 2**64, scaled by the inverse power of the range's start.
    """

    _INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))

    def __init__(self, h: np.ndarray):
        one = np.ones(1, np.uint64)
        power = np.concatenate((one, np.cumprod(np.full(len(h), _BASE))))
        self.back = np.concatenate((one, np.cumprod(np.full(len(h), self._INVERSE))))
        self.total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * power[: len(h)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.total[end] - self.total[start]) * self.back[start])


def sliding(x: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (the better of two) over every run of ``width`` values, by runs of doubled width."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def leftmost(grams: np.ndarray, window: int) -> np.ndarray:
    """For every run of ``window`` values, the place of the first least one."""

    def pick(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(grams[b] < grams[a], b, a)

    return sliding(np.arange(len(grams)), window, pick)


def anchors(h: np.ndarray, k: int, window: int, need: int) -> tuple[np.ndarray, ...]:
    """Anchor positions of all windows of ``need + window - 1`` words, keys, context hashes, and first and last window."""
    n, length = len(h), need + window - 1
    if n < length:
        return (np.zeros(0, np.int64),) * 5
    with np.errstate(over="ignore"):
        ranges = Prefixes(h)
        at = np.arange(n - need + 1)
        owner = leftmost(ranges.of(at, at + k), window)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        last = np.append(first[1:], len(owner)) - 1
        pick = owner[first]
        key, context = ranges.of(pick, pick + need), ranges.of(first, last + length)
    return pick, key.view(np.int64), context.view(np.int64), first, last


def windows(h: np.ndarray, at: np.ndarray, k: int, window: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of the anchors ``at``, and the anchor of each."""
    pick, _, _, first, last = anchors(h, k, window, need)
    mine = np.isin(pick, at)
    pick, first, size = pick[mine], first[mine], (last - first + 1)[mine]
    start = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
    with np.errstate(over="ignore"):
        value = Prefixes(h).of(start, start + need + window - 1)
    return value.view(np.int64), np.repeat(pick, size)


def _hashed(known: _Hashes, text: bytes | None) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _columns(names: str, rows: list[tuple]) -> dict:
    """Columns of int64 from rows of arrays."""
    return {name: np.concatenate(c) if c else np.zeros(0, np.int64) for name, c in zip(names.split(), list(zip(*rows, strict=True)) or [()] * len(names.split()), strict=True)}


def _suffixes(docs: DataFrame, k: int, window: int, need: int) -> DataFrame:
    def run(cols: dict, n: int) -> dict:
        known, out = _Hashes(), []
        for i, row, text in zip(cols["id"], cols["row"], cols["text"], strict=True):
            pick, key, context, _, _ = anchors(_hashed(known, text), k, window, need)
            out.append((np.full(len(pick), i), np.full(len(pick), row), pick, key, context))
        return _columns("id row pos key g", out)

    return arrow_map(docs.select("id", "row", "text"), run, "id long,row long,pos long,key long,g long", binary=("text",))


def _windows(texts: DataFrame, k: int, window: int, need: int) -> DataFrame:
    """Rows (id, row, pos, key, g): each window of the anchors in the array ``at``, g its hash."""

    def run(cols: dict, n: int) -> dict:
        known, out = _Hashes(), []
        for i, row, text, at in zip(cols["id"], cols["row"], cols["text"], cols["at"], strict=True):
            g, pos = windows(_hashed(known, text), np.array(at, np.int64), k, window, need)
            out.append((np.full(len(g), i), np.full(len(g), row), pos, g, g))
        return _columns("id row pos key g", out)

    return arrow_map(texts.select("id", "row", "text", "at"), run, "id long,row long,pos long,key long,g long", binary=("text",))


def _dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with a salt, sorted by (g, salt, id, row, pos).

    A crowd is dealt out by document. Every salt of it also gets the crowd's rows of least and greatest
    hash of the document, so a text that is alone in its salt still meets another one, if there is any.
    """
    low = (1 << 24) - 1
    place = F.xxhash64("id", "row").bitwiseAND(F.lit(~low)).bitwiseOR(F.col("pos").bitwiseAND(F.lit(low)))
    rows = rows.withColumn("place", place)
    crowds = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("a"), F.max("place").alias("b")).where(f"n >= {2 * CROWD}")
    crowds = stored(crowds.select("g", "a", "b", (F.col("n") / CROWD).cast("long").alias("salts")), "crowds")
    every = F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)
    own = F.array(F.pmod(F.xxhash64("id", "row"), F.coalesce("salts", F.lit(1).cast("long"))))
    met = rows.join(crowds, "g", "left").withColumn("salt", F.explode(F.when(F.col("place").isin(F.col("a"), F.col("b")), every).otherwise(own)))
    return met.repartition("g", "salt").sortWithinPartitions("g", "salt", "id", "row", "pos")


_NEAR = ["id", "row", "pos", "id2", "row2", "pos2", "key", "g"]


def _neighbours(rows: DataFrame) -> DataFrame:
    """Rows of equal g with their nearest neighbours from other texts, before and after.

    With null in id2, row2 and pos2, the rows whose windows are still to be looked at: the first and the
    last of a group with several texts, every one of a group with a single text.
    """

    def pairs(block: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
        """block: columns g, salt, id, row, pos, sorted. Own rows, rows of mates, rows that go on."""
        n = len(block)
        edge = lambda c: np.concatenate(([True], np.any(block[1:, c] != block[:-1, c], axis=1)))
        group, text = edge([0, 1]), edge([0, 1, 2, 3])
        start = np.flatnonzero(text)
        end = np.append(start[1:], n)
        run = np.cumsum(text) - 1
        within = np.arange(n) - start[run]
        opens = group[start]
        closes = np.append(opens[1:], True)
        own, mate = [], []
        for has, step in ((~opens, -1), (~closes, 1)):
            mine = np.flatnonzero(has[run])
            other = run[mine] + step
            own.append(mine)
            mate.append(start[other] + np.minimum(within[mine], end[other] - start[other] - 1))
        alone = (opens & closes)[run]
        go = alone | (opens & ~closes)[run] & text | (closes & ~opens)[run] & np.append(text[1:], True)
        return np.concatenate(own), np.concatenate(mate), np.flatnonzero(go)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 6), np.int64)

        def done(rows: np.ndarray) -> pa.RecordBatch:
            own, mate, go = pairs(rows[:, :5], rows[:, 5])
            ids = np.concatenate((rows[own, 2:5], rows[go, 2:5]))
            far = np.concatenate((rows[mate, 2:5], np.zeros((len(go), 3), np.int64)))
            more = np.concatenate((rows[own][:, [5, 0]], rows[go][:, [5, 0]]))
            none = np.concatenate((np.zeros(len(own), bool), np.ones(len(go), bool)))
            cols = [pa.array(ids[:, i]) for i in range(3)] + [pa.array(far[:, i], mask=none) for i in range(3)] + [pa.array(more[:, i]) for i in range(2)]
            return pa.RecordBatch.from_arrays(cols, names=_NEAR)

        for batch in batches:
            rows = np.concatenate((held, np.stack([c.to_numpy() for c in batch.columns], axis=1)))
            if not len(rows):
                continue
            cut = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
            last = int(cut[-1]) + 1 if len(cut) else 0
            held = rows[last:]
            if last:
                yield done(rows[:last])
        if len(held):
            yield done(held)

    return rows.select("g", "salt", "id", "row", "pos", "key").mapInArrow(run, ", ".join(f"{c} long" for c in _NEAR))


#: Words compared at once while a match goes on.
STRIDE = 64


def _equal_after(words: list[bytes], others: list[bytes], a: int, shift: int) -> int:
    """How many words from ``a`` on are equal on a diagonal."""
    most, n = min(len(words) - a, len(others) - a - shift), 0
    while n + STRIDE <= most and words[a + n : a + n + STRIDE] == others[a + shift + n : a + shift + n + STRIDE]:
        n += STRIDE
    while n < most and words[a + n] == others[a + shift + n]:
        n += 1
    return n


def _equal_before(words: list[bytes], others: list[bytes], a: int, shift: int) -> int:
    """How many words before ``a`` are equal on a diagonal."""
    most, n = min(a, a + shift), 0
    while n + STRIDE <= most and words[a - n - STRIDE : a - n] == others[a + shift - n - STRIDE : a + shift - n]:
        n += STRIDE
    while n < most and words[a - n - 1] == others[a + shift - n - 1]:
        n += 1
    return n


def extended(words: list[bytes], others: list[bytes], a: int, b: int, shift: int, length: int) -> list[tuple[int, int]]:
    """Maximal equal ranges, of ``length`` words or more, on the diagonal ``shift`` that touch [a, b)."""
    out = []
    while a < b:
        if a + shift < 0 or a + shift >= len(others) or words[a] != others[a + shift]:
            a += 1
            continue
        s, e = a - _equal_before(words, others, a, shift), a + _equal_after(words, others, a, shift)
        if e - s >= length:
            out.append((s, e))
        a = e + 1
    return out


def repeated_passages(docs: DataFrame, length: int = 50, window: int = 30, k: int = 6) -> DataFrame:
    """Rows (doc_id, start, end, n_words, other_id, other_start): word ranges that also stand in another document.

    Ranges of one document don't overlap or touch: what any neighbour covers is put together, and the
    partner named is that of the longest part, of ties that of least id and place. Long texts are read
    whole; extra columns are not read; an empty table gives an empty one. Rows equal in id and text are one document; a null id is
    read as the greatest long in the search and null in the result; null and empty texts, and texts
    under ``length`` words, have no row. Repeats inside one document alone are not reported.
    """
    prepare(docs.sparkSession)
    need = length - window + 1
    big = 2**63 - 1
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(big)).alias("id"), F.xxhash64("text").alias("row"), "text")
    made = stored(_suffixes(rows, k, window, need), "suffixes")
    counts = stored(made.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "keys")
    met = stored(made.join(counts.select("key"), "key").select("id", "row", "pos", "key", "g"), "met")
    discard(made)
    discard(counts)
    whole = stored(_neighbours(_dealt(met)), "contexts")
    discard(met)
    go = whole.where("id2 IS NULL").select("id", "row", "pos", "key", "g")
    mixed = go.groupBy("key").agg(F.min("g").alias("a"), F.max("g").alias("b")).where("a <> b").select("key")
    places = stored(go.join(mixed, "key").groupBy("id", "row").agg(F.collect_set("pos").alias("at")), "places")
    parts = stored(_windows(rows.join(places, ["id", "row"]), k, window, need), "windows")
    discard(places)
    near = whole.where("id2 IS NOT NULL").unionByName(_neighbours(_dealt(parts)).where("id2 IS NOT NULL"))
    found = stored(near.groupBy("id", "row", "id2", "row2").agg(F.collect_set(F.struct("pos", "pos2")).alias("hits")), "neighbours")
    discard(whole)
    discard(parts)
    texts = rows.select("id", "row", "text")
    mine = found.select("id", "row").distinct()
    kept = stored(texts.join(mine, ["id", "row"], "left_semi").dropDuplicates(["id", "row"]), "texts")
    both = found.join(kept, ["id", "row"]).join(kept.select(F.col("id").alias("id2"), F.col("row").alias("row2"), F.col("text").alias("text2")), ["id2", "row2"])
    both = both.select("id", "row", "id2", "text", "text2", F.col("hits.pos").alias("pos"), F.col("hits.pos2").alias("pos2"))

    def verify(cols: dict, n: int) -> dict:
        out: dict[str, list] = {c: [] for c in ("id", "row", "start", "end", "id2", "start2")}
        for i, row, id2, text, text2, pos, pos2 in zip(*(cols[c] for c in ("id", "row", "id2", "text", "text2", "pos", "pos2")), strict=True):
            words, others = words_of(text), words_of(text2)
            lines: dict[int, list[int]] = defaultdict(list)
            for p, q in zip(pos, pos2, strict=True):
                lines[q - p].append(p)
            for shift, at in lines.items():
                end = -1
                for p in sorted(at):
                    if p < end:
                        continue
                    for s, e in extended(words, others, p, p + need, shift, length):
                        end = e
                        for c, v in zip(out.values(), (i, row, s, e, id2, s + shift), strict=True):
                            c.append(v)
        return out

    spans = arrow_map(both, verify, "id long,row long,start long,end long,id2 long,start2 long", binary=("text", "text2"))
    whole = spans.groupBy("id", "row").agg(F.collect_set(F.struct("start", "end", "id2", "start2")).alias("s"))

    def merged(cols: dict, n: int) -> dict:
        out: dict[str, list] = {c: [] for c in ("doc_id", "start", "end", "n_words", "other_id", "other_start")}
        for i, spans in zip(cols["id"], cols["s"], strict=True):
            runs: list[list[dict]] = []
            for x in sorted(spans, key=lambda x: (x["start"], -x["end"], x["id2"], x["start2"])):
                if runs and x["start"] <= runs[-1][0]["end"]:
                    runs[-1][0] = runs[-1][0] | {"end": max(runs[-1][0]["end"], x["end"])}
                    runs[-1].append(x)
                else:
                    runs.append([dict(x), x])
            for whole, *parts in runs:
                best = min(parts, key=lambda x: (x["start"] - x["end"], x["id2"], x["start2"]))
                values = (None if i == big else i, whole["start"], whole["end"], whole["end"] - whole["start"], None if best["id2"] == big else best["id2"], best["start2"])
                for c, v in zip(out.values(), values, strict=True):
                    c.append(v)
        return out

    return arrow_map(whole.select("id", "s"), merged, "doc_id long,start long,end long,n_words long,other_id long,other_start long")
