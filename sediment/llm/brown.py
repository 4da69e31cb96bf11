"""Brown class-based n-gram scoring.

Words are lower-cased runs between white space; a text is its words and one end. The model's units are
the frequent words, the most frequent endings (which stand for all other words, unseen ones included),
one unit for the rest and one for the end of a text. Exchange clustering moves units between classes
while the class bigram likelihood of the training corpus grows, in two steps. A core (the most frequent
words; endings for the others) is clustered unit by unit from its matrix of bigrams. Then every word
seen twice or more, first in the class of its core unit, goes to the class that adds most to the
likelihood by its own counts of neighbouring classes; Spark gathers those counts and workers choose,
words side by side, and a sweep that doesn't raise the likelihood is undone. Rarer words keep the class
of their ending, as unseen words do: the neighbours of one token tell little of a word. Then

    P(w | h) = mix * P(class(w) | class(h)) * P(w | class(w)) + (1 - mix) * (c(w) + 0.5) / (N + 0.5 (V + 1))

with word counts of the whole vocabulary. In each class one outcome stands for all unseen words; its
pseudo-count is half the number of the class's words seen once, plus one half.

What is sent to the driver or broadcast is of bounded size: units are of bounded number, and counts of
words outside a bounded number of frequent ones are joined. As the factor c(w) + 0.5 stands
alone in the product, that join needs no context, only a word and how often a text holds it.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import fold, prepare, stored

#: White space becomes a space, A-Z lower case.
_TABLE = bytes(32 if b == 32 or 9 <= b <= 13 else b + 32 if 65 <= b <= 90 else b for b in range(256))


@dataclass(frozen=True)
class Settings:
    """``words`` and ``endings`` fix the core, ``frequent`` bounds the words that are units of their own.

    ``rounds`` bounds the rounds of the core's clustering, ``sweeps`` those over all words of ``least`` tokens or more.
    """

    classes: int = 48
    words: int = 1000
    endings: int = 1000
    ending_bytes: int = 4
    frequent: int = 131_072
    longest: int = 128
    rounds: int = 6
    sweeps: int = 1
    least: int = 2
    mix: float = 0.9
    prior: float = 20.0
    kept: int = 400_000


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _texts(docs: DataFrame, *more) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("text").cast("binary").alias("text"), *more)


def word_counts(train: DataFrame, s: Settings) -> DataFrame:
    """Rows (word binary, c): the count of every training word; the end of a text is the empty word.

    Each task sums in a table of bounded size and passes on partial counts.
    """
    kept = s.kept

    def run(batches):
        def rows(table: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(table), pa.binary()), pa.array(list(table.values()), pa.int64())], names=["word", "c"])

        table: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                table.update(words_of(text))
                table[b""] += 1
                if len(table) > kept:
                    yield rows(table)
                    table = Counter()
        yield rows(table)

    return _texts(train).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Units:
    """Which unit a word belongs to: itself if frequent, else its ending, else the rest; unit 0 is the end.

    ``coarse`` gives each unit's number in the core, where words after the first ``core`` are their endings.
    """

    def __init__(self, words: list[bytes], endings: list[bytes], ending_bytes: int, core: int):
        self.words = {w: i + 1 for i, w in enumerate(words)}
        self.endings = {e: len(words) + 1 + i for i, e in enumerate(endings)}
        self.tail = ending_bytes
        self.size = len(words) + len(endings) + 2
        self.memo: dict[bytes, int] = {}
        core = min(core, len(words))
        self.coarse = np.arange(self.size)
        self.coarse[len(words) + 1 :] -= len(words) - core
        for w in words[core:]:
            self.coarse[self.words[w]] = self.coarse[self.endings.get(w[-ending_bytes:], self.size - 1)]

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def of(self, words: list[bytes]) -> np.ndarray:
        """Unit numbers of ``words``."""
        memo, missing = self.memo, None
        try:
            return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            missing = [w for w in set(words) if w not in memo]
        if len(memo) > 500_000:
            memo.clear()
            missing = set(words)
        for w in missing:
            unit = self.words.get(w)
            memo[w] = self.endings.get(w[-self.tail :], self.size - 1) if unit is None else unit
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def chains(train: DataFrame, units: Units) -> DataFrame:
    """Rows (chain binary), stored: the units of each training text between two ends, 32-bit little-endian."""
    sent = train.sparkSession.sparkContext.broadcast(units)

    def run(batches):
        own = sent.value
        for batch in batches:
            found = [_chain(own, words_of(text)).astype("<i4").tobytes() for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["chain"])

    return stored(_texts(train).mapInArrow(run, "chain binary"), "chains")


def _adjacent(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Each unit of a batch of chains and the one after it, none across chains."""
    found = batch.column(0).to_pylist()
    whole = np.frombuffer(b"".join(found), "<i4").astype(np.int64)
    inside = np.ones(max(len(whole) - 1, 0), bool)
    inside[np.cumsum([len(x) // 4 for x in found])[:-1] - 1] = False
    return whole[:-1][inside], whole[1:][inside]


def _count(total: np.ndarray, code: np.ndarray) -> None:
    """Add to each place of ``total`` how often ``code`` has it."""
    place, c = np.unique(code, return_counts=True)
    total[place] += c.astype(total.dtype)


def class_pairs(held: DataFrame, at: np.ndarray, size: int) -> np.ndarray:
    """The matrix of counts of adjacent classes over all chains.

    ``at`` has each unit's class, of ``size``; with ``units.coarse`` this is the core's matrix of bigrams.
    """
    sent = held.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        cls, total = sent.value, np.zeros(size * size, np.int64)
        for batch in batches:
            first, then = _adjacent(batch)
            _count(total, cls[first] * size + cls[then])
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(total[code])], names=["code", "c"])

    found = held.mapInArrow(run, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    counts = np.zeros(size * size)
    counts[found["code"].to_numpy()] = found["c"].to_numpy()
    return counts.reshape(size, size)


def word_contexts(held: DataFrame, at: np.ndarray, k: int, words: int) -> DataFrame:
    """Rows (unit, near): what stands next to units 1 to ``words`` in all chains, ``near`` a list of (code, c).

    Of ``k`` classes, code h counts class h after the unit, k + h class h before it, 2 k the unit after itself.
    Each task sums in one array over all units and codes, whose size the bound on words fixes.
    """
    wide = 2 * k + 1
    sent = held.sparkSession.sparkContext.broadcast(at)

    def run(batches):
        cls, total = sent.value, np.zeros((words + 1) * wide, np.int32)
        for batch in batches:
            first, then = _adjacent(batch)
            left, right = (first > 0) & (first <= words), (then > 0) & (then <= words)
            twice = first[left & (first == then)]
            for code in (first[left] * wide + cls[then[left]], then[right] * wide + k + cls[first[right]], twice * wide + 2 * k):
                _count(total, code)
        found = np.flatnonzero(total)
        for i in range(0, len(found), 250_000):
            some = found[i : i + 250_000]
            columns = [(some // wide).astype(np.int32), (some % wide).astype(np.int32), total[some].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["unit", "code", "c"])

    counts = held.mapInArrow(run, "unit int, code int, c long").groupBy("unit", "code").agg(F.sum("c").alias("c"))
    return counts.groupBy("unit").agg(F.collect_list(F.struct("code", "c")).alias("near"))


def _chain(units: Units, words: list[bytes]) -> np.ndarray:
    """Units of a text's words, between two ends."""
    chain = np.zeros(len(words) + 2, np.int64)
    chain[1:-1] = units.of(words)
    return chain


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(joint: np.ndarray) -> float:
    """What exchange makes larger, of a matrix of class bigrams."""
    f = _xlogx
    return float(f(joint).sum() - f(joint.sum(0)).sum() - f(joint.sum(1)).sum())


def gains(joint: np.ndarray, r: np.ndarray, c: np.ndarray, own: float) -> np.ndarray:
    """What a unit adds to the likelihood in each class; ``joint`` is without the unit.

    ``r`` and ``c`` count the classes after and before the unit without itself, ``own`` the unit after itself.
    Class 0, the end's, takes no other unit.
    """
    f = _xlogx
    rows, cols = joint.sum(1) + c, joint.sum(0) + r
    after, before = r.nonzero()[0], c.nonzero()[0]
    right, left = joint[:, after], joint[before]
    gain = (f(right + r[after]) - f(right)).sum(1) + (f(left + c[before, None]) - f(left)).sum(0)
    diag = joint.diagonal()
    gain += f(diag + r + c + own) - f(diag + r) - f(diag + c) + f(diag)
    gain -= f(rows + r.sum() + own) - f(rows) + f(cols + c.sum() + own) - f(cols)
    gain[0] = -np.inf
    return gain


def sweep(contexts: DataFrame, at: np.ndarray, joint: np.ndarray) -> np.ndarray:
    """The class that each unit gains most by, all against the same class bigrams; at most one row a unit is collected."""
    k = len(joint)
    sent = contexts.sparkSession.sparkContext.broadcast((at, joint))

    def run(batches):
        cls, whole = sent.value
        for batch in batches:
            units, best = batch.column(0).to_pylist(), []
            for u, near in zip(units, batch.column(1).to_pylist(), strict=True):
                n = np.zeros(2 * k + 1)
                for x in near:
                    n[x["code"]] = x["c"]
                a, r, c, own = cls[u], n[:k], n[k : 2 * k], n[2 * k]
                r[a] -= own
                c[a] -= own
                rest = whole.copy()
                rest[a] -= r
                rest[:, a] -= c
                rest[a, a] -= own
                gain = gains(rest, r, c, own)
                b = int(np.argmax(gain))
                best.append(b if gain[b] > gain[a] + 1e-9 else int(a))
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.int32()), pa.array(best, pa.int32())], names=["unit", "best"])

    found = contexts.select("unit", "near").mapInArrow(run, "unit int, best int").toArrow()
    out = at.copy()
    out[found["unit"].to_numpy()] = found["best"].to_numpy()
    return out


def exchange(pairs: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each unit by exchange clustering; unit 0, the end, keeps a class of its own.

    Units start in turn by frequency. Each in turn goes to the class that adds most to
    sum n(g,h) log n(g,h) - sum n(g.) log n(g.) - sum n(.h) log n(.h), until a round moves none.
    """
    size = len(pairs)
    k = min(classes, size)
    order = sorted(range(1, size), key=lambda u: (-pairs[u].sum(), u))
    at = np.zeros(size, np.int64)
    for i, u in enumerate(order):
        at[u] = 1 + i % max(1, k - 1) if k > 1 else 0
    if k < 3:
        return at
    member = np.zeros((size, k))
    member[np.arange(size), at] = 1
    joint = member.T @ pairs @ member
    after, before = pairs @ member, (member.T @ pairs).T

    for _ in range(rounds):
        moved = 0
        for u in order:
            a, own = at[u], pairs[u, u]
            r, c = after[u].copy(), before[u].copy()
            r[a] -= own
            c[a] -= own
            if r.sum() + c.sum() + own == 0:
                continue
            joint[a] -= r
            joint[:, a] -= c
            joint[a, a] -= own
            gain = gains(joint, r, c, own)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            joint[b] += r
            joint[:, b] += c
            joint[b, b] += own
            if b != a:
                moved += 1
                at[u] = b
                after[:, a] -= pairs[:, u]
                after[:, b] += pairs[:, u]
                before[:, a] -= pairs[u]
                before[:, b] += pairs[u]
        if not moved:
            break
    return at


@dataclass
class Model:
    """What scoring needs on every executor; all of bounded size."""

    units: Units
    at: np.ndarray
    log_count: np.ndarray
    seen: np.ndarray
    unseen: np.ndarray
    end: float
    total: int
    types: int


def train_model(train: DataFrame, s: Settings) -> tuple[Model, DataFrame]:
    """The model, and the stored counts of the words that are not broadcast."""
    counts = stored(word_counts(train, s), "words")
    total, types = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    total = total or 0
    short = counts.where((F.length("word") > 0) & (F.length("word") <= s.longest))
    top = short.orderBy(F.desc("c"), "word").limit(s.frequent).toArrow()
    words, c = [bytes(w) for w in top["word"].to_pylist()], top["c"].to_numpy().astype(float)
    core = words[: s.words]
    named = train.sparkSession.createDataFrame([(bytearray(w),) for w in core] or [(bytearray(b""),)], "word binary")
    others = counts.where(F.length("word") > 0).join(F.broadcast(named), "word", "left_anti")
    ending = F.expr(f"substring(word, greatest(1, length(word) - {s.ending_bytes - 1}))")
    endings = others.groupBy(ending.alias("e")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(s.endings).collect()
    units = Units(words, [bytes(r["e"]) for r in endings], s.ending_bytes, s.words)
    held = chains(train, units)
    pairs = class_pairs(held, units.coarse, int(units.coarse.max()) + 1)
    at = exchange(pairs, s.classes, s.rounds)
    k = int(at.max()) + 1
    member = np.eye(k)[at]
    joint, at = member.T @ pairs @ member, at[units.coarse]
    clustered = int((c >= s.least).sum())
    for _ in range(s.sweeps if k > 2 and clustered else 0):
        moved = sweep(word_contexts(held, at, k, clustered), at, joint)
        then = class_pairs(held, moved, k)
        if likelihood(then) <= likelihood(joint):
            break
        at, joint = moved, then
    weight = np.array(_class_sizes(counts, units, at, k))
    n_g, v_g, once = weight.T
    unseen = 0.5 * once + 0.5
    z_g = n_g + 0.5 * v_g + unseen
    share = (n_g + 1) / (n_g.sum() + k)
    step = (joint + s.prior * share) / (joint.sum(1, keepdims=True) + s.prior)
    z = total + 0.5 * (types + 1)
    seen = np.log10(s.mix * step / z_g + (1 - s.mix) / z)
    lost = np.log10(s.mix * step * unseen / z_g + (1 - s.mix) * 0.5 / z)
    ends = counts.where(F.length("word") == 0).first()
    tail = counts.where(F.length("word") > 0).join(F.broadcast(train.sparkSession.createDataFrame(pa.table({"word": pa.array(words, pa.binary())}))), "word", "left_anti") if words else counts.where(F.lit(False))
    model = Model(units, at, np.log10(c + 0.5), seen, lost, float(ends["c"]) if ends else 0.0, total, types)
    return model, tail


def _class_sizes(counts: DataFrame, units: Units, at: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tokens, types and types seen once of each class, over the whole vocabulary."""
    sent = counts.sparkSession.sparkContext.broadcast((units, at))

    def run(batches):
        own, cls = sent.value
        for batch in batches:
            words, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            g = cls[[own.of([w])[0] if w else 0 for w in words]] if words else np.zeros(0, np.int64)
            out = [np.bincount(g, weights=x, minlength=k).astype(np.int64) for x in (c, np.ones(len(c)), c == 1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), *map(pa.array, out)], names=["g", "n", "v", "once"])

    rows = counts.select("word", "c").mapInArrow(run, "g long, n long, v long, once long").groupBy("g").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("once").alias("once")).collect()
    found = {r["g"]: (r["n"], r["v"], r["once"]) for r in rows}
    return [found.get(i, (0, 0, 0)) for i in range(k)]


_ROW = "rid long, doc_id long, held_out boolean, n long, known long, base double, score double, word binary"


def _scored(docs: DataFrame, model: Model, s: Settings) -> DataFrame:
    """One row a text (word null) with what broadcast counts give, one a text and other word.

    A word's row has its occurrences (n) and by how much the score changes if it was never seen (score).
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = _texts(docs, F.col("doc_id").cast("long").alias("doc_id"), "held_out")

    def run(batches):
        from pyspark import TaskContext

        m = sent.value
        rid = TaskContext.get().partitionId() << 33
        z = m.total + 0.5 * (m.types + 1)
        logz, log_end = math.log10(z), math.log10(m.end + 0.5)
        cut = m.seen.shape[1]
        seen, unseen = m.seen.ravel(), m.unseen.ravel()
        more = unseen - seen
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            texts, ids, held = (batch.column(i).to_pylist() for i in range(3))
            for text, doc_id, out in zip(texts, ids, held, strict=True):
                rid += 1
                words = words_of(text)
                units = _chain(m.units, words)
                chain, place = m.at[units], units[1:-1] - 1
                pair = chain[:-1] * cut + chain[1:]
                hot = place < len(m.log_count)
                logs = float(m.log_count[place[hot]].sum()) + log_end
                score = float(seen[pair].sum()) + logs
                if not m.end:
                    score = score - float(seen[pair[-1]]) - log_end + float(unseen[pair[-1]])
                row = (rid, doc_id, out, len(words) + 1, int(hot.sum()) + (m.end > 0), logs - logz * (len(words) + 1), score, None)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
                rest: dict[bytes, list] = {}
                for i in np.flatnonzero(~hot).tolist():
                    x = rest.setdefault(words[i], [0, 0.0])
                    x[0] += 1
                    x[1] += more[pair[i]]
                for w, (n, d) in rest.items():
                    for c, v in zip(cols, (rid, None, None, n, None, None, d, w), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _ROW.split(", ")])

    return rows.mapInArrow(run, _ROW)


def score_texts(docs: DataFrame, s: Settings = Settings(), folds: int = 5, held: int = 1) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    The model learns from the documents outside the held-out fold. A null or empty text is its end
    alone; repeated rows count and are scored each; a null id counts as the empty text in the fold.
    With no training text every token is unseen. Long texts are read whole; extra columns are not read; an
    empty table gives an empty one; words of equal count are ordered by their bytes.
    """
    docs = docs.select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), folds) == held)
    model, tail = train_model(docs.where(~F.col("held_out")), s)
    rows = stored(_scored(docs, model, s), "scored")
    texts = rows.where(F.col("word").isNull())
    words = rows.where(F.col("word").isNotNull()).select("rid", "n", F.col("score").alias("d"), "word")
    met = words.join(tail, "word", "left")
    known = F.col("c").isNotNull()
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5) * F.col("n")
    more = met.groupBy("rid").agg(F.sum(F.when(known, F.col("n")).otherwise(0)).alias("k"), F.sum(log_c).alias("b"), F.sum(F.when(known, log_c).otherwise(F.col("d"))).alias("s"))
    whole = texts.join(more, "rid", "left")
    return whole.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
