"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

Tokens are runs of letters and digits, and runs of other visible characters; a text's features are its
hashed tokens and pairs of tokens (or longer runs, ``orders``), present or not, scaled to unit length.
Training takes a bounded sample of labelled documents, the ids with the least hash, features of whole
texts made on the executors. Scoring is one sparse dot product a document, with weights of fixed size.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import arrow_map, fold, prepare, tidy

#: Stands for a token that equals the one before it.
REPEATED = 1
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled documents that training sees; ``bits`` fixes the weights' size."""

    sample: int = 6000
    bits: int = 20
    orders: tuple[int, ...] = (1, 2)
    epochs: int = 4
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.05
    folds: int = 3
    held: int = 1


class _Hashes(dict):
    """Hash of a token, remembered up to a bound."""

    def __missing__(self, token: bytes) -> int:
        value = zlib.crc32(token)
        if len(self) < 300_000:
            self[token] = value
        return value


def features(text: bytes, orders: tuple[int, ...], bits: int, known: _Hashes) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    tokens = _TOKEN.findall(text)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    if len(h) > 1:
        h = np.append(h[:1], np.where(h[1:] == h[:-1], np.uint64(REPEATED), h[1:]))
    parts = []
    for n in orders:
        if len(h) >= n:
            mix = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                mix = (mix ^ h[i : len(h) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                mix ^= mix >> np.uint64(29)
            parts.append(mix >> np.uint64(64 - bits))
    return np.unique(np.concatenate(parts)).astype(np.int32) if parts else np.zeros(0, np.int32)


def train(rows: list[tuple[np.ndarray, int]], s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal over ``rows`` in the given order, ``s.epochs`` times."""
    size = 1 << s.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    for _ in range(s.epochs):
        for idx, y in rows:
            at = np.append(idx, size)
            x = np.full(len(at), 1 / np.sqrt(max(1, len(idx))))
            x[-1] = 1.0
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= s.l1, 0.0, -(zi - np.sign(zi) * s.l1) / ((s.beta + np.sqrt(ni)) / s.alpha + s.l2))
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / s.alpha * w
            n[at] += g * g
    w = np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))
    return w[:-1].astype(np.float32), float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Weights and bias from the labelled rows of ``docs`` outside the held-out fold.

    An id labelled more than once counts once, as 1 if at least half of its labels are 1; of several texts
    of one id that of least hash counts; null labels and ids are left out, and so are labels without a
    text's row. Without any labelled row, or with one class only, the bias alone is learnt. Null and empty
    texts have no features; long ones are read whole; extra columns are not read.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id"), s.folds) != s.held))
    one = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("y"))
    picked = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    texts = found.groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    orders, bits = s.orders, s.bits

    def run(cols: dict, n: int) -> dict:
        seen = _Hashes()
        return {"doc_id": cols["doc_id"], "y": cols["y"], "at": [features(t or b"", orders, bits, seen) for t in cols["text"]]}

    made = arrow_map(texts, run, "doc_id long,y int,at array<int>", binary=("text",)).toArrow()
    at = made["at"].combine_chunks()
    flat, ends = at.flatten().to_numpy(), at.offsets.to_numpy()
    ids, ys = made["doc_id"].to_numpy(), made["y"].to_numpy()
    order = sorted(range(len(ids)), key=lambda i: (zlib.crc32(str(ids[i]).encode()), ids[i]))
    return train([(flat[ends[i] : ends[i + 1]], int(ys[i])) for i in order], s)


def score(docs: DataFrame, weights: np.ndarray, bias: float, s: Settings = Settings(), keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) for every document.

    A null or empty text scores by the bias alone; repeated rows are scored each; a null id counts as the
    empty text in the fold; long texts are scored whole; extra columns are not read; an empty table gives
    an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    orders, bits = s.orders, s.bits

    def run(cols: dict, n: int) -> dict:
        w, known, out = sent.value, _Hashes(), []
        for text in cols["text"]:
            at = features(text or b"", orders, bits, known)
            v = bias + float(w[at].sum()) / np.sqrt(max(1, len(at)))
            out.append(float(1 / (1 + np.exp(-min(35.0, max(-35.0, v))))))
        return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": out, "predicted": [int(x >= 0.5) for x in out]}

    rows = docs.select("doc_id", "text", (fold(F.col("doc_id"), s.folds) == s.held).alias("held_out"))
    return arrow_map(rows, run, "doc_id long,held_out boolean,score double,predicted int", binary=("text",))


def accepted(docs: DataFrame, weights: np.ndarray, bias: float, s: Settings = Settings(), least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, all columns as they were, extra ones too.

    Null, empty and long texts, repeated rows and empty tables are handled as by ``score``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    orders, bits = s.orders, s.bits

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            w, known, keep = sent.value, _Hashes(), []
            for text in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist():
                at = features(text or b"", orders, bits, known)
                v = bias + float(w[at].sum()) / np.sqrt(max(1, len(at)))
                keep.append(1 / (1 + np.exp(-min(35.0, max(-35.0, v)))) >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    prepare(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
