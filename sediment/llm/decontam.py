"""Benchmark decontamination with a generalised suffix automaton.

The test items' words become the transitions of one automaton. A document's words stream through it
while the longest matching length is tracked; where it reaches the window length (or the whole of a
shorter item) the matched words are hit. Stretches without enough consecutive known word pairs can't
hold a window, so the automaton only runs over the others; the pair table may err towards running.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import LOWER, UPPER, arrow_map, prepare, tidy

#: Words of items that one automaton may hold; more items go to further automata.
BLOCK_WORDS = 1_000_000

#: Bytes that are no part of a word become spaces, A-Z become lower case.
_WORD_BYTES = bytes(b if b >= 0x80 or chr(b) in LOWER + "0123456789" else ord(chr(b).lower()) if chr(b) in UPPER else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and characters outside ASCII."""
    return text.translate(_WORD_BYTES).split()


class Automaton:
    """Generalised suffix automaton over items, each a list of word ids."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.names: list[str] = []
        rows, pairs = [], set()
        for name, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                self.names.append(name)
                rows.append(ids)
                pairs.update(zip(ids, ids[1:], strict=False))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.least = min((min(len(r), window) for r in rows), default=0)
        #: A hashed table of known pairs; a false positive only costs a walk.
        self.bits = 22
        self.pairs = np.zeros(1 << self.bits, bool)
        if pairs:
            a = np.array(list(pairs), np.uint64)
            self.pairs[self._slot(a[:, 0], a[:, 1])] = True
        self._mark(rows)

    def _slot(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _new(self, size: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the longest string that reaches ``q`` from ``p`` by ``c``."""
        if self.size[p] + 1 == self.size[q]:
            return q
        clone = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        cur, p = self._new(self.size[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, self.next[p][c], c)
        return cur

    def _mark(self, rows: list[list[int]]) -> None:
        """Which items hold each state's strings, and which short items end at each state."""
        self.items: list[list[int]] = [[] for _ in self.size]
        self.short: list[tuple[tuple[int, int], ...]] = [()] * len(self.size)
        own: list[list[tuple[int, int]]] = [[] for _ in self.size]
        for k, ids in enumerate(rows):
            s = 0
            for c in ids:
                s = self.next[s][c]
                t = s
                while t > 0 and (not self.items[t] or self.items[t][-1] != k):
                    self.items[t].append(k)
                    t = self.link[t]
            if len(ids) < self.window:
                own[s].append((len(ids), k))
        for s in sorted(range(len(self.size)), key=self.size.__getitem__):
            self.short[s] = tuple(own[s]) + (self.short[self.link[s]] if s else ())
        #: The state of the window-long suffix of what a state stands for.
        self.at: list[int] = [0] * len(self.size)
        for s in sorted(range(len(self.size)), key=self.size.__getitem__):
            if self.size[s] >= self.window:
                self.at[s] = s if self.size[self.link[s]] < self.window else self.at[self.link[s]]

    def stretches(self, words: list[bytes]) -> tuple[list[int], list[tuple[int, int]]]:
        """Word ids (-1: in no item) and the word ranges that may hold a window."""
        if not self.names or len(words) < self.least:
            return [], []
        ids = np.fromiter(map(self.vocab.get, words, _NONE), np.int64, len(words))
        known = ids >= 0
        if self.least > 1:
            pair = known[:-1] & known[1:]
            u = ids.astype(np.uint64)
            pair &= self.pairs[self._slot(u[:-1], u[1:])]
            extra, need, mask = 1, self.least - 1, pair
        else:
            extra, need, mask = 0, 1, known
        edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).view(np.int8)))
        a, b = edge[::2], edge[1::2]
        keep = b - a >= need
        if not keep.any():
            return [], []
        return ids.tolist(), list(zip(a[keep].tolist(), (b[keep] + extra).tolist(), strict=True))

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word ranges inside any occurrence of a window, and the items met."""
        ids, ranges = self.stretches(words)
        spans: list[list[int]] = []
        found: set[int] = set()
        nxt, link, size, window = self.next, self.link, self.size, self.window
        for start, end in ranges:
            state = length = 0
            for i in range(start, end):
                c = ids[i]
                while state and c not in nxt[state]:
                    state = link[state]
                    length = size[state]
                if c in nxt[state]:
                    state, length = nxt[state][c], length + 1
                n = 0
                if length >= window:
                    n = window
                    found.update(self.items[self.at[state] if size[state] >= window else state])
                for m, k in self.short[state]:
                    if m <= length:
                        found.add(k)
                        n = max(n, m)
                if n:
                    if spans and i - n + 1 <= spans[-1][1]:
                        spans[-1] = [min(spans[-1][0], i - n + 1), i + 1]
                    else:
                        spans.append([i - n + 1, i + 1])
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        return [(a, b) for a, b in merged], {self.names[k] for k in found}


class _Nones:
    def __iter__(self) -> Iterator[int]:
        while True:
            yield -1


_NONE = _Nones()


def automata(benchmark: DataFrame, window: int, block_words: int = BLOCK_WORDS) -> list[Automaton]:
    """Automata over all items, each of ``block_words`` words at most (or one item).

    Items are streamed from Spark in order of id, a partition at a time; items with no word are left out.
    """
    made, block, n = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("k"), F.coalesce("text", F.lit("")).cast("binary").alias("t")).orderBy("k", "t")
    for row in rows.toLocalIterator():
        words = words_of(bytes(row["t"]))
        if block and n + len(words) > block_words:
            made.append(Automaton(block, window))
            block, n = [], 0
        block.append((row["k"] if row["k"] is not None else "", words))
        n += len(words)
    return [*made, Automaton(block, window)] if block else made


def scan(text: bytes, blocks: list[Automaton]) -> tuple[list[bytes], list[tuple[int, int]], set[str]]:
    """A text's words, the word ranges hit by any block, and the items met."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    items: set[str] = set()
    for block in blocks:
        more, met = block.hits(words)
        spans += more
        items |= met
    if len(blocks) > 1:
        merged: list[tuple[int, int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
            else:
                merged.append((a, b))
        spans = merged
    return words, spans, items


def cleaned(text: bytes, blocks: list[Automaton], limit: float) -> tuple[bytes | None, int, int]:
    """The text without hit spans, its words and hit words; None where more than ``limit`` is hit.

    A cut leaves a line break. Words that come together by it are scanned again until none is hit.
    """
    words, spans, _ = scan(text, blocks)
    n, hit = len(words), sum(b - a for a, b in spans)
    if n and hit > limit * n:
        return None, n, hit
    while spans:
        plain = text.translate(_WORD_BYTES)
        b = np.frombuffer(plain, np.uint8) != 32
        edge = np.flatnonzero(np.diff(np.concatenate(([False], b, [False])).view(np.int8))).tolist()
        starts, ends = edge[::2], edge[1::2]
        out, last = [], 0
        for a, z in spans:
            out.append(text[last : starts[a]].rstrip(b" "))
            last = ends[z - 1]
        text = b"\n".join([*out, text[last:].lstrip(b" ")])
        _, spans, _ = scan(text, blocks)
    return text, n, hit


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans) for every document.

    A null or empty text has no words; repeated rows are reported each; with no items nothing is hit;
    long texts are read whole; extra columns are not read; an empty table gives an empty one. Null items
    have no words. Items with equal id count once. The automata are broadcast in blocks of bounded words.
    """
    blocks = docs.sparkSession.sparkContext.broadcast(automata(benchmark, window, block_words))

    def run(cols: dict, n: int) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
        for text in cols["text"]:
            words, spans, items = scan(text or b"", blocks.value)
            hit = sum(b - a for a, b in spans)
            row = (len(words), hit, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), hit > 0, ",".join(f"{a}:{b}" for a, b in spans))
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": cols["doc_id"]} | out

    schema = "doc_id long,n_words long,n_hit long,n_items long,items_sha256 string,contaminated boolean,spans string"
    return arrow_map(docs.select("doc_id", "text"), run, schema, binary=("text",))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, limit: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with hit spans cut out, documents of which more than ``limit`` is hit dropped.

    All columns of ``docs`` stay, extra ones too; ``n_chars``, where there is one, follows the new text.
    Documents without a hit keep their text unchanged, null and empty ones included; repeated rows are
    each cleaned alike; long texts are read whole; an empty table, or no items, changes nothing.
    """
    blocks = docs.sparkSession.sparkContext.broadcast(automata(benchmark, window, block_words))
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            keep, texts, sizes = [], [], []
            for i, text in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                new, _, hit = cleaned(text or b"", blocks.value, limit)
                if new is not None:
                    keep.append(i)
                    texts.append(text if not hit else new)
                    sizes.append(len(new.decode()) if hit else None)
            part = batch.take(pa.array(keep, pa.int64()))
            cols = list(part.columns)
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in names:
                j = batch.schema.get_field_index("n_chars")
                old = cols[j].to_pylist()
                cols[j] = pa.array([o if s is None else s for o, s in zip(old, sizes, strict=True)], cols[j].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    prepare(docs.sparkSession)
    return docs.mapInArrow(tidy(run), docs.schema)
