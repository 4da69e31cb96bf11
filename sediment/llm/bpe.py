"""Byte-pair encoding by forced boundaries.

A pair of adjacent bytes that occurs inside no vocabulary token is a certain cut: no token spans it,
so no merge crosses it. A text is cut at such pairs, each fragment is encoded by itself (known
fragments come from a bounded table in the worker), and the ids are concatenated.

Cuts are kept only where the library's own text splitter can't tell a fragment from the whole text:
never after white space or a control character (the splitter looks ahead there), never before an
apostrophe (contractions), never inside a character, never inside a special token.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import KEPT, arrow_map

#: Fragments longer than this are encoded each time they occur; the rest are remembered.
LONGEST_KEPT = 64
#: Fragments a worker remembers before it starts afresh.
MOST_KEPT = 400_000

#: White space outside ASCII, as UTF-8.
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: character -> byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBpe:
    """Encoder and decoder over a tokenizer file's JSON text (byte-level BPE without a normaliser)."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        model, alphabet = json.loads(spec), byte_alphabet()
        self.pieces: dict[int, bytes] = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in model["model"]["vocab"].items()}
        self.pieces |= {t["id"]: t["content"].encode() for t in model["added_tokens"]}
        inside = np.zeros((256, 256), bool)
        for piece in self.pieces.values():
            for a, b in zip(piece, piece[1:], strict=False):
                inside[a, b] = True
        cut = ~inside
        cut[:33, :] = cut[127, :] = False
        cut[:, 0x80:0xC0] = cut[:, ord("'")] = False
        self.cut = cut.reshape(-1)
        self.widths = np.zeros(max(self.pieces) + 1, np.int64)
        self.widths[list(self.pieces)] = [len(x) for x in self.pieces.values()]
        self.known: dict[bytes, bytes] = {}

    def fragments(self, text: bytes) -> list[bytes]:
        """``text`` cut at every forced boundary."""
        if len(text) < 2:
            return [text] if text else []
        b = np.frombuffer(text, np.uint8)
        at = self.cut[(b[:-1].astype(np.uint16) << 8) | b[1:]]
        for m in _WIDE_SPACE.finditer(text):
            if m.end() <= len(at):
                at[m.end() - 1] = False
        ends = (np.flatnonzero(at) + 1).tolist()
        return [text[i:j] for i, j in zip([0, *ends], [*ends, len(text)], strict=True)]

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        known, out = self.known, []
        for text in texts:
            parts = self.fragments(text)
            if missing := {p for p in parts if p not in known}:
                if len(known) > MOST_KEPT:
                    known.clear()
                    missing = set(parts)
                self._learn(missing)
            out.append(b"".join(map(known.__getitem__, parts)))
            for p in missing:
                if len(p) > LONGEST_KEPT:
                    del known[p]
        return out

    def _learn(self, parts: set[bytes]) -> None:
        """Encode new fragments. Those that start with a space are laid end to end where that makes a
        forced boundary again, encoded in one call and told apart by their lengths in bytes."""
        known, cut = self.known, self.cut
        chain = [p for p in parts if p[0] == 32 and len(p) > 1 and cut[p[-1] << 8 | 32] and (p[-1] < 128 or not _WIDE_SPACE.search(p))]
        if chain:
            ids = self.library.encode(b"".join(chain).decode(), add_special_tokens=False).ids
            ends = np.cumsum(self.widths[ids])
            at = np.searchsorted(ends, np.cumsum([len(p) for p in chain])) + 1
            raw, i = np.asarray(ids, "<u4").tobytes(), 0
            for part, j in zip(chain, at.tolist(), strict=True):
                known[part], i = raw[4 * i : 4 * j], j
        rest = list(parts.difference(chain))
        for part, enc in zip(rest, self.library.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False), strict=True):
            known[part] = np.asarray(enc.ids, "<u4").tobytes()

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8; byte runs that are no text go the library's way."""
        values = np.frombuffer(ids, "<u4").tolist()
        raw = b"".join(map(self.pieces.__getitem__, values))
        try:
            raw.decode()
        except UnicodeDecodeError:
            raw = self.library.decode(values, skip_special_tokens=False).encode()
        return raw


def _coder(spec: str) -> ForcedBoundaryBpe:
    """One coder a worker process and vocabulary, until the worker turns to another operator."""
    made = KEPT.setdefault("bpe", {})
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in made:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        made[key] = ForcedBoundaryBpe(spec)
    return made[key]


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_text: bool = True, with_ids: bool = False) -> DataFrame:
    """Rows (key, n_tokens, ids binary, decoded string) or, without ``with_text``, digests of both.

    ``with_ids`` adds the ids to the digests.

    ``path`` names a tokenizer file on the driver; its content (a vocabulary, of fixed size) goes to
    the executors. A null text counts as empty: no ids, empty decoded text. Repeated rows are encoded
    each; extra columns are ignored; an empty table gives an empty result.
    """
    with open(path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(cols: dict, n: int) -> dict:
        coder = _coder(spec.value)
        ids = coder.encode_all([t or b"" for t in cols["text"]])
        back = map(coder.decode, ids)
        out = {key: cols["key"], "n_tokens": [len(x) // 4 for x in ids]}
        if with_text:
            return out | {"ids": ids, "decoded": [x.decode() for x in back]}
        if with_ids:
            out["ids"] = ids
        return out | {"ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(x).hexdigest() for x in back]}

    shape = "ids binary,decoded string" if with_text else "ids binary," * with_ids + "ids_sha256 string,decoded_sha256 string"
    kind = docs.schema[key].dataType.simpleString().replace("bigint", "long")
    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"{key} {kind},n_tokens long,{shape}", binary=("text",), owner="bpe")
