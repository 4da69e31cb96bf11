"""Secret scans: fixed patterns, and zstandard novelty primed with dictionaries.

Pattern spans are always reported. Besides them, every mixed string that follows a sensitive word is
a candidate. Its marginal cost is the bytes it adds to a zstandard frame whose dictionary is an
identifier list and the text around it: a name, a path or a value used elsewhere in the file costs a
few bytes, a random key nearly one byte a character. Places where the same string is a candidate too
are left out of its dictionary, so a key that follows two sensitive words doesn't vouch for itself;
a value used in other places does. Candidates that stay incompressible are reported as kind ``novel``; where a long one has a small alphabet, entropy coding alone
makes it shorter, so its limit is lowered in that measure.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame

from sediment.llm.common import arrow_map, prepare, tidy

#: Kinds in the order of ties, with their patterns and least lengths (of group 2 or of the match).
#: Fixed values.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows sensitive, and how far their reach goes in characters.
SENSITIVE = re.compile(r"(?:passw|passphrase|pwd|secret|token|api_?key|auth|bearer|credential|private|access_?key)", re.I | re.A)
REACH = 48
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")

#: Identifiers that occur in any code base; they prime every dictionary.
IDENTIFIERS = (
    "access_key access_token account api_key apikey application auth authorization base64 bearer client_id client_secret config connection "
    "credential credentials database default development environment example export file function hostname https import integer "
    "localhost object option parameter passphrase password postgres private_key production project public_key redis refresh_token "
    "region request response secret secret_key server service session_token setting signature socket string token username value version "
    "changeme placeholder your_api_key_here your_secret_here 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890abcdef"
)

_LOWER_TABLE = bytes(b | 32 if 65 <= b <= 90 else b for b in range(256))
_HEX_TABLE = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_HINTS = (b"passw", b"secret", b"token", b"api", b"passphrase", b"pwd", b"auth", b"bearer", b"credential", b"private", b"access")


class Novelty:
    """Marginal compressed bytes of a string, given the text around it."""

    def __init__(self, around: int = 2048, level: int = 12):
        self.around, self.level = around, level

    def cost(self, text: str, start: int, end: int, also: list[tuple[int, int]] = []) -> float:  # noqa: B006
        """Bytes a character that text[start:end] adds to a frame primed with its surroundings but for the places ``also``."""
        import zstandard

        first, last = max(0, start - self.around), min(len(text), end + self.around)
        cuts = sorted({(start, end), *((a, b) for a, b in also if first <= a and b <= last)})
        starts = [first, *(b for _, b in cuts)]
        near = "\n".join(text[a:b] for a, b in zip(starts, [*(a for a, _ in cuts), last], strict=True))
        primer = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + near).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        pack = zstandard.ZstdCompressor(level=self.level, dict_data=primer, write_content_size=False, write_checksum=False).compress
        lead = text[max(starts[cuts.index((start, end))], start - 32) : start].encode()
        value = text[start:end].encode()
        return (len(pack(lead + value)) - len(pack(lead))) / max(1, len(value))


#: Length from which entropy coding shortens a random value, and bits of a character of full alphabet.
LONG, BITS = 64, 6


def alphabet(value: str) -> float:
    """What a character of a random value of the same letters costs, as a share of the full alphabet's; 1 for short values."""
    return min(1.0, math.log2(max(2, len(set(value)))) / BITS) if len(value) >= LONG else 1.0


def base_spans(text: str, hints: tuple[bool, bool, bool] = (True, True, True)) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, each leftmost and non-overlapping."""
    out = []
    if hints[0]:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if hints[1]:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if hints[2]:
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(out)


def novel_spans(text: str, base: list[tuple[int, int, int]], least: float, novelty: Novelty) -> list[tuple[int, int, int]]:
    """Spans that the novelty test adds: mixed strings in sensitive context, outside the base spans."""
    found: set[tuple[int, int]] = set()
    for word in SENSITIVE.finditer(text):
        for m in CANDIDATE.finditer(text, word.start(), min(len(text), word.end() + REACH + 12)):
            a, b = m.start(), CANDIDATE.match(text, m.start()).end()
            value = text[a:b]
            mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
            if mixed and not any(s < b and a < e for s, _, e in base):
                found.add((a, b))
    places: dict[str, list[tuple[int, int]]] = {}
    for a, b in found:
        places.setdefault(text[a:b], []).append((a, b))
    kept = sorted((a, 3, b) for value, at in places.items() for a, b in at if novelty.cost(text, a, b, at) >= least * alphabet(value))
    return [x for i, x in enumerate(kept) if not any(x[2] <= y[2] for y in kept[:i])]


def find(text: bytes, least: float, novelty: Novelty) -> tuple[str, list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The text (only if it has anything), its base spans and all its spans."""
    low = text.translate(_LOWER_TABLE)
    sensitive = any(h in low for h in _HINTS)
    hints = (sensitive, b"AKIA" in text, b"h" * 16 in text.translate(_HEX_TABLE))
    if not any(hints):
        return "", [], []
    whole = text.decode()
    base = base_spans(whole, hints)
    more = novel_spans(whole, base, least, novelty) if sensitive else []
    return whole, base, sorted(base + more)


def label(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end of each span, comma-joined."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """``text`` with each run of overlapping spans replaced by one ``mark``."""
    out, last = [], 0
    for a, _, b in spans:
        if a >= last:
            out += [text[last:a], mark]
        last = max(last, b)
    return "".join([*out, text[last:]])


def secret_scan(docs: DataFrame, least: float = 0.7, around: int = 2048) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel) for every document.

    ``least`` is the cost in bytes a character from which a candidate is reported, ``around`` the
    characters of surrounding text on each side that prime its dictionary. A null or empty text has no
    spans; repeated rows are reported each; long texts are searched whole; extra columns are not read; an
    empty table gives an empty one. Offsets are code points, ends exclusive; of spans that start together
    the kinds go as listed.
    """

    def run(cols: dict, n: int) -> dict:
        novelty = Novelty(around)
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")}
        for text in cols["text"]:
            _, base, spans = find(text or b"", least, novelty)
            counts = [sum(s[1] == k for s in spans) for k in range(4)]
            row = (*counts[:3], hashlib.sha256(label(base).encode()).hexdigest(), label(spans), counts[3])
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"doc_id": cols["doc_id"]} | out

    schema = "doc_id long,n_assign long,n_access long,n_hex long,base_sha256 string,spans string,n_novel long"
    return arrow_map(docs.select("doc_id", "text"), run, schema, binary=("text",))


def redact(docs: DataFrame, least: float = 0.7, around: int = 2048, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; rows and columns stay, extra ones too, ``n_chars`` follows the text.

    Null and empty texts stay as they are; overlapping spans become one mark; repeated rows are each
    changed alike; long texts are searched whole; an empty table gives an empty one.
    """
    names = docs.columns
    prepare(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        novelty = Novelty(around)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, sizes = [], []
            for text in batch.column(at).cast(pa.binary()).to_pylist():
                whole, _, spans = find(text or b"", least, novelty)
                if not spans:
                    texts.append(text)
                    sizes.append(None)
                    continue
                new = replaced(whole, spans, mark)
                texts.append(new.encode())
                sizes.append(len(new))
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.binary()).cast(pa.string())
            if "n_chars" in names:
                j = batch.schema.get_field_index("n_chars")
                cols[j] = pa.array([o if s is None else s for o, s in zip(cols[j].to_pylist(), sizes, strict=True)], cols[j].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
