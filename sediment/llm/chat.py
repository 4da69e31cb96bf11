"""Chat formatting with incremental black-box rendering.

The template is a function from a list of turns to a string; nothing else is known of it. Rendering
successive prefixes of a conversation and comparing each output with the one before locates every
turn's span: the part by which the output grew. A template whose longer output doesn't start with the
shorter one rewrites history, and is reported as such. Within a span the text's place is found by
rendering the same prefix with two probes in place of the last text: where the outputs first differ,
the text begins.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import arrow_map

Turn = tuple[str, str]

#: Strings that chat formats treat as control. Fixed values.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_TAILS = "|".join(sorted({re.escape(c[1:]) for c in CONTROL}))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[]\\*)\\(?={_TAILS})")


def escape(text: str) -> str:
    """Put one more backslash after the first character of anything that is, escaped or not, a control string."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    """Undo ``escape``."""
    return _UNESCAPE.sub(r"\1", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_template(turns: list[Turn]) -> str:
    """Each turn between start and end marks, its role on the first line."""
    return "".join(f"<|im_start|>{escape_role(r)}\n{escape(t)}<|im_end|>\n" for r, t in turns)


_TURN = re.compile(r"<\|im_start\|>(.*)\n([\s\S]*?)<\|im_end\|>\n")


def read_back(output: str) -> list[Turn]:
    """The turns of a text made by ``turn_template``."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(output)]


def locate(turns: list[Turn], template: Callable[[list[Turn]], str], learn: tuple[str, ...] = ("assistant",)) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]], bool]:
    """The output, each turn's span, the spans of the texts of roles in ``learn``, and whether history is rewritten.

    A rewriting template gets no spans, as no part of its output belongs to one turn for sure.
    """
    before = template([])
    spans, mask = [], []
    for k, (role, text) in enumerate(turns):
        now = template(turns[: k + 1])
        if not now.startswith(before):
            return template(turns), [], [], True
        spans.append((len(before), len(now)))
        if role in learn:
            empty = template([*turns[:k], (role, "")])
            probe = template([*turns[:k], (role, "a")]), template([*turns[:k], (role, "b")])
            at = next((i for i in range(len(before), min(map(len, probe))) if probe[0][i] != probe[1][i]), None)
            size = len(now) - len(empty)
            if at is None or size < 0 or now[:at] != empty[:at] or now[at + size :] != empty[at:]:
                return template(turns), [], [], True
            mask.append((at, at + size))
        before = now
    return before, spans, mask, False


def chat_format(conversations: DataFrame, template: Callable[[list[Turn]], str] = turn_template, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Rows (conv_id, formatted, spans, mask, rewrites): one for each conversation.

    ``spans`` and ``mask`` are flat lists of starts and ends in code points of ``formatted``. Turns go
    by turn, then role, then text; null turns come first; a null text or role counts as empty; repeated
    rows are turns of their own; a null conv_id is a conversation like any other; extra columns are not
    read; an empty table gives an empty one. A formatted conversation is one value, so its turns, however
    long, meet in one row.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    rows = whole.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))

    def run(cols: dict, n: int) -> dict:
        out: dict[str, list] = {k: [] for k in ("formatted", "spans", "mask", "rewrites")}
        for roles, texts in zip(cols["roles"], cols["texts"], strict=True):
            text, spans, mask, rewrites = locate(list(zip(roles, texts, strict=True)), template, learn)
            for k, v in zip(out, (text, [x for s in spans for x in s], [x for s in mask for x in s], rewrites), strict=True):
                out[k].append(v)
        return {"conv_id": cols["conv_id"]} | out

    return arrow_map(rows, run, "conv_id long,formatted string,spans array<long>,mask array<long>,rewrites boolean")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, loss text and their digests.

    One row for each of ``formatted``; a rewriting template has no mask, so its loss text is empty; an empty
    table gives an empty one.
    """

    def run(cols: dict, n: int) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites")}
        for text, spans, mask, rewrites in zip(cols["formatted"], cols["spans"], cols["mask"], cols["rewrites"], strict=True):
            turns = read_back(text) if rewrites else [read_back(text[a:b])[0] for a, b in zip(spans[::2], spans[1::2], strict=True)]
            loss = "".join(unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True))
            sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
            row = (len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), rewrites)
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        return {"conv_id": cols["conv_id"]} | out

    return arrow_map(formatted, run, "conv_id long,n_turns long,turns_sha256 string,loss_chars long,loss_sha256 string,formatted_chars long,rewrites boolean")
