"""Stream patterns: ``*`` stands for one segment, ``**`` for any number of them, else segments are literal."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from sediment.model import SYSTEM, InvalidPattern


def matches(pattern: str, stream_id: str) -> bool:
    """Whether ``stream_id`` matches, on the driver."""
    return _compiled(pattern).match("/" + stream_id) is not None


def to_regex(pattern: str) -> str:
    """The regular expression, for ``'/' || stream_id``, that the pattern stands for."""
    out = []
    for part in pattern.split("/"):
        out.append(r"(?:/[^/]+)*" if part == "**" else r"/[^/]+" if part == "*" else "/" + re.sub(r"([^\w/])", r"\\\1", part))
    return "^" + "".join(out) + "$"


@lru_cache(1024)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(to_regex(pattern)[:-1] + r"\Z")


def specificity(pattern: str) -> int:
    """Number of leading literal segments."""
    n = 0
    for part in pattern.split("/"):
        if part in ("*", "**"):
            break
        n += 1
    return n


def overlap(a: str, b: str) -> bool:
    """Whether two patterns may match one stream; any ``**`` counts as an overlap."""
    x, y = a.split("/"), b.split("/")
    if "**" in x or "**" in y:
        return True
    return len(x) == len(y) and all(p == q or "*" in (p, q) for p, q in zip(x, y, strict=True))


def validate_pattern(pattern: str) -> str:
    """No empty pattern, slash at an edge, white space or quote."""
    if not pattern or pattern[0] == "/" or pattern[-1] == "/" or re.search(r"[\s'\"`]", pattern):
        raise InvalidPattern(pattern)
    return pattern


def matching(stream: Column, pattern: str) -> Column:
    """Predicate for a stream column.

    Literal leading segments become a prefix or an equality, which file statistics can use; the
    regular expression runs only where wildcards remain. ``**`` alone needs no test.
    """
    parts = pattern.split("/")
    n = specificity(pattern)
    head = "/".join(parts[:n])
    rest = parts[n:]
    if not rest:
        return stream == head
    if parts == ["**"]:
        return stream.isNotNull()
    exact = F.concat(F.lit("/"), stream).rlike(to_regex(pattern))
    if not n:
        return exact
    if rest == ["**"]:
        return (stream == head) | stream.startswith(head + "/")
    if all(p == "**" for p in rest):
        return (stream == head) | stream.startswith(head + "/")
    if rest[0] == "**":
        return stream.startswith(head) & exact
    return stream.startswith(head + "/") & exact


def is_system(stream: Column) -> Column:
    """Whether the engine itself writes the stream."""
    return stream.startswith(SYSTEM + "/")


def hidden(stream: Column) -> Column:
    """Whether a stream is left out of subscriptions that don't ask for it: a leading underscore."""
    return stream.startswith("_")


def hub_name(stream: Column, source: str) -> Column:
    """A stream's name in a hub: as it is if already under ``source``, else put there."""
    return F.when(stream.startswith(source + "/"), stream).otherwise(F.concat(F.lit(source + "/"), stream))
