"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text's figures are computed in its own row (no shuffle of words or lines). Ratios of these
figures go into KLL quantile sketches for every language and source; sketches merge into one for each
language and one for all. A document is held against fences of its own group: beyond the fence on any
ratio it is not kept. A fence lies ``share`` of the way from the group's median to its far percentile,
and three interquartile ranges away at least, so its distance follows the group's own spread and tail.
A group's quantiles are drawn towards its language's, and those towards all, by weight of ``prior``
rows, at every size alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sediment.llm.common import stored

#: White space that splits words.
SPACE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Rule:
    """A ratio, which side is bad, and a floor of its fence's distance for groups without any spread."""

    name: str
    value: str
    floor: float
    below: bool = False
    above: bool = True


#: The adaptive rules. A floor decides only where a group's whole range is narrower.
RULES = (
    Rule("symbols", "n_symbols / word_chars", 0.01),
    Rule("word_length", "word_chars / n_words", 0.3, below=True),
    Rule("repeats", "n_repeat_words / n_words", 0.02),
    Rule("dup_lines", "n_dup_lines / n_lines", 0.02),
    Rule("capitals", "n_capitals / n_words", 0.02),
)

#: The quantiles that fences are made of: far, lower quarter, median, upper quarter, far.
QUANTILES = (0.01, 0.25, 0.5, 0.75, 0.99)


def figures(text: Column) -> dict[str, Column]:
    """Counts of one text. Windows of three words are compared as strings; only a text in which any
    comes twice sorts its windows to find which."""
    words = F.filter(F.split(text, f"{SPACE}+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    return {
        "words": words,
        "lines": lines,
        "word_chars": F.length(text) - F.regexp_count(text, F.lit(SPACE)),
        "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")),
        "n_capitals": F.regexp_count(text, F.lit("[A-Z][A-Z]+")),
    }


def _windows(words: str) -> Column:
    """The three-word windows of an array of words, in order."""
    return F.expr(f"CASE WHEN size({words}) < 3 THEN cast(array() AS array<string>) ELSE zip_with(zip_with(slice({words}, 1, size({words}) - 2), slice({words}, 2, size({words}) - 2), (a, b) -> concat(a, ' ', b)), slice({words}, 3, size({words}) - 2), (a, b) -> concat(a, ' ', b)) END")


#: Words in windows that come twice or more: sort windows with their places, keep those equal to a
#: neighbour, count the distinct places that they cover.
_REPEATED = """
CASE WHEN size(windows) < 2 OR size(array_distinct(windows)) = size(windows) THEN 0 ELSE
  transform(array(array_sort(transform(windows, (w, i) -> named_struct('w', w, 'i', i)))), s ->
    size(array_distinct(flatten(transform(
      filter(sequence(0, size(s) - 1), k -> (k > 0 AND s[greatest(k - 1, 0)].w = s[k].w) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].w = s[k].w)),
      k -> array(s[k].i, s[k].i + 1, s[k].i + 2))))))[0]
END
"""


def measured(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals)."""
    text = F.coalesce("text", F.lit(""))
    made = docs.select("doc_id", "lang", "source", *[c.alias(n) for n, c in figures(text).items()])
    made = made.withColumn("windows", _windows("words"))
    return made.select(
        "doc_id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(_REPEATED).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.col("n_capitals").cast("long").alias("n_capitals"),
    )


def thresholds(rows: DataFrame, rules: tuple[Rule, ...] = RULES, prior: float = 100.0, share: float = 0.6, reach: float = 3.0, k: int = 400) -> DataFrame:
    """Rows (lang, source, <rule>_low, <rule>_high), one for each group of ``rows``; nulls make groups of their own.

    Sketches are made once for each language and source (partial sketches merge before the shuffle),
    then merged for each language and for all.
    """
    ratios = rows.select("lang", "source", *[F.expr(f"CASE WHEN {r.value.split('/')[1]} > 0 THEN cast({r.value} AS double) END").alias(r.name) for r in rules])
    sketches = stored(ratios.groupBy("lang", "source").agg(*[F.kll_sketch_agg_double(F.col(r.name), F.lit(k)).alias(r.name) for r in rules]), "sketches")
    merge = [F.kll_merge_agg_double(F.col(r.name), F.lit(k)).alias(r.name) for r in rules]

    def quantiles(df: DataFrame, tag: str, *keys: str) -> DataFrame:
        out = [F.col(x).alias(f"{tag}_{x}") for x in keys]
        for r in rules:
            n = F.coalesce(F.kll_sketch_get_n_double(r.name), F.lit(0))
            out.append(n.cast("double").alias(f"{tag}_{r.name}_n"))
            out.append(F.when(n > 0, F.array(*[F.kll_sketch_get_quantile_double(F.col(r.name), F.lit(p)) for p in QUANTILES])).alias(f"{tag}_{r.name}"))
        return df.select(*out)

    def drawn(own: Column, n: Column, wider: Column) -> Column:
        """``own`` quantiles of n rows and ``prior`` rows like the ``wider`` ones."""
        mixed = F.zip_with(own, wider, lambda x, y: (n * x + prior * y) / (n + prior))
        return F.coalesce(mixed, own, wider)

    a, b, c = quantiles(sketches, "a", "lang", "source"), quantiles(sketches.groupBy("lang").agg(*merge), "b", "lang"), quantiles(sketches.agg(*merge), "c")
    both = a.join(b, F.col("a_lang").eqNullSafe(F.col("b_lang")), "left").join(F.broadcast(c))
    cols = [F.col("a_lang").alias("lang"), F.col("a_source").alias("source")]
    for r in rules:
        wider = drawn(F.col(f"b_{r.name}"), F.col(f"b_{r.name}_n"), F.col(f"c_{r.name}"))
        cols.append(drawn(F.col(f"a_{r.name}"), F.col(f"a_{r.name}_n"), wider).alias(r.name))
    made = both.select(*cols)
    fences = []
    for r in rules:
        low, q1, mid, q3, high = (F.get(r.name, F.lit(i)) for i in range(len(QUANTILES)))
        middle = reach * (q3 - q1)
        fences.append((mid - F.greatest(middle, share * (mid - low), F.lit(r.floor))).alias(f"{r.name}_low"))
        fences.append((mid + F.greatest(middle, share * (high - mid), F.lit(r.floor))).alias(f"{r.name}_high"))
    return made.select("lang", "source", *fences)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, prior: float = 100.0, share: float = 0.6, reach: float = 3.0) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed) for every document.

    ``failed`` lists the adaptive rules that a document breaks. A null text has no words and fails the
    base rule; null languages and sources are groups of their own; repeated rows count and are
    reported each; a ratio without a denominator breaks no rule; long texts are measured whole; extra
    columns are not read; an empty table gives an empty one. A value equal to its fence passes.
    """
    rows = stored(measured(docs), "figures")
    limits = thresholds(rows, rules, prior, share, reach).withColumnsRenamed({"lang": "t_lang", "source": "t_source"})
    whole = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    broken = []
    for r in rules:
        value = F.expr(f"CASE WHEN {r.value.split('/')[1]} > 0 THEN cast({r.value} AS double) END")
        bad = (value > F.col(f"{r.name}_high")) if r.above else F.lit(False)
        if r.below:
            bad = bad | (value < F.col(f"{r.name}_low"))
        broken.append(F.when(bad, F.lit(r.name)))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    failed = F.concat_ws(",", *broken)
    return whole.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & (failed == "")).alias("kept"), failed.alias("failed"))
