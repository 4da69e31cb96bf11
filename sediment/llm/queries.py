"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sediment.llm import bpe, brown, chat, classifier, decontam, licenses, quality, secrets, simhash, suffix
from sediment.llm.common import table

#: The tokenizer file that op8 and the pipeline use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based n-gram score of every document, next to the unigram base."""
    return brown.score_texts(table(spark, sf_dir, "documents"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of 50 words or more that stands in more than one document."""
    return suffix.repeated_passages(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures and verdict of every document by rules that adapt to language and source."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, *classifier.fit(docs, table(spark, sf_dir, "labels")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    return bpe.bpe_encode(table(spark, sf_dir, "documents"), tokenizer_path(), with_text=False)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document: the fixed kinds and what the novelty test adds."""
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return licenses.licence_scan(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back, with one more that holds control strings."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.chat_format(own.unionByName(more)))


def op10_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of every document stands in a benchmark item's windows."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_brown": op2_brown,
    "op3_suffix": op3_suffix,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_classifier": op7_classifier,
    "op8_bpe": op8_bpe,
    "op9_chat": op9_chat,
    "op10_decontam": op10_decontam,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op9_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\2\\\3', 'g') AS safe FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(safe)) AS BIGINT) AS formatted_chars,
  FALSE AS rewrites
FROM e GROUP BY conv_id
""",
    "op10_decontam": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
k AS (SELECT item, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM k)),
p AS (SELECT r, ks.k, s, array_to_string(w[s:s + ks.k - 1], ' ') AS g
      FROM (SELECT DISTINCT k FROM win) ks, (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d) x WHERE s + ks.k - 1 <= len(w)),
m AS (SELECT p.r, p.s, p.k, win.item FROM p JOIN win ON p.k = win.k AND p.g = win.g),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS q FROM m) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)
""",
}
