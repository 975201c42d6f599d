"""Quality rules: a threshold table compiled into one Spark projection.

Every metric is a built-in expression of the row alone, so the operator is one narrow stage: no user
function, no shuffle, and rows of any skew are equal work per character.

Defined results: a null text has no words and fails the base rules; ratios over nothing are 0; very
long texts take O(n log n); repeated rows get equal verdicts; other columns pass through untouched.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import WORD, shielded, text_of

# Frequent words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "it", "that", "for", "on", "with", "as", "was", "at", "by", "this", "be", "from", "are", "or", "an", "a",
    "le", "la", "les", "de", "du", "des", "et", "en", "un", "une", "que", "qui", "dans", "pour", "par", "sur", "au", "aux", "est",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "sich", "nicht", "auf", "dem", "ein", "eine",
    "el", "los", "las", "del", "y", "una", "con", "para", "se", "su", "al", "no", "por",
)


class Rule(NamedTuple):
    """A document passes if ``low <= metric <= high``; it is held to it from ``min_words`` words on."""

    metric: str
    low: float
    high: float
    min_words: int = 0


#: The production table. Thresholds follow common published heuristics, loosened for prose in four languages.
RULES = (
    Rule("n_words", 10, float("inf")),
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", 0.0, 0.25),
    Rule("shout_ratio", 0.0, 0.25),
    Rule("capital_ratio", 0.0, 0.5, 20),
    Rule("stop_word_ratio", 0.02, 1.0, 80),
    Rule("dup_line_ratio", 0.0, 0.5),
    Rule("bullet_line_ratio", 0.0, 0.9),
    Rule("ellipsis_line_ratio", 0.0, 0.5),
)
WINDOW = 5


def _bind(value: Column, body) -> Column:
    """``let x = value in body(x)``: the value is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words lying in windows whose hash occurs twice or more. O(n log n): sort, then look at neighbours."""

    def positions(pairs: Column) -> Column:
        size = F.size(pairs)
        same = lambda s, at: s["h"] == F.get(pairs, at)["h"]
        marked = F.transform(pairs, lambda s, k: F.struct(s["i"].alias("i"), (((k > 0) & F.coalesce(same(s, k - 1), F.lit(False))) | ((k < size - 1) & F.coalesce(same(s, k + 1), F.lit(False)))).alias("d")))
        return F.sort_array(F.transform(F.filter(marked, lambda s: s["d"]), lambda s: s["i"]))

    def total(at: Column) -> Column:
        gaps = F.transform(at, lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get(at, k - 1))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return _bind(_bind(pairs, positions), total)


def with_metrics(docs: DataFrame, text: str = "text", prefix: str = "_wg_") -> DataFrame:
    """``docs`` with the base counts and the ratios of the table, each named with ``prefix``."""
    t, n = text_of(text), F.col(f"{prefix}n_words")
    col = lambda name: F.col(f"{prefix}{name}")
    words = col("words")
    windows = F.when(F.size(words) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    letters = lambda keep: F.length(F.regexp_replace(t, keep, "")).cast("long")
    of_lines = lambda pattern: F.size(F.filter(col("lines"), lambda x: x.rlike(pattern)))
    first = docs.withColumns(
        {
            f"{prefix}words": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
            f"{prefix}lines": lines,
            f"{prefix}n_symbols": letters(r"[^#*$%&|<>]+"),
            f"{prefix}n_shouts": letters(r"[^!]+"),
            f"{prefix}n_capitals": letters(r"[^A-Z]+"),
        }
    )
    second = first.withColumns(
        {
            f"{prefix}n_words": F.size(words).cast("long"),
            f"{prefix}windows": windows,
            f"{prefix}word_chars": F.length(F.array_join(words, "")).cast("long"),
            f"{prefix}n_stop_words": F.size(F.filter(col("words"), lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
            f"{prefix}n_lines": F.size(col("lines")).cast("long"),
            f"{prefix}n_dup_lines": (F.size(col("lines")) - F.size(F.array_distinct(col("lines")))).cast("long"),
            f"{prefix}n_bullets": of_lines(r"^[\x20\x09-\x0D]*[-*•]"),
            f"{prefix}n_ellipses": of_lines(r"(\.\.\.|…)[\x20\x09-\x0D]*$"),
        }
    )
    repeated = F.when(F.size(F.array_distinct(col("windows"))) < F.size(col("windows")), _covered(col("windows"))).otherwise(0).cast("long")
    second = second.withColumn(f"{prefix}n_repeat_words", repeated)
    ratio = lambda a, b: F.when(col(b) > 0, col(a) / col(b)).otherwise(0.0)
    return second.withColumns(
        {
            f"{prefix}mean_word_chars": ratio("word_chars", "n_words"),
            f"{prefix}symbol_ratio": ratio("n_symbols", "n_words"),
            f"{prefix}shout_ratio": ratio("n_shouts", "n_words"),
            f"{prefix}capital_ratio": ratio("n_capitals", "word_chars"),
            f"{prefix}stop_word_ratio": ratio("n_stop_words", "n_words"),
            f"{prefix}dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            f"{prefix}bullet_line_ratio": ratio("n_bullets", "n_lines"),
            f"{prefix}ellipsis_line_ratio": ratio("n_ellipses", "n_lines"),
            f"{prefix}base_failed": (n < 10) | (100 * col("n_repeat_words") > 20 * n),
        }
    )


def compile_rules(rules=RULES, prefix: str = "_wg_") -> Column:
    """One boolean expression for the whole table: true where every rule holds."""
    passed = F.lit(True)
    for r in rules:
        metric = F.col(f"{prefix}{r.metric}")
        holds = (metric >= F.lit(float(r.low))) & (metric <= F.lit(float(r.high)))
        passed = passed & (holds if not r.min_words else ((F.col(f"{prefix}n_words") < r.min_words) | holds))
    return passed


@shielded
def judge(docs: DataFrame, text: str = "text", rules=RULES, prefix: str = "_wg_") -> DataFrame:
    """``docs`` with all metrics, ``base_failed`` and ``kept`` (each prefixed)."""
    return with_metrics(docs, text, prefix).withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & compile_rules(rules, prefix))


@shielded
def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns only.

    The verdict depends on the partition's number (always at least 0): a filter over an indeterminate column
    stays above the projection, which thus computes each metric once, not once per use in the condition.
    """
    verdict = F.col("_wg_kept") & (F.spark_partition_id() >= 0)
    return judge(docs, text, rules).withColumn("_wg_verdict", verdict).filter("_wg_verdict").select(*docs.columns)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines")
    return judge(docs).select("doc_id", *(F.col(f"_wg_{x}").alias(x) for x in names))


ORACLE_SQL = r"""
WITH b AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
v AS (SELECT rid, unnest(generate_series(1, len(w) - 4)) AS i, w FROM b WHERE len(w) >= 5),
g AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] AS s FROM v),
d AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, sum(least(5, coalesce(i - p, 5))) AS n FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM d) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         length(regexp_replace(t, '[^!]+', '', 'g')) AS shouts, length(regexp_replace(t, '[^A-Z]+', '', 'g')) AS capitals,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(w, lambda x: lower(x) IN (@STOP))) AS BIGINT) AS n_stop_words, CAST(len(l) AS BIGINT) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS ellipses
  FROM b LEFT JOIN r USING (rid)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_stop_words, n_lines,
       NOT base_failed AND n_words >= 10 AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND n_symbols <= 0.25 * n_words AND shouts <= 0.25 * n_words
       AND (n_words < 20 OR capitals <= 0.5 * word_chars) AND (n_words < 80 OR n_stop_words >= 0.02 * n_words)
       AND n_dup_lines <= 0.5 * n_lines AND bullets <= 0.9 * n_lines AND ellipses <= 0.5 * n_lines AS kept
FROM f
""".replace("@STOP", ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS)))
