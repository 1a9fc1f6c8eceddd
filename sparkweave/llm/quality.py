"""Quality rules: a table of thresholds compiled into one Spark projection.

No user function runs: words, lines and 3-word windows are arrays built by built-in functions
inside each row, so nothing is shuffled and a row never leaves the task that read it.

Edge cases: a null or empty text has no words and fails the base rule; repeated rows are judged
one by one; extra columns pass through :func:`judge` untouched, whatever they are called, unless they bear
the name of a measure, which is then replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import lines, whole, words

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with on by this be are from at or an a "
    "le la les de des du et un une en que qui est dans pour pas au sur avec plus "
    "der die das und zu den von mit ist nicht ein eine auf für dem im sich auch "
    "el los las y que del por con para su una es se lo como más no al"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a document only while low <= measure <= high; a bound of None is open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Lenient on purpose: clean prose of the four languages stays.
RULES = (
    Rule("mean_word_length", "mean_word_length", 2.0, 20.0),
    Rule("symbols_per_word", "symbols_per_word", None, 0.1),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
)


def _repeat_words(tokens: Column, grams: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; grams: array of struct(hash, position), sorted."""
    hits = F.transform(
        grams,
        lambda g, k: F.when(
            (F.get(grams, k - 1)["h"] == g["h"]) | (F.get(grams, k + 1)["h"] == g["h"]), g["i"]
        ),
    )
    starts = F.array_compact(hits)
    covered = F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))
    return F.size(F.array_distinct(covered)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words and n_stop_words."""
    df = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    df = df.withColumns({"words": words(F.col("text")), "lines": lines(F.col("text"))})
    w = F.col("words")
    df = df.withColumn(
        "hashes",
        F.slice(
            F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))),
            1,
            F.greatest(F.size(w) - 2, F.lit(0)),
        ),
    )
    hashes = F.col("hashes")
    df = df.withColumn(
        "grams",
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    found = {
        "n_words": F.size(w),
        "word_chars": F.length(F.concat_ws("", w)),
        "n_symbols": F.length(F.regexp_replace(whole(F.col("text")), r"[^#*$%&|<>]+", "")),
        "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": F.when(F.col("grams").isNull(), 0).otherwise(_repeat_words(w, F.col("grams"))),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(F.rtrim(x, F.lit(".,;:!?"))).isin(*STOP_WORDS))),
    }
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in found]
    return df.select(*own, *[x.cast("long").alias(c) for c, x in found.items()])


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word_length": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "stop_word_ratio": F.col("n_stop_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """All rules as one boolean Column over the measures."""
    known, ok = ratios(), F.lit(True)
    for r in rules:
        value = known.get(r.measure, F.col(r.measure))
        if r.low is not None:
            ok = ok & (value >= r.low)
        if r.high is not None:
            ok = ok & (value <= r.high)
    return ok


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with their measures, base_failed and kept."""
    df = measures(docs, text)
    return df.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & verdict(rules)
    )


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that pass, in their own columns, whatever those are called.

    A filter on kept would be pushed below the measures and repeat them inside its condition, so the verdict passes
    an explode of one element, which filters on its output don't cross.
    """
    packed = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text"))
    judged = judge(packed, rules, "_text").select("_row", F.explode(F.array("kept")).alias("kept"))
    return judged.filter("kept").select("_row.*")


#: DuckDB twin of judge() with RULES.
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, E'\n'), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS n
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
c AS (SELECT r, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls) AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(list_filter(ws, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}],
                 lower(rtrim(x, '.,;:!?'))))) AS n_stop_words
      FROM w LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, greatest(n_words, 1) AS n FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n >= 2.0 AND word_chars / n <= 20.0 AND n_symbols / n <= 0.1
       AND n_stop_words / n >= 0.02 AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AS kept
FROM b
"""
