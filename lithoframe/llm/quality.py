"""Quality rules: a threshold table compiled into one projection of built-in functions.

Every metric is a Spark expression over the whole text; no Python runs on executors and nothing is shuffled.
A null or empty text has no words, fails the base rule and is not kept. Rows come back once each, whatever repeats; an
empty table gives an empty one. Very long texts are judged whole. A column ``quality`` that ``docs`` already has stays
with :func:`keep_good`; :func:`judge` refuses it, unless its result gets another name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Symbols that count, as a character class.
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it that for on with as was be by are this from or an at "
    "der die das und in zu den von mit ist für auf nicht ein eine im des dem sich "
    "le la les de des du et en un une que qui dans pour est sur au par pas ne "
    "el los las del y que en un una por con para se es no lo su al"
)


@dataclass(frozen=True)
class Rule:
    """A text passes if ``low <= metric <= high``; None leaves that side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: Production thresholds. A ratio over nothing is null and passes.
RULES = (
    Rule("n_words", 10, None),
    Rule("mean_word_chars", 3.0, 12.0),
    Rule("symbol_ratio", None, 0.02),
    Rule("shout_ratio", None, 0.3),
    Rule("stop_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.5),
    Rule("repeat_ratio", None, 0.2),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words in 5-word windows that occur twice or more: windows sorted by hash, neighbours compared, spans united."""

    def spans(pairs: Column) -> Column:
        same = F.transform(
            pairs,
            lambda p, k: F.when((F.get(pairs, k - 1)["h"] == p["h"]) | (F.get(pairs, k + 1)["h"] == p["h"]), p["i"]),
        )
        return F.aggregate(
            F.sort_array(F.array_compact(same)),
            F.struct(F.lit(-5).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    some = F.size(F.array_distinct(windows)) < F.size(windows)  # only then is the sort paid for
    return F.when(some, _let(F.sort_array(placed), spans)).otherwise(F.lit(0).cast("long"))


def metrics(text: Column) -> Column:
    """A struct of the base counts and what the rules need, from a text that is not null."""
    stop = sorted(set(STOP_WORDS.split()))
    chars = F.char_length(text)

    def of_words(words: Column) -> Column:
        def of_codes(codes: Column) -> Column:
            five = F.transform(
                F.slice(codes, 1, F.greatest(F.size(codes) - 4, F.lit(0))),
                lambda h, i: F.xxhash64(h, *(F.get(codes, i + k) for k in range(1, 5))),
            )
            return F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                _let(five, _covered).alias("n_repeat_words"),
                F.size(F.filter(words, lambda w: F.lower(w).isin(*stop))).cast("long").alias("n_stops"),
            )

        return _let(F.transform(words, lambda w: F.xxhash64(w)), of_codes)

    counts = _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return _let(
        F.struct(counts.alias("c"), lines.alias("l")),
        lambda v: F.struct(
            *(v["c"][x].alias(x) for x in ("n_words", "word_chars", "n_repeat_words", "n_stops")),
            (chars - F.char_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (chars - F.char_length(F.replace(text, F.lit("!!"), F.lit("!")))).cast("long").alias("n_shouts"),
            F.size(v["l"]).cast("long").alias("n_lines"),
            (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
        ),
    )


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_lines", "n_dup_lines", "n_repeat_words", "n_stops")


def verdict(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one struct: the counts, the names of failed rules, the base rule and the verdict."""
    n = m["n_words"]
    value = {
        "n_words": n.cast("double"),
        "mean_word_chars": F.try_divide(m["word_chars"], n),
        "symbol_ratio": F.try_divide(m["n_symbols"], m["word_chars"]),
        "shout_ratio": F.try_divide(m["n_shouts"], n),
        "stop_ratio": F.try_divide(m["n_stops"], n),
        "dup_line_ratio": F.try_divide(m["n_dup_lines"], m["n_lines"]),
        "repeat_ratio": F.try_divide(m["n_repeat_words"], n),
    }
    failed = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (value[r.metric] < r.low)
        if r.high is not None:
            bad = bad | (value[r.metric] > r.high)
        failed.append(F.when(bad, F.lit(r.metric)))
    base = (n < 10) | (100 * m["n_repeat_words"] > 20 * n)
    return _let(
        F.struct(F.array_compact(F.array(*failed)).alias("f"), base.alias("b")),
        lambda v: F.struct(
            *(m[x].alias(x) for x in _COUNTS),
            v["f"].alias("failed"),
            v["b"].alias("base_failed"),
            (~v["b"] & (F.size(v["f"]) == 0)).alias("kept"),
        ),
    )


def judgement(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Everything about a text in one expression."""
    return _let(F.coalesce(text, F.lit("")), lambda t: _let(metrics(t), lambda m: verdict(m, rules)))


def judge(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, name: str = "quality") -> DataFrame:
    """``df`` with the struct ``name``: counts, ``failed`` (names of rules), ``base_failed`` and ``kept``."""
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"the table has a column {name} already: give the verdict another name")
    return df.withColumn(name, judgement(F.col(text), rules))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    return docs.where(judgement(F.col(text), rules)["kept"])


def query(spark, sf_dir: str) -> DataFrame:
    """One row per document with the base counts and the verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judge(docs).select("doc_id", *(F.col("quality")[x].alias(x) for x in names))


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS.split())))
#: DuckDB: rows with their metrics and verdicts, as `judged`, over a relation `src(rid, doc_id, text)`.
JUDGED_SQL = rf"""
q_word AS (SELECT rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM src),
q_win AS (
  SELECT rid, unnest(range(1, len(w) - 3)) AS i, w FROM q_word WHERE len(w) >= 5),
q_grams AS (SELECT rid, i, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS g FROM q_win),
q_twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM q_grams),
q_gap AS (SELECT rid, least(5, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -9)) AS d FROM q_twice WHERE c > 1),
q_rep AS (SELECT rid, sum(d)::BIGINT AS n_repeat_words FROM q_gap GROUP BY rid),
q_m AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(replace(t, '!!', '!')))::BIGINT AS n_shouts,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stops
  FROM q_word),
q_n AS (
  SELECT q_m.*, len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM q_m LEFT JOIN q_rep USING (rid)),
judged AS (
  SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
         NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
         AND word_chars::DOUBLE / n_words >= 3.0 AND word_chars::DOUBLE / n_words <= 12.0
         AND n_symbols::DOUBLE / word_chars <= 0.02 AND n_shouts::DOUBLE / n_words <= 0.3
         AND n_stops::DOUBLE / n_words >= 0.02
         AND n_dup_lines::DOUBLE / n_lines <= 0.5 AS kept
  FROM q_n)"""
SQL = rf"""WITH src AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), {JUDGED_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged"""
