"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Every measure is a DataFrame expression over the whole text, so a document is judged where it was read: no shuffle, no
Python. Windows of words are compared by 64-bit hashes, so a text of a million words has a false repeat with a probability
of some 3 in 100 million. Texts of any length are read whole. A null text has no words. Extra columns of the input, whatever
their names, pass through ``keep_good`` unchanged and are ignored by ``measure``. Repeated rows are judged one by one; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.staging import filter_here, table

#: Frequent function words of English, German, French and Spanish, as written in the middle or at the start of a sentence.
STOP_WORDS = (
    "a and are as at be by for from had have he in is it not of on or that the this to was were which with you "
    "als auch auf aus bei das dem den der des die ein eine einer für im ist mit nicht sich sie und von zu "
    "au aux ce dans de des du elle en est et il la le les par pas pour que qui se sur un une "
    "al como con del el ella es esta las lo los más no o para pero por se su sus una y"
).split()

#: White space that parts words, and symbols that prose rarely holds.
SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Words of a window, a power of two.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``; None leaves a side open."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: A document fails the base with fewer words, or a larger share (in hundredths) of words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30

RULES = (
    Rule("length", "n_words", None, 1_000_000),
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("stop_words", "stop_ratio", 0.02, None),
    Rule("word_runs", "run_ratio", None, 0.25),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.60),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.90),
    Rule("cut_lines", "ellipsis_line_ratio", None, 0.30),
)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the ascending ``starts``."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("end"))
    step = lambda a, p: F.struct((a["total"] + F.least(F.lit(WINDOW), p + WINDOW - a["end"])).cast("long").alias("total"), (p + WINDOW).cast("long").alias("end"))
    return F.aggregate(starts, zero, step, lambda a: a["total"])


def _measured(docs: DataFrame, text_col: str) -> DataFrame:
    """``row`` holds the input's columns and ``m`` the measures. Steps that several expressions read are projections of their own, so that each runs once."""
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    df = df.select("row", "t", _words(F.col("t")).alias("words"), F.filter(F.split("t", "\n"), lambda x: F.translate(x, SPACE, "") != "").alias("lines"))
    # the hash of a window of 1, 2, 4, 8 words from those of its halves; what reaches beyond the last word is cut off
    df, last = df.select("*", F.transform("words", lambda w: F.xxhash64(w)).alias("h1")), "h1"
    for k in (1 << i for i in range(WINDOW.bit_length() - 1)):
        both = F.zip_with(last, F.slice(last, F.lit(1 + k), F.size(last)), lambda a, b: F.xxhash64(a, b))
        df, last = df.select(*[c for c in df.columns if c != last], both.alias(f"h{2 * k}")), f"h{2 * k}"
    none = F.array().cast("array<bigint>")
    df = df.select(*[c for c in df.columns if c != last], F.when(F.size(last) >= WINDOW, F.slice(last, F.lit(1), F.greatest(F.size(last) - (WINDOW - 1), F.lit(0)))).otherwise(none).alias("grams"))
    ranked = F.sort_array(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.select("*", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), ranked).alias("ranked")).drop("grams")
    # a window is repeated if its neighbour in the sorted list has the same hash
    twice = F.filter("ranked", lambda x, k: F.coalesce(F.get("ranked", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("ranked", k + 1)["h"] == x["h"], F.lit(False)))
    df = df.select("*", F.coalesce(_covered(F.sort_array(F.transform(twice, lambda x: x["i"].cast("long")))), F.lit(0)).cast("long").alias("n_repeat_words")).drop("ranked")
    stops = F.size(F.filter("words", lambda w: F.translate(w, ".,;:", "").isin(*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS])))
    runs = F.size(F.filter("words", lambda w, i: w == F.get("words", i - 1)))
    share = lambda f: F.size(F.filter("lines", f))
    df = df.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").alias("n_lines"),
        stops.alias("n_stops"),
        runs.alias("n_runs"),
        share(lambda x: F.ltrim(x).rlike("^[-*•·]")).alias("n_bullets"),
        share(lambda x: F.rtrim(x).rlike("(\\.\\.\\.|…)$")).alias("n_cut"),
    )
    per = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return df.select(
        "row",
        F.struct(
            *COUNTS,
            per("word_chars", "n_words").alias("mean_word_chars"),
            per("n_symbols", "n_words").alias("symbol_ratio"),
            per("n_stops", "n_words").alias("stop_ratio"),
            per("n_runs", "n_words").alias("run_ratio"),
            per("n_dup_lines", "n_lines").alias("dup_line_ratio"),
            per("n_bullets", "n_lines").alias("bullet_line_ratio"),
            per("n_cut", "n_lines").alias("ellipsis_line_ratio"),
        ).alias("m"),
    )


def compile_rules(rules: tuple[Rule, ...], metrics: str) -> Column:
    """The rules as one boolean expression over the struct column ``metrics``."""
    parts = [F.lit(True)]
    for r in rules:
        m = F.col(f"{metrics}.{r.metric}")
        parts += [m >= F.lit(r.low)] if r.low is not None else []
        parts += [m <= F.lit(r.high)] if r.high is not None else []
    return reduce(lambda a, b: a & b, parts)


def base_failed(metrics: str) -> Column:
    return (F.col(f"{metrics}.n_words") < MIN_WORDS) | (F.col(f"{metrics}.n_repeat_words") * 100 > F.col(f"{metrics}.n_words") * MAX_REPEAT_PERCENT)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row: its id, all measures, ``base_failed`` and ``kept`` (the base holds and every rule passes)."""
    df = _measured(docs, text_col)
    bad = base_failed("m")
    return df.select(F.col(f"row.`{id_col}`").alias(id_col), "m.*", bad.alias("base_failed"), (~bad & compile_rules(rules, "m")).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with the input's columns."""
    df = _measured(docs, text_col)
    return filter_here(df, ~base_failed("m") & compile_rules(rules, "m")).select("row.*")


# the query ------------------------------------------------------------------------------------------------------------


def op8_quality_rules(spark, sf_dir):
    return measure(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")


def _sql() -> str:
    """The same in DuckDB SQL, written over positions instead of sorted lists."""
    stops = ", ".join(f"'{w}'" for x in STOP_WORDS for w in (x, x.capitalize()))
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    rule = " AND ".join(" AND ".join(x) for r in RULES if (x := [f"{r.metric} {s} {v}" for s, v in ((">=", r.low), ("<=", r.high)) if v is not None]))
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: translate(x, {space}, '') <> '') AS lines FROM d),
g AS (SELECT k, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS gram FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS u(i)),
p AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT k, sum(least({WINDOW}, i - coalesce(prev, -100))) AS n FROM (SELECT k, i, lag(i) OVER (PARTITION BY k ORDER BY i) AS prev FROM p) GROUP BY k),
m AS (SELECT w.k, doc_id, len(words)::BIGINT AS n_words, length(translate(t, {space}, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: translate(x, '.,;:', '') IN ({stops}))) AS n_stops,
             len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_runs, len(lines) AS n_lines,
             len(list_filter(lines, lambda x: regexp_matches(ltrim(x), '^[-*•·]'))) AS n_bullets,
             len(list_filter(lines, lambda x: regexp_matches(rtrim(x), '(\\.\\.\\.|…)$'))) AS n_cut
      FROM w LEFT JOIN c ON w.k = c.k),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
             n_stops / greatest(n_words, 1) AS stop_ratio, n_runs / greatest(n_words, 1) AS run_ratio,
             n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_bullets / greatest(n_lines, 1) AS bullet_line_ratio,
             n_cut / greatest(n_lines, 1) AS ellipsis_line_ratio,
             n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, {", ".join(COUNTS)}, base_failed, NOT base_failed AND {rule} AS kept FROM r"""


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL = {"op8_quality_rules": _sql()}
