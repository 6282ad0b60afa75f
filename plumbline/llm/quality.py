r"""Operator 3: quality rules, a threshold table compiled into one Spark projection.

Every metric is an expression over the text; the verdict is the conjunction of the rows of
``RULES``.  No user function runs.  Words are ``[^\x20\x09-\x0D]+``.

Repeated windows: windows are first told apart by hash, and only where hashes repeat are the
windows themselves sorted and compared, so the count is exact and the usual text cheap.

Edge cases: a null or empty text has no words, fails the base rules and isn't kept; ratios
with nothing to divide by are 0; repeated rows give repeated rows; an empty table an empty
result; columns of other names are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: Frequent words of the languages of the corpus (fixed values).
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "are", "this",
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est", "pour", "dans", "qui", "par",
    "el", "y", "los", "se", "del", "las", "por", "con", "no", "su", "para", "es",
)


@dataclass(frozen=True)
class Rule:
    """A metric and the values it may have, both ends included."""

    metric: str
    least: float | None = None
    most: float | None = None


#: The threshold table, for texts that pass the base rules.
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", None, 0.10),
    Rule("stop_word_ratio", 0.02, None),
    Rule("duplicate_line_ratio", None, 0.50),
    Rule("bullet_line_ratio", None, 0.90),
    Rule("ellipsis_line_ratio", None, 0.30),
    Rule("letter_word_ratio", 0.60, None),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _windows_hash(w: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(w) - 2)
    return F.transform(at, lambda i: F.xxhash64(F.get(w, i - 1), F.get(w, i), F.get(w, i + 1)))


def _sorted_windows(w: Column) -> Column:
    at = F.sequence(F.lit(1), F.size(w) - 2)
    window = lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i), F.get(w, i + 1))
    return F.sort_array(F.transform(at, lambda i: F.struct(window(i).alias("t"), i.alias("i"))))


def _repeated(windows: Column) -> Column:
    """Words in windows that occur twice or more.  ``windows``: a column, sorted, so that equal ones are neighbours."""
    equal = lambda x, k: F.get(windows, k)["t"].eqNullSafe(x["t"])
    twice = F.filter(windows, lambda x, k: equal(x, k - 1) | equal(x, k + 1))
    return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` with the counts and ratios that the rules use."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", text.alias("t"))
    df = df.select("doc_id", "t", F.array_remove(F.split("t", f"[{SPACE}]+"), "").alias("w"), F.split("t", "\n").alias("l"))
    df = df.select(
        "doc_id",
        "w",
        F.filter("l", lambda x: x.rlike(f"[^{SPACE}]")).alias("l"),
        F.char_length(F.regexp_replace("t", f"[{SPACE}]+", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.when(F.size("w") > 2, _windows_hash(F.col("w"))).otherwise(F.array().cast("array<bigint>")).alias("h"),
    )
    df = df.withColumn("h", F.when(F.size(F.array_distinct("h")) < F.size("h"), _sorted_windows(F.col("w"))))
    n_words, n_lines = F.size("w").cast("long"), F.size("l")
    return df.select(
        "doc_id",
        n_words.alias("n_words"),
        "word_chars",
        "n_symbols",
        (n_lines - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("h").isNull(), F.lit(0)).otherwise(_repeated(F.col("h"))).cast("long").alias("n_repeat_words"),
        n_lines.cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter("w", lambda x: x.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter("l", lambda x: x.rlike(rf"^[{SPACE}]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter("l", lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE}]*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def metrics() -> dict[str, Column]:
    c = F.col
    return {
        "mean_word_chars": _ratio(c("word_chars"), c("n_words")),
        "symbol_ratio": _ratio(c("n_symbols"), c("word_chars")),
        "stop_word_ratio": _ratio(c("n_stop_words"), c("n_words")),
        "duplicate_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
        "bullet_line_ratio": _ratio(c("n_bullet_lines"), c("n_lines")),
        "ellipsis_line_ratio": _ratio(c("n_ellipsis_lines"), c("n_lines")),
        "letter_word_ratio": _ratio(c("n_letter_words"), c("n_words")),
    }


def compiled(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression."""
    values, out = metrics(), F.lit(True)
    for r in rules:
        v = values[r.metric]
        out = out & (v >= r.least if r.least is not None else F.lit(True)) & (v <= r.most if r.most is not None else F.lit(True))
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """:func:`measure` with ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return measure(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & compiled(rules))


def _sql_rules(rules: tuple[Rule, ...]) -> str:
    tests = []
    for r in rules:
        tests += [f"{r.metric} >= {r.least}"] * (r.least is not None) + [f"{r.metric} <= {r.most}"] * (r.most is not None)
    return " AND ".join(tests)


ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT row_id, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d
), windows AS (
  SELECT row_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)
), twice AS (
  SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, s) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT row_id, count(DISTINCT i + k)::BIGINT AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY row_id
), m AS (
  SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))}))) AS n_stop_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines
  FROM w LEFT JOIN covered USING (row_id)
), r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
    CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN n_stop_words / n_words ELSE 0 END AS stop_word_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS duplicate_line_ratio,
    CASE WHEN n_lines > 0 THEN n_bullet_lines / n_lines ELSE 0 END AS bullet_line_ratio,
    CASE WHEN n_lines > 0 THEN n_ellipsis_lines / n_lines ELSE 0 END AS ellipsis_line_ratio,
    CASE WHEN n_words > 0 THEN n_letter_words / n_words ELSE 0 END AS letter_word_ratio,
    n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {_sql_rules(RULES)} AS kept
FROM r
"""
