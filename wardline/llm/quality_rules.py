"""Quality rules, line first: bad lines go, then texts that lose too much go. SQL functions only.

A word is a run of characters other than ASCII white space. A text's counts and verdict depend on its own
row alone, so nothing is shuffled and a hot source costs nothing extra.

Defined results: a null or empty text has no words, counts 0, and fails (under 50 words); white space only
likewise; repeated rows give repeated results; extra columns of the input are dropped from the result of
``judge`` except ``keep``; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"[\x20\x09-\x0D]+"
FULL = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated three-word windows
# line rules
MAX_MARKS = 0.5  # symbols and exclamation marks for each word of a line
MIN_BARS = 3  # separators that make a line a menu, if at least a third of its words
SEPARATORS = r"[|>\u00BB\u00B7\u2022]"
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie(s| policy)|sign (in|up)|log ?in"
    "|subscribe|newsletter|click here|read more|share this|follow us|skip to content|enable javascript"
)
BOILERPLATE_WORDS = 12  # longer lines are prose that mentions such a phrase
MAX_LOST = 0.5  # of the characters of lines with a word


def words(text: Column) -> Column:
    """Words in order. Splitting leaves empty strings only at either end."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def line_words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(rf"{FULL}+"))


def bad_line(line: Column) -> Column:
    """Punctuation, menu and boilerplate rules; false for a line without words."""
    n = line_words(line)
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>!]"))
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    phrase = F.lower(line).rlike(BOILERPLATE) & (n <= BOILERPLATE_WORDS)
    return (n > 0) & ((marks > MAX_MARKS * n) | ((bars >= MIN_BARS) & (bars * 3 >= n)) | phrase)


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts, ``base_failed``, ``kept``, ``kept_chars`` and ``lost_lines`` of each row."""
    ids = [F.col(c) for c in keep]
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*ids, text.alias("_text"))
    rows = rows.select(
        *ids,
        words(F.col("_text")).alias("_words"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("_text", "\n"), lambda x: x.rlike(FULL)).alias("_lines"),
    )
    trigram = lambda i: F.struct(
        F.xxhash64(*(F.get("_words", i + k) for k in range(3))).alias("h"), i.alias("i")
    )
    starts = F.when(F.size("_words") >= 3, F.sequence(F.lit(0), F.size("_words") - 3))
    rows = rows.select(
        *ids,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(F.transform(starts, trigram)).alias("_sorted"),
        "_lines",
        F.filter("_lines", lambda x: ~bad_line(x)).alias("_good"),
    )
    same = lambda x, i: (F.get("_sorted", i)["h"] == x["h"])
    twice = F.filter(
        "_sorted",
        lambda x, i: F.coalesce(same(x, i + 1), F.lit(False))
        | F.coalesce(F.when(i > 0, same(x, i - 1)), F.lit(False)),
    )
    total = lambda c: F.coalesce(F.char_length(F.array_join(c, "")), F.lit(0))
    rows = rows.select(
        *ids, "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.sort_array(F.transform(twice, lambda x: x["i"])).alias("_at"),
        total("_lines").alias("_chars"),
        total("_good").cast("long").alias("kept_chars"),
        (F.size("_lines") - F.size("_good")).cast("long").alias("lost_lines"),
    )
    # a window covers three words, less what the next one covers
    cover = F.transform("_at", lambda x, j: F.least(F.lit(3), F.coalesce(F.get("_at", j + 1) - x, F.lit(3))))
    repeated = F.coalesce(F.aggregate(cover, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    rows = rows.withColumn("n_repeat_words", repeated)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    rich = F.col("kept_chars") >= (1 - MAX_LOST) * F.col("_chars")
    return rows.select(
        *ids, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & rich).alias("kept"), "kept_chars", "lost_lines",
    )


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '{FULL}+') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
      FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
n AS (SELECT r, count(DISTINCT i + x) AS c FROM p, (VALUES (0), (1), (2)) v(x) GROUP BY r),
l AS (SELECT r, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n,
        len(regexp_extract_all(x, '[#*$%&|<>!]')) AS marks,
        len(regexp_extract_all(x, '[|>\x{{BB}}\x{{B7}}\x{{2022}}]')) AS bars
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
      WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
b AS (SELECT r, x, marks > {MAX_MARKS} * n OR (bars >= {MIN_BARS} AND bars * 3 >= n)
        OR (n <= {BOILERPLATE_WORDS} AND regexp_matches(lower(x), '{BOILERPLATE}')) AS bad FROM l),
s AS (SELECT r, count(*) - count(DISTINCT x) AS dup, sum(length(x)) AS chars,
        coalesce(sum(length(x)) FILTER (NOT bad), 0) AS good, count(*) FILTER (bad) AS lost FROM b GROUP BY r),
c AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
        coalesce(n.c, 0)::BIGINT AS n_repeat_words, coalesce(chars, 0) AS chars,
        coalesce(good, 0)::BIGINT AS kept_chars, coalesce(lost, 0)::BIGINT AS lost_lines
      FROM w LEFT JOIN n USING (r) LEFT JOIN s USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND kept_chars >= {1 - MAX_LOST} * chars AS kept, kept_chars, lost_lines FROM f
"""
