"""Quality rules: base counts of a text, and cross-document line frequency per host.

Base rules look at one text: words, characters in words, symbols, repeated lines, and words
inside three-word windows that occur twice or more.

Line rule. Lines are normalised (lower case, runs of spaces to one, runs of digits to 0) and
hashed with their host. A line is over the limit when more than ``max_docs`` documents of its
host have it; exact copies of a text count as one document, as copies are the business of
deduplication. Lines over the limit are removed everywhere but in the host's first document
(smallest id) that has them. A document that loses more than ``max_lost`` percent of its words
is depleted and rejected.

DataFrame operations only. Counts are pre-aggregated before each shuffle; the join of line
instances with the lines over the limit is a plain join, so Spark may split a hot line.

Null texts have no words and no lines. A null host is one host. Documents that share an id
are told apart by their text; identical rows get identical verdicts. Null ids are allowed;
such a document never counts as a host's first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import SPACE, words, written

MIN_WORDS = 50
MAX_REPEATED = 50
MAX_DOCS = 20
MAX_LOST = 50
SYMBOLS = "#*$%&|<>"


def with_repeats(df: DataFrame, out: str = "n_repeat_words") -> DataFrame:
    """Adds the number of words of array column ``w`` in windows of three that occur again.

    Each window becomes one long: its hash above, its position in the low ``bits``. Sorted,
    equal windows are neighbours, so a text costs n log n and no shuffle. Hash bits go from
    54 for a text of 1,000 words to 44 for one of a million.
    """
    df = df.withColumn("bits", F.length(F.bin(F.size("w").cast("long"))))
    df = df.withColumn("s", F.expr(
        "sort_array(IF(size(w) < 3, CAST(array() AS array<bigint>), transform(sequence(0, greatest(size(w), 3) - 3), "
        "i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), bits) | CAST(i AS bigint))))"))
    df = df.withColumn("p", F.expr(
        "sort_array(transform(filter(s, (x, j) -> (j > 0 AND shiftright(x, bits) = shiftright(get(s, j - 1), bits)) "
        "OR (j + 1 < size(s) AND shiftright(x, bits) = shiftright(get(s, j + 1), bits))), "
        "x -> x & (shiftleft(1L, bits) - 1L)))"))
    covered = F.expr("aggregate(zip_with(p, slice(p, 2, size(p)), (a, b) -> least(3L, coalesce(b - a, 3L))), 0L, (t, x) -> t + x)")
    return df.withColumn(out, covered).drop("bits", "s", "p")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumn("w", words(F.col(text))).withColumn("l", lines)
    df = with_repeats(df)
    df = df.select(
        *docs.columns, F.size("w").cast("long").alias("n_words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), "n_repeat_words")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def normal(line: Column) -> Column:
    spaced = F.regexp_replace(F.btrim(F.lower(line), F.lit(SPACE)), r"[\x20\x09-\x0D]+", " ")
    return F.regexp_replace(spaced, "[0-9]+", "0")


def _line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host.isNull(), host, normal(line))


def _content(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _line_rows(docs: DataFrame) -> DataFrame:
    """One row per line with a word: id, content, position, key, words. Takes id, host, text."""
    rows = docs.select("id", "host", _content(F.col("text")).alias("content"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")))
    rows = rows.withColumn("n", F.size(words(F.col("col")))).where("n > 0")
    return rows.select("id", "content", "pos", _line_key(F.col("host"), F.col("col")).alias("key"), "n")


def lines_over(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """(key, first): the lines over the limit and the first document that has them."""
    counts = _line_rows(docs).groupBy("key").agg(F.count_distinct("content").alias("n_docs"), F.min("id").alias("first"))
    return counts.where(F.col("n_docs") > max_docs).select(F.col("key").alias("over"), "first")


def removed_lines(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """The line instances to remove: id, content, pos, n; each once."""
    gone = _line_rows(docs).join(lines_over(docs, max_docs), F.col("key") == F.col("over"))
    return gone.where(~F.col("id").eqNullSafe(F.col("first"))).select("id", "content", "pos", "n").distinct()


def _slim(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))


def _verdicts(slim: DataFrame, max_docs: int, max_lost: int) -> DataFrame:
    """Per row: id, content, the counts, kept, and the positions of the lines to remove.

    Written, so that a filter on a verdict is no reason to evaluate the counts once more.
    """
    lost = (removed_lines(slim, max_docs).groupBy("id", "content").agg(F.sum("n").alias("gone"), F.collect_set("pos").alias("at"))
            .select(F.col("id").alias("of"), F.col("content").alias("of_content"), "gone", "at"))
    base = base_counts(slim).withColumn("content", _content(F.col("text"))).drop("text", "host")
    on = F.col("id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("of_content"))
    rows = base.join(lost, on, "left").withColumn("n_removed_words", F.coalesce("gone", F.lit(0)).cast("long")).drop("of", "of_content", "gone")
    kept = ~F.col("base_failed") & (100 * F.col("n_removed_words") <= max_lost * F.col("n_words"))
    return written(rows.withColumn("kept", kept), "verdicts")


def judged(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST, id_col: str = "doc_id",
           text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, n_removed_words, kept."""
    return _verdicts(_slim(docs, id_col, text_col, host_col), max_docs, max_lost).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_removed_words", "kept")


def kept_rows(docs: DataFrame, *, max_docs: int = MAX_DOCS, max_lost: int = MAX_LOST, id_col: str = "doc_id",
              text_col: str = "text", host_col: str = "source", chars_col: str | None = None) -> DataFrame:
    """The documents that pass, with their own columns, and without the lines over the limit.

    ``chars_col`` names a column that holds the text's length; it follows a changed text.
    """
    passed = (_verdicts(_slim(docs, id_col, text_col, host_col), max_docs, max_lost).where("kept")
              .select(F.col("id").alias("of"), F.col("content").alias("of_content"), "at").dropDuplicates(["of", "of_content"]))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), _content(F.col(text_col)).alias("content"))
    rows = rows.join(passed, F.col("id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("of_content")))
    whole = F.col("row")[text_col]
    rest = F.array_join(F.filter(F.split(whole, "\n"), lambda x, k: ~F.array_contains("at", k)), "\n")
    rows = rows.select("row", "at", F.when(F.col("at").isNull(), whole).otherwise(rest).alias("left"))
    new = {text_col: F.col("left")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col("at").isNull(), F.col("row")[chars_col]).otherwise(F.length("left").cast("long"))
    return rows.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
wins AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w) x),
marked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM marked WHERE c > 1) y GROUP BY doc_id),
lines AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
own AS (SELECT doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
          regexp_replace(regexp_replace(array_to_string(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'), ' '), '[0-9]+', '0', 'g'), ' +', ' ', 'g') AS norm
        FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM own GROUP BY doc_id),
freq AS (SELECT source, norm, count(DISTINCT text) AS n_docs, min(doc_id) AS first FROM own GROUP BY source, norm),
gone AS (SELECT o.doc_id, sum(o.n) AS n FROM own o JOIN freq f ON f.source IS NOT DISTINCT FROM o.source AND f.norm = o.norm
         WHERE f.n_docs > 20 AND o.doc_id <> f.first GROUP BY o.doc_id),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
        CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN covered c ON c.doc_id = w.doc_id LEFT JOIN gone g ON g.doc_id = w.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed, n_removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_words <= 50 * n_words AS kept
FROM b
"""
