"""Headline polarity with phrases, case and punctuation.

On top of the look-back rules of ``sentiment`` (boosters and negations in the three words before)
this follows the rest of the lexicon-and-rules scheme of Hutto & Gilbert (2014):

- lexicon entries may have up to ``MAX_WORDS`` words; runs of words join the lexicon, and of
  overlapping hits the longer one counts (of equally long ones the earlier): an idiom
  replaces the valences of its words;
- a hit in capitals, in a headline that isn't all capitals, gains ``CAPS_INCR``;
- hits before the first contrast word weigh half, those after it one and a half;
- exclamation and question marks amplify the headline's sum in its own direction.

The lexicon is an input table of any size, ``(token, valence)`` in any case; entries with more than
``MAX_WORDS`` words fail the job rather than match nothing. Null and empty titles have polarity 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.operators import phrase_packs
from barlake.operators.phrase_packs import MAX_WORDS
from barlake.operators.sentiment import (BOOST_DECR, BOOST_INCR, BOOSTERS_DOWN, BOOSTERS_UP, DISTANCE_DECAY, NEGATION_SCALAR,
                                         NEGATIONS, NORMALIZE_ALPHA)
from barlake.session import ship, small_batches, staged

# fixed values: rule constants of the scheme
CAPS_INCR = 0.733
BEFORE_CONTRAST, AFTER_CONTRAST = 0.5, 1.5
EXCLAMATION_INCR, EXCLAMATION_MAX = 0.292, 4
QUESTION_INCR, QUESTION_MAX, QUESTION_MANY = 0.18, 3, 0.96
# fixed values: contrast words
CONTRASTS = ["but", "aber", "pero", "mais"]
# codes of the words before a hit
_PLAIN, _NEGATION, _UP, _DOWN = range(4)
_TURN = 4  # with a code: a contrast word
TABLE_BITS = 28
#: Bits of the table that spares runs outside the lexicon the join; full, it spares none.
FILTER_BITS = 1 << 24


def words(text: Column) -> Column:
    """Words of a text in their own case: runs of letters."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}]+"), lambda t: t != "")


def phrase_lexicon(lexicon: DataFrame) -> DataFrame:
    """token (lower-case words joined by a blank), n_words, valence; of several valences the largest."""
    parts = words(F.lower("token"))
    n = F.size(parts)
    checked = F.when(n > MAX_WORDS, F.raise_error(F.concat(F.lit("lexicon entry too long: "), F.col("token"))).cast("int")).otherwise(n)
    rows = lexicon.select(F.array_join(parts, " ").alias("token"), checked.alias("n_words"), F.col("valence").cast("double").alias("valence"))
    return rows.where(F.col("n_words") > 0).groupBy("token", "n_words").agg(F.max("valence").alias("valence"))


def emphasis(title: Column) -> Column:
    """What the marks of a headline add to its sum."""
    count = lambda mark: F.length(title) - F.length(F.replace(title, F.lit(mark), F.lit("")))
    marks, asks = count("!"), count("?")
    ask = F.when(asks <= 1, 0.0).when(asks <= QUESTION_MAX, asks * QUESTION_INCR).otherwise(QUESTION_MANY)
    return F.least(marks, F.lit(EXCLAMATION_MAX)) * EXCLAMATION_INCR + ask


def _table(blobs: DataFrame, *more: type) -> phrase_packs.Table:
    """A bit table of the blobs' hashes with 16 bits and more for each, up to 2 ** TABLE_BITS; full, it lets all through."""
    n = blobs.agg(F.sum("n")).first()[0] or 0
    bits = min(TABLE_BITS, max(16, (16 * n).bit_length()))
    rows = blobs.select("b", "n", "data").repartition("b").sortWithinPartitions("b")
    return phrase_packs.Table(bits, [tuple(r) for r in rows.mapInArrow(lambda it: phrase_packs.table_slices(it, bits, *more), "b int, data binary").collect()])


def _maybe_listed(token: Column, lex: DataFrame) -> Column:
    """False for most tokens that ``lex`` lacks, true for all that it has: a test of FILTER_BITS bits."""
    n = FILTER_BITS // 64
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    at = lex.select(slot(F.col("token")).alias("slot"))
    some = at.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(bit(F.col("slot"))).alias("bits"))
    words = some.sparkSession.range(n).join(some, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    table = words.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("w")).select("w.bits").scalar()
    return F.get(table, F.shiftright(slot(token), 6).cast("int")).bitwiseAND(bit(slot(token))) != 0


def _longest(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which hits (places in order, words; one a place) no overlapping hit beats: a longer one, or an equally long one that starts earlier."""
    beaten = np.zeros(len(at), bool)
    for d in range(1, MAX_WORDS):
        met = at[:-d] + size[:-d] > at[d:]
        beaten[d:] |= met & (size[:-d] >= size[d:])
        beaten[:-d] |= met & (size[d:] > size[:-d])
    return ~beaten


class _Hits:
    """The hits (hash, valence) of a pack, by word number and by hash."""

    def __init__(self, distinct: np.ndarray, known: np.ndarray, valence: np.ndarray):
        self.known, self.valence = known, valence
        self.shift = np.uint64(64 - phrase_packs.NEAR_BITS)
        self.near = np.zeros(1 << phrase_packs.NEAR_BITS, bool)
        self.near[(known >> self.shift).astype(np.int64)] = True
        single, value = self.met(phrase_packs.run_hashes(distinct, 1))
        self.size, self.value = np.zeros(len(distinct), np.int8), np.zeros(len(distinct))
        self.size[single], self.value[single] = 1, value

    def met(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the runs are hits, and their valences."""
        at = np.nonzero(self.near[(found >> self.shift).astype(np.int64)])[0]
        of = np.minimum(np.searchsorted(self.known, found[at]), len(self.known) - 1)
        same = self.known[of] == found[at]
        return at[same], self.valence[of[same]]


def _sums(hits: _Hits, distinct: np.ndarray, code: np.ndarray, number: np.ndarray, caps: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, sum of the scores, whether it is null) of the rows with a hit."""
    row, end = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    size, v = hits.size[number], hits.value[number]
    for k, found, at in phrase_packs.runs(distinct[number], row):  # of the hits of a place the longest
        if k > 1:
            hit, value = hits.met(found)
            size[at[hit]], v[at[hit]] = k, value
    size, code = size.astype(np.int64), code[number]
    at = np.nonzero(size)[0]
    at = at[_longest(at, size[at])]
    size, v, row = size[at], v[at], row[at]
    loud = np.concatenate([[0], np.cumsum(caps)])
    begin = end - sizes
    mixed = (loud[end] - loud[begin] < sizes)[row]
    null = v.view(np.uint64) == np.array(phrase_packs.NULL).view(np.uint64)
    score = v + np.where(mixed & (loud[at + size] - loud[at] == size), np.sign(v) * CAPS_INCR, 0.0)
    for d in (1, 2, 3):
        c = np.where(at - d >= begin[row], code[np.maximum(at - d, 0)] & 3, _PLAIN)
        step = np.where(c == _UP, BOOST_INCR * DISTANCE_DECAY[d - 1], np.where(c == _DOWN, BOOST_DECR * DISTANCE_DECAY[d - 1], 0.0))
        boosted = score + step * np.sign(score)
        score = np.where(c == _NEGATION, boosted * NEGATION_SCALAR, boosted)
    turn = np.full(len(sizes), -1)
    turns = np.nonzero(code & _TURN)[0][::-1]
    turn[np.searchsorted(end, turns, "right")] = turns
    turn = turn[row]
    score *= np.where(turn < 0, 1.0, np.where(at < turn, BEFORE_CONTRAST, np.where(at > turn, AFTER_CONTRAST, 1.0)))
    rows, first = np.unique(row, return_index=True)
    if not len(rows):
        return rows, np.zeros(0), np.zeros(0, bool)
    return rows, np.add.reduceat(np.where(null, 0.0, score), first), np.logical_and.reduceat(null, first)


def _scored(batches: Iterator[pa.RecordBatch], table: phrase_packs.Table, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(keep, compound) of the packs' rows with a hit, from rows (pack, b, n, data): a pack (b = -1) and then its hits."""
    data, parts = None, []

    def scored() -> Iterator[pa.RecordBatch]:
        distinct, code, number, caps, sizes, kept = phrase_packs.opened(data)
        runs = phrase_packs.asked(distinct, number, sizes, table)
        found = [phrase_packs.answer(*part, runs) for part in parts]  # in order of their buckets, so sorted
        hits = _Hits(distinct, *(np.concatenate([x[j] for x in found]) for j in range(2)))
        del runs, found
        sums = []
        for at, words_ in phrase_packs.spans(sizes):
            rows, *sum_ = _sums(hits, distinct, code, number[words_], caps[words_], sizes[at])
            sums.append((rows + at.start, *sum_))
        rows, s, null = (np.concatenate([x[j] for x in sums]) for j in range(3))
        kept = kept.take(pa.array(rows)).combine_chunks()
        s = s + np.sign(s) * kept.column(kept.num_columns - 1).to_numpy()
        found = pa.array(s / np.sqrt(s * s + NORMALIZE_ALPHA), mask=null)
        for part in pa.Table.from_arrays([*kept.columns[:-1], found], names=names).to_batches():
            yield part

    for batch in batches:
        for b, n, blob in zip(*(batch.column(j).to_pylist() for j in (1, 2, 3))):
            if b < 0:
                if parts:
                    yield from scored()
                data, parts = blob, []
            else:
                parts.append((b, n, blob))
    if parts:
        yield from scored()


def headline_polarity(headlines: DataFrame, lexicon: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, compound) of every headline with a hit; the others have compound 0.

    Boosters that the lexicon lists as words don't boost. Texts are packed once, some millions of words a pack; what goes to the
    lexicon's buckets and back are a pack's distinct runs that a bit table of the lexicon lets through, not a row per run.
    """
    spark = headlines.sparkSession
    ship(spark)
    with small_batches(spark):
        lex = phrase_lexicon(lexicon)
        boosters = [*BOOSTERS_UP, *BOOSTERS_DOWN]
        listed = {r.token for r in lex.where(F.col("token").isin(boosters)).select("token").collect()}
        code = {w: _UP if w in BOOSTERS_UP else _DOWN for w in boosters if w not in listed} | dict.fromkeys(NEGATIONS, _NEGATION)
        codes = {w.encode(): code.get(w, _PLAIN) | (_TURN if w in CONTRASTS else 0) for w in [*code, *CONTRASTS]}
        entries = staged(lex.select(F.split("token", " ").alias("words"), "valence").mapInArrow(phrase_packs.entries, phrase_packs.BLOB), "lexicon-runs")
        table = _table(entries, np.float64)
        base = headlines.select(*keep, emphasis(F.coalesce("title", F.lit(""))).cast("double").alias("_emphasis"), words(F.col("title")).alias("_w"))
        shout = lambda t: (F.upper(t) == t) & (F.length(t) > 1)
        base = base.select(*keep, "_emphasis", F.transform("_w", F.lower).alias("_low"), F.transform("_w", shout).alias("_caps"))
        packs = staged(base.mapInArrow(lambda it: phrase_packs.packs(it, table, codes), phrase_packs.PACK), "polarity-packs")
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), packs.where("b < 0").count())
        asked = entries.select("b", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pack"), "n", "data").union(
            packs.where("b >= 0").select("b", F.lit(1), "pack", "n", "data"))
        hits = (asked.repartition(min(tasks, 1 << phrase_packs.BUCKET_BITS), "b").sortWithinPartitions("b", "kind")
                .mapInArrow(phrase_packs.hits, phrase_packs.PACK))
        rows = packs.where("b < 0").union(hits)
        schema = headlines.select(*keep, F.lit(0.0).cast("double").alias("compound")).schema
        names = schema.names
        scores = rows.repartition(tasks, "pack").sortWithinPartitions("pack", "b").mapInArrow(
            lambda it: _scored(it, table, names), T.StructType([T.StructField(f.name, f.dataType) for f in schema]))
        return staged(scores, "polarity-scores")


def ticker_polarity(headlines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean polarity per ticker: ticker, sentiment_score, n_headlines, n_scored (headlines with a hit)."""
    sums = headline_polarity(headlines, lexicon, ["ticker"]).groupBy("ticker").agg(
        F.sum("compound").alias("_c"), F.count(F.lit(1)).alias("n_scored"))
    counts = headlines.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_headlines"))
    return counts.join(sums, "ticker", "left").select(
        "ticker", (F.coalesce("_c", F.lit(0.0)) / F.col("n_headlines")).alias("sentiment_score"), "n_headlines",
        F.coalesce("n_scored", F.lit(0)).alias("n_scored"))


def learned_lexicon(texts: DataFrame, label: str, min_texts: int = 5, least: float = 1.0, prior: int = 10) -> DataFrame:
    """Lexicon of words and phrases from labelled texts (text, ``label`` 0/1): valence 4 (p - n) / (p + n + prior).

    p and n count the texts of either label that hold the phrase, each once. Entries in fewer
    than ``min_texts`` texts, or with a valence below ``least`` either way, are left out.
    """
    spark = texts.sparkSession
    ship(spark)
    most = max(1, min(min_texts, (1 << phrase_packs.LOW_BITS) - 1))
    with small_batches(spark):
        low = texts.select(words(F.col("text")).alias("_w"), F.col(label).cast("long").alias("y")).where("y is not null")
        low = low.select(F.transform("_w", F.lower).alias("_low"), "y")
        packs = staged(low.mapInArrow(phrase_packs.labelled_packs, "n int, data binary"), "labelled-packs").select("data")
        # first the runs' hashes alone, cut short: a run's texts all count where its hash counts, so no entry is lost
        counts = packs.mapInArrow(lambda it: phrase_packs.run_counts(it, most), phrase_packs.BLOB)
        often = staged(counts.repartition("b").sortWithinPartitions("b").mapInArrow(lambda it: phrase_packs.frequent(it, most), phrase_packs.BLOB), "frequent-runs")
        table = _table(often)
        seen = packs.mapInArrow(lambda it: phrase_packs.known_runs(it, table), phrase_packs.BLOB)
        counts = seen.repartition("b").sortWithinPartitions("b").mapInArrow(phrase_packs.token_counts, "token string, p long, n long")
        valence = F.lit(4.0) * (F.col("p") - F.col("n")) / (F.col("p") + F.col("n") + prior)
        return staged(counts.where(F.col("p") + F.col("n") >= min_texts).select("token", valence.alias("valence"))
                      .where(F.abs("valence") >= least), "learned-lexicon")
