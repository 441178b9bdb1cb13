"""Personal data: base patterns, and identifiers found by bootstrapped lexical contexts.

*Base.* E-mail addresses, IP addresses, card and phone numbers by the fixed rules below.

*Mentions.* Base entities are seeds. All other words with a digit or an ``@`` are candidates; words of digits
and marks only, one space apart and not parted by punctuation, are one candidate up to ``RUN_DIGITS`` digits (a
longer row of numbers is several). The contexts decide, not the shape. Every mention has two lexical patterns: the
two words before it, and the word before with the word behind (of mentions of one word). An instance is a mention's text.

*Graph.* Patterns with ``MIN_SUPPORT`` different instances get their total: how often their words
occur in the whole corpus, counted over all texts. Then, ``ROUNDS`` times, Spark scores both sides:

- a pattern: the sum of its instances' scores over its total (plus a smoothing), so contexts
  that mostly hold other words score near 0;
- an instance: 1 for a seed, else the mean score of its patterns over its mentions, if one of them has
  ``MIN_SUPPORT`` trusted instances. So a number that stands everywhere doesn't carry a score from one context to others.

New instances raise patterns that no seed has; these find further instances in the next round.

*Discovery.* Candidates in a pattern with ``MIN_SUPPORT`` trusted instances and a score of ``HIGH`` or
more become spans of that pattern's main kind. Base spans stay as they are.

All steps are joins and aggregations of whole tables; contexts travel as 64-bit hashes. Null texts are empty. Rows that
share an id are told apart by their text; equal rows get equal results; null ids are allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.shared import ship, written
from barlake.llm.shingles import word_hashes

KINDS = ("email", "ip", "card", "phone")
#: Most digits of a candidate of several words, as of the longest base entity.
RUN_DIGITS = 19
MIN_SUPPORT = 3
SMOOTHING = 1.0
HIGH = 0.6
TRUSTED = 0.5
ROUNDS = 3
FILTER_BITS = 1 << 24

_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile("[0-9@]")
_LETTER = re.compile(r"[^\W\d_]|@")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base entities, sorted; each kind leftmost and non-overlapping.

    Addresses are looked up by their ``@`` and digits runs are entered at their start only, so
    the time is linear in the text.
    """
    found, last = [], 0
    for m in _HOST.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _contexts(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per word, the hashes of (two words before) and (word before, word behind); 0 where there are none."""
    two, around = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    two[2:] = (words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1]) | np.uint64(1)
    around[1:-1] = (words[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:]) & ~np.uint64(1)
    return two, around


def _runs(text: str, words: list[tuple[int, int]], signed: list[int], covered: set[int]) -> list[tuple[int, int]]:
    """(first, last) word of every candidate among the words ``signed`` with a digit or an ``@``."""
    runs, held = [], 0  # digits of the last run, 0 if no word may join it
    for k in signed:
        start, end = words[k]
        if k in covered:
            held = 0
            continue
        n = 0 if _LETTER.search(text, start, end) else sum(text.count(c, start, end) for c in "0123456789")
        if n and held and runs[-1][1] == k - 1 and held + n <= RUN_DIGITS and text[words[k - 1][1]:start] == " ":
            runs[-1], held = (runs[-1][0], k), held + n
        else:
            runs.append((k, k))
            held = n
        if text[end - 1] in ".,;:!?":
            held = 0
    return runs


def mentions(text: str) -> list[dict]:
    """Base entities and candidates with their patterns, by start."""
    if not _SIGN.search(text):
        return []
    base = base_spans(text)
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    two, around = _contexts(word_hashes(text))
    starts = np.array([w[0] for w in words])
    out, covered, reach = [], set(), -1

    def mention(start: int, end: int, kind: int | None, first: int, last: int) -> dict:
        # the patterns of the first word; behind an entity of several words stands the last one's neighbour
        inst = xxhash.xxh3_64_intdigest(text[start:end].lower().encode("utf-8", "surrogatepass"))
        near = around[first] if first == last else np.uint64(0)
        return {"start": start, "end": end, "kind": kind, "inst": np.uint64(inst).view(np.int64).item(),
                "patterns": [p.view(np.int64).item() for p in (two[first], near) if p]}

    for start, kind, end in base:
        first, last = (int(np.searchsorted(starts, x, "right")) - 1 for x in (start, end - 1))
        covered.update(range(first, last + 1))
        out.append(mention(start, end, kind, first, last))
    signs = np.array([m.start() for m in _SIGN.finditer(text)])
    for first, last in _runs(text, words, np.unique(np.searchsorted(starts, signs, "right") - 1).tolist(), covered):
        inside = [k for k in range(words[first][0], words[last][1]) if text[k].isalnum()]
        if not inside:
            continue
        left, right = inside[0], inside[-1] + 1
        if left > words[first][0] and (text[left - 1] == "+" or text[left - 1] == "(" and ")" in text[left:right]):
            left -= 1
        out.append(mention(left, right, None, first, last))
    return sorted(out, key=lambda m: (m["start"], -1 if m["kind"] is None else m["kind"]))


_MENTION = "array<struct<start:long,end:long,kind:int,inst:long,patterns:array<long>>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("inst", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def scanned(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, content (hash of the text), found (its mentions)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [mentions(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, _ARROW)], names=["id", "content", "found"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("content"), text.alias("text")).mapInArrow(
        run, f"id long, content long, found {_MENTION}")


def totals(docs: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """(pattern, total): occurrences of the wanted patterns' words at all places of all texts.

    A bit table of fixed size keeps other places at home; a join then drops its false hits.
    """
    bit = F.expr(f"pmod(shiftright(pattern, 1), {FILTER_BITS})")
    rows = (wanted.groupBy(F.shiftright(bit, 6).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(shiftright(pattern, 1), {FILTER_BITS}) & 63 AS int))")).alias("bits"))).toPandas()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    table = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = table.value
        for batch in batches:
            hits = []
            for text in batch.column(0).to_pylist():
                for codes in _contexts(word_hashes(text)):
                    at = (codes.view(np.int64) >> 1) & np.int64(FILTER_BITS - 1)
                    hits.append(codes[((bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)])
            patterns, n = np.unique(np.concatenate(hits) if hits else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(patterns.view(np.int64)), pa.array(n, pa.int64())], names=["pattern", "n"])

    places = docs.select(F.col(text_col).alias("text")).where("text is not null").mapInArrow(run, "pattern long, n long")
    counted = places.groupBy("pattern").agg(F.sum("n").alias("total"))
    return counted.join(wanted.select("pattern"), "pattern", "left_semi")


def patterns_scored(edges: DataFrame, counts: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, score, kind, trusted) after the last round. ``edges``: pattern, inst, n; ``seeds``: inst, kind."""
    known = seeds.select("inst", F.lit(1.0).alias("weight"), "kind")
    for k in range(rounds):
        held = edges.join(known, "inst", "left")
        weight = F.coalesce("weight", F.lit(0.0))
        by_kind = held.groupBy("pattern", "kind").agg(F.sum(weight * F.col("n")).alias("good"),
                                                      F.sum((weight >= TRUSTED).cast("int")).alias("trusted"))
        scored = (by_kind.groupBy("pattern").agg(F.sum("good").alias("good"), F.sum("trusted").alias("trusted"),
                                                 F.max(F.struct("good", -F.col("kind"))).alias("main"))
                  .join(counts, "pattern")
                  .select("pattern", F.least(F.col("good") / (F.col("total") + SMOOTHING), F.lit(0.999)).alias("score"),
                          (-F.col("main.col2")).alias("kind"), "trusted"))
        scored = written(scored.where("score > 0 and kind is not null"), "patterns")
        if k < rounds - 1:
            reached = edges.join(scored, "pattern", "left")
            new = (reached.groupBy("inst").agg((F.sum(F.coalesce("score", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("weight"),
                                               F.max(F.when(F.col("score").isNotNull(), F.struct("score", -F.col("kind")))).alias("main"),
                                               F.max("trusted").alias("most"))
                   .where(F.col("most") >= MIN_SUPPORT).select("inst", "weight", (-F.col("main.col2")).alias("kind")).join(seeds, "inst", "left_anti"))
            known = written(seeds.select("inst", F.lit(1.0).alias("weight"), "kind").union(new), "instances")
    return scored


def discovered(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """(id, content, more): spans that high-confidence patterns add to a document."""
    each = found.select("id", "content", F.explode("found").alias("m")).select("id", "content", "m.*")
    links = each.select("inst", "kind", F.explode("patterns").alias("pattern"))
    edges = links.groupBy("pattern", "inst").agg(F.count("*").alias("n"))
    wanted = edges.groupBy("pattern").agg(F.count("*").alias("support")).where(F.col("support") >= MIN_SUPPORT)
    wanted = written(wanted, "wanted")
    edges = written(edges.join(wanted.select("pattern"), "pattern", "left_semi"), "edges")
    seeds = each.where("kind is not null").groupBy("inst").agg(F.min("kind").alias("kind"))
    scored = patterns_scored(edges, written(totals(docs, wanted, text_col), "totals"), written(seeds, "seeds"))
    high = scored.where((F.col("score") >= HIGH) & (F.col("trusted") >= MIN_SUPPORT)).select("pattern", "score", F.col("kind").alias("as_kind"))
    new = (each.where("kind is null").select("id", "content", "start", "end", F.explode("patterns").alias("pattern")).join(high, "pattern")
           .groupBy("id", "content", "start", "end").agg(F.max(F.struct("score", -F.col("as_kind"))).alias("best")))
    span = F.struct("start", (-F.col("best.col2")).alias("kind"), "end")
    return new.groupBy("id", "content").agg(F.collect_set(span).alias("more"))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered."""
    ship(docs.sparkSession)
    found = written(scanned(docs, id_col, text_col), "mentions")
    more = discovered(docs, found, text_col).select(F.col("id").alias("of"), F.col("content").alias("of_content"), "more")
    base = F.transform(F.filter("found", lambda m: m["kind"].isNotNull()),
                       lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    rows = found.select("id", "content", base.alias("base")).join(
        more, F.col("id").eqNullSafe(F.col("of")) & (F.col("content") == F.col("of_content")), "left")
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    extra = F.coalesce("more", none)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return rows.select(F.col("id").alias("doc_id"), *map(count, range(4)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                       _joined(F.concat("base", extra)).alias("spans"), F.size(extra).alias("n_discovered"))
