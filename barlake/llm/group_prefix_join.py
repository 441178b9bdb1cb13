"""Jaccard self-join of word-shingle sets by a grouped prefix join.

Two sets with Jaccard similarity of at least ``t`` share one of the first
``n - ceil(t * n) + 1`` tokens of either under any fixed order of the tokens.

1. *Sets.* One pass hashes the shingles of every whole text. The order is: tokens outside the
   hot table by hash, then hot tokens by count. The hot table holds at most ``HOT_TOKENS``
   tokens, counted on a sample of the texts; any table gives the same links, a good one keeps
   common passages out of the prefixes.
2. *Classes and groups.* Equal sets are one class (its id is its smallest document id). Classes
   with identical prefix and size are one group; only groups enter the inverted index.
3. *Group pairs.* For every token that several groups share, one group is the pivot (one of
   ``PIVOTS`` seeds, so lists of equal members agree on it). Pairs are the pivot with each
   other group of the list, filtered by size, so they grow with the lists, not with their
   squares. Expanded to members they are screened by parity bitmaps (bits that differ are a lower
   bound of the sets' difference, so no link is lost) and verified on the texts.
4. *The rest.* A list all of whose members are now known to be connected needs no more. In the
   others, every pair of groups that isn't known to be connected is expanded and verified
   too, unless their bitmaps, folded and carried in the lists, already tell them apart: the join
   over a token only makes pairs that may link. So no link that matters to a component is missed,
   and nothing is capped.
5. *Components* of the links. Every link lies inside one of them.
6. *All links.* The classes of a component are cut into blocks by size and hash, and every two blocks
   whose sizes may link meet in one task, which intersects all their sets and returns a count per
   class: every link counts, however many a group has, and none becomes a row.

Null and empty texts have no shingles and link with nothing. Rows with null id take no part
(null component). Rows that share an id count as one document. Equal rows get equal results. The number
of links counts the other documents that link with one, its copies included; an id that stands
over different texts counts once for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlake.llm.components import components
from barlake.llm.shared import ship, small_batches, written
from barlake.llm.shingles import overlap, shingle_set, word_hashes

WORDS = 5
PERCENT = 75
SAMPLE_SHARE = 16
HOT_COUNT = 3
HOT_TOKENS = 500_000
PIVOTS = 4
SIGN_BITS = 1024
#: Words of 64 bits that the lists of the last step carry of each bitmap.
MARKS = range(8)
OPEN_TOKENS = 1_000_000
#: Classes and tokens of a block, about; and pairs of equal tokens that are counted at once.
BLOCK_CLASSES = 1024
BLOCK_TOKENS = 1 << 20
MET = 1 << 21
SALTS = 16
#: Bits of the filter that spares texts without a candidate the shuffle; full, it spares none.
FILTER_BITS = 1 << 24


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def prefix(tokens: np.ndarray, hot: np.ndarray, rank: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, int]:
    """First tokens of a sorted set, others by hash, then hot ones by their rank; and how many are others."""
    p = prefix_length(len(tokens), percent)
    if len(hot) and len(tokens):
        at = np.searchsorted(hot, tokens)
        at[at == len(hot)] = 0
        is_hot = hot[at] == tokens
        cold = tokens[~is_hot]
        if len(cold) < p:
            late = tokens[is_hot][np.argsort(rank[at[is_hot]], kind="stable")]
            return np.concatenate([cold, late[:p - len(cold)]]), len(cold)
        return cold[:p], p
    return tokens[:p], p


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.astype(np.uint64).view(np.int64), pa.int64())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def parity(tokens: np.ndarray) -> np.ndarray:
    """Parities, a power of two and at least SIGN_BITS and 1.5 per token: bit k says whether an odd
    number of the tokens falls on k."""
    bits = SIGN_BITS
    while 2 * bits < 3 * len(tokens):
        bits *= 2
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def screened(pairs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sizes and parity bitmaps leave a similarity of ``percent`` possible."""
    a = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sign").alias("sa"))
    b = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sign").alias("sb"))
    width = F.least(F.size("sa"), F.size("sb"))

    def folded(sign: str) -> Column:  # sizes that near differ by one doubling at most
        halves = F.zip_with(F.slice(sign, 1, width), F.slice(sign, width + 1, width), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(sign) > width, halves).otherwise(F.col(sign))

    apart = F.aggregate(F.zip_with(folded("sa"), folded("sb"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    both = pairs.join(a, "a").join(b, "b").where(_near("na", "nb", percent))
    return both.where((100 + percent) * apart <= (100 - percent) * (F.col("na") + F.col("nb"))).select("a", "b").distinct()


def hot_tokens(texts: DataFrame, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(tokens ascending, rank by count) of the most frequent shingles of a sample of the ids.

    At most HOT_TOKENS tokens reach the driver. Equal texts count once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(word_hashes(t), size).view(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.list_(pa.int64()))], names=["tokens"])

    sample = texts.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLE_SHARE)) == 0).select("text")
    first = sample.groupBy(F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).select("text")
    counts = (first.mapInArrow(run, "tokens array<long>").select(F.explode("tokens").alias("token"))
              .groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_COUNT))
    with small_batches(texts.sparkSession):
        top = counts.orderBy(F.desc("n"), "token").limit(HOT_TOKENS).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - np.arange(len(tokens)))[order]  # the most frequent last


def sets(texts: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, n, s1, s2 (hash of the set), g (hash of prefix and size), prefix, cold (its tokens outside the hot table), sign."""
    import xxhash

    table = texts.sparkSession.sparkContext.broadcast(hot_tokens(texts, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = table.value
        for batch in batches:
            n, whole, group, heads, colds, signs = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                tokens = shingle_set(word_hashes(text), size)
                head, cold = prefix(tokens, hot, rank, percent)
                colds.append(cold)
                signs.append(parity(tokens))
                n.append(len(tokens))
                whole.append(xxhash.xxh3_128_intdigest(tokens.tobytes()))
                group.append(xxhash.xxh3_64_intdigest(head.tobytes(), seed=len(tokens)))
                heads.append(head.view(np.int64))
            low = (1 << 64) - 1
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(n, pa.int64()), _signed(np.array([w >> 64 for w in whole], np.uint64)),
                _signed(np.array([w & low for w in whole], np.uint64)), _signed(np.array(group, np.uint64)),
                pa.array(heads, pa.list_(pa.int64())), pa.array(colds, pa.int32()),
                pa.array(signs, pa.list_(pa.int64()))], names=["id", "n", "s1", "s2", "g", "prefix", "cold", "sign"])

    return texts.mapInArrow(run, "id long, n long, s1 long, s2 long, g long, prefix array<long>, cold int, sign array<long>")


def shared_postings(rows: DataFrame) -> DataFrame:
    """(token, g, n), distinct, of the tokens that several groups have in their prefixes.

    The postings are shuffled once, by (token, salt): a token of the hot table is dealt to
    SALTS places by its group, and only its extremes meet again. Both the search for
    shared tokens and the join back read that one exchange.
    """
    postings = (rows.select(F.posexplode("prefix").alias("at", "token"), "g", "n", "cold")
                .select("token", F.when(F.col("at") >= F.col("cold"), F.pmod("g", F.lit(SALTS))).otherwise(-1).cast("int").alias("salt"), "g", "n")
                .repartition("token", "salt"))
    ends = postings.groupBy("token", "salt").agg(F.min("g").alias("lo"), F.max("g").alias("hi"))
    cold = ends.where("salt < 0 and lo <> hi").select("token", "salt")
    hot = (ends.where("salt >= 0").groupBy("token").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi")
           .select("token", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    return postings.join(cold.union(hot), ["token", "salt"]).groupBy("token", "salt", "g", "n").agg(F.count("*")).select("token", "g", "n")


def _near(a: str, b: str, percent: int) -> Column:
    """Sizes that leave a similarity of ``percent`` possible."""
    return (100 * F.col(a) >= percent * F.col(b)) & (100 * F.col(b) >= percent * F.col(a))


class _Opened(dict):
    """Shingle sets of compressed texts; a task keeps at most OPEN_TOKENS tokens besides the pair in work."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.held = size, 0

    def __missing__(self, data: bytes) -> np.ndarray:
        import zstandard

        tokens = shingle_set(word_hashes(zstandard.decompress(data).decode("utf-8", "surrogatepass")), self.size)
        if self.held + len(tokens) > OPEN_TOKENS:
            self.clear()
            self.held = 0
        self[data] = tokens
        self.held += len(tokens)
        return tokens


def packed(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, data): the texts of ``ids``, compressed. Only they move."""
    import zstandard

    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    bits = (ids.groupBy(F.shiftright(slot, 6).alias("word"))
            .agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(xxhash64(id), {FILTER_BITS}) & 63 AS int))")).alias("bits")))
    rows = bits.toPandas()  # at most FILTER_BITS / 64 rows
    bitmap = np.zeros(FILTER_BITS // 64, np.uint64)
    bitmap[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    table = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, words = zstandard.ZstdCompressor(level=3), table.value
        for batch in batches:
            at = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            batch = batch.filter(pa.array(hit.astype(bool)))
            data = [press.compress(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    marked = texts.where("id is not null").select("id", "text", slot.alias("slot"))
    found = marked.mapInArrow(run, "id long, data binary").join(ids, "id", "left_semi").distinct()
    with small_batches(texts.sparkSession):
        return written(found, "candidates", **{"parquet.enable.dictionary": "false", "compression": "none"})


def verified(pairs: DataFrame, texts: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose texts link, checked on whole shingle sets.

    Only texts of candidates move, compressed; a pivot's pairs may be split over tasks.
    """
    found = packed(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _Opened(size)
        for batch in batches:
            a, b, da, db = (c.to_pylist() for c in batch.columns)
            linked = []
            for x, y in zip(da, db):
                p, q = opened[x], opened[y]
                both = overlap(p, q)
                linked.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    right = pairs.join(found.select(F.col("id").alias("b"), F.col("data").alias("db")), "b")
    both = right.join(found.select(F.col("id").alias("a"), F.col("data").alias("da")), "a").select("a", "b", "da", "db")
    with small_batches(texts.sparkSession):
        return written(both.mapInArrow(check, "a long, b long").distinct(), "links")


def _marks(sign: str) -> list[Column]:
    """b0, b1, ...: the bitmap folded to the words of MARKS, which still bounds the difference from below."""
    fold = "aggregate(filter({0}, (x, j) -> j % {1} = {2}), 0L, (t, x) -> t ^ x)"
    return [F.expr(fold.format(sign, len(MARKS), k)).alias(f"b{k}") for k in MARKS]


def _alike(percent: int, sure: bool = False) -> Column:
    """Whether bits and sizes of two sides (n, b0.., and o_n, o_b0..) leave a similarity of ``percent`` possible.

    With ``sure`` the sides are groups, and only bits that all members share (m0.., o_m0..) count.
    """
    def apart(k: int) -> Column:
        differ = F.col(f"b{k}").bitwiseXOR(F.col(f"o_b{k}"))
        return F.bit_count(differ.bitwiseAND(F.col(f"m{k}")).bitwiseAND(F.col(f"o_m{k}")) if sure else differ)

    return (100 + percent) * sum((apart(k) for k in MARKS[1:]), apart(0)) <= (100 - percent) * (F.col("n") + F.col("o_n"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(docs: DataFrame, *, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
           text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, links): set figures per row, classes with their group, and verified links of classes,
    as many as their components need; ``link_counts`` counts all."""
    ship(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    with small_batches(docs.sparkSession):
        rows = written(sets(texts, size, percent), "sets", **{"parquet.enable.dictionary": "false"})
    some = rows.where("n > 0 and id is not null")
    classes = written(some.groupBy("n", "s1", "s2", "g").agg(F.min("id").alias("cls"), F.any_value("sign").alias("sign")), "classes")
    groups = classes.groupBy("g").agg(F.min("cls").alias("rep"))

    lists = written(shared_postings(some), "lists")
    seed = F.struct(F.xxhash64("g", F.pmod("token", F.lit(PIVOTS))).alias("h"), F.col("g").alias("pg"), F.col("n").alias("pn"))
    pivots = lists.groupBy("token").agg(F.min(seed).alias("p")).select("token", "p.pg", "p.pn")
    hits = lists.join(pivots, "token")
    stars = hits.where(F.col("g") != F.col("pg")).where(_near("n", "pn", percent)).select("pg", "g").distinct()
    across = (stars.join(groups.select(F.col("g").alias("pg"), "rep"), "pg").join(classes.select("g", "cls"), "g"))
    within = classes.select("g", "cls").join(groups, "g")
    pairs = across.select("rep", "cls").union(within.select("rep", "cls")).where("rep <> cls")
    pairs = written(pairs.select(*_ordered("rep", "cls")).distinct(), "pairs")
    close = written(screened(pairs, classes, percent), "close-pairs")
    links = verified(close, texts, size, percent)

    # classes with one label are connected already
    labels = components(links).select(F.col("id").alias("cls"), F.col("component").alias("label"))
    named = written(classes.join(labels, "cls", "left").select("g", "n", "cls", F.coalesce("label", "cls").alias("label")), "labels")
    marks = classes.select("cls", *_marks("sign"))
    named = named.join(marks, "cls")
    sure = [F.expr(f"~(bit_and(b{k}) ^ bit_or(b{k}))").alias(f"m{k}") for k in MARKS]
    span = named.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), *[F.bit_and(f"b{k}").alias(f"b{k}") for k in MARKS], *sure)
    lists = lists.join(span, "g")
    open_lists = lists.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l <> h").select("token")
    rest = written(lists.join(open_lists, "token", "left_semi"), "open-lists")
    bits = [f"b{k}" for k in MARKS]
    other = rest.select("token", *[F.col(c).alias(f"o_{c}") for c in ("g", "n", "lo", "hi", *bits, *[f"m{k}" for k in MARKS])])
    unequal = (F.col("lo") != F.col("hi")) | (F.col("o_lo") != F.col("o_hi")) | (F.col("lo") != F.col("o_lo"))
    open_groups = (rest.join(other, "token").where((F.col("g") < F.col("o_g")) & unequal & _near("n", "o_n", percent) & _alike(percent, sure=True))
                   .select("g", "o_g").distinct())
    inside = span.where("lo <> hi").select("g", F.col("g").alias("o_g"))
    left, right = (named.select(*[F.col(c).alias(f"{side}{c}") for c in ("g", "n", "cls", "label", *bits)]) for side in ("", "o_"))
    more = (open_groups.union(inside).join(left, "g").join(right, "o_g")
            .where((F.col("label") != F.col("o_label")) & (F.col("cls") != F.col("o_cls")) & _alike(percent)).select(*_ordered("cls", "o_cls")).distinct())
    more = written(screened(more.join(pairs, ["a", "b"], "left_anti"), classes, percent), "more-pairs")
    links = links.union(verified(more, texts, size, percent))
    return rows, classes, links


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set in ``a`` with every set in ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    tokens = np.concatenate([*a, *b])
    _, token = np.unique(tokens, return_inverse=True)
    cut = sum(map(len, a))
    n = int(token.max(initial=-1)) + 1
    ta, tb = token[:cut], token[cut:]
    in_a, in_b = np.bincount(ta, minlength=n), np.bincount(tb, minlength=n)
    ra, rb = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    # tokens of many sets by matrix products
    often = np.flatnonzero(16 * in_a * in_b > len(a) * len(b))
    column = np.full(n, -1)
    column[often] = np.arange(len(often))
    for low in range(0, len(often), BLOCK_CLASSES):
        sides = []
        for t, r, rows in ((ta, ra, len(a)), (tb, rb, len(b))):
            at = column[t] - low
            hit = (column[t] >= low) & (at < BLOCK_CLASSES)
            side = np.zeros((rows, BLOCK_CLASSES), np.float32)
            side[r[hit], at[hit]] = 1
            sides.append(side)
        out += (sides[0] @ sides[1].T).astype(np.int64)
    # the others by the pairs that they make
    in_b[often] = 0
    order = np.argsort(tb, kind="stable")
    first = np.r_[0, np.cumsum(np.bincount(tb, minlength=n))]
    rest = np.flatnonzero(in_b[ta] > 0)
    met = np.cumsum(in_b[ta[rest]])
    low = 0
    while low < len(rest):
        high = max(low + 1, int(np.searchsorted(met, (met[low - 1] if low else 0) + MET, "right")))
        part = rest[low:high]
        many = in_b[ta[part]]
        at = np.repeat(first[ta[part]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        pairs = np.repeat(ra[part], many) * len(b) + rb[order[at]]
        out += np.bincount(pairs, minlength=out.size).reshape(out.shape)
        low = high
    return out


def link_counts(classes: DataFrame, found: DataFrame, texts: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(cls, linked): how many documents stand in the classes that a class links with.

    ``classes`` (cls, n, copies), ``found`` their components (id, component). Sizes of links differ by a factor
    of at most 100 / percent, so a class meets the blocks of its own level of sizes and of the next ones.
    """
    import zstandard

    members = classes.join(found.withColumnRenamed("id", "cls"), "cls").select("cls", "component", "copies", "n")
    members = written(members.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / float(np.log(100.5 / percent))).cast("int")), "members")
    whole = members.groupBy("component").agg(F.count("*").alias("k"), F.sum("copies").alias("all"))
    two = members.join(whole.where("k = 2"), "component").select("cls", (F.col("all") - F.col("copies")).alias("linked"))
    many = members.join(whole.where("k > 2").select("component"), "component")
    parts = F.ceil(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum("n") / BLOCK_TOKENS)).cast("int")
    levels = many.groupBy("component", "level").agg(parts.alias("parts"))

    def beside(step: int, name: str) -> DataFrame:
        return levels.select("component", (F.col("level") - step).alias("level"), F.col("parts").alias(name))

    dealt = (many.join(levels, ["component", "level"]).join(beside(1, "above"), ["component", "level"], "left")
             .join(beside(-1, "below"), ["component", "level"], "left"))
    block = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    each = lambda n, f: F.transform(F.sequence(F.lit(1), n), lambda j: f(j - 1))
    spot = lambda low, high, i, j, side: F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"), side.alias("side"))
    level, b, none = F.col("level"), F.col("block"), F.array().cast("array<struct<low:int,high:int,i:int,j:int,side:int>>")
    spots = F.concat(
        each(F.col("parts"), lambda j: spot(level, level, F.least(b, j), F.greatest(b, j), F.when(b <= j, 0).otherwise(1))),
        F.coalesce(each(F.col("above"), lambda j: spot(level, level + 1, b, j, F.lit(0))), none),
        F.coalesce(each(F.col("below"), lambda j: spot(level - 1, level, j, b, F.lit(1))), none))
    key = ["component", "low", "high", "i", "j"]
    rows = dealt.withColumn("block", block).select("cls", "component", "copies", F.explode(spots).alias("s")).select("cls", "component", "copies", "s.*")
    data = packed(texts, many.select(F.col("cls").alias("id")))
    met = rows.join(data.withColumnRenamed("id", "cls"), "cls").select(*key, "side", "cls", "copies", "data")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])

        def ended() -> Iterator[pa.RecordBatch]:
            same = now[1] == now[2] and now[3] == now[4]  # a block with itself
            left, right = sides[0], sides[0] if same else sides[1]
            if not left or not right:
                return
            (ca, wa, a), (cb, wb, b) = zip(*left), zip(*right)
            both = common(a, b)
            na, nb = (np.array([len(x) for x in y], np.int64) for y in (a, b))
            linked = (both > 0) & (100 * both >= percent * (na[:, None] + nb[None, :] - both))
            if same:
                np.fill_diagonal(linked, False)
            out = [(ca, linked @ np.array(wb, np.int64))] + ([] if same else [(cb, np.array(wa, np.int64) @ linked)])
            for cls, n in out:
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(n, pa.int64())], names=["cls", "linked"])

        for batch in batches:
            for *spot, side, cls, copies, data in zip(*(c.to_pylist() for c in batch.columns)):
                if spot != now:
                    if now:
                        yield from ended()
                    now, sides = spot, ([], [])
                text = zstandard.decompress(data).decode("utf-8", "surrogatepass")
                sides[side].append((cls, copies, shingle_set(word_hashes(text), size)))
        if now:
            yield from ended()

    counted = met.repartition(*key).sortWithinPartitions(*key).mapInArrow(count, "cls long, linked long")
    with small_batches(texts.sparkSession):
        counted = written(counted, "block-counts")
    return two.union(counted).groupBy("cls").agg(F.sum("linked").alias("linked"))


def _components(docs: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, found): ``found`` is the component of every class that links with another."""
    rows, classes, links = linked(docs, **options)
    return rows, classes, components(links)


def _per_row(rows: DataFrame, named: DataFrame) -> DataFrame:
    """``rows`` with the columns of their class in ``named``."""
    return rows.drop("prefix", "cold", "sign").join(named, ["s1", "s2", "n", "g"], "left")


def join_components(docs: DataFrame, *, size: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, n_links (other documents that link with it, copies included)."""
    rows, classes, found = _components(docs, size=size, percent=percent, id_col=id_col, text_col=text_col)
    key = ["s1", "s2", "n", "g"]
    copies = rows.where("n > 0 and id is not null").groupBy(*key).agg(F.countDistinct("id").alias("copies"))
    weighed = written(classes.drop("sign").join(copies, key), "weighed-classes")
    counts = link_counts(weighed, found, _texts(docs, id_col, text_col), size, percent)
    named = (weighed.join(found.withColumnRenamed("id", "cls"), "cls", "left").join(counts, "cls", "left")
             .select(*key, F.coalesce("component", "cls").alias("component_id"),
                     (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    known = F.col("id").isNotNull()
    return _per_row(rows, named).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(known, F.coalesce("component_id", "id")).alias("component_id"),
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"))


def first_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are the first of their component, with their own columns.

    Rows are told apart by (id, text): each text is a document of its own here (known by a 64-bit
    hash), whatever ids it stands under, and a component keeps the row with its smallest id (of
    several texts under that id, the one with the smallest hash). Of equal rows one stays. Rows with
    null id stay, as do texts without a word.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("t"), text.alias("text"),
                                                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    sets_of, classes, found = _components(named.select("t", "text"), id_col="t", text_col="text", **options)
    of = classes.drop("sign").join(found.withColumnRenamed("id", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    members = _per_row(sets_of.where("n > 0"), of.drop("cls")).groupBy(F.col("id").alias("t")).agg(F.min("component").alias("component"))
    rows = written(named.select("id", "t").distinct().join(members, "t", "left"), "members")
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "t")).alias("f")).select("f.id", "f.t")
    stay = first.union(rows.where("component IS NULL").select("id", "t"))
    kept = named.select("id", "t", "row").join(stay, ["id", "t"], "left_semi").dropDuplicates(["id", "t"])
    return docs.where(F.col(id_col).isNull()).unionByName(kept.select("row.*"))
