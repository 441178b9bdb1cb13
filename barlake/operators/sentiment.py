"""Headline sentiment.

Polarity follows the lexicon-and-rules scheme of Hutto & Gilbert (2014):
token valences from a lexicon; walking back over the three preceding tokens, a
booster shifts the valence by 0.293 (x0.95 / x0.9 at distance 2 / 3) in the
valence's current direction and a negation scales it by -0.74; the sum s
maps to compound = s / sqrt(s^2 + 15). Case emphasis, punctuation and idiom
rules are not part of this version.

The lexicon is an input table of any size: tokens join it, and the look-back rules run at
the hits only. Whole texts are scored, never a prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.schemas import LEXICON

# fixed values: rule constants of the scheme
BOOST_INCR = 0.293
BOOST_DECR = -0.293
NEGATION_SCALAR = -0.74
NORMALIZE_ALPHA = 15.0
DISTANCE_DECAY = [1.0, 0.95, 0.9]
NEGATIONS = ["not", "no", "never", "nor", "none", "nothing", "without", "cannot", "nicht", "kein", "nunca", "jamais"]
BOOSTERS_UP = ["very", "really", "extremely", "most", "more", "than", "sehr", "muy", "tres"]
BOOSTERS_DOWN = ["slightly", "somewhat", "barely", "less", "only", "ing"]
# fixed values: demonstration lexicon over frequent fixture tokens (token, valence)
DEFAULT_LEXICON = [
    ("good", 1.9), ("great", 3.1), ("gain", 2.4), ("profit", 1.9), ("strong", 2.3), ("rally", 1.8),
    ("bad", -2.5), ("loss", -1.3), ("weak", -1.9), ("crash", -2.0), ("fear", -2.2), ("risk", -1.1),
    ("rely", 1.0), ("thing", 0.6), ("tion", 0.4), ("ble", -0.5), ("orre", -1.2), ("hehely", 2.0),
    ("rewh", -0.7), ("ononst", 1.3), ("inoran", -1.6), ("orantion", 0.9), ("thatin", -0.4),
    ("que", 0.3), ("der", -0.3), ("los", 0.8), ("ción", -0.9), ("und", 0.5), ("chung", -1.1),
    ("les", 0.7), ("des", -0.6), ("ment", 1.1), ("eine", 0.2),
]


def default_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEFAULT_LEXICON, LEXICON)


def normal_lexicon(lexicon: DataFrame) -> DataFrame:
    """One row per lower-case token; of several valences the largest."""
    return lexicon.groupBy(F.lower("token").alias("token")).agg(F.max(F.col("valence").cast("double")).alias("valence"))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != "")


def token_rows(headlines: DataFrame, keep: list[str], outer: bool = False) -> DataFrame:
    """One row per token with the three tokens before it and its headline's number ``_h``."""
    toks = headlines.select(*keep, F.monotonically_increasing_id().alias("_h"), tokens(F.col("title")).alias("_toks"))
    back = lambda i, d: F.get("_toks", i - d)
    each = F.transform(F.sequence(F.lit(0), F.size("_toks") - 1), lambda i: F.struct(
        *[back(i, d).alias(f"t{d}") for d in range(4)]))
    each = F.when(F.size("_toks") > 0, each)
    return toks.select(*keep, "_h", (F.explode_outer if outer else F.explode)(each).alias("t")).select(*keep, "_h", "t.*")


def valence(lexicon: DataFrame) -> Column:
    """Valence of a lexicon hit (``valence``, ``t1`` .. ``t3``): over the tokens 1, 2, 3 back, add the
    (decayed) booster in the current direction, then flip and damp at a negation. Boosters
    that the lexicon lists as words don't boost."""
    boosters = BOOSTERS_UP + BOOSTERS_DOWN
    listed = lexicon.where(F.col("token").isin(boosters)).agg(F.collect_set("token")).scalar()
    score = F.col("valence")
    for d in (1, 2, 3):
        t = F.col(f"t{d}")
        plain = ~F.array_contains(listed, t)
        step = (F.when(t.isin(BOOSTERS_UP) & plain, BOOST_INCR * DISTANCE_DECAY[d - 1])
                .when(t.isin(BOOSTERS_DOWN) & plain, BOOST_DECR * DISTANCE_DECAY[d - 1]).otherwise(0.0))
        boosted = score + F.coalesce(step, F.lit(0.0)) * F.signum(score)
        score = F.when(t.isin(NEGATIONS), boosted * NEGATION_SCALAR).otherwise(boosted)
    return F.when(F.col("valence") == 0, 0.0).otherwise(score)


def compound(total: Column) -> Column:
    return total / F.sqrt(total * total + F.lit(NORMALIZE_ALPHA))


def headline_scores(headlines: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(ticker, ..., title) -> + compound."""
    lex = normal_lexicon(lexicon)
    cols = headlines.columns
    rows = token_rows(headlines, cols, outer=True).join(lex.withColumnRenamed("token", "t0"), "t0", "left")
    total = F.coalesce(F.sum(valence(lex)), F.lit(0.0))
    return rows.groupBy("_h", *cols).agg(total.alias("_s")).select(*cols, compound(F.col("_s")).alias("compound"))


def ticker_sentiment(headlines: DataFrame, lexicon: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Mean compound per ticker (G5) -> (ticker, sentiment_score, n_headlines).

    Only tokens that the lexicon lists go on to the look-back rules and the sum per headline;
    headlines without any have compound 0, so they only count. ``tickers`` limits the work to
    the tickers that will use the scores.
    """
    if tickers is not None:
        headlines = headlines.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
    lex = normal_lexicon(lexicon)
    hits = token_rows(headlines, ["ticker"]).join(lex.withColumnRenamed("token", "t0"), "t0")
    per_headline = hits.groupBy("ticker", "_h").agg(F.sum(valence(lex)).alias("_s"))
    sums = per_headline.groupBy("ticker").agg(F.sum(compound(F.col("_s"))).alias("_c"))
    counts = headlines.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_headlines"))
    return counts.join(sums, "ticker", "left").select(
        "ticker", (F.coalesce("_c", F.lit(0.0)) / F.col("n_headlines")).alias("sentiment_score"), "n_headlines")


def news_titles(news: DataFrame, first_n: int | None = None) -> DataFrame:
    """Nested news (ticker, news: array<struct<title, content: struct<title>>>) -> titles.

    Get-with-default on nested fields (X23): the nested ``content.title`` wins when
    ``content`` is present, even when
    it has no title (then the item is skipped); otherwise the outer title.
    ``first_n`` keeps the first n items before the empty-title filter (T3).
    """
    items = news.select("ticker", F.posexplode("news").alias("pos", "item"))
    if first_n is not None:
        items = items.where(F.col("pos") < first_n)
    title = F.when(F.col("item.content").isNotNull(), F.col("item.content.title")).otherwise(F.col("item.title"))
    return (items.select("ticker", "pos", title.alias("title"))
            .where(F.col("title").isNotNull() & (F.col("title") != "")))


def sentiment_label(score: Column) -> Column:
    """> 0.05 positive, < -0.05 negative, else neutral."""
    return F.when(score > 0.05, "positive").when(score < -0.05, "negative").otherwise("neutral")


def short_title(title: Column, n: int = 80) -> Column:
    """Headline cut at n characters plus '...' (X14)."""
    return F.when(F.length(title) > n, F.concat(F.substring(title, 1, n), F.lit("..."))).otherwise(title)
