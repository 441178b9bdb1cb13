"""Registered queries of the phrase polarity: the lexicon is learned from the labelled documents, then scores every text."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlake.operators import polarity as P
from barlake.operators import sentiment as S
from barlake.plans.catalog import register
from barlake.plans.projection import spark_project, sql_project
from barlake.sources.fixtures import headlines

LEX_SPEC = [("token", "string"), ("valence", "double")]
POL_SPEC = [("ticker", "string"), ("sentiment_score", "double"), ("n_headlines", "long"), ("n_scored", "long"), ("sentiment_label", "string")]


def quality_lexicon(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    # a join that sorts would shuffle all texts, and few may have a label
    labelled = P._maybe_listed(F.col("doc_id").cast("string"), labels.select(F.col("doc_id").cast("string").alias("token")))
    return P.learned_lexicon(docs.where(labelled).join(labels, "doc_id"), "quality")


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{L}]+'), lambda x: x <> '')"


def _runs_sql(rows: str, key: str, cols: str) -> str:
    """Runs of 1 to MAX_WORDS words of ``rows`` (``key``, text), by one row per word and its neighbours."""
    w = f"OVER (PARTITION BY {key} ORDER BY pos)"
    lead = [f"lead(word, {d}) {w} AS n{d}, lead(caps, {d}) {w} AS u{d}" for d in range(1, P.MAX_WORDS)]
    lag = [f"lag(word, {d}) {w} AS b{d}" for d in (1, 2, 3)]
    token = lambda k: " || ' ' || ".join(["word", *[f"n{d}" for d in range(1, k)]])
    caps = lambda k: " AND ".join(["caps", *[f"u{d}" for d in range(1, k)]])
    parts = [f"SELECT {cols}, pos, {k} AS n_words, {token(k)} AS token, {caps(k)} AS caps, b1, b2, b3 FROM near WHERE ({token(k)}) IS NOT NULL"
             for k in range(1, P.MAX_WORDS + 1)]
    return f"""
    WITH split AS (SELECT {cols}, {_WORDS} AS w FROM {rows}),
    each AS (SELECT {cols}, unnest(w) AS raw, generate_subscripts(w, 1) - 1 AS pos FROM split),
    cased AS (SELECT {cols}, pos, lower(raw) AS word, upper(raw) = raw AND length(raw) > 1 AS caps FROM each),
    near AS (SELECT {cols}, pos, word, caps, {', '.join(lead + lag)} FROM cased)
    {' UNION ALL '.join(parts)}"""


def quality_lexicon_sql() -> str:
    return f"""
    WITH c AS (SELECT token, sum(quality) AS p, sum(1 - quality) AS n FROM (
        SELECT DISTINCT doc_id, quality, token FROM ({_runs_sql('(SELECT doc_id, quality, text FROM documents JOIN labels USING (doc_id)) dl', 'doc_id', 'doc_id, quality')}) r) u
        GROUP BY token)
    SELECT token, CAST(4.0 AS DOUBLE) * (p - n) / (p + n + 10) AS valence FROM c
    WHERE p + n >= 5 AND abs(CAST(4.0 AS DOUBLE) * (p - n) / (p + n + 10)) >= 1.0"""


def headline_polarity_sql() -> str:
    w = "OVER (PARTITION BY h ORDER BY pos)"
    beaten = " OR ".join(
        f"coalesce(lag(pos, {d}) {w} + lag(n_words, {d}) {w} > pos AND lag(n_words, {d}) {w} >= n_words, false) OR "
        f"coalesce(lead(pos, {d}) {w} < pos + n_words AND lead(n_words, {d}) {w} > n_words, false)" for d in range(1, P.MAX_WORDS))
    folds, prev = [], "v0"
    for d in (1, 2, 3):
        plain = f"b{d} NOT IN (SELECT token FROM lex)"
        step = (f"CASE WHEN b{d} IN ({_list(S.BOOSTERS_UP)}) AND {plain} THEN CAST({S.BOOST_INCR * S.DISTANCE_DECAY[d - 1]} AS DOUBLE) "
                f"WHEN b{d} IN ({_list(S.BOOSTERS_DOWN)}) AND {plain} THEN CAST({S.BOOST_DECR * S.DISTANCE_DECAY[d - 1]} AS DOUBLE) ELSE 0.0 END")
        folds.append(f"s{d} AS (SELECT *, ({prev} + ({step}) * sign({prev})) * CASE WHEN coalesce(b{d} IN ({_list(S.NEGATIONS)}), false) "
                     f"THEN CAST({S.NEGATION_SCALAR} AS DOUBLE) ELSE 1.0 END AS v{d} FROM {'counted' if d == 1 else f's{d - 1}'})")
        prev = f"v{d}"
    return f"""
    WITH lex AS ({quality_lexicon_sql()}),
    raw AS (SELECT upper(substr(lang, 1, 1)) AS ticker, doc_id AS h, coalesce(text, '') AS text FROM documents),
    runs AS MATERIALIZED ({_runs_sql('raw', 'h', 'ticker, h')}),
    heads AS (SELECT h, bool_or(NOT caps) AS mixed, min(CASE WHEN token IN ({_list(P.CONTRASTS)}) THEN pos END) AS turn
              FROM runs WHERE n_words = 1 GROUP BY h),
    marks AS (SELECT h, least(length(text) - length(replace(text, '!', '')), {P.EXCLAMATION_MAX}) AS marks, length(text) - length(replace(text, '?', '')) AS asks FROM raw),
    hits AS (SELECT runs.*, lex.valence FROM runs JOIN lex USING (token)),
    longest AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY h, pos ORDER BY n_words DESC) = 1),
    counted AS (SELECT b.*, heads.turn, valence + CASE WHEN mixed AND caps THEN sign(valence) * CAST({P.CAPS_INCR} AS DOUBLE) ELSE 0.0 END AS v0
                FROM (SELECT *, {beaten} AS beaten FROM longest) b JOIN heads USING (h) WHERE NOT beaten),
    {', '.join(folds)},
    sums AS (SELECT ticker, h, sum(v3 * CASE WHEN turn IS NULL OR pos = turn THEN 1.0 WHEN pos < turn THEN {P.BEFORE_CONTRAST} ELSE {P.AFTER_CONTRAST} END) AS s
             FROM s3 GROUP BY ticker, h),
    per AS (SELECT ticker, s + sign(s) * (marks * CAST({P.EXCLAMATION_INCR} AS DOUBLE)
                + CASE WHEN asks <= 1 THEN 0.0 WHEN asks <= {P.QUESTION_MAX} THEN asks * CAST({P.QUESTION_INCR} AS DOUBLE) ELSE {P.QUESTION_MANY} END) AS x
            FROM sums JOIN marks USING (h)),
    c AS (SELECT ticker, sum(x / sqrt(x * x + {S.NORMALIZE_ALPHA})) AS c, count(*) AS n_scored FROM per GROUP BY ticker)
    SELECT a.ticker, coalesce(c.c, 0.0) / n_headlines AS sentiment_score, n_headlines, coalesce(n_scored, 0) AS n_scored
    FROM (SELECT ticker, count(*) AS n_headlines FROM raw GROUP BY ticker) a LEFT JOIN c ON a.ticker = c.ticker"""


@register("learned_lexicon", sql_project(quality_lexicon_sql(), LEX_SPEC))
def q_learned_lexicon(spark, sf_dir):
    """Words and phrases whose presence tells the quality label, with their valence."""
    return spark_project(quality_lexicon(spark, sf_dir), LEX_SPEC)


@register("headline_polarity", sql_project(
    f"SELECT *, CASE WHEN sentiment_score > 0.05 THEN 'positive' WHEN sentiment_score < -0.05 THEN 'negative' ELSE 'neutral' END AS sentiment_label "
    f"FROM ({headline_polarity_sql()}) s", POL_SPEC))
def q_headline_polarity(spark, sf_dir):
    """X24/G5/X9 with phrases, case, contrast and marks: every whole text scored by the learned lexicon."""
    s = P.ticker_polarity(headlines(spark, sf_dir), quality_lexicon(spark, sf_dir))
    return spark_project(s.withColumn("sentiment_label", S.sentiment_label(F.col("sentiment_score"))), POL_SPEC)
