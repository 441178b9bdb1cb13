"""Registered queries of sources, sinks, requests and reports: what is written is read back and compared.

Fixtures are derived from the driver tables by stated rules; their SQL forms stand beside them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.config import DEFAULT
from barlake.operators import metrics as M
from barlake.operators import report as RP
from barlake.operators import sentiment as S
from barlake.operators.cleaning import sparse_summary
from barlake.operators.quality import run_metadata, validate
from barlake.operators.requests import check_requests
from barlake.plans import jobs
from barlake.plans import sql_twins as sq
from barlake.plans.catalog import CLEAN_REPORT_SPEC, QUALITY_SPEC, register
from barlake.plans.pipeline import clean_report, feature_table, preprocessed_bars
from barlake.plans.projection import BARS_SPEC, spark_project, sql_project
from barlake.schemas import VALUE_COLS, model_columns
from barlake.session import checkpoint_dir, staged
from barlake.sinks import writers as W
from barlake.sources import bars as B
from barlake.sources import tables as TB
from barlake.sources.fixtures import fundamentals, scored_table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Six tickers by supplier.
MODE = "CASE l_suppkey % 6 WHEN 0 THEN 'AIR' WHEN 1 THEN 'FOB' WHEN 2 THEN 'MAIL' WHEN 3 THEN 'RAIL' WHEN 4 THEN 'SHIP' ELSE 'TRUCK' END"

# ------------------------------------------------------------------ faults in bars

_FAULTS = {
    "Open": "CASE WHEN ticker = 'FOB' AND day(date) = 1 THEN NULL ELSE {0} END",
    "High": "CASE WHEN ticker = 'MAIL' AND day(date) = 2 THEN -{0} WHEN ticker = 'RAIL' AND day(date) = 9 THEN NULL ELSE {0} END",
    "Low": "CASE WHEN ticker = 'FOB' AND day(date) = 3 THEN -{0} WHEN ticker = 'MAIL' AND day(date) = 9 THEN NULL ELSE {0} END",
    "Close": "CASE WHEN ticker = 'MAIL' AND day(date) = 4 THEN NULL WHEN ticker = 'RAIL' AND day(date) = 5 THEN -{0} ELSE {0} END",
    "Adj Close": "CASE WHEN ticker = 'RAIL' AND day(date) = 6 THEN 3 * {0} WHEN ticker = 'TRUCK' AND day(date) = 7 THEN NULL "
                 "WHEN ticker = 'TRUCK' AND day(date) = 8 THEN -{0} ELSE {0} END",
    "Volume": "CASE WHEN ticker = 'AIR' AND day(date) = 8 THEN 0 * {0} ELSE {0} END",
}
_KEPT = "NOT (ticker = 'SHIP' AND day(date) > 10)"


def faulty_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with faults by rule: nulls, negatives, zero volumes, bad splits, and a ticker with long gaps."""
    bars = B.bars_from_lineitem(spark, sf_dir, MODE).where(_KEPT)
    return bars.select("ticker", "date", *[F.expr(e.format(f"`{c}`")).alias(c) for c, e in _FAULTS.items()])


def faulty_bars_sql() -> str:
    cols = ", ".join(f'{e.format(f"""{chr(34)}{c}{chr(34)}""")} AS "{c}"' for c, e in _FAULTS.items())
    return f"SELECT ticker, date, {cols} FROM ({sq.bars_sql(MODE)}) fb WHERE {_KEPT}"


def _on_faults(sql: str) -> str:
    return sql.replace(sq.bars_sql(MODE), faulty_bars_sql())


def _report(bars: DataFrame) -> DataFrame:
    rep = validate(bars)
    return spark_project(rep.select("ticker", "rows", "missing_days", F.size("issues").alias("n_issues"),
                                    F.array_join("issues", " | ").alias("issues")), QUALITY_SPEC)


@register("faulty_quality_report", sql_project(_on_faults(sq.quality_sql(MODE)), QUALITY_SPEC))
def q_faulty_quality(spark, sf_dir):
    """Every issue text of the quality report."""
    return _report(faulty_bars(spark, sf_dir))


_NO_ADJ = _on_faults(sq.quality_sql(MODE)).replace("WHEN n_a > 0", "WHEN false").replace("WHEN g_a > 0", "WHEN false").replace(
    "WHEN bs > 0", "WHEN false").replace("WHEN zv > 0", "WHEN false")


@register("quality_of_present_columns", sql_project(_NO_ADJ, QUALITY_SPEC))
def q_present_columns(spark, sf_dir):
    """rules whose columns are absent are left out."""
    return _report(faulty_bars(spark, sf_dir).drop("Adj Close", "Volume"))


@register("faulty_clean_report", sql_project(_on_faults(sq.clean_report_sql(MODE)), CLEAN_REPORT_SPEC))
def q_faulty_clean(spark, sf_dir):
    """G2-G4/F11/W14 on series with gaps, nulls and a ticker too sparse to keep."""
    return spark_project(clean_report(faulty_bars(spark, sf_dir)), CLEAN_REPORT_SPEC)


STATUS_SPEC = [("ticker", "string"), ("status", "string"), ("cleaned_rows", "long")]


@register("faulty_job_summary", sql_project(f"""
    SELECT req.ticker, CASE WHEN rep.kept THEN 'OK' WHEN NOT rep.kept THEN 'DROPPED' ELSE 'FAILED' END AS status,
           coalesce(rep.cleaned_rows, 0) AS cleaned_rows
    FROM (SELECT DISTINCT {MODE} AS ticker FROM lineitem UNION SELECT DISTINCT l_returnflag FROM lineitem) req
    LEFT JOIN ({_on_faults(sq.clean_report_sql(MODE))}) rep USING (ticker)""", STATUS_SPEC))
def q_faulty_summary(spark, sf_dir):
    """OK, DROPPED and FAILED (return flags are requested too, and have no bars here)."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    requested = li.select(F.explode(F.array(F.expr(MODE), F.col("l_returnflag"))).alias("ticker")).distinct()
    return spark_project(sparse_summary(clean_report(faulty_bars(spark, sf_dir)), requested), STATUS_SPEC)


# ------------------------------------------------------------------ requests

_REQ_TICKER = """CASE o_orderkey % 6 WHEN 0 THEN ' aapl ' WHEN 1 THEN lower(o_orderpriority) WHEN 2 THEN 'TOOLONG' WHEN 3 THEN NULL
    WHEN 4 THEN o_orderstatus ELSE 'Tsla' END"""
_REQ_END = """CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '31/01/2024' WHEN 2 THEN start_date WHEN 3 THEN '2999-01-01'
    WHEN 4 THEN '1990-05-05' ELSE '2005-06-30' END"""
REQ_SPEC = [("request_id", "string"), ("ticker", "string"), ("start", "date"), ("end", "date"), ("reason", "string"), ("valid", "bool")]


@register("request_checks", sql_project(f"""
    WITH r AS (SELECT *, {_REQ_END} AS end_date FROM (
      SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS request_id, {_REQ_TICKER} AS ticker,
             CASE WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS start_date FROM orders) o),
    p AS (SELECT request_id, upper(trim(ticker)) AS ticker, try_cast(try_strptime(start_date, '%Y-%m-%d') AS DATE) AS start,
                 try_cast(try_strptime(end_date, '%Y-%m-%d') AS DATE) AS "end" FROM r)
    SELECT *, reason IS NULL AS valid FROM (SELECT *, CASE
      WHEN NOT coalesce(regexp_full_match(ticker, '[A-Z]{{1,5}}'), false) THEN 'ticker is not one to five letters A-Z'
      WHEN start IS NULL OR "end" IS NULL THEN 'start_date and end_date must be dates like 2024-01-31'
      WHEN "end" > current_date THEN 'the range ends after today'
      WHEN "end" <= start THEN 'the range is empty: its end is not after its start' END AS reason FROM p) c""", REQ_SPEC))
def q_request_checks(spark, sf_dir):
    """Requests derived from orders, with tickers and dates of every kind."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = "CASE WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"
    req = (o.selectExpr("o_orderkey", "CAST(o_orderkey AS STRING) AS request_id", f"{_REQ_TICKER} AS ticker", f"{start} AS start_date")
           .selectExpr("request_id", "ticker", "start_date", f"{_REQ_END} AS end_date"))
    return spark_project(check_requests(req), REQ_SPEC)


# ------------------------------------------------------------------ bar sources

SCAN_SPEC = [("ticker", "string"), ("fetch_status", "string"), ("n", "long"), ("first_day", "date"), ("last_day", "date"), ("volume", "double")]
_FROM, _TO = "1994-01-01", "1996-07-01"


@register("bar_scan", sql_project(f"""
    SELECT r.ticker, CASE WHEN count(b.date) > 0 THEN 'OK' ELSE 'FAILED' END AS fetch_status, count(b.date) AS n,
           min(b.date) AS first_day, max(b.date) AS last_day, coalesce(sum(b."Volume"), 0.0) AS volume
    FROM (VALUES ('AIR'), ('MAIL'), ('GHOST')) r(ticker)
    LEFT JOIN ({sq.bars_sql(MODE)}) b ON b.ticker = r.ticker AND b.date >= DATE '{_FROM}' AND b.date < DATE '{_TO}'
    GROUP BY r.ticker""", SCAN_SPEC))
def q_bar_scan(spark, sf_dir):
    """Bars written as a table by ticker, scanned for named tickers over [start, end)."""
    path = _folder(spark, "bars")
    B.bars_from_lineitem(spark, sf_dir, MODE).write.partitionBy("ticker").parquet(path)
    found = B.read_bars(spark, path, tickers=["air", " MAIL ", "ghost"], start=_FROM, end=_TO)
    asked = spark.createDataFrame([("air",), (" MAIL ",), ("ghost",)], "ticker string")
    agg = found.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
                                      F.sum("Volume").alias("volume"))
    out = B.fetch_status(asked, found).join(agg, "ticker", "left").fillna(0, ["n"]).fillna(0.0, ["volume"])
    return spark_project(out, SCAN_SPEC)


@register("wide_layout", sql_project(f"""
    WITH b AS ({sq.bars_sql('l_returnflag')})
    SELECT t.ticker, d.date, {', '.join(f'b."{c}"' for c in VALUE_COLS)}
    FROM (SELECT DISTINCT ticker FROM b) t, (SELECT DISTINCT date FROM b) d LEFT JOIN b ON b.ticker = t.ticker AND b.date = d.date""", BARS_SPEC))
def q_wide_layout(spark, sf_dir):
    """The vendor's wide layout (one column per field and ticker), written and turned into rows again."""
    bars = B.bars_from_lineitem(spark, sf_dir, "l_returnflag")
    cells = bars.unpivot(["ticker", "date"], VALUE_COLS, "field", "value")
    named = cells.select(F.to_date("date").alias("date"), F.concat_ws("|", "field", "ticker").alias("name"), "value")
    wide = staged(named.groupBy("date").pivot("name").agg(F.first("value")), "wide")
    return spark_project(B.wide_to_long(wide), BARS_SPEC)


# ------------------------------------------------------------------ stores

RAW_SPEC = [("ticker", "string"), ("run_date", "string"), ("n", "long"), ("volume", "double")]


@register("raw_versions", sql_project(f"""
    SELECT ticker, CASE WHEN ticker = 'F' THEN '2024-01-03' ELSE '2024-01-02' END AS run_date, count(*) AS n,
           sum("Volume") + CASE WHEN ticker = 'F' THEN 2 * count(*) ELSE 0 END AS volume
    FROM ({sq.bars_sql('l_linestatus')}) b GROUP BY ticker""", RAW_SPEC))
def q_raw_versions(spark, sf_dir):
    """Raw versions of several days, one of them run again; the newest of every ticker is read."""
    path = _folder(spark, "raw")
    bars = staged(B.bars_from_lineitem(spark, sf_dir, "l_linestatus"), "bars")
    W.write_raw(bars, path, "2024-01-02")
    for extra in (1, 2):  # the second run of the day replaces the first
        W.write_raw(bars.where("ticker = 'F'").withColumn("Volume", F.col("Volume") + extra), path, "2024-01-03")
    latest = TB.load_latest_raw(spark, path)
    return spark_project(latest.groupBy("ticker", "run_date").agg(F.count(F.lit(1)).alias("n"), F.sum("Volume").alias("volume")), RAW_SPEC)


STORE_SPEC = [("source", "string"), ("ticker", "string"), ("n", "long"), ("n_up", "long"), ("n_extra", "long"), ("rsi", "double")]


def _store_sql() -> str:
    one = "SELECT '{0}' AS source, ticker, count(*) AS n, sum(target_direction) AS n_up, {1} AS n_extra, sum(rsi_14) AS rsi FROM f {2} GROUP BY ticker"
    parts = [one.format("cache", "0", "WHERE ticker <> 'N'"), one.format("cache again", "0", "WHERE ticker <> 'N'"),
             one.format("one ticker", "0", "WHERE ticker = 'A'"), one.format("loose files", "CASE WHEN ticker = 'A' THEN count(*) ELSE 0 END", "")]
    return f"WITH f AS ({sq.features_sql('l_returnflag')}) " + " UNION ALL ".join(parts)


@register("feature_store", sql_project(_store_sql(), STORE_SPEC))
def q_feature_store(spark, sf_dir):
    """A store with one of the requested tickers, the misses computed and published once
    (asking again adds nothing), a point read, and loose files with different columns."""
    store, loose = _folder(spark, "features"), _folder(spark, "loose")
    bars = staged(B.bars_from_lineitem(spark, sf_dir, "l_returnflag"), "bars")
    feats = staged(feature_table(bars), "features")
    W.save_features(feats.where("ticker = 'A'"), store)
    asked = spark.createDataFrame([(" a",), ("r",), ("R",), ("GHOST",)], "ticker string")

    def summed(df: DataFrame, source: str) -> DataFrame:
        extra = F.count("extra") if "extra" in df.columns else F.lit(0).cast("long")
        return df.groupBy("ticker").agg(F.lit(source).alias("source"), F.count(F.lit(1)).alias("n"), F.sum("target_direction").alias("n_up"),
                                        extra.alias("n_extra"), F.sum("rsi_14").alias("rsi"))

    first = summed(jobs.features_for(spark, asked, store, bars), "cache")
    again = summed(jobs.features_for(spark, asked, store, bars), "cache again")
    for t in ("A", "N", "R"):
        part = feats.where(F.col("ticker") == t).drop("ticker")
        (part.withColumn("extra", F.lit(1)) if t == "A" else part).write.parquet(f"{loose}/{t.lower()}_features.parquet")
    point = summed(TB.load_feature_data(spark, store, " a "), "one ticker")
    out = first.union(again).union(point).unionByName(summed(TB.load_loose_features(spark, loose), "loose files"))
    return spark_project(out, STORE_SPEC)


META_SPEC = [("ticker", "string"), ("row_count", "long"), ("columns", "string"), ("validation_issues", "string"), ("run_date", "string")]


@register("metadata_files", sql_project(f"SELECT *, '2024-02-01' AS run_date FROM ({sq.run_metadata_sql('l_linestatus')}) m", META_SPEC))
def q_metadata_files(spark, sf_dir):
    """Run metadata written as JSON per ticker and day, and read again."""
    path = _folder(spark, "metadata")
    bars = staged(B.bars_from_lineitem(spark, sf_dir, "l_linestatus"), "bars")
    W.write_metadata(run_metadata(preprocessed_bars(bars), validate(bars), "1992-01-01", "1999-01-01"), path, "2024-02-01")
    back = spark.read.schema("row_count long, columns array<string>, validation_issues array<string>, ticker string, run_date string").json(path)
    return spark_project(back.select("ticker", "row_count", F.array_join("columns", ",").alias("columns"),
                                     F.array_join("validation_issues", " | ").alias("validation_issues"), "run_date"), META_SPEC)


# ------------------------------------------------------------------ log, reports and runs

LOG_SPEC = [("ticker", "string"), ("feature_names", "string"), ("first_feature", "double"), ("prediction", "int"), ("direction", "string"),
            ("confidence", "double"), ("has_time", "bool")]


def _rule_sql(inner: str) -> str:
    """Newest feature row of each ticker with a sign rule's prediction."""
    return f"""SELECT *, CAST(macd_histogram > 0 AS INTEGER) AS prediction, 0.5 + rsi_14 / 200.0 AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM ({inner}) f) x WHERE rn = 1"""


def _rule(latest: DataFrame) -> DataFrame:
    return latest.withColumns({"prediction": (F.col("macd_histogram") > 0).cast("int"), "confidence": 0.5 + F.col("rsi_14") / 200.0})


@register("prediction_log_files", sql_project(f"""
    SELECT ticker, 'bb_upper,macd,macd_histogram,macd_signal,rsi_14,volume_normalised' AS feature_names, volume_normalised AS first_feature, prediction,
           CASE WHEN prediction = 1 THEN 'UP' ELSE 'DOWN' END AS direction, confidence, true AS has_time
    FROM ({_rule_sql(sq.features_sql('l_returnflag'))}) r""".replace("bb_upper,macd,macd_histogram,macd_signal,rsi_14,volume_normalised",
                                                                     "macd,macd_histogram,macd_signal,rsi_14,volume_normalised"), LOG_SPEC))
def q_prediction_log_files(spark, sf_dir):
    """Records with the first five model columns appended as JSON lines, blank lines
    in the log skipped, timestamps parsed."""
    path = _folder(spark, "log")
    feats = feature_table(B.bars_from_lineitem(spark, sf_dir, "l_returnflag"))
    rows = _rule(RP.latest_row(feats))
    W.append_prediction_log(W.prediction_records(rows, model_columns(feats.columns), 1.5), path)
    spark.createDataFrame([("",), ("   ",)], "value string").write.mode("append").text(path)
    log = TB.with_parsed_time(TB.read_prediction_log(spark, path))
    return spark_project(log.select(
        "ticker", F.array_join(F.array_sort(F.map_keys("features")), ",").alias("feature_names"), F.col("features")["volume_normalised"].alias("first_feature"),
        "prediction", RP.direction(F.col("prediction")).alias("direction"), "confidence", F.col("ts").isNotNull().alias("has_time")), LOG_SPEC)


RULES = (("low", 0.02), ("middle", 0.1), ("high", 0.5))
RANK_SPEC = [("model", "string"), ("n", "long"), ("accuracy", "double"), ("f1", "double"), ("beats_baseline", "bool"), ("best_model", "string"),
             ("n_params", "int"), ("stamped", "bool")]


def _ranked_sql() -> str:
    each = " UNION ALL ".join(
        f"SELECT '{name}' AS model, {k} AS ordinal, * FROM ({sq.confusion_sql(f'SELECT label, CAST(score > {cut} AS INTEGER) AS prediction FROM s', None)}) m{k}"
        for k, (name, cut) in enumerate(RULES))
    return f"""WITH s AS ({sq.scored_sql()}), m AS ({each})
    SELECT model, n, accuracy, f1, f1 > (SELECT f1 FROM ({sq.baseline_sql('SELECT * FROM s', None)}) b) AS beats_baseline,
           (SELECT model FROM m ORDER BY f1 DESC, ordinal LIMIT 1) AS best_model, 1 AS n_params, true AS stamped FROM m"""


@register("ranked_rules", sql_project(_ranked_sql(), RANK_SPEC))
def q_ranked_rules(spark, sf_dir):
    """Three threshold rules evaluated, the best by F1 and the flag against the baseline; the runs are
    appended to the training-run table and read again."""
    scored = scored_table(spark, sf_dir)
    runs = None
    for k, (name, cut) in enumerate(RULES):
        m = M.confusion_metrics(scored.withColumn("prediction", (F.col("score") > cut).cast("int"))).withColumns(
            {"model": F.lit(name), "ordinal": F.lit(k), "params": F.create_map(F.lit("cut"), F.lit(str(cut)))})
        runs = m if runs is None else runs.unionByName(m)
    base = M.baseline_always_up(scored).select("f1").scalar()
    ranked = M.beats_baseline(runs, base).withColumn("best_model", M.best_by_f1(runs).select("best_model").scalar())
    path = _folder(spark, "runs")
    W.append_training_runs(ranked, path)
    back = spark.read.parquet(path)
    return spark_project(back.withColumns({"n_params": F.size("params"), "stamped": F.col("run_timestamp").isNotNull()}), RANK_SPEC)


NEWS_SPEC = [("ticker", "string"), ("batch", "long"), ("pos", "int"), ("title", "string"), ("short_title", "string")]
_BATCH = 16


@register("news_titles", sql_project(f"""
    WITH i AS (SELECT upper(substr(lang, 1, 1)) AS ticker, doc_id // {_BATCH} AS batch, doc_id % 4 AS kind, substr(text, 1, 40 + doc_id % 90) AS title,
                      CAST(row_number() OVER (PARTITION BY upper(substr(lang, 1, 1)), doc_id // {_BATCH} ORDER BY doc_id) - 1 AS INTEGER) AS pos FROM documents)
    SELECT ticker, batch, pos, title, CASE WHEN length(title) > 80 THEN substr(title, 1, 80) || '...' ELSE title END AS short_title
    FROM i WHERE pos < 10 AND kind IN (0, 1) AND title <> '' AND title IS NOT NULL""", NEWS_SPEC))
def q_news_titles(spark, sf_dir):
    """Nested news (outer title, nested title, content without a title, empty title), the first ten of
    every list, cut for display. Lists hold at most 16 items."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    title = F.expr("substr(text, 1, CAST(40 + doc_id % 90 AS INT))")
    kind = F.col("doc_id") % 4
    content = F.struct(F.when(kind == 1, title).alias("title"))
    item = F.struct("doc_id", F.when(kind == 3, "").when(kind == 0, title).otherwise("outer").alias("title"),
                    F.when((kind == 1) | (kind == 2), content).alias("content"))
    lists = (d.select(F.upper(F.substring("lang", 1, 1)).alias("letter"), F.expr(f"doc_id div {_BATCH}").alias("batch"), item.alias("item"))
             .groupBy("letter", "batch").agg(F.array_sort(F.collect_list("item")).alias("news")))
    news = lists.select(F.concat_ws("/", "letter", "batch").alias("ticker"), F.transform("news", lambda x: F.struct(
        x["title"].alias("title"), x["content"].alias("content"))).alias("news"))
    path = _folder(spark, "news")
    news.write.json(path)
    from barlake.schemas import NEWS

    titles = S.news_titles(spark.read.schema(NEWS).json(path), first_n=10)
    parts = F.split("ticker", "/")
    return spark_project(titles.select(parts[0].alias("ticker"), parts[1].cast("long").alias("batch"), "pos", "title",
                                       S.short_title(F.col("title")).alias("short_title")), NEWS_SPEC)


RECORD_SPEC = [("ticker", "string"), ("direction_prediction", "string"), ("confidence", "d4"), ("anomaly_flag", "bool"), ("sentiment_score", "double"),
               ("rsi_14", "double"), ("bollinger_position", "string"), ("volume_ratio", "double"), ("market_cap", "string"),
               ("pe_ratio", "double"), ("model_used", "string"), ("dated", "bool")]
_LETTERS = "CASE {0} WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE 'X' || {0} END"


@register("analysis_record", sql_project(f"""
    WITH r AS ({_rule_sql(sq.features_sql('l_returnflag'))}),
    i AS (SELECT f.*, {_LETTERS.format('s_suppkey')} AS letter FROM ({sq.fundamentals_api_sql()}) f
          JOIN (SELECT s_suppkey, translate(lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), '0123456789', 'ABCDEFGHIJ') AS t FROM supplier) s ON s.t = f.ticker)
    SELECT r.ticker, CASE WHEN prediction = 1 THEN 'UP' ELSE 'DOWN' END AS direction_prediction, round(confidence, 4) AS confidence,
           r.ticker = 'N' AS anomaly_flag, sentiment_score, round(rsi_14, 2) AS rsi_14,
           CASE WHEN bb_position > 0.8 THEN 'upper' WHEN bb_position < 0.2 THEN 'lower' ELSE 'middle' END AS bollinger_position,
           round(volume_ratio, 4) AS volume_ratio, i.market_cap, i.pe_ratio, 'rule' AS model_used, true AS dated
    FROM r LEFT JOIN i ON i.letter = r.ticker""", RECORD_SPEC))
def q_analysis_record(spark, sf_dir):
    """Analysis rows of a sign rule's predictions with an anomaly flag and fundamentals that match two of three tickers."""
    feats = staged(feature_table(B.bars_from_lineitem(spark, sf_dir, "l_returnflag")), "features")
    preds = _rule(RP.latest_row(feats)).select("ticker", "prediction", "confidence", F.lit("rule").alias("model"))
    flag = spark.createDataFrame([("N", True)], "ticker string, anomaly_flag boolean")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", F.translate(
        F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), "0123456789", "ABCDEFGHIJ").alias("ticker"))
    info = fundamentals(spark, sf_dir).join(s, "ticker").withColumn("ticker", F.expr(_LETTERS.format("s_suppkey"))).drop("s_suppkey")
    rec = RP.analysis_record(feats, preds, flag, info)
    return spark_project(rec.select("*", "signals.rsi_14", "signals.bollinger_position", "signals.volume_ratio", "fundamentals.market_cap",
                                    "fundamentals.pe_ratio", F.col("analysis_date").isNotNull().alias("dated")), RECORD_SPEC)




# ------------------------------------------------------------------ models as tables

MODEL_SPEC = [("model", "string"), ("n_train", "long"), ("n_test", "long"), ("n_up", "long"), ("n_equal", "long"), ("n_side_by_side", "long"),
              ("named_features", "long"), ("timed", "bool"), ("weighs_features", "bool")]
_SPLIT = sq.split_sql(sq.features_sql("l_returnflag"), DEFAULT.training.test_size, DEFAULT.training.random_seed)


@register("exported_models", sql_project(f"""
    WITH s AS ({_SPLIT}), t AS (SELECT count_if(split = 'train') AS n_train, count_if(split = 'test') AS n_test,
                                       count_if(split = 'test' AND target_direction = 1) AS n_up FROM s)
    SELECT m.model, n_train, n_test, n_up, n_test AS n_equal, n_test AS n_side_by_side, 16 AS named_features, true AS timed, m.trees AS weighs_features
    FROM (VALUES ('Random Forest', true), ('XGBoost', true), ('Logistic Regression', false)) m(model, trees), t""", MODEL_SPEC))
def q_exported_models(spark, sf_dir):
    """The three classifiers are trained, exported as node and coefficient rows, written,
    and scored by joins; every test row's class and probability must equal the library's, also side by side."""
    from barlake.operators import classifiers as C
    from barlake.operators import model_tables as MT
    from barlake.operators.split import random_split

    cfg = DEFAULT.training
    ft = staged(feature_table(B.bars_from_lineitem(spark, sf_dir, "l_returnflag")), "features")
    split = staged(random_split(ft, cfg.test_size, cfg.random_seed), "split")
    runs, models = C.train_evaluate(split, cfg)
    cols = model_columns(ft.columns)
    test = split.where("split = 'test'").select("ticker", "date", "target_direction", *cols)
    together = C.side_by_side(test, models)
    out = None
    for name, model in models.items():
        nodes = staged(MT.export(model, cols, _folder(spark, "trees")), "model")
        depth = {"RandomForest": cfg.rf_max_depth, "XGBoost": cfg.gbt_max_depth}.get(name, 0)
        mine = MT.score_rows(nodes, test, cols, ["ticker", "date"], depth).withColumnRenamed("prediction", "own").withColumnRenamed("score", "own_score")
        both = C.score(model, test).select("ticker", "date", "target_direction", "prediction", "score").join(mine, ["ticker", "date"])
        both = both.join(together.select("ticker", "date", F.col(f"pred_{name}").alias("beside"), F.col(f"conf_{name}").alias("conf")), ["ticker", "date"])
        agg = both.agg(F.count(F.lit(1)).alias("n_test"), F.sum("target_direction").alias("n_up"),
                       F.count_if((F.col("own") == F.col("prediction")) & (F.abs(F.col("own_score") - F.col("score")) < 1e-9)).alias("n_equal"),
                       F.count_if((F.col("beside") == F.col("own")) & (F.abs(F.col("conf") - F.col("confidence")) < 1e-9)).alias("n_side_by_side"))
        out = (lambda x: x if out is None else out.unionByName(x))(agg.withColumn("name", F.lit(name)))
    total = C.importances_table(runs).groupBy(F.col("model").alias("name")).agg(F.sum("importance").alias("weight"))
    facts = runs.select(F.col("model").alias("name"), "n_train", (F.col("training_time_seconds") > 0).alias("timed"))
    joined = out.join(facts, "name").join(total, "name", "left")
    return spark_project(joined.select("*", C.display_name("name").alias("model"), F.lit(len(cols)).alias("named_features"),
                                       F.coalesce(F.abs(F.col("weight") - 1) < 1e-9, F.lit(False)).alias("weighs_features")), MODEL_SPEC)
