"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each builder returns plain ANSI-ish SQL over the driver's pre-registered
views. The Spark side and these strings share only the configuration values.
Doubles are rounded to the same places on both sides before the value hash.
"""

from __future__ import annotations

from barlake.config import DEFAULT, Config

R = 6      # places for plain doubles
R_EMA = 4  # places for EMA-derived doubles


def bars_sql(ticker_col: str = "l_linestatus") -> str:
    return f"""
    SELECT ticker, date,
           min(k).e AS "Open", max(l_extendedprice) AS "High", min(l_extendedprice) AS "Low",
           max(k).e AS "Close", max(k).e * (1 - max(k).d) AS "Adj Close", sum(l_quantity) AS "Volume"
    FROM (
      SELECT {ticker_col} AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice, l_quantity,
             struct_pack(o := l_orderkey, n := l_linenumber, p := l_partkey, s := l_suppkey,
                         e := l_extendedprice, d := l_discount) AS k
      FROM lineitem) li
    GROUP BY ticker, date"""


def _fdiv(num: str, den: str) -> str:
    return (f"(CASE WHEN ({num}) IS NULL OR ({den}) IS NULL THEN NULL "
            f"WHEN ({den}) = 0 THEN (CASE WHEN ({num}) > 0 THEN 'inf'::DOUBLE "
            f"WHEN ({num}) < 0 THEN '-inf'::DOUBLE ELSE NULL END) ELSE ({num}) / ({den}) END)")


def _flog(x: str) -> str:
    return (f"(CASE WHEN ({x}) = 0 THEN '-inf'::DOUBLE WHEN ({x}) = 'inf'::DOUBLE THEN 'inf'::DOUBLE "
            f"WHEN ({x}) > 0 THEN ln({x}) ELSE NULL END)")


def _roll(agg: str, x: str, n: int, key="ticker", order="date") -> str:
    frame = f"OVER (PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"(CASE WHEN count({x}) {frame} >= {n} THEN {agg}({x}) {frame} END)"


def quality_sql(ticker_col: str = "l_linestatus") -> str:
    wd = "(isodow(date) - 1)"
    return f"""
    WITH bars AS ({bars_sql(ticker_col)}),
    agg AS (
      SELECT ticker, count(*) AS rows, min(date) AS a, max(date) AS b,
             count_if({wd} < 5) AS wrows,
             count_if("Open" IS NULL) n_o, count_if("Open" < 0) g_o,
             count_if("High" IS NULL) n_h, count_if("High" < 0) g_h,
             count_if("Low" IS NULL) n_l, count_if("Low" < 0) g_l,
             count_if("Close" IS NULL) n_c, count_if("Close" < 0) g_c,
             count_if("Adj Close" IS NULL) n_a, count_if("Adj Close" < 0) g_a,
             count_if("Volume" = 0) zv,
             count_if({_fdiv('"Adj Close"', '"Close"')} < 0.5 OR {_fdiv('"Adj Close"', '"Close"')} > 1.5) bs
      FROM bars GROUP BY ticker),
    cal AS (
      SELECT ticker, (SELECT count(*) FROM generate_series(a, b, INTERVAL 1 DAY) g(d)
                      WHERE isodow(d) <= 5) AS ndays FROM agg)
    SELECT ticker, CAST(rows AS BIGINT) AS rows, CAST(ndays - wrows AS BIGINT) AS missing_days,
           CAST(len(issues) AS INTEGER) AS n_issues, array_to_string(issues, ' | ') AS issues
    FROM (SELECT agg.*, ndays, list_filter([
             CASE WHEN ndays - wrows > 0 THEN (ndays - wrows)::VARCHAR || ' missing trading day(s) found' END,
             CASE WHEN n_o > 0 THEN 'Open has ' || n_o || ' null(s)' END,
             CASE WHEN g_o > 0 THEN 'Open has ' || g_o || ' negative value(s)' END,
             CASE WHEN n_h > 0 THEN 'High has ' || n_h || ' null(s)' END,
             CASE WHEN g_h > 0 THEN 'High has ' || g_h || ' negative value(s)' END,
             CASE WHEN n_l > 0 THEN 'Low has ' || n_l || ' null(s)' END,
             CASE WHEN g_l > 0 THEN 'Low has ' || g_l || ' negative value(s)' END,
             CASE WHEN n_c > 0 THEN 'Close has ' || n_c || ' null(s)' END,
             CASE WHEN g_c > 0 THEN 'Close has ' || g_c || ' negative value(s)' END,
             CASE WHEN n_a > 0 THEN 'Adj Close has ' || n_a || ' null(s)' END,
             CASE WHEN g_a > 0 THEN 'Adj Close has ' || g_a || ' negative value(s)' END,
             CASE WHEN zv > 0 THEN 'Volume is zero on ' || zv || ' trading day(s)' END,
             CASE WHEN bs > 0 THEN 'Adj Close / Close ratio is extreme on ' || bs
                  || ' day(s) — possible bad split adjustment' END], lambda x: x IS NOT NULL) AS issues
          FROM agg JOIN cal USING (ticker)) q"""


def cleaned_sql(ticker_col: str = "l_linestatus", cfg: Config = DEFAULT) -> str:
    d = cfg.data
    lim = d.max_consecutive_fill
    fill = ", ".join(
        f'last_value(b."{c}" IGNORE NULLS) OVER (PARTITION BY c.ticker ORDER BY c.date '
        f'ROWS BETWEEN {lim} PRECEDING AND CURRENT ROW) AS "{c}"'
        for c in ["Open", "High", "Low", "Close", "Adj Close", "Volume"])
    nulls = " + ".join(f'CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END'
                       for c in ["Open", "High", "Low", "Close", "Adj Close", "Volume"])
    p = d.volume_outlier_cap_percentile / 100.0
    return f"""
    WITH bars AS ({bars_sql(ticker_col)}),
    span AS (SELECT ticker, min(date) a, max(date) b FROM bars GROUP BY ticker),
    cal AS (SELECT ticker, CAST(g.d AS DATE) AS date FROM span, generate_series(a, b, INTERVAL 1 DAY) g(d)
            WHERE isodow(g.d) <= 5),
    dense AS (SELECT c.ticker, c.date, {fill} FROM cal c LEFT JOIN bars b
              ON b.ticker = c.ticker AND b.date = c.date),
    scored AS (SELECT *, avg(({nulls}) / 6.0) OVER (PARTITION BY ticker) AS mp FROM dense),
    kept AS (SELECT * FROM scored WHERE mp <= {d.max_missing_pct}
             AND "Open" IS NOT NULL AND "High" IS NOT NULL AND "Low" IS NOT NULL
             AND "Close" IS NOT NULL AND "Adj Close" IS NOT NULL AND "Volume" IS NOT NULL),
    caps AS (SELECT ticker, quantile_cont("Volume", {p}) AS cap FROM kept GROUP BY ticker)
    SELECT k.ticker, k.date, "Open", "High", "Low", "Close", "Adj Close",
           least("Volume", cap) AS "Volume"
    FROM kept k JOIN caps USING (ticker)"""


def preprocessed_sql(ticker_col: str = "l_linestatus", cfg: Config = DEFAULT) -> str:
    n = cfg.data.volume_norm_window
    prev = 'lag("Close", 1) OVER (PARTITION BY ticker ORDER BY date)'
    return f"""
    WITH cleaned AS ({cleaned_sql(ticker_col, cfg)}),
    p AS (SELECT *, {_flog(_fdiv('"Close"', prev))} AS log_return,
                 {_fdiv('"Volume"', _roll('avg', '"Volume"', n))} AS volume_normalised
          FROM cleaned)
    SELECT * FROM p WHERE log_return IS NOT NULL AND volume_normalised IS NOT NULL
      AND NOT isnan(log_return) AND NOT isnan(volume_normalised)"""


def features_sql(ticker_col: str = "l_linestatus", cfg: Config = DEFAULT, sentiment: str | None = None) -> str:
    f = cfg.features
    a12, a26, a9 = (2.0 / (s + 1.0) for s in (f.macd_fast, f.macd_slow, f.macd_signal))
    w = "OVER (PARTITION BY ticker ORDER BY date)"
    delta = f'("Close" - lag("Close", 1) {w})'
    ag = _roll("avg", "gain", f.rsi_period)
    al = _roll("avg", "loss", f.rsi_period)
    bw = f.bollinger_window
    sma = _roll("avg", '"Close"', bw)
    sd = _roll("stddev_samp", '"Close"', bw)
    lags = ", ".join(f"lag(log_return, {k}) {w} AS return_lag_{k}d" for k in f.lag_periods)
    if sentiment is None:
        sent_expr, sent_join = f"{f.sentiment_neutral_fill}::DOUBLE", ""
    else:
        sent_expr = f"coalesce(snt.sentiment_score, {f.sentiment_neutral_fill})::DOUBLE"
        sent_join = f"LEFT JOIN ({sentiment}) snt USING (ticker)"
    return f"""
    WITH RECURSIVE pre AS ({preprocessed_sql(ticker_col, cfg)}),
    num AS (SELECT *, row_number() {w} AS rn FROM pre),
    ema(ticker, rn, e_fast, e_slow, sig) AS (
      SELECT ticker, rn, "Close", "Close", 0.0::DOUBLE FROM num WHERE rn = 1
      UNION ALL
      SELECT n.ticker, n.rn,
             {a12} * n."Close" + (1 - {a12}) * e.e_fast,
             {a26} * n."Close" + (1 - {a26}) * e.e_slow,
             {a9} * (({a12} * n."Close" + (1 - {a12}) * e.e_fast) - ({a26} * n."Close" + (1 - {a26}) * e.e_slow))
               + (1 - {a9}) * e.sig
      FROM ema e JOIN num n ON n.ticker = e.ticker AND n.rn = e.rn + 1),
    g AS (SELECT num.*, e_fast - e_slow AS macd, CASE WHEN num.rn = 1 THEN 0.0 ELSE sig END AS macd_signal,
                 CASE WHEN {delta} > 0 THEN {delta} ELSE 0.0 END AS gain,
                 CASE WHEN {delta} < 0 THEN -{delta} ELSE 0.0 END AS loss
          FROM num JOIN ema USING (ticker, rn)),
    f AS (
      SELECT ticker, date, "Open", "High", "Low", "Close", "Adj Close", "Volume", log_return, volume_normalised,
             CASE WHEN {al} = 0 THEN 0.0 ELSE 100.0 - 100.0 / (1.0 + {ag} / {al}) END AS rsi_{f.rsi_period},
             macd, macd_signal, macd - macd_signal AS macd_histogram,
             {sma} + {f.bollinger_std} * {sd} AS bb_upper, {sma} AS bb_middle,
             {sma} - {f.bollinger_std} * {sd} AS bb_lower,
             {_roll("stddev_samp", "log_return", f.volatility_window)} AS volatility_{f.volatility_window}d,
             {_fdiv('"Volume"', _roll("avg", '"Volume"', f.volume_ratio_window))} AS volume_ratio,
             {sent_expr} AS sentiment_score,
             {lags},
             CAST(coalesce(lead("Close", 1) {w} > "Close", false) AS INTEGER) AS target_direction,
             abs({_fdiv('"Close"', f'lag("Close", 1) {w}')} - 1) AS price_change_pct
      FROM g {sent_join})
    SELECT * FROM (
      SELECT * REPLACE ({_fdiv('"Close" - bb_lower', 'bb_upper - bb_lower')} AS bb_position)
      FROM (SELECT *, NULL::DOUBLE AS bb_position FROM f) f2) f3
    WHERE COLUMNS(*) IS NOT NULL"""


def clean_report_sql(ticker_col: str = "l_linestatus", cfg: Config = DEFAULT) -> str:
    d = cfg.data
    body = cleaned_sql(ticker_col, cfg)
    # reuse the cleaned CTE chain up to `caps`, then report per ticker
    head = body[: body.rindex("    SELECT k.ticker")]
    return f"""{head}
    , rep AS (SELECT s.ticker, any_value(mp) AS missing_pct FROM scored s GROUP BY s.ticker),
    capped AS (SELECT ticker, any_value(cap) AS volume_cap, count_if("Volume" > cap) AS n_capped,
                      count(*) AS cleaned_rows FROM kept JOIN caps USING (ticker) GROUP BY ticker)
    SELECT rep.ticker, missing_pct, missing_pct <= {d.max_missing_pct} AS kept, volume_cap,
           coalesce(n_capped, 0) AS n_capped, coalesce(cleaned_rows, 0) AS cleaned_rows
    FROM rep LEFT JOIN capped USING (ticker)"""


EPOCH = "2024-01-01"


def scored_sql() -> str:
    return f"""
    SELECT upper(d.lang) AS ticker, CAST(DATE '{EPOCH}' + CAST(l.doc_id AS INTEGER) AS DATE) AS date,
           CAST(l.quality AS INTEGER) AS label,
           CAST(CAST(d.n_chars AS DOUBLE) / (SELECT max(d2.n_chars) FROM labels l2 JOIN documents d2
                 ON l2.doc_id = d2.doc_id) > 0.5 AS INTEGER) AS prediction,
           CAST(d.n_chars AS DOUBLE) / (SELECT CAST(max(d2.n_chars) AS DOUBLE) FROM labels l2
                 JOIN documents d2 ON l2.doc_id = d2.doc_id) AS score
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def _rates(prefix: str = "") -> str:
    return f"""
           CASE WHEN tp + tn + fp + fn = 0 THEN 0.0 ELSE (tp + tn) / (tp + tn + fp + fn) END AS accuracy,
           CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision,
           CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
           CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1"""


def confusion_sql(inner: str, group: str | None, label: str = "label", pred: str = "prediction") -> str:
    sel = f"{group}, " if group else ""
    grp = f"GROUP BY {group}" if group else ""
    return f"""
    SELECT *, {_rates()} FROM (
      SELECT {sel}count(*) AS n,
             count_if({label} = 0 AND {pred} = 0)::DOUBLE AS tn, count_if({label} = 0 AND {pred} = 1)::DOUBLE AS fp,
             count_if({label} = 1 AND {pred} = 0)::DOUBLE AS fn, count_if({label} = 1 AND {pred} = 1)::DOUBLE AS tp
      FROM ({inner}) s {grp}) c"""


def auc_sql(inner: str, group: str | None) -> str:
    part = f"PARTITION BY {group}" if group else ""
    part2 = f"PARTITION BY {group}, score" if group else "PARTITION BY score"
    sel = f"{group}, " if group else ""
    grp = f"GROUP BY {group}" if group else ""
    return f"""
    SELECT {sel}CASE WHEN count_if(label = 1) = 0 OR count_if(label = 0) = 0 THEN NULL ELSE
           (sum(CASE WHEN label = 1 THEN r END) - count_if(label = 1) * (count_if(label = 1) + 1) / 2.0)
           / (count_if(label = 1)::DOUBLE * count_if(label = 0)) END AS roc_auc
    FROM (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({part2}) - 1) / 2.0 AS r
          FROM ({inner}) s) ranked
    {grp}"""


def baseline_sql(inner: str, group: str | None, label: str = "label") -> str:
    sel = f"{group}, " if group else ""
    grp = f"GROUP BY {group}" if group else ""
    return f"""
    SELECT {sel}n, p AS accuracy, p AS precision, CASE WHEN p > 0 THEN 1.0 ELSE 0.0 END AS recall,
           CASE WHEN 1 + p = 0 THEN 0.0 ELSE 2 * p / (1 + p) END AS f1
    FROM (SELECT {sel}count(*) AS n, avg(CAST({label} AS DOUBLE)) AS p FROM ({inner}) s {grp}) b"""


def fairness_sql(inner: str, pair: tuple[str, str], min_rows: int, gap_limit: float) -> str:
    a, b = pair
    m = confusion_sql(f"SELECT * FROM ({inner}) x WHERE ticker IN ('{a}', '{b}')", "ticker")
    cols = ", ".join(f"max(CASE WHEN ticker = '{t}' THEN {c} END) AS {c}_{t}"
                     for t in pair for c in ("accuracy", "f1", "n"))
    return f"""
    SELECT *, abs(accuracy_{a} - accuracy_{b}) AS accuracy_gap, abs(accuracy_{a} - accuracy_{b}) > {gap_limit} AS gap_warning
    FROM (SELECT {cols} FROM ({m}) m WHERE n >= {min_rows}) w"""


def split_sql(inner: str, test_size: float, seed: int, label: str = "target_direction") -> str:
    key = f"concat_ws('|', ticker, CAST(date AS VARCHAR), '{seed}')"
    return f"""
    WITH f AS ({inner}),
    c AS (SELECT {label} AS label, count(*) AS n, (SELECT count(*) FROM f) AS total,
                 CAST(ceil(CAST({test_size} AS DOUBLE) * (SELECT count(*) FROM f)) AS BIGINT) AS wanted FROM f GROUP BY {label}),
    b AS (SELECT *, wanted * n // total AS base, row_number() OVER (ORDER BY wanted * n % total DESC, label) AS rest FROM c),
    q AS (SELECT label, base + CAST(rest <= wanted - (SELECT sum(base) FROM b) AS BIGINT) AS quota FROM b)
    SELECT f.*, CASE WHEN row_number() OVER (PARTITION BY {label} ORDER BY ('0x' || substr(md5({key}), 1, 15))::BIGINT, {key}) <= q.quota
                     THEN 'test' ELSE 'train' END AS split
    FROM f JOIN q ON q.label = f.{label}"""


def ks_sql(inner: str, feature_cols: list[str], ref_fraction: float, lookback: int, min_values: int) -> str:
    on = ", ".join(feature_cols)
    ords = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(feature_cols))
    return f"""
    WITH f AS (SELECT * FROM ({inner}) x),
    flagged AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn,
                       count(*) OVER (PARTITION BY ticker) AS n FROM f),
    flags AS (SELECT ticker, {on}, rn <= floor(n * {ref_fraction}) AS is_ref, rn > n - {lookback} AS is_rec
              FROM flagged),
    long AS (UNPIVOT flags ON {on} INTO NAME feature VALUE value),
    cnt AS (SELECT ticker, feature, value, count_if(is_ref) AS c_ref, count_if(is_rec) AS c_rec
            FROM long GROUP BY ticker, feature, value),
    cum AS (SELECT *, sum(c_ref) OVER (PARTITION BY ticker, feature ORDER BY value) AS cum_ref,
                      sum(c_rec) OVER (PARTITION BY ticker, feature ORDER BY value) AS cum_rec,
                      sum(c_ref) OVER (PARTITION BY ticker, feature) AS n_ref,
                      sum(c_rec) OVER (PARTITION BY ticker, feature) AS n_rec FROM cnt)
    SELECT ticker, feature, CASE feature {ords} END AS ordinal, n_ref, n_rec, h,
           CAST(h AS DOUBLE) / CAST(n_ref * n_rec AS DOUBLE) AS ks_statistic
    FROM (SELECT ticker, feature, any_value(n_ref) AS n_ref, any_value(n_rec) AS n_rec,
                 max(abs(cum_ref * n_rec - cum_rec * n_ref)) AS h FROM cum GROUP BY ticker, feature) s
    WHERE n_ref >= {min_values} AND n_rec >= {min_values}"""


def prediction_log_sql() -> str:
    return """
    SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, upper(event_type) AS ticker,
           CAST(value > (SELECT quantile_cont(value, 0.5) FROM events) AS INTEGER) AS prediction,
           0.5 + 0.5 * value / (SELECT max(value) FROM events) AS confidence, value AS latency_ms, event_id
    FROM events"""


def prediction_drift_sql(lookback: int, threshold: float, min_rows: int) -> str:
    return f"""
    WITH log AS ({prediction_log_sql()}),
    ranked AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, ticker DESC, event_id DESC) AS rk,
                      count(*) OVER () AS n FROM log),
    s AS (SELECT any_value(n) AS n,
                 avg(CASE WHEN rk > least({lookback}, n // 3) THEN prediction END) AS hist,
                 avg(CASE WHEN rk <= least({lookback}, n // 3) THEN prediction END) AS rec FROM ranked)
    SELECT n AS n_records, CASE WHEN n >= {min_rows} THEN hist END AS historical_up_pct,
           CASE WHEN n >= {min_rows} THEN rec END AS recent_up_pct,
           CASE WHEN n >= {min_rows} THEN abs(rec - hist) END AS shift, {threshold} AS threshold,
           coalesce(CASE WHEN n >= {min_rows} THEN abs(rec - hist) > {threshold} END, false) AS drifted,
           CASE WHEN n < {min_rows} THEN 'Not enough predictions for drift check' END AS reason
    FROM s"""


def rolling_accuracy_sql(window: int, min_periods: int) -> str:
    frame = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    return f"""
    WITH s AS ({scored_sql()}),
    j AS (SELECT p.ticker, p.date, p.prediction, a.label FROM s p JOIN s a ON p.ticker = a.ticker AND p.date = a.date)
    SELECT *, CASE WHEN count(correct) {frame} >= {min_periods} THEN avg(correct) {frame} END AS rolling_accuracy
    FROM (SELECT *, CAST(prediction = label AS INTEGER) AS correct FROM j) c"""


def headline_sentiment_sql() -> str:
    from barlake.operators import sentiment as S

    lex = ", ".join(f"('{t}', {v})" for t, v in S.DEFAULT_LEXICON)
    negs = ", ".join(f"'{w}'" for w in S.NEGATIONS)
    ups = ", ".join(f"'{w}'" for w in S.BOOSTERS_UP)
    downs = ", ".join(f"'{w}'" for w in S.BOOSTERS_DOWN)
    w = "OVER (PARTITION BY doc_id ORDER BY pos)"

    def step(d: int) -> str:
        dec = S.DISTANCE_DECAY[d - 1]
        return (f"CASE WHEN p{d} IN ({ups}) AND NOT w{d} THEN {S.BOOST_INCR * dec} "
                f"WHEN p{d} IN ({downs}) AND NOT w{d} THEN {S.BOOST_DECR * dec} ELSE 0.0 END")

    def fold(prev: str, d: int) -> str:
        boosted = f"({prev} + ({step(d)}) * sign({prev}))"
        return f"CASE WHEN coalesce(p{d} IN ({negs}), false) THEN {boosted} * {S.NEGATION_SCALAR} ELSE {boosted} END"

    return f"""
    WITH lex(token, valence) AS (VALUES {lex}),
    h AS (SELECT upper(substr(lang, 1, 1)) AS ticker, doc_id, text AS title FROM documents),
    t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}]+'), lambda x: x <> '') AS arr FROM h),
    u AS (SELECT doc_id, unnest(arr) AS tok, generate_subscripts(arr, 1) AS pos FROM t),
    n AS (SELECT u.doc_id, u.pos, coalesce(lex.valence, 0.0) AS base,
                 lag(tok, 1) {w} AS p1, lag(tok, 2) {w} AS p2, lag(tok, 3) {w} AS p3 FROM u LEFT JOIN lex ON u.tok = lex.token),
    nw AS (SELECT n.*, coalesce(p1 IN (SELECT token FROM lex), false) AS w1,
                  coalesce(p2 IN (SELECT token FROM lex), false) AS w2,
                  coalesce(p3 IN (SELECT token FROM lex), false) AS w3 FROM n),
    v1 AS (SELECT *, {fold('base', 1)} AS v1 FROM nw),
    v2 AS (SELECT *, {fold('v1', 2)} AS v2 FROM v1),
    v3 AS (SELECT *, CASE WHEN base = 0 THEN 0.0 ELSE {fold('v2', 3)} END AS v FROM v2),
    per_doc AS (SELECT h.ticker, h.doc_id, coalesce(sum(v3.v), 0.0) AS s FROM h LEFT JOIN v3 USING (doc_id)
                GROUP BY h.ticker, h.doc_id)
    SELECT ticker, avg(s / sqrt(s * s + {S.NORMALIZE_ALPHA})) AS sentiment_score, count(*) AS n_headlines
    FROM per_doc GROUP BY ticker"""


def fundamentals_fixture_sql() -> str:
    return """
    SELECT translate(lpad(CAST(s_suppkey AS VARCHAR), 5, '0'), '0123456789', 'ABCDEFGHIJ') AS ticker,
           s_acctbal / 97.0 AS "trailingPE", s_acctbal / 971.0 AS "trailingEps",
           CASE WHEN s_suppkey % 7 = 0 THEN 0.0 ELSE abs(s_acctbal) *
                (CASE WHEN s_nationkey % 3 = 0 THEN 1e9 WHEN s_nationkey % 3 = 1 THEN 1e6 ELSE 1e12 END) / 997.0
           END AS "marketCap",
           s_acctbal / 9973.0 AS "profitMargins", s_acctbal / 19997.0 AS "revenueGrowth",
           abs(s_acctbal) / 7.0 + 1 AS "fiftyTwoWeekHigh", abs(s_acctbal) / 13.0 AS "fiftyTwoWeekLow",
           abs(s_acctbal) * 997.0 / 3.0 AS "averageVolume",
           CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE abs(s_acctbal) / 17.0 END AS "regularMarketPrice"
    FROM supplier"""


def _dec_round(x: str, places: int) -> str:
    # Spark's bround on a double: half-even on its shortest decimal string
    return f"CAST(round_even(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(38, 12)), {places}) AS DOUBLE)"


def _cap(c: str, na_zero: bool) -> str:
    na = f"WHEN {c} IS NULL OR {c} = 0 THEN 'N/A'" if na_zero else f"WHEN {c} IS NULL THEN 'N/A'"
    return (f"CASE {na} WHEN {c} >= 1e12 THEN printf('$%.2fT', {_dec_round(c + ' / 1e12', 2)}) "
            f"WHEN {c} >= 1e9 THEN printf('$%.2fB', {_dec_round(c + ' / 1e9', 2)}) "
            f"ELSE printf('$%.0fM', {_dec_round(c + ' / 1e6', 0)}) END")


def fundamentals_api_sql() -> str:
    return f"""
    SELECT ticker, "regularMarketPrice" IS NOT NULL AS found, "trailingPE" AS pe_ratio, "trailingEps" AS eps,
           {_cap('"marketCap"', True)} AS market_cap, "profitMargins" AS profit_margin,
           "revenueGrowth" AS revenue_growth, "fiftyTwoWeekHigh" AS fifty_two_week_high,
           "fiftyTwoWeekLow" AS fifty_two_week_low
    FROM ({fundamentals_fixture_sql()}) f"""


def fundamentals_dashboard_sql() -> str:
    def num(c):
        return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%.2f', {_dec_round(c, 2)}) END"

    def pct(c):
        return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE printf('%.1f%%', {_dec_round(c + ' * 100', 1)}) END"

    return f"""
    SELECT ticker, {num('"trailingPE"')} AS pe_ratio, {num('"trailingEps"')} AS eps,
           {_cap('"marketCap"', False)} AS market_cap, {pct('"profitMargins"')} AS profit_margin,
           {pct('"revenueGrowth"')} AS revenue_growth, {num('"fiftyTwoWeekHigh"')} AS high_52w,
           {num('"fiftyTwoWeekLow"')} AS low_52w,
           CASE WHEN "averageVolume" IS NULL THEN 'N/A' ELSE printf('%.1fM', {_dec_round('"averageVolume" / 1e6', 1)}) END
             AS avg_volume
    FROM ({fundamentals_fixture_sql()}) f"""


def latest_vs_previous_sql(ticker_col: str = "l_linestatus") -> str:
    return f"""
    WITH r AS (SELECT ticker, date, "Close", row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn
               FROM ({bars_sql(ticker_col)}) b),
    a AS (SELECT ticker, max(CASE WHEN rn = 1 THEN date END) AS date,
                 max(CASE WHEN rn = 1 THEN "Close" END) AS latest_close,
                 coalesce(max(CASE WHEN rn = 2 THEN "Close" END), max(CASE WHEN rn = 1 THEN "Close" END)) AS previous_close
          FROM r WHERE rn <= 2 GROUP BY ticker)
    SELECT *, latest_close - previous_close AS change,
           {_fdiv('latest_close - previous_close', 'previous_close')} * 100 AS change_pct FROM a"""


def latest_signals_sql() -> str:
    inner = features_sql("l_linestatus", DEFAULT, headline_sentiment_sql())
    return f"""
    SELECT ticker, date, round(coalesce(rsi_14, 0.0), 2) AS rsi_14, round(coalesce(macd, 0.0), 4) AS macd,
           round(coalesce(macd_signal, 0.0), 4) AS macd_signal,
           CASE WHEN coalesce(bb_position, 0.5) > 0.8 THEN 'upper' WHEN coalesce(bb_position, 0.5) < 0.2 THEN 'lower'
                ELSE 'middle' END AS bollinger_position,
           round(coalesce(volume_ratio, 1.0), 4) AS volume_ratio,
           round(coalesce(volatility_20d, 0.0), 6) AS volatility_20d,
           round(coalesce(sentiment_score, 0.0), 4) AS sentiment_score
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM ({inner}) f) x
    WHERE rn = 1"""


def log_kpis_sql() -> str:
    return f"""
    SELECT count(*) AS total_requests, avg(CAST(prediction AS DOUBLE)) * 100 AS up_pct,
           avg(confidence) * 100 AS avg_confidence_pct FROM ({prediction_log_sql()}) l"""


def prediction_histogram_sql(min_rows: int = 5) -> str:
    return f"""
    SELECT prediction, count(*) AS n FROM ({prediction_log_sql()}) l GROUP BY prediction
    HAVING (SELECT count(*) FROM ({prediction_log_sql()}) l2) > {min_rows}"""


def display_indicators_sql(ticker_col: str = "l_linestatus", months: int = 12, cfg: Config = DEFAULT) -> str:
    f = cfg.features
    a12, a26, a9 = (2.0 / (s + 1.0) for s in (f.macd_fast, f.macd_slow, f.macd_signal))
    w = "OVER (PARTITION BY ticker ORDER BY date)"
    delta = f'("Close" - lag("Close", 1) {w})'
    ag, al = _roll("avg", "gain", f.rsi_period), _roll("avg", "loss", f.rsi_period)
    sma, sd = _roll("avg", '"Close"', f.bollinger_window), _roll("stddev_samp", '"Close"', f.bollinger_window)
    return f"""
    WITH RECURSIVE b AS ({bars_sql(ticker_col)}),
    lb AS (SELECT * FROM (SELECT *, max(date) OVER (PARTITION BY ticker) AS mx FROM b) x
           WHERE date >= CAST(mx - INTERVAL {months} MONTH AS DATE)),
    num AS (SELECT *, row_number() {w} AS rn FROM lb),
    ema(ticker, rn, e_fast, e_slow, sig) AS (
      SELECT ticker, rn, "Close", "Close", 0.0::DOUBLE FROM num WHERE rn = 1
      UNION ALL
      SELECT n.ticker, n.rn, {a12} * n."Close" + (1 - {a12}) * e.e_fast, {a26} * n."Close" + (1 - {a26}) * e.e_slow,
             {a9} * (({a12} * n."Close" + (1 - {a12}) * e.e_fast) - ({a26} * n."Close" + (1 - {a26}) * e.e_slow))
               + (1 - {a9}) * e.sig
      FROM ema e JOIN num n ON n.ticker = e.ticker AND n.rn = e.rn + 1),
    g AS (SELECT num.*, e_fast - e_slow AS macd, sig AS macd_signal,
                 CASE WHEN {delta} > 0 THEN {delta} ELSE 0.0 END AS gain,
                 CASE WHEN {delta} < 0 THEN -{delta} ELSE 0.0 END AS loss
          FROM num JOIN ema USING (ticker, rn)),
    d AS (SELECT ticker, date, "Open", "Close", macd, macd_signal, macd - macd_signal AS macd_histogram,
                 CASE WHEN {al} = 0 THEN 0.0 ELSE 100.0 - 100.0 / (1.0 + {ag} / {al}) END AS rsi_14,
                 {sma} + {f.bollinger_std} * {sd} AS bb_upper, {sma} AS bb_middle,
                 {sma} - {f.bollinger_std} * {sd} AS bb_lower FROM g)
    SELECT *, "Close" >= "Open" AS is_up, coalesce(macd_histogram, 0.0) >= 0 AS hist_pos,
           CASE WHEN rsi_14 > 70 THEN 'overbought' WHEN rsi_14 < 30 THEN 'oversold' ELSE 'neutral' END AS rsi_zone
    FROM d"""


def missing_days_sql(ticker_col: str = "l_returnflag") -> str:
    return f"""
    WITH bars AS ({bars_sql(ticker_col)}),
    span AS (SELECT ticker, min(date) a, max(date) b FROM bars GROUP BY ticker),
    cal AS (SELECT ticker, CAST(g.d AS DATE) AS date FROM span, generate_series(a, b, INTERVAL 1 DAY) g(d)
            WHERE isodow(g.d) <= 5)
    SELECT c.ticker, c.date FROM cal c ANTI JOIN bars b ON b.ticker = c.ticker AND b.date = c.date"""


def job_summary_sql(cfg: Config = DEFAULT) -> str:
    rep = (f"SELECT * FROM ({clean_report_sql('l_returnflag', cfg)}) r1 UNION ALL "
           f"SELECT * FROM ({clean_report_sql('l_linestatus', cfg)}) r2")
    feats = (f"SELECT ticker, count(*) AS n FROM ({features_sql('l_returnflag', cfg)}) f GROUP BY ticker UNION ALL "
             f"SELECT ticker, count(*) AS n FROM ({features_sql('l_linestatus', cfg)}) g GROUP BY ticker")
    return f"""
    WITH req AS (SELECT DISTINCT upper(trim(l_returnflag)) AS ticker FROM lineitem
                 UNION SELECT DISTINCT upper(trim(l_linestatus)) FROM lineitem),
    rep AS ({rep}), fc AS ({feats})
    SELECT req.ticker, coalesce(CASE WHEN rep.kept THEN 'OK' WHEN NOT rep.kept THEN 'DROPPED' END, 'FAILED') AS status,
           coalesce(rep.cleaned_rows, 0) AS cleaned_rows, coalesce(fc.n, 0) AS feature_rows
    FROM req LEFT JOIN rep USING (ticker) LEFT JOIN fc USING (ticker)"""


def run_metadata_sql(ticker_col: str = "l_linestatus", cfg: Config = DEFAULT) -> str:
    cols = ["Open", "High", "Low", "Close", "Adj Close", "Volume", "log_return", "volume_normalised"]
    nulls = ", ".join(f'count_if("{c}" IS NULL) AS "nulls_{c}"' for c in cols)
    return f"""
    SELECT p.ticker, count(*) AS row_count, '{",".join(cols)}' AS columns, {nulls},
           q.issues AS validation_issues
    FROM ({preprocessed_sql(ticker_col, cfg)}) p LEFT JOIN ({quality_sql(ticker_col)}) q USING (ticker)
    GROUP BY p.ticker, q.issues"""


def hourly_bars_sql() -> str:
    return """
    SELECT upper(substr(event_type, 1, 5)) AS ticker, date_trunc('hour', ts) AS bucket,
           arg_min(value, struct_pack(t := ts, e := event_id)) AS "Open", max(value) AS "High",
           min(value) AS "Low", arg_max(value, struct_pack(t := ts, e := event_id)) AS "Close",
           arg_max(value, struct_pack(t := ts, e := event_id)) AS "Adj Close", CAST(count(*) AS DOUBLE) AS "Volume"
    FROM events GROUP BY 1, 2"""


def _unit(*parts: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15))::BIGINT AS DOUBLE) / {float(16 ** 15)})"


def forest_ctes(inner: str, n_trees: int, max_samples: int, contamination: float, seed: int) -> str:
    """CTEs that sample, grow and score the forest over ``inner``; the last one is ``flags``: its rows with
    ``anomaly_score`` and ``anomaly``."""
    levels = max(1, (max_samples - 1).bit_length())
    c = "(CASE WHEN {0} <= 1 THEN 0.0::DOUBLE WHEN {0} = 2 THEN 1.0::DOUBLE ELSE 2.0 * (ln({0} - 1.0) + 0.5772156649015329) - 2.0 * ({0} - 1.0) / {0} END)"
    out = [f"""feat AS MATERIALIZED (
      SELECT *, round(volume_ratio, 6) AS x0, round(price_change_pct, 6) AS x1, ticker || '|' || CAST(date AS VARCHAR) AS key
      FROM ({inner}) f0 WHERE volume_ratio IS NOT NULL AND price_change_pct IS NOT NULL)""",
           f"""size AS MATERIALIZED (
      SELECT least({max_samples}, count(*)) AS psi, least(1.0::DOUBLE, 2.0 * least({max_samples}, count(*)) / greatest(count(*), 1)) AS rate,
             ceil(log2(greatest(least({max_samples}, count(*)), 2))) AS deep FROM feat)""",
           f"""sampled AS MATERIALIZED (
      SELECT tree, x0, x1 FROM (
        SELECT tree, x0, x1, psi, row_number() OVER (PARTITION BY tree ORDER BY {_unit(str(seed + 1), 'tree', 'key')}, key) AS r
        FROM feat, size, range({n_trees}) t(tree)
        WHERE {_unit(str(seed), '-1', 'key')} < least(1.0::DOUBLE, rate * {n_trees})
          AND {_unit(str(seed), 'tree', 'key')} < rate / least(1.0::DOUBLE, rate * {n_trees})) s0
      WHERE r <= psi)""",
           "l0 AS MATERIALIZED (SELECT tree, 0 AS node, true AS open, x0, x1 FROM sampled)"]
    for d in range(levels + 1):
        out.append(f"""s{d} AS MATERIALIZED (
      SELECT *, CASE WHEN n <= 1 OR {d} >= (SELECT deep FROM size) OR NOT (b0 > a0 OR b1 > a1) THEN -1
                     WHEN b0 > a0 AND b1 > a1 THEN CAST(floor({_unit(str(seed), "'feature'", 'tree', 'node')} * 2) AS INTEGER)
                     WHEN b0 > a0 THEN 0 ELSE 1 END AS f
      FROM (SELECT tree, node, count(*) AS n, min(x0) AS a0, max(x0) AS b0, min(x1) AS a1, max(x1) AS b1
            FROM l{d} WHERE open GROUP BY tree, node) g{d})""")
        out.append(f"""n{d} AS MATERIALIZED (
      SELECT tree, node, {d} AS depth, f, n, CASE WHEN f = 0 THEN a0 + {_unit(str(seed), "'threshold'", 'tree', 'node')} * (b0 - a0)
             WHEN f = 1 THEN a1 + {_unit(str(seed), "'threshold'", 'tree', 'node')} * (b1 - a1) ELSE 0.0 END AS t FROM s{d})""")
        if d < levels:
            out.append(f"""l{d + 1} AS MATERIALIZED (
      SELECT l.tree, 2 * l.node + 1 + CAST((CASE WHEN n.f = 0 THEN l.x0 ELSE l.x1 END) >= n.t AS INTEGER) AS node, true AS open, l.x0, l.x1
      FROM l{d} l JOIN n{d} n ON n.tree = l.tree AND n.node = l.node WHERE n.f >= 0)""")
    out.append("nodes AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM n{d}" for d in range(levels + 1)) + ")")
    out.append(f"w0 AS (SELECT key, x0, x1, tree, 0 AS node FROM feat, range({n_trees}) t(tree))")
    for d in range(levels):
        out.append(f"""w{d + 1} AS (
      SELECT key, x0, x1, w.tree, CASE WHEN n.f < 0 OR n.depth <> {d} THEN w.node
             ELSE 2 * w.node + 1 + CAST((CASE WHEN n.f = 0 THEN x0 ELSE x1 END) >= n.t AS INTEGER) END AS node
      FROM w{d} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node)""")
    out.append(f"""paths AS MATERIALIZED (
      SELECT w.key, sum(CAST(round((n.depth + {c.format('n.n')}) * 1000000) AS BIGINT)) AS total
      FROM w{levels} w JOIN nodes n ON n.tree = w.tree AND n.node = w.node GROUP BY w.key)""")
    out.append(f"""scores AS MATERIALIZED (
      SELECT feat.*, pow(2.0, -(total / {float(n_trees * 1_000_000)}) / (SELECT {c.format('psi')} FROM size)) AS anomaly_score
      FROM feat JOIN paths ON paths.key = feat.key)""")
    out.append(f"""flags AS MATERIALIZED (
      SELECT *, CASE WHEN anomaly_score > (SELECT quantile_cont(anomaly_score, {1.0 - contamination}) FROM scores) THEN -1 ELSE 1 END AS anomaly
      FROM scores)""")
    return ",\n    ".join(out)


def anomaly_summary_sql(inner: str, **forest) -> str:
    return f"""WITH {forest_ctes(inner, **forest)}
    SELECT count_if(anomaly = -1) AS n_anomalies, count(*) AS n_rows,
           round(100.0 * avg(CAST(anomaly = -1 AS DOUBLE)), 2) AS anomaly_pct FROM flags"""


def anomalies_top_sql(inner: str, k: int, **forest) -> str:
    return f"""WITH {forest_ctes(inner, **forest)}
    SELECT ticker, rn, CAST(date AS VARCHAR) AS date, round(coalesce("Close", 0.0), 2) AS close_price, coalesce("Volume", 0.0) AS volume,
           round(coalesce(volume_ratio, 0.0), 4) AS volume_ratio, round(coalesce(price_change_pct, 0.0), 6) AS price_change_pct, total_anomalies
    FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn, count(*) OVER (PARTITION BY ticker) AS total_anomalies
          FROM flags WHERE anomaly = -1) a WHERE rn <= {k}"""


def forest_nodes_sql(inner: str, **forest) -> str:
    return f"""WITH {forest_ctes(inner, **forest)}
    SELECT tree, node, depth, f AS feature, t AS threshold, n AS size FROM nodes"""


def stored_anomalies_sql(inner: str, **forest) -> str:
    """Flags of each ticker's newest row and their shares, from the scored table."""
    return f"""WITH {forest_ctes(inner, **forest)}
    SELECT ticker, count(*) AS n_rows, count_if(anomaly = -1) AS n_anomalies, max(anomaly_score) AS top_score,
           arg_max(anomaly = -1, date) AS latest_flag FROM flags GROUP BY ticker"""


def feature_drift_sql(inner_ks: str, threshold: float) -> str:
    """Exact KS p-values: lattice paths that stay inside |i * n2 - j * n1| < h, one running sum per j."""
    inside = "abs(i * n2 - (j + 1) * n1) < h"
    return f"""
    WITH RECURSIVE ks AS MATERIALIZED (SELECT *, greatest(n_ref, n_rec) AS n1, least(n_ref, n_rec) AS n2 FROM ({inner_ks}) k0),
    lat AS (
      SELECT ticker, feature, n1, n2, h, 0::BIGINT AS j, i, CASE WHEN i * n2 < h THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v
      FROM ks, LATERAL (SELECT unnest(range(0, CAST(n1 + 1 AS BIGINT))) AS i) r
      UNION ALL
      SELECT ticker, feature, n1, n2, h, j + 1, i, CASE WHEN {inside} THEN sum(CASE WHEN {inside} THEN v ELSE 0.0 END) OVER (
             PARTITION BY ticker, feature ORDER BY i) ELSE 0.0 END FROM lat WHERE j < n2),
    p AS (
      SELECT ks.*, CASE WHEN ks.h <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 1.0 - lat.v * exp(
             lgamma(ks.n1 + 1) + lgamma(ks.n2 + 1) - lgamma(ks.n1 + ks.n2 + 1)))) END AS p_value
      FROM ks JOIN lat ON lat.ticker = ks.ticker AND lat.feature = ks.feature AND lat.j = ks.n2 AND lat.i = ks.n1)
    SELECT ticker, feature, ordinal, ks_statistic, p_value, p_value < {threshold} AS drifted FROM p"""


def retrain_sql(inner: str, ks: str, cfg) -> str:
    """Drift roll-up, prediction drift and the rolling accuracy of the histogram sign rule, with reasons."""
    n, m = cfg.rolling_accuracy_window, cfg.rolling_accuracy_min_periods
    frame = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"""
    WITH fd AS MATERIALIZED ({feature_drift_sql(ks, cfg.ks_pvalue_threshold)}),
    roll AS (SELECT ticker, count(*) AS tested, count_if(drifted) AS n_drifted,
                    coalesce(list(feature ORDER BY ordinal) FILTER (drifted), []) AS names FROM fd GROUP BY ticker),
    c AS (SELECT ticker, date, CAST(CAST(macd_histogram > 0 AS INTEGER) = target_direction AS INTEGER) AS correct FROM ({inner}) f),
    acc AS (SELECT ticker, arg_max(a, date) AS a FROM (SELECT ticker, date, CASE WHEN count(correct) {frame} >= {m} THEN avg(correct) {frame} END AS a FROM c) r
            GROUP BY ticker),
    pd AS (SELECT * FROM ({prediction_drift_sql(cfg.drift_lookback_days, cfg.prediction_drift_threshold, cfg.min_log_rows)}) p0),
    r AS (SELECT roll.*, acc.a, list_filter([
            CASE WHEN n_drifted > 0 THEN 'Feature drift in: [' || array_to_string(list_transform(names, lambda x: '''' || x || ''''), ', ') || ']' END,
            CASE WHEN (SELECT drifted FROM pd) THEN printf('Prediction drift: %.1f%%', (SELECT shift FROM pd) * 100) END,
            CASE WHEN a < {cfg.min_accuracy_threshold} THEN printf('Rolling accuracy %.1f%% < %.0f%%', a * 100, {cfg.min_accuracy_threshold * 100}) END],
            lambda x: x IS NOT NULL) AS reasons
          FROM roll LEFT JOIN acc USING (ticker))
    SELECT ticker, {{total}} AS total_features, tested AS tested_features, n_drifted, array_to_string(names, ',') AS drifted_features,
           a AS rolling_accuracy, array_to_string(reasons, ' | ') AS reasons, len(reasons) > 0 AS retrain FROM r"""
