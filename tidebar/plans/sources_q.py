"""Queries for ticks, payloads, cleaning, joins, sinks and sentiment."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidebar.functions.text import clean_text, lexicon_table, with_compound
from tidebar.operators import features as ft, metrics as mt, sentiment as se
from tidebar.operators.layout import number_bars
from tidebar.plans.features_q import DAY_SQL, day_col, full_sql
from tidebar.plans.registry import query, rounded, sql_rounded
from tidebar.plans.tables import ORDER_TICKS, bars_cte, daily, hourly, order_ticks, table, weekly
from tidebar.session import cut_lineage, shared_folder
from tidebar.sources import bars as src

OHLCV = src.PRICES


def _out(df, ts="day"):
    t = day_col() if ts == "day" else F.col("bar_ts")
    return df.select("symbol", t, *rounded(df, OHLCV))


BARS_OUT = f"SELECT symbol, {DAY_SQL}, {sql_rounded(OHLCV)} FROM bars"


@query("bars_daily", "A13 A8", f"WITH {bars_cte()} {BARS_OUT}")
def bars_daily(spark, sf):
    return _out(src.require_columns(daily(spark, sf)))


@query("bars_weekly", "A13", f"WITH {bars_cte('week')} {BARS_OUT}")
def bars_weekly(spark, sf):
    return _out(weekly(spark, sf))


@query("bars_hourly", "A13", f"WITH {bars_cte('hour')} SELECT symbol, bar_ts, {sql_rounded(OHLCV)} FROM bars")
def bars_hourly(spark, sf):
    return _out(hourly(spark, sf), "hour")


@query("bar_numbers", "B4", f"WITH {bars_cte()} SELECT symbol, {DAY_SQL}, n AS bar_no FROM bars WHERE n >= 80 AND bar_ts BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'")
def bar_numbers(spark, sf):
    b = number_bars(daily(spark, sf))
    return src.bar_window(b, "1996-01-01", "1999-12-31", 80).select("symbol", day_col(), "bar_no")


def payloads(spark, sf, width=6):
    """Daily bars as candle payload strings per symbol and month (with a short row that must be skipped)."""
    b = daily(spark, sf)
    text = lambda c: F.col(c).cast("string")
    row = F.array((F.unix_timestamp("bar_ts") * 1000).cast("string"), *map(text, OHLCV[: width - 1]))
    return b.groupBy("symbol", F.trunc("bar_ts", "month").alias("m")).agg(
        F.to_json(F.concat(F.collect_list(row), F.array(F.array(F.lit("0"), F.lit("1"))))).alias("payload")
    )


@query("parse_klines_payload", "A5 J2", f"WITH {bars_cte()} {BARS_OUT}")
def parse_klines_payload(spark, sf):
    return _out(src.parse_klines(payloads(spark, sf)))


@query(
    "ohlc_with_volume_series", "A6 E1",
    f"WITH {bars_cte()} SELECT symbol, {DAY_SQL}, {sql_rounded(OHLCV[:4])}, CASE WHEN n % 3 = 0 THEN 0 ELSE volume END::DOUBLE AS volume FROM bars",
)
def ohlc_with_volume_series(spark, sf):
    ohlc = src.parse_ohlc(payloads(spark, sf, width=5))
    b = number_bars(daily(spark, sf)).where(F.col("bar_no") % 3 != 0)
    pair = F.array((F.unix_timestamp("bar_ts") * 1000).cast("string"), F.col("volume").cast("string"))
    docs = b.groupBy("symbol", F.trunc("bar_ts", "month").alias("m")).agg(F.to_json(F.struct(F.collect_list(pair).alias("total_volumes"))).alias("payload"))
    return _out(src.join_volume(ohlc, src.parse_series(docs, "total_volumes")))


@query(
    "clean_prices", "A7 P6",
    f"""WITH {ORDER_TICKS}, f AS (SELECT symbol, ts, arg_min(price, seq) AS price, min(seq) AS s FROM ticks GROUP BY ALL)
SELECT symbol, ts::DATE AS bar_day, round(price, 6) AS close, (CASE WHEN s % 4 = 0 THEN 0 ELSE s END)::DOUBLE AS volume FROM f WHERE s % 5 <> 0""",
)
def clean_prices(spark, sf):
    t = order_ticks(spark, sf)
    p = F.col("price").cast("string")
    raw = t.select(
        "symbol", F.col("ts").alias("bar_ts"), F.col("seq").alias("ingest_seq"), p.alias("open"), p.alias("high"), p.alias("low"),
        F.when(F.col("seq") % 5 == 0, F.lit("n/a")).otherwise(p).alias("close"),
        F.when(F.col("seq") % 4 != 0, F.col("seq").cast("string")).alias("volume"),
    )
    c = src.clean_prices(raw)
    return c.select("symbol", day_col(), F.round("close", 6).alias("close"), "volume")


@query(
    "source_fallback", "A14",
    f"""WITH {bars_cte('hour')}, p AS (SELECT * FROM bars WHERE symbol <> 'click' OR n <= 50), k AS (SELECT symbol FROM p GROUP BY 1 HAVING count(*) >= 100)
SELECT symbol, bar_ts, round(close, 6) AS close FROM p WHERE symbol IN (SELECT symbol FROM k) UNION ALL SELECT symbol, bar_ts, round(close + 1, 6) FROM bars WHERE symbol NOT IN (SELECT symbol FROM k)""",
)
def source_fallback(spark, sf):
    b = number_bars(hourly(spark, sf), 2048 * 3600)
    primary = b.where((F.col("symbol") != "click") | (F.col("bar_no") <= 50))
    secondary = b.withColumn("close", F.col("close") + 1.0)
    return src.with_source_fallback(primary, secondary).select("symbol", "bar_ts", F.round("close", 6).alias("close"))


@query(
    "symbol_lookup", "A12",
    "WITH n AS (SELECT o_orderkey AS id, ['Bitcoin', ' ethereum ', 'BNB', 'xrp', 'Unknown', 'pepe '][(o_orderkey % 6 + 1)::INT] AS name FROM orders) SELECT id, name, CASE lower(trim(name)) WHEN 'bitcoin' THEN 'bitcoin' WHEN 'ethereum' THEN 'ethereum' WHEN 'bnb' THEN 'binancecoin' WHEN 'xrp' THEN 'ripple' WHEN 'pepe' THEN 'pepe' END AS source_id FROM n",
)
def symbol_lookup(spark, sf):
    names = F.array(*map(F.lit, ["Bitcoin", " ethereum ", "BNB", "xrp", "Unknown", "pepe "]))
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("name"))
    return src.resolve_symbols(df, src.symbol_dim(spark)).select("id", "name", "source_id")


@query("latest_rows", "H7", f"WITH {bars_cte()} SELECT symbol, {DAY_SQL}, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC) = 1")
def latest_rows(spark, sf):
    return src.latest_rows(daily(spark, sf)).select("symbol", day_col(), F.round("close", 6).alias("close"))


@query(
    "parity_diff", "E9",
    f"""WITH {bars_cte()}, b AS (SELECT symbol, bar_ts, n, close, volume, CASE WHEN close > open THEN 'up' ELSE 'down' END AS direction FROM bars),
o AS (SELECT symbol, bar_ts, CASE WHEN n % 10 = 0 THEN close + 0.5 WHEN n % 7 = 0 THEN close + 1e-12 ELSE close END AS close, CASE WHEN n % 15 = 0 THEN 'flat' ELSE direction END AS direction FROM b WHERE n % 50 <> 0)
SELECT b.symbol, b.bar_ts::DATE AS bar_day, f.field FROM b LEFT JOIN o USING (symbol, bar_ts), (VALUES ('close'), ('direction')) f(field)
WHERE CASE f.field WHEN 'close' THEN o.close IS NULL OR abs(b.close - o.close) > 1e-9 ELSE o.direction IS NULL OR b.direction <> o.direction END""",
)
def parity_diff(spark, sf):
    b = number_bars(daily(spark, sf)).withColumn("direction", F.when(F.col("close") > F.col("open"), "up").otherwise("down"))
    b = cut_lineage(b)
    n = F.col("bar_no")
    other = b.where(n % 50 != 0).withColumns(
        {
            "close": F.when(n % 10 == 0, F.col("close") + 0.5).when(n % 7 == 0, F.col("close") + 1e-12).otherwise(F.col("close")),
            "direction": F.when(n % 15 == 0, "flat").otherwise(F.col("direction")),
        }
    )
    d = mt.parity_diff(b, other, ["symbol", "bar_ts"], ["close", "direction"])
    return d.select("symbol", day_col(), "field")


# --- stored tables: every sink is read back ------------------------------------------------------------


def _folder(spark, name):
    return f"{shared_folder(spark)}/tidebar/{name}-{uuid.uuid4().hex}"


@query("parquet_round_trip", "A1 A2 A4 A9", f"WITH {bars_cte()} SELECT symbol, {DAY_SQL}, {sql_rounded(OHLCV)} FROM bars WHERE bar_ts <= TIMESTAMP '1997-12-31'")
def parquet_round_trip(spark, sf):
    path = _folder(spark, "bars")
    b = cut_lineage(daily(spark, sf))
    src.write_features(b, path)
    src.write_features(b.where(F.col("symbol") == "BUILDING"), path)  # a refresh of one symbol keeps the others
    stored = src.scan_features(spark, path, asof="1997-12-31")
    return _out(stored.join(src.scan_bars(spark, path).select("symbol", "bar_ts"), ["symbol", "bar_ts"], "left_semi"))


@query("csv_round_trip", "A3 A4 A10", f"WITH {bars_cte('week')} {BARS_OUT}")
def csv_round_trip(spark, sf):
    path = _folder(spark, "csv")
    w = weekly(spark, sf)
    src.write_csv(w.select(F.col("bar_ts").alias("Date"), "symbol", *[F.col(c).alias(c.upper()) for c in OHLCV]), path)
    return _out(src.scan_csv_bars(spark, path))


@query(
    "json_summary_round_trip", "A11 J10",
    f"WITH {bars_cte()} SELECT symbol, count(*)::BIGINT AS n_bars, round(avg(close), 4) AS mean_close, round(sum(volume), 4) AS total_volume FROM bars GROUP BY 1",
)
def json_summary_round_trip(spark, sf):
    path = _folder(spark, "json")
    s = daily(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars"), F.avg("close").alias("mean_close"), F.sum("volume").alias("total_volume"))
    src.write_json_summary(s, path, {"metrics": ["n_bars", "mean_close"], "health": ["total_volume"]}, ["symbol"])
    back = spark.read.schema("symbol string, metrics struct<n_bars:bigint,mean_close:double>, health struct<total_volume:double>").json(path)
    return back.select("symbol", "metrics.n_bars", F.round("metrics.mean_close", 4).alias("mean_close"), F.round("health.total_volume", 4).alias("total_volume"))


# --- text -----------------------------------------------------------------------------------------------

# The test texts are invented words: frequent ones stand in for a valence lexicon.
TEST_LEXICON = {"the": 1.4, "and": -0.9, "of": 0.6, "le": 1.1, "la": -1.3, "der": 0.8, "und": -0.7, "en": 1.7, "is": 2.0, "in": -1.1, "not": -0.5, "for": 0.9}
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
LEX_SQL = ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in TEST_LEXICON.items())
CLEAN_SQL = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'http\S+', ' ', 'g'), 'www\.\S+', ' ', 'g'), '@\w+', ' ', 'g'), '#(\w+)', '\1', 'g'), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"""


def posts(spark, sf):
    d = table(spark, sf, "documents")
    day = F.date_add(F.lit("1996-01-01").cast("date"), (F.col("doc_id") % 120).cast("int"))
    symbol = F.element_at(F.array(*map(F.lit, SEGMENTS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return d.select("doc_id", symbol.alias("symbol"), "text", day.cast("timestamp").alias("created_at"))


POSTS_SQL = f"""lex(w, v) AS (VALUES {LEX_SQL}),
posts AS (SELECT doc_id, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[(doc_id % 5 + 1)::INT] AS symbol, (DATE '1996-01-01' + (doc_id % 120)::INT) AS day, {CLEAN_SQL} AS cleaned FROM documents),
tok AS (SELECT doc_id, unnest(string_split(cleaned, ' ')) AS w, generate_subscripts(string_split(cleaned, ' '), 1) AS i FROM posts),
hit AS (SELECT doc_id, v, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS p, t.w FROM tok t LEFT JOIN lex USING (w)),
sc AS (SELECT doc_id, coalesce(sum(CASE WHEN p IN ('no', 'not', 'never', 'cannot', 'without') THEN -0.74 ELSE 1 END * v), 0) AS s FROM hit GROUP BY 1),
cmp AS (SELECT p.symbol, p.day, p.doc_id, cleaned, s / sqrt(s * s + 15) AS compound FROM posts p JOIN sc USING (doc_id))"""


@query("union_of_assets", "A4", f"WITH {bars_cte()} SELECT symbol, {DAY_SQL}, round(open, 6) AS open, round(close, 6) AS close, volume FROM bars")
def union_of_assets(spark, sf):
    """One frame per asset, put together again."""
    bars = cut_lineage(daily(spark, sf))
    frames = {s: bars.where(F.col("symbol") == s).drop("symbol") for s in SEGMENTS}
    u = src.union_assets(frames)
    return u.select("symbol", day_col(), *rounded(u, ["open", "close"]), "volume")


@query("sentiment_scores", "J3 J4", f"WITH {POSTS_SQL} SELECT doc_id, length(cleaned)::BIGINT AS clean_chars, md5(cleaned) AS clean_md5, round(compound, 6) AS compound FROM cmp")
def sentiment_scores(spark, sf):
    p = posts(spark, sf).withColumn("c", clean_text(F.col("text")))
    p = p.select("doc_id", F.length("c").cast("bigint").alias("clean_chars"), F.md5("c").alias("clean_md5"), "c")
    s = with_compound(p, "c", ["doc_id", "clean_chars", "clean_md5"], lexicon_table(spark, TEST_LEXICON))
    return s.select("doc_id", "clean_chars", "clean_md5", F.round("compound", 6).alias("compound"))


ROLL_SQL = """dly AS (SELECT symbol, day, avg(compound) AS sc_, count(*)::DOUBLE AS vol_ FROM cmp GROUP BY ALL),
rol AS (SELECT *, coalesce(sc_ - lag(sc_, 3) OVER w, 0) AS mom, avg(sc_) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS a7 FROM dly WINDOW w AS (PARTITION BY symbol ORDER BY day))"""


@query("daily_sentiment", "F1 F2", f"WITH {POSTS_SQL}, {ROLL_SQL} SELECT symbol, day, round(sc_, 6) AS sentiment_score, vol_ AS sentiment_volume, round(mom, 6) AS momentum, round(a7, 6) AS mean7 FROM rol")
def daily_sentiment(spark, sf):
    d = se.with_rolling(cut_lineage(se.daily_sentiment(se.scored_posts(posts(spark, sf), TEST_LEXICON))))
    return d.select(
        "symbol", "day", F.round("sentiment_score", 6).alias("sentiment_score"), "sentiment_volume",
        F.round("twitter_sentiment_momentum", 6).alias("momentum"), F.round("twitter_sentiment_7d_avg", 6).alias("mean7"),
    )


@query(
    "sentiment_overlay", "E3",
    f"WITH {POSTS_SQL}, {ROLL_SQL} SELECT symbol, day, round(CASE WHEN extract(day FROM day) <= 10 THEN sc_ ELSE least(1, greatest(-1, sc_ * 2 - 0.1)) END, 6) AS sentiment_score, CASE WHEN extract(day FROM day) <= 10 THEN vol_ ELSE 22 END::DOUBLE AS sentiment_volume FROM dly",
)
def sentiment_overlay(spark, sf):
    d = cut_lineage(se.daily_sentiment(se.scored_posts(posts(spark, sf), TEST_LEXICON)))
    base = d.withColumns({"sentiment_score": F.col("sentiment_score") * 2.0 - 0.1, "sentiment_volume": F.lit(22.0)})
    o = src.overlay(base, d.where(F.dayofmonth("day") <= 10), ["symbol", "day"], ["sentiment_score", "sentiment_volume"])
    o = se.bounded_daily(o)
    return o.select("symbol", "day", F.round("sentiment_score", 6).alias("sentiment_score"), "sentiment_volume")


SIX = ["twitter_sentiment", "twitter_sentiment_7d_avg", "twitter_sentiment_momentum", "twitter_volume", "sentiment_x_momentum", "sentiment_x_volatility"]


@query(
    "features_with_sentiment", "C46 E2 C47",
    full_sql().replace("WITH ticks", f"WITH {POSTS_SQL}, {ROLL_SQL}, ticks", 1)
    + f""", j AS (SELECT f.symbol, f.bar_ts, coalesce(momentum_logret_7d, 0) AS m7_, least(0.25, greatest(0, coalesce(rolling_std_logret_14, 0))) AS r14_, coalesce(sc_, 0) AS s_, coalesce(r.a7, 0) AS a_, coalesce(r.mom, 0) AS d_, coalesce(vol_, 0) AS v_
  FROM full_f f LEFT JOIN rol r ON r.symbol = f.symbol AND r.day = f.bar_ts::DATE)
SELECT symbol, {DAY_SQL}, round(s_, 6) AS twitter_sentiment, round(a_, 6) AS twitter_sentiment_7d_avg, round(greatest(-1, least(1, d_)), 6) AS twitter_sentiment_momentum, round(v_, 6) AS twitter_volume,
  round(greatest(-0.2, least(0.2, s_ * m7_)), 6) AS sentiment_x_momentum, round(greatest(-0.06, least(0.06, s_ * r14_)), 6) AS sentiment_x_volatility FROM j""",
)
def features_with_sentiment(spark, sf):
    s = se.as_features(se.with_rolling(cut_lineage(se.daily_sentiment(se.scored_posts(posts(spark, sf), TEST_LEXICON)))))
    bars = cut_lineage(number_bars(cut_lineage(daily(spark, sf))))
    df = ft.full_features(bars, sentiment=s)
    return df.select("symbol", day_col(), *rounded(df, SIX))
