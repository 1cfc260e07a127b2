"""Scans, payload parsing, cleaning and sinks for price bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from tidebar.operators.heavy import BYTES, checked_join

PRICES = ["open", "high", "low", "close", "volume"]
BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("bar_ts", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in PRICES]
)

# Display name -> source id and venue code of the supported assets.
ASSETS = [
    ("Bitcoin", "bitcoin", "BTCUSDT"),
    ("Ethereum", "ethereum", "ETHUSDT"),
    ("BNB", "binancecoin", "BNBUSDT"),
    ("XRP", "ripple", "XRPUSDT"),
    ("Solana", "solana", "SOLUSDT"),
    ("Dogecoin", "dogecoin", "DOGEUSDT"),
    ("Cardano", "cardano", "ADAUSDT"),
    ("Avalanche", "avalanche-2", "AVAXUSDT"),
    ("Chainlink", "chainlink", "LINKUSDT"),
    ("PEPE", "pepe", "PEPEUSDT"),
    ("SHIB", "shiba-inu", "SHIBUSDT"),
]


def require_columns(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fail early, without a job, when price columns are absent or not numeric."""
    wanted = cols or PRICES
    fields = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in wanted if c not in fields]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    wrong = [c for c in wanted if not isinstance(fields[c], T.NumericType)]
    if wrong:
        raise TypeError(f"columns must be numeric: {wrong}")
    return df


def scan_bars(spark: SparkSession, path: str) -> DataFrame:
    """Bars of all symbols from a directory laid out by symbol; only price columns are read."""
    return spark.read.schema(BARS).parquet(path)


def scan_features(spark: SparkSession, path: str, asof: str | None = None) -> DataFrame:
    """Stored features, cut at a decision time (the cut reaches the parquet scan)."""
    df = spark.read.parquet(path)
    return df if asof is None else df.where(F.col("bar_ts") <= F.lit(asof).cast("timestamp"))


def scan_csv_bars(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """Headed CSV in any column order and letter case; the time column is ``date`` or ``bar_ts``."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    ts = "bar_ts" if "bar_ts" in raw.columns else "date"
    sym = F.lit(symbol) if symbol is not None else F.col("symbol")
    return raw.select(
        sym.alias("symbol"),
        F.col(ts).cast("timestamp").alias("bar_ts"),
        *[F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in PRICES],
    )


def union_assets(frames: dict[str, DataFrame]) -> DataFrame:
    """One relation over per-asset frames; the asset becomes the ``symbol`` column."""
    out = None
    for symbol, df in frames.items():
        one = df.select(F.lit(symbol).alias("symbol"), "bar_ts", *PRICES)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no assets given")
    return out


def _millis_to_day(c: Column) -> Column:
    return F.date_trunc("day", F.timestamp_millis(c.cast("bigint")))


def _rows_of(payload: str, least: int) -> Column:
    rows = F.from_json(F.col(payload), "array<array<string>>")
    return F.filter(rows, lambda r: F.size(r) >= least)


def parse_klines(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Candle payloads ``[[ts_ms,o,h,l,c,v,...],...]``; rows with fewer than six items are skipped."""
    rows = df.select("symbol", F.explode(_rows_of(payload, 6)).alias("r"))
    return rows.select(
        "symbol",
        _millis_to_day(F.col("r")[0]).alias("bar_ts"),
        *[F.col("r")[i + 1].try_cast("double").alias(c) for i, c in enumerate(PRICES)],
    )


def parse_ohlc(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Candle payloads without volume; volume is 0 until joined."""
    rows = df.select("symbol", F.explode(_rows_of(payload, 5)).alias("r"))
    return rows.select(
        "symbol",
        _millis_to_day(F.col("r")[0]).alias("bar_ts"),
        *[F.col("r")[i + 1].try_cast("double").alias(c) for i, c in enumerate(PRICES[:4])],
        F.lit(0.0).alias("volume"),
    )


def parse_series(df: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """One named series ``{key: [[ts_ms, value], ...]}`` of a chart payload."""
    doc = F.from_json(F.col(payload), f"`{key}` array<array<string>>")
    rows = df.select(
        "symbol", F.explode(F.filter(doc[key], lambda r: F.size(r) >= 2)).alias("r")
    )
    return rows.select(
        "symbol",
        _millis_to_day(F.col("r")[0]).alias("bar_ts"),
        F.col("r")[1].try_cast("double").alias("value"),
    )


def clean_prices(df: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """First record per (symbol, time), numbers coerced, no missing close, volume 0 if unknown.

    The first record is an aggregate, not a window: copies of one key are combined before the
    shuffle, so any number of copies of a bar costs one row per task.
    """
    nums = [F.col(c).try_cast("double").alias(c) for c in PRICES]
    typed = df.select("symbol", F.col("bar_ts").cast("timestamp").alias("bar_ts"), seq, *nums)
    first = typed.groupBy("symbol", "bar_ts").agg(
        F.min_by(F.struct(*PRICES), F.col(seq)).alias("p")
    )
    return (
        first.select("symbol", "bar_ts", "p.*")
        .dropna(subset=["close"])
        .fillna(0.0, subset=["volume"])
    )


def bars_from_ticks(ticks: DataFrame, freq: str, tie: str | None = None) -> DataFrame:
    """Open/high/low/close/volume per symbol and period from ``(symbol, ts, price, size)``.

    Ticks that share a timestamp are ordered by ``tie`` in a first aggregation, so that both
    steps keep only fixed-width buffers (hash aggregation with map-side combining).
    """
    open_at, close_at = ("price", "ts"), ("price", "ts")
    src = ticks
    hi, lo, vol = F.max("price"), F.min("price"), F.sum("size")
    if tie is not None:
        src = ticks.groupBy("symbol", "ts").agg(
            F.min_by("price", tie).alias("o"),
            F.max_by("price", tie).alias("c"),
            F.max("price").alias("h"),
            F.min("price").alias("l"),
            F.sum("size").alias("v"),
        )
        open_at, close_at = ("o", "ts"), ("c", "ts")
        hi, lo, vol = F.max("h"), F.min("l"), F.sum("v")
    return (
        src.withColumn("bar_ts", F.date_trunc(freq, F.col("ts").cast("timestamp")))
        .groupBy("symbol", "bar_ts")
        .agg(
            F.min_by(*open_at).alias("open"),
            hi.alias("high"),
            lo.alias("low"),
            F.max_by(*close_at).alias("close"),
            vol.cast("double").alias("volume"),
        )
    )


def with_source_fallback(primary: DataFrame, secondary: DataFrame, least: int = 100, most: int = BYTES) -> DataFrame:
    """Per symbol: the primary source when it has ``least`` rows, else the secondary one.

    The per-symbol counts decide; each source is then filtered by the list of symbols, which is
    broadcast while it is small.  Beyond that the rows of a heavy symbol are dealt to many tasks.
    Rows without a symbol have no primary count and come from the secondary source.
    """
    n1 = primary.where(F.col("symbol").isNotNull()).groupBy("symbol").agg(F.count(F.lit(1)).alias("n1"))
    chosen = n1.where(F.col("n1") >= least).select("symbol", F.lit(True).alias("_chosen"))
    first = checked_join(primary, chosen, "symbol", "inner", most)
    other = checked_join(secondary, chosen, "symbol", "left", most).where("_chosen IS NULL")
    return first.drop("_chosen").select(primary.columns).unionByName(other.drop("_chosen"))


def symbol_dim(spark: SparkSession) -> DataFrame:
    """The supported assets, in display order."""
    return spark.createDataFrame(
        [(i, *row) for i, row in enumerate(ASSETS)], "ord int, name string, source_id string, venue_code string"
    )


def resolve_symbols(df: DataFrame, dim: DataFrame, name: str = "name") -> DataFrame:
    """Case-insensitive, trimmed lookup of display names; unknown names get NULL ids."""
    key = lambda c: F.lower(F.trim(c))
    d = dim.select(key(F.col("name")).alias("_k"), F.col("source_id"), F.col("venue_code"))
    return df.withColumn("_k", key(F.col(name))).join(d, "_k", "left").drop("_k")


def join_volume(ohlc: DataFrame, volume: DataFrame) -> DataFrame:
    """Prices with the separately delivered volume; 0 where there is none."""
    v = volume.select("symbol", "bar_ts", F.col("value").alias("_v"))
    return (
        ohlc.join(v, ["symbol", "bar_ts"], "left")
        .withColumn("volume", F.coalesce("_v", F.lit(0.0)))
        .drop("_v")
    )


def overlay(base: DataFrame, recent: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Recent values replace base values on equal keys; missing recent values do not."""
    r = recent.select(*keys, *[F.col(c).alias(f"_r_{c}") for c in cols])
    return base.join(r, keys, "left").withColumns(
        {c: F.coalesce(f"_r_{c}", c) for c in cols}
    ).drop(*[f"_r_{c}" for c in cols])


def common_dates(bars: DataFrame) -> DataFrame:
    """Bars at the times that every symbol has.

    Bars are unique per (symbol, time), so a time is common when its row count equals the number
    of symbols; both counts combine before the shuffle.
    """
    total = bars.select("symbol").distinct().agg(F.count(F.lit(1)).alias("_n"))
    full = bars.groupBy("bar_ts").agg(F.count(F.lit(1)).alias("_n")).join(F.broadcast(total), "_n")
    return bars.join(full.select("bar_ts"), "bar_ts", "left_semi")


def bar_window(df: DataFrame, start=None, end=None, min_history: int = 80) -> DataFrame:
    """Bars in a date range that have enough history; needs ``bar_no``."""
    keep = F.col("bar_no") >= min_history
    if start is not None:
        keep = keep & (F.col("bar_ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        keep = keep & (F.col("bar_ts") <= F.lit(end).cast("timestamp"))
    return df.where(keep)


def date_ranges(bars: DataFrame) -> DataFrame:
    """First and last bar of every symbol."""
    return bars.groupBy("symbol").agg(
        F.min("bar_ts").alias("first_bar"), F.max("bar_ts").alias("last_bar")
    )


def latest_rows(df: DataFrame, key: str = "symbol", ts: str = "bar_ts") -> DataFrame:
    """The last row of every key, as one aggregate."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(ts)).alias("r")).select(key, "r.*")


def chart_tail(bars: DataFrame, n: int = 90) -> DataFrame:
    """Last n (time, close) of every symbol; the rank limit is applied before the shuffle too."""
    rank = F.row_number().over(W.partitionBy("symbol").orderBy(F.col("bar_ts").desc()))
    return bars.select("symbol", "bar_ts", "close").withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")


def freshness(bars: DataFrame, now: Column, stale_hours: float = 24.0) -> DataFrame:
    """Age of the newest bar of every symbol in whole hours and whether it is still fresh.

    ``now`` is a literal, a scalar subquery or an aggregate over the bars.
    """
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    latest = bars.groupBy("symbol").agg(F.max("bar_ts").alias("latest_ts"), now.alias("_at"))
    age = F.greatest(seconds(F.col("_at")) - seconds(F.col("latest_ts")), F.lit(0).cast("bigint"))
    return latest.withColumns(
        {"age_hours": F.floor(age / 3600), "is_fresh": F.coalesce(age <= stale_hours * 3600, F.lit(False))}
    ).drop("_at")


# --- sinks -----------------------------------------------------------------------------------


def write_features(df: DataFrame, path: str) -> None:
    """One folder per symbol; a refresh replaces only the symbols it contains."""
    (
        df.write.partitionBy("symbol")
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def write_csv(df: DataFrame, path: str) -> None:
    """Headed CSV; nested columns as JSON text; an empty result still gets its header."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = [
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.option("header", True).mode("overwrite").csv(path)


def write_json_summary(df: DataFrame, path: str, groups: dict[str, list[str]], keys: list[str]) -> None:
    """Nested summary documents: one struct per group of columns."""
    df.select(
        *keys, *[F.struct(*cols).alias(name) for name, cols in groups.items()]
    ).write.mode("overwrite").json(path)
