"""Trade outcomes: exits, non-overlapping positions, equity, portfolios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidebar.functions.nulls import all_of, clip, div, ladder, truth
from tidebar.operators.chains import FACTOR, RUN, chain, followers, levels
from tidebar.operators.layout import blocked, chunk_width, order, own_rows, rolling
from tidebar.operators.scan import number_by_range, running
from tidebar.operators.touch import far_exits
from tidebar.session import cut_lineage

ACTIONABLE = ["STRONG_BUY", "WEAK_BUY", "PROBING_BUY"]
# Stop, target and longest holding by conviction.
PROFILES = {"STRONG_BUY": (0.02, 0.03, 3), "WEAK_BUY": (0.015, 0.02, 1), "PROBING_BUY": (0.015, 0.02, 1)}
SLIPPAGE = 0.001
FAR = 64  # bars that a row still lists


def with_profile(signals: DataFrame, decision: str = "decision") -> DataFrame:
    """Stop, target and holding columns of a decision (NULL when it is not actionable)."""
    d = F.col(decision)
    pick = lambda i: ladder([(d == k, v[i]) for k, v in PROFILES.items()], None)
    return signals.withColumns({"stop_pct": pick(0), "take_pct": pick(1), "hold": pick(2)})


def _next_bars(n: int) -> Column:
    bar = F.struct(*[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close")])
    return F.collect_list(bar).over(order().rowsBetween(1, n))


def _touch(bars: Column, stop: Column, target: Column, hold: Column, gap_rule: bool) -> Column:
    """First bar at which a long leaves, as struct(price, reason, days)."""

    def leave(b: Column, i: Column) -> Column:
        rules = []
        if gap_rule:
            rules += [(b["open"] <= stop, (b["open"], "SL")), (b["open"] >= target, (b["open"], "TP"))]
        rules += [
            (b["low"] <= stop, (stop, "SL")),
            (b["high"] >= target, (target, "TP")),
            (i + 1 == hold, (b["close"], "TIME")),
        ]
        return F.struct(
            ladder([(c, v[0]) for c, v in rules], None).alias("price"),
            ladder([(c, v[1]) for c, v in rules], None).alias("reason"),
            (i + 1).cast("int").alias("days"),
        )

    path = F.transform(F.slice(bars, 1, hold), leave)
    return F.try_element_at(F.filter(path, lambda x: x["reason"].isNotNull()), F.lit(1))


def first_touch_exits(signals: DataFrame, max_hold: int = 3, block: int | None = None) -> DataFrame:
    """Outcome of a long opened at the next open for every row that carries a profile.

    Within a bar an opening gap through a level counts first, then the stop, then the target;
    the last allowed bar leaves at its close.  The bars a trade can see are a window of
    ``max_hold`` rows, so no join is needed.  Trades without an entry or whose bars run out are
    INVALID.  Holds above ``FAR`` bars search range tables instead of listing the bars.
    """
    if max_hold > FAR:
        return far_exits(signals, max_hold, block)
    df = blocked(signals, ahead=max_hold, block=block).withColumn("_bars", _next_bars(max_hold))
    df = own_rows(df.where(F.col("hold").isNotNull()))
    entry = F.try_element_at("_bars", F.lit(1))["open"]
    df = df.withColumn("entry_price", F.when(entry > 0, entry))
    e = F.col("entry_price")
    hold = F.greatest(F.col("hold"), F.lit(1))
    exit_ = _touch(F.col("_bars"), e * (F.lit(1.0) - F.col("stop_pct")), e * (F.col("take_pct") + 1.0), hold, True)
    df = df.withColumn("_x", F.when(e.isNotNull(), exit_))
    return df.withColumns(
        {
            "exit_price": F.col("_x.price"),
            "exit_reason": F.coalesce("_x.reason", F.lit("INVALID")),
            "holding_days": F.col("_x.days"),
            "exit_no": F.col("bar_no") + F.col("_x.days"),
            "return_pct": div(F.col("_x.price"), e) - 1.0,
        }
    ).drop("_bars", "_x")


def slipped_exits(signals: DataFrame, horizon: int | list[int] = 3, stop: float = 0.02, take: float = 0.03, min_history: int = 0, block: int | None = None) -> DataFrame:
    """Outcome of a long with slippage both ways, stop before target, close at the horizon.

    Rows need ``horizon + 1`` later bars and ``min_history`` earlier ones.  Several horizons share
    one window; each gives its own row with its ``horizon``.
    """
    horizons = [horizon] if isinstance(horizon, int) else list(horizon)
    reach = max(horizons) + 1
    df = blocked(signals, ahead=reach, block=block).withColumn("_bars", _next_bars(reach))
    df = own_rows(df.where(F.col("bar_no") > min_history)).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    df = df.where(F.size("_bars") >= F.col("horizon") + 1)
    df = df.withColumn("entry_price", F.element_at("_bars", 1)["open"] * (1.0 + SLIPPAGE))
    e = F.col("entry_price")
    exit_ = _touch(F.col("_bars"), e * (1.0 - stop), e * (1.0 + take), F.col("horizon"), False)
    return (
        df.withColumn("_x", exit_)
        .withColumn("exit_price", F.col("_x.price") * (1.0 - SLIPPAGE))
        .withColumn("trade_return", div(F.col("exit_price") - e, e))
        .drop("_bars", "_x")
    )


# --- positions ---------------------------------------------------------------------------------


def last_bar_until(bars: DataFrame, asked: DataFrame, out: str = "last_no") -> DataFrame:
    """Number of the last bar at or before ``until`` (epoch seconds) for every row of ``asked``.

    Bars and questions are put in one order inside time chunks, whose width follows the density of
    the bars; the chunk table carries the last bar of earlier chunks.  No bar is counted, so it does
    not matter how many lie between.
    """
    seconds = F.unix_timestamp(F.col("bar_ts").cast("timestamp"))
    events = bars.select("symbol", seconds.alias("_sec"), F.lit(0).alias("_ask"), F.col("bar_no").alias("_no"))
    asks = asked.select("symbol", F.col("until").alias("_sec")).distinct()
    events = events.unionByName(asks.select("symbol", "_sec", F.lit(1).alias("_ask"), F.lit(None).cast("bigint").alias("_no")))
    events = events.withColumn("_chunk", F.floor(F.col("_sec") / chunk_width(bars)))
    ends = events.groupBy("symbol", "_chunk").agg(F.max("_no").alias("_m"))
    before = W.partitionBy("symbol").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select("symbol", "_chunk", F.max("_m").over(before).alias("_c"))
    inside = W.partitionBy("symbol", "_chunk").orderBy("_sec", "_ask").rowsBetween(W.unboundedPreceding, 0)
    found = events.withColumn("_m", F.max("_no").over(inside)).where("_ask = 1").join(carried, ["symbol", "_chunk"])
    found = found.select("symbol", F.col("_sec").alias("until"), F.coalesce("_m", "_c").alias(out))
    return asked.join(found, ["symbol", "until"], "left")


def with_release(trades: DataFrame, bars: DataFrame, cooldown_days: int, use: Column | None = None) -> DataFrame:
    """First bar number at which a new trade may be decided once this one is taken.

    ``use`` switches the cooldown per row; without it a trade only blocks until its exit.
    """
    seconds = F.unix_timestamp(F.col("bar_ts").cast("timestamp"))
    if cooldown_days > 0:
        asked = trades.withColumn("until", seconds + cooldown_days * 86400)
        out = last_bar_until(bars.select("symbol", "bar_no", "bar_ts"), asked).withColumn("_after", F.col("last_no") + 1).drop("until", "last_no")
    else:
        out = trades.withColumn("_after", F.col("bar_no") + 1)
    after = F.col("_after")
    if use is not None:
        after = F.when(use, after).otherwise(F.col("bar_no") + 1)
    return out.withColumn("release_no", F.greatest(F.col("exit_no"), after)).drop("_after")


def non_overlapping(trades: DataFrame, run: int = RUN, factor: int = FACTOR, min_history: int = 0) -> DataFrame:
    """Keep the trades a trader with one position at a time would take, from bar ``min_history`` on.

    Taking a trade at ``bar_no`` blocks decisions until ``release_no``.  Each trade is linked to the first
    one at or after its release, and the links are followed level by level (see ``chains``), so a release
    may lie at any distance.  Of trades of one bar the one released first counts, and all rows of a taken bar stay.
    """
    t = cut_lineage(trades.where(F.col("release_no").isNotNull() & (F.col("bar_no") >= min_history)))
    once = t.groupBy("symbol", F.col("bar_no").cast("bigint").alias("at")).agg(F.min(F.col("release_no").cast("bigint")).alias("free"))
    taken = chain(followers(once, run), levels(once, run, factor), run, factor).withColumnRenamed("at", "bar_no")
    return t.join(taken, ["symbol", "bar_no"], "left_semi")


def cooldown_active(bars: DataFrame, positions: DataFrame) -> DataFrame:
    """``bars`` with a flag: an accepted trade still blocks new decisions at this bar."""
    blocked_bars = positions.select("symbol", F.explode(F.sequence(F.col("bar_no") + 1, F.greatest(F.col("bar_no") + 1, F.col("release_no") - 1))).alias("bar_no"), "release_no")
    blocked_bars = blocked_bars.where(F.col("bar_no") < F.col("release_no")).select("symbol", "bar_no", F.lit(True).alias("cooldown_active")).distinct()
    return bars.join(blocked_bars, ["symbol", "bar_no"], "left").withColumn("cooldown_active", F.coalesce("cooldown_active", F.lit(False)))


def equity_curve(bars: DataFrame, positions: DataFrame, min_history: int = 80, block: int | None = None) -> DataFrame:
    """Equity, drawdown and in-position flag per evaluated bar; full equity in every trade.

    A trade decided at ``bar_no`` is open on the bars after it up to ``exit_no``; those few bars
    are listed per trade and matched by equality.
    """
    open_bars = positions.select(
        "symbol",
        F.explode(F.sequence(F.col("bar_no") + 1, F.col("exit_no"))).alias("bar_no"),
        "exit_no", "entry_price", "return_pct",
    )
    df = bars.select("symbol", "bar_ts", "bar_no", "close").join(open_bars, ["symbol", "bar_no"], "left")
    leaving = F.col("bar_no") == F.col("exit_no")
    df = df.withColumn("_g", F.when(leaving, F.log1p("return_pct")).otherwise(0.0))
    df = running(df, ["symbol"], "bar_no", {"_cash": ("sum", "_g")}, block)
    held = F.col("entry_price").isNotNull() & ~truth(leaving)
    value = F.exp("_cash") * F.when(held, div(F.col("close"), F.col("entry_price"))).otherwise(1.0)
    df = df.where(F.col("bar_no") >= min_history).withColumn("equity", value)
    df = running(df, ["symbol"], "bar_no", {"_peak": ("max", "equity")}, block)
    return df.select(
        "symbol", "bar_ts", "bar_no", "equity",
        (div(F.col("equity"), F.greatest(F.col("_peak"), F.lit(1.0))) - 1.0).alias("drawdown"),
        F.col("entry_price").isNotNull().cast("int").alias("in_position"),
    )


# --- daily portfolio ---------------------------------------------------------------------------


def top_n_per_date(scored: DataFrame, n: int, score: str = "score", least: int = 2) -> DataFrame:
    """The n best symbols of each time, ties by symbol; times with fewer than ``least`` are skipped.

    The rank limit is applied per task before the shuffle, so a crowded time is not gathered.
    """
    sizes = scored.groupBy("bar_ts").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least)
    rank = F.row_number().over(W.partitionBy("bar_ts").orderBy(F.col(score).desc(), F.col("symbol")))
    return (
        scored.withColumn("rank", rank)
        .where(F.col("rank") <= n)
        .join(sizes.select("bar_ts"), "bar_ts", "left_semi")
    )


def next_dates(dates: DataFrame) -> DataFrame:
    """Each time with the time after it (equi-join on a dense number; no global sort)."""
    d = cut_lineage(number_by_range(dates, "bar_ts", "_no"))
    after = d.select(F.col("bar_ts").alias("next_ts"), (F.col("_no") - 1).alias("_no"))
    return d.join(after, "_no").select("bar_ts", "next_ts")


def portfolio_returns(picks: DataFrame, bars: DataFrame, test_dates: DataFrame) -> DataFrame:
    """Equal-weight return of the picks over the next test date, slippage both ways."""
    nxt = bars.select("symbol", F.col("bar_ts").alias("next_ts"), "open", "close")
    entry = F.col("open") * (1.0 + SLIPPAGE)
    leave = F.col("close") * (1.0 - SLIPPAGE)
    trades = (
        picks.select("symbol", "bar_ts", "rank")
        .join(next_dates(test_dates), "bar_ts")
        .join(nxt, ["symbol", "next_ts"])
        .where(entry > 0)
        .withColumn("_r", div(leave - entry, entry))
    )
    chosen = F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"])
    return trades.groupBy("bar_ts").agg(F.avg("_r").alias("ret"), chosen.alias("symbols"))


def pseudo_random_score(seed: int) -> Column:
    """Deterministic shuffle key per (symbol, time)."""
    return F.xxhash64(F.col("symbol"), F.col("bar_ts"), F.lit(seed)).cast("double")


def gate(prob: Column, vol: Column, cooling: Column, threshold: float = 0.58) -> tuple[Column, Column]:
    """BUY / NO_TRADE and the reasons against buying."""
    from tidebar.functions.nulls import tags

    # Tradable range of the five-bar volatility.
    low, high = 0.005, 0.08
    reasons = tags(
        [
            (prob < threshold, "probability_below_threshold"),
            (~truth((vol > low) & (vol < high)), "volatility_out_of_range"),
            (truth(cooling), "cooldown_active"),
        ]
    )
    return F.when(F.size(reasons) == 0, "BUY").otherwise("NO_TRADE"), reasons


def fast_gate(scored: DataFrame, threshold: float = 0.60, top_share: float = 0.20, window: int = 50, block: int | None = None) -> DataFrame:
    """Signals whose probability is high, in the top share of the last ``window`` and gated.

    Needs prob, realized_vol_5d, ret_lag_3.
    """
    df = blocked(scored, back=window, block=block).withColumn(
        "cutoff", rolling(lambda c: F.percentile(c, 1.0 - top_share), "prob", window)
    )
    df = own_rows(df)
    decision, _ = gate(F.col("prob"), F.col("realized_vol_5d"), F.lit(False), threshold)
    ok = all_of(F.col("prob") >= threshold, F.col("prob") >= F.col("cutoff"), decision == "BUY", F.col("ret_lag_3") > 0)
    return df.withColumn("signal", truth(ok))
