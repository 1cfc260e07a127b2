"""Aggregates over trades, equity, predictions and signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidebar.functions.nulls import clip, div, ladder, truth
from tidebar.operators.layout import blocked, chunk_width, lag, own_rows
from tidebar.operators.quantiles import exact_quantiles
from tidebar.operators.scan import number_rows, running
from tidebar.session import cut_lineage

YEAR = math.sqrt(252.0)
INF = float("inf")


def trade_statistics(trades: DataFrame, keys: list[str], ret: str = "return_pct") -> DataFrame:
    """Per key: counts, averages, summed and compounded return, extremes, profit factor, notes."""
    r = F.col(ret)
    gains = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0))
    losses = F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0)))
    trades = cut_lineage(trades)
    out = trades.groupBy(*keys).agg(
        F.count(r).alias("total_trades"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(r).alias("avg_return_per_trade"),
        F.sum(r).alias("total_return"),
        (F.product(r + 1.0) - 1.0).alias("compounded_return"),
        F.max(r).alias("best_trade"),
        F.min(r).alias("worst_trade"),
        F.avg("holding_days").alias("average_holding_days"),
        F.when(losses >= 1e-15, gains / losses).alias("profit_factor"),
    )
    mid = exact_quantiles(trades, keys, ret, {"median_return_per_trade": 0.5})
    notes = F.array_compact(
        F.array(
            F.when(F.col("profit_factor").isNull(), "No trade lost: there is no profit factor."),
            F.when(F.col("total_trades") < 2, "Fewer than two trades: read ratios with caution."),
        )
    )
    return out.join(mid, keys, "left").withColumns(
        {"expectancy": F.col("avg_return_per_trade"), "metrics_notes": notes}
    )


def equity_ratios(equity: DataFrame, keys: list[str], step_return: str = "step_return") -> DataFrame:
    """Sharpe, Sortino and deepest drawdown of equity rows that carry their step return."""
    r = F.col(step_return)
    down = F.when(r < 0, r)
    mu, sd, dsd = F.avg(r), F.stddev_samp(r), F.stddev_samp(down)
    enough = F.count(r) >= 2
    return equity.groupBy(*keys).agg(
        F.when(enough & (sd > 1e-12), mu / sd * YEAR).alias("sharpe_ratio"),
        F.when(enough & (F.count(down) >= 2) & (dsd > 1e-12), mu / dsd * YEAR).alias("sortino_ratio"),
        F.when(enough, F.min("drawdown")).alias("max_drawdown"),
        F.avg(F.col("in_position").cast("double")).alias("exposure_ratio"),
    )


def with_step_return(equity: DataFrame, block: int | None = None) -> DataFrame:
    """Relative change of equity against the bar before."""
    df = blocked(equity, back=1, block=block).withColumn("_p", lag("equity"))
    return own_rows(df.withColumn("step_return", (F.col("equity") - F.col("_p")) / clip(F.col("_p"), lo=1e-12))).drop("_p")


def portfolio_metrics(returns: DataFrame, keys: list[str], ts: str = "bar_ts", ret: str = "ret", block: int | None = None) -> DataFrame:
    """Counts, compounded return, win rate, profit factor, Sharpe and deepest drawdown.

    Losses include zero returns; with no loss the profit factor is infinite.  The running peak
    starts at the first equity value.
    """
    chunk = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / chunk_width(returns, keys, ts))
    df = number_rows(returns, keys, ts, "_no", chunk)
    df = running(df.withColumn("_g", F.log1p(ret)), keys, "_no", {"_cum": ("sum", "_g")}, block)
    df = df.withColumn("_eq", F.exp("_cum"))
    df = running(df, keys, "_no", {"_peak": ("max", "_eq")}, block)
    return simple_summary(df, keys, ret, extra=[
        F.coalesce(F.when(F.stddev_pop(ret) > 0, F.avg(ret) / F.stddev_pop(ret) * YEAR), F.lit(0.0)).alias("sharpe_ratio"),
        F.min((F.col("_eq") - F.col("_peak")) / F.col("_peak")).alias("max_drawdown"),
    ])


def simple_summary(trades: DataFrame, keys: list[str], ret: str = "trade_return", extra: list[Column] = ()) -> DataFrame:
    """Count, compounded return, win rate and profit factor (losses include zero)."""
    r = F.col(ret)
    gain = F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0))
    loss = F.abs(F.coalesce(F.sum(F.when(r <= 0, r)), F.lit(0.0)))
    return trades.groupBy(*keys).agg(
        F.count(r).alias("trade_count"),
        (F.product(r + 1.0) - 1.0).alias("compounded_return"),
        F.avg((r > 0).cast("double")).alias("win_rate"),
        F.when(loss > 0, gain / loss).otherwise(F.lit(INF)).alias("profit_factor"),
        *extra,
    )


def regime_performance(trades: DataFrame, keys: list[str], regime: str = "market_regime", ret: str = "return_pct") -> DataFrame:
    """Trades, win rate, average and summed return per regime."""
    r = F.col(ret)
    return trades.groupBy(*keys, regime).agg(
        F.count(r).alias("trades"), F.avg((r > 0).cast("double")).alias("win_rate"),
        F.avg(r).alias("avg_return"), F.sum(r).alias("total_return"),
    )


def best_regime(performance: DataFrame, keys: list[str], regime: str = "market_regime") -> DataFrame:
    """Regime with the largest summed return per key (name order breaks ties)."""
    return performance.groupBy(*keys).agg(
        F.max_by(F.col(regime), F.struct("total_return", regime)).alias("best_regime")
    )


def rejection_bucket(reasons: Column) -> Column:
    """First matching keyword group over the joined reasons."""
    text = F.lower(F.concat_ws(" ", reasons))
    has = lambda w: text.contains(w)
    # Keyword groups in order of precedence.
    return ladder(
        [
            (has("cooldown"), "cooldown"),
            (has("sanity"), "feature_sanity"),
            (has("shock"), "volatility_shock"),
            (has("confidence") & has("below"), "low_confidence"),
            (has("agreement"), "low_agreement"),
            (has("edge"), "low_edge"),
            (has("regime") & has("volatile"), "regime_filter"),
            (has("trend") | has("neutral") | has("aligned"), "trend_filter"),
            (has("sentiment") | has("conflict"), "sentiment_conflict"),
        ],
        "other",
    )


def strategy_health(signals: DataFrame, keys: list[str], decision: str = "decision", cooling: str = "cooldown_active") -> DataFrame:
    """Signal frequencies, mean distance between signals, blocked and idle shares.

    The mean distance between consecutive signals is (last - first) / (count - 1), which needs
    no ordering.
    """
    d = F.col(decision)
    acts = d.isin("STRONG_BUY", "WEAK_BUY", "PROBING_BUY")
    at = F.when(acts, F.col("bar_no"))
    share = lambda c: F.avg(c.cast("double"))
    return signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days_evaluated"),
        share(acts).alias("signal_frequency"),
        share(d == "STRONG_BUY").alias("strong_signal_frequency"),
        share(d == "WEAK_BUY").alias("weak_signal_frequency"),
        share(d == "PROBING_BUY").alias("probing_signal_frequency"),
        F.when(F.count(at) >= 2, (F.max(at) - F.min(at)) / (F.count(at) - 1)).alias("average_time_between_signals"),
        share(F.col(cooling)).alias("percentage_days_blocked_by_cooldown"),
        share(d == "NO_TRADE").alias("percentage_no_trade"),
    )


def rejection_shares(signals: DataFrame, keys: list[str], decision: str = "decision", reasons: str = "reasons") -> DataFrame:
    """Count and share (of all evaluated rows) of every rejection bucket."""
    bucket = F.when(F.col(decision) == "NO_TRADE", rejection_bucket(F.col(reasons)))
    per = signals.groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys))
    return per.withColumn("share", F.col("n") / total).where(F.col("bucket").isNotNull())


# --- predictions -------------------------------------------------------------------------------


def regression_metrics(preds: DataFrame, keys: list[str], y: str = "y", p: str = "y_pred") -> DataFrame:
    """MAE, RMSE, R2, MAPE as a fraction and sign accuracy."""
    y_, p_ = F.col(y), F.col(p)
    e = y_ - p_
    tot = F.var_pop(y_) * F.count(y_)
    sized = F.abs(y_) > 1e-10
    return preds.groupBy(*keys).agg(
        F.count(y_).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(tot < 1e-12, 0.0).otherwise(F.lit(1.0) - F.sum(e * e) / tot).alias("r2"),
        F.coalesce(F.avg(F.when(sized, F.abs(div(e, y_)))), F.lit(0.0)).alias("mape"),
        F.coalesce(
            F.avg(F.when(y_ != 0, (F.signum(y_) == F.signum(p_)).cast("double"))), F.lit(0.5)
        ).alias("directional_accuracy"),
    )


def over_folds(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Mean and population deviation of each metric over folds."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("folds"),
        *[F.avg(m).alias(f"{m}_mean") for m in names],
        *[F.stddev_pop(m).alias(f"{m}_std") for m in names],
    )


AUC_BINS = 1 << 16


def auc(preds: DataFrame, keys: list[str], y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Area under the ROC curve with tied scores averaged; NULL with a single class.

    Scores are counted per value, values per bin of [0, 1]; only the bin totals (a fixed number
    per key) and the values of one bin are ever ordered together.
    """
    hit = (F.col(y) == 1).cast("bigint")
    vals = cut_lineage(
        preds.groupBy(*keys, F.col(p).alias("_p"))
        .agg(F.sum(hit).alias("_pos"), F.sum(F.lit(1) - hit).alias("_neg"))
        .withColumn("_bin", F.least(F.floor(F.col("_p") * AUC_BINS), F.lit(AUC_BINS - 1)))
    )
    bins = vals.groupBy(*keys, "_bin").agg(F.sum("_neg").alias("_bneg"))
    before = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    base = bins.select(*keys, "_bin", F.coalesce(F.sum("_bneg").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*keys, "_bin").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    low = F.coalesce(F.sum("_neg").over(inside), F.lit(0))
    ranked = vals.withColumn("_low", low).join(base, [*keys, "_bin"])
    wins = F.sum(F.col("_pos") * (F.col("_low") + F.col("_base") + F.col("_neg") * 0.5))
    pos, neg = F.sum("_pos").cast("double"), F.sum("_neg").cast("double")
    return ranked.groupBy(*keys).agg(F.try_divide(wins, pos * neg).alias("roc_auc"))


def classification_metrics(preds: DataFrame, keys: list[str], y: str = "y_true", c: str = "y_pred", p: str = "y_prob") -> DataFrame:
    """Accuracy, Brier score and ROC AUC."""
    base = preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col(y) == F.col(c)).cast("double")).alias("accuracy"),
        F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier_score"),
    )
    return base.join(auc(preds, keys, y, p), keys, "left")


def model_weights(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Weights by inverse error, normalised over the models of a key (a handful of rows)."""
    inv = lambda c: F.when(F.col(c) > 1e-12, F.lit(1.0) / F.col(c))
    raw = F.coalesce(inv("mae"), inv("rmse"), F.lit(1.0))
    w = W.partitionBy(*keys)
    total, n = F.sum("_raw").over(w), F.count(F.lit(1)).over(w)
    return metrics.withColumn("_raw", raw).withColumn(
        "weight", F.when(total < 1e-12, F.lit(1.0) / n).otherwise(F.col("_raw") / total)
    ).drop("_raw")


def mean_directional_accuracy(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Average of the models' direction accuracy; 0.5 when there is none in range."""
    a = F.col("directional_accuracy")
    return metrics.groupBy(*keys).agg(
        F.coalesce(F.avg(F.when(a.between(0.0, 1.0), a)), F.lit(0.5)).alias("mean_directional_accuracy")
    )


def parity_diff(a: DataFrame, b: DataFrame, keys: list[str], cols: list[str], tol: float = 1e-9) -> DataFrame:
    """Long table of the values two result sets disagree on; a missing row differs everywhere."""
    numeric = {f.name for f in a.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint")}
    left = a.select(*keys, F.lit(True).alias("_ina"), *[F.col(c).alias(f"_a_{c}") for c in cols])
    right = b.select(*keys, F.lit(True).alias("_inb"), *[F.col(c).alias(f"_b_{c}") for c in cols])
    both = left.join(right, keys, "full_outer")

    def differs(c):
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        same = x.eqNullSafe(y)
        if c in numeric:
            same = same | truth(F.abs(x - y) <= tol)
        return ~same | F.col("_ina").isNull() | F.col("_inb").isNull()

    found = F.array_compact(
        F.array(
            *[
                F.when(
                    differs(c),
                    F.struct(F.lit(c).alias("field"), F.col(f"_a_{c}").cast("string").alias("left_value"), F.col(f"_b_{c}").cast("string").alias("right_value")),
                )
                for c in cols
            ]
        )
    )
    return both.select(*keys, F.explode(found).alias("d")).select(*keys, "d.*")
