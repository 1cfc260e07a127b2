"""Rankings, scanner rows, charts and row audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidebar.functions.nulls import ladder, truth
from tidebar.functions.prices import round_price
from tidebar.sources.bars import chart_tail


def scanner_rows(signals: DataFrame, top: int = 3) -> DataFrame:
    """Market score order with ranks for the best; ties by confidence, then symbol.

    One row per symbol (see bars.latest_rows).  The best rows come from a limit, which is taken
    per task first; nothing is gathered to rank the rest.
    """
    by = [F.col("market_score").desc(), F.col("confidence_score").desc(), F.col("symbol")]
    best = signals.orderBy(*by).limit(top).select("symbol", "market_score", "confidence_score")
    rank = F.row_number().over(W.orderBy(*by))
    ranks = best.withColumn("top_opportunity_rank", rank).select("symbol", "top_opportunity_rank")
    return signals.join(F.broadcast(ranks), "symbol", "left")


def decision_priority(decision: Column) -> Column:
    d = F.upper(F.coalesce(decision, F.lit("NO_TRADE")))
    return ladder([(d == "STRONG_BUY", 0), (d == "WEAK_BUY", 1)], 2)


def display_order() -> list[Column]:
    """Sort columns of the scanner display."""
    return [F.col("market_score").desc(), decision_priority(F.col("trade_decision")), F.col("confidence_score").desc(), F.col("symbol")]


def with_leader_flags(rows: DataFrame) -> DataFrame:
    """Flags for the largest confidence and the largest expected move of all rows."""
    peak = lambda c: rows.agg(F.max(c)).scalar()
    return rows.withColumns(
        {
            "is_max_confidence": truth(F.col("confidence_score") == peak("confidence_score")),
            "is_max_move": truth(F.col("expected_move_pct") == peak("expected_move_pct")),
        }
    )


def direction_text(up: Column, down: Column, neutral: Column) -> Column:
    z = lambda x: F.coalesce(x, F.lit(0.0))
    return ladder([((z(up) >= z(down)) & (z(up) >= z(neutral)), "UP"), ((z(down) >= z(up)) & (z(down) >= z(neutral)), "DOWN")], "NEUTRAL")


def chart(bars: DataFrame, n: int = 90) -> DataFrame:
    """Last n closes per symbol, rounded on the scale of the newest one."""
    tail = chart_tail(bars.dropna(subset=["close"]), n)
    newest = tail.groupBy("symbol").agg(F.max_by("close", "bar_ts").alias("_ref"))
    return tail.join(newest, "symbol").withColumn("close", round_price(F.col("close"), F.col("_ref"))).drop("_ref")


def best_model(metrics: DataFrame) -> DataFrame:
    """Model with the least MAE per symbol, its metrics in display units."""
    best = metrics.groupBy("symbol").agg(
        F.min_by(F.struct("model", "mae", "rmse", "mape", "directional_accuracy"), F.struct(F.coalesce("mae", F.lit(float("inf"))), "model")).alias("b")
    )
    return best.select(
        "symbol", F.initcap(F.replace(F.col("b.model"), F.lit("_"), F.lit(" "))).alias("best_model"),
        F.round("b.mae", 4).alias("mae"), F.round("b.rmse", 4).alias("rmse"),
        F.round(F.col("b.mape") * 100, 2).alias("mape"), F.round(F.col("b.directional_accuracy") * 100, 2).alias("directional_accuracy"),
    )


# --- row audits ------------------------------------------------------------------------------------


def audit_issues(features: list[str], cap: float = 1e7) -> Column:
    """Array of (at most 12) problems of a feature row; names with date or target_ are skipped."""
    checks = []
    for f in features:
        if "date" in f.lower() or "target_" in f.lower():
            continue
        x = F.col(f).cast("double")
        checks.append(
            F.when(x.isNull() | F.isnan(x), F.lit(f"NaN in {f}"))
            .when(F.abs(x) == float("inf"), F.lit(f"Non-finite in {f}"))
            .when(F.abs(x) > cap, F.lit(f"Extreme magnitude in {f}"))
        )
    return F.slice(F.array_compact(F.array(*checks)), 1, 12)


def with_filled_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Missing features as 0, with the missing and the zero share of the row."""
    n = float(max(1, len(features)))
    have = [f for f in features if f in df.columns]
    total = lambda exprs, start: sum(exprs, F.lit(float(start)))
    absent = len(features) - len(have)
    missing = total([F.isnull(f).cast("double") for f in have], absent)
    zeros = total([(F.coalesce(F.col(f).cast("double"), F.lit(0.0)) == 0).cast("double") for f in have], absent)
    return df.withColumns({"missing_feature_fill_ratio": missing / n, "zero_value_ratio": zeros / n}).withColumns(
        {f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in have else F.lit(0.0) for f in features}
    )
