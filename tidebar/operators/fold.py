"""Recursive forecasts as one fold over a row of state per symbol.

A forecast path lets every step see the bars predicted before it.  What the features of the next step
need of the past is small: the last bars and a few smoothed moments.  So each symbol's last bars travel
in one row, and all steps advance inside the task that holds it, vectorised over the symbols of a batch:
one job whatever the horizon, no features built anew.  Fitted trees are read once from their saved form
into flat arrays and scored for all symbols and trees together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel, LinearRegressionModel, RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidebar.functions.arrays import column_of, cumsum
from tidebar.operators.ewm import WARMUP, span
from tidebar.operators.heavy import spread_join
from tidebar.operators.paths import HARD_CAP, HORIZON, OUTER_CAP, SIGMA_CAP, with_cumulative_guardrail
from tidebar.session import shared_folder

TAIL = WARMUP + 64  # bars of a symbol in its row: what is older weighs less than the rounding of a double
SYMBOLS = 256  # symbols advanced together
FEW = 1_000_000  # symbols whose last bar numbers are broadcast
BAR = ["open", "high", "low", "close", "volume"]


# --- fitted members as arrays ----------------------------------------------------------------------


class Trees:
    """Trees of one model side by side: node arrays, roots and the weight of each tree."""

    def __init__(self, nodes: pd.DataFrame, weights: list[float], columns: list[int]):
        nodes = nodes.sort_values(["tree", "id"], kind="stable")
        base = np.searchsorted(nodes["tree"].to_numpy(), nodes["tree"].to_numpy())  # first node of the tree
        self.leaf = nodes["left"].to_numpy() < 0
        here = np.arange(len(nodes))
        self.left = np.where(self.leaf, here, base + nodes["left"].to_numpy())
        self.right = np.where(self.leaf, here, base + nodes["right"].to_numpy())
        self.feature = np.where(self.leaf, 0, nodes["feature"].to_numpy())
        self.threshold = nodes["threshold"].fillna(0.0).to_numpy()
        self.value = nodes["value"].to_numpy()
        self.roots = np.unique(base)
        self.weights, self.columns = np.array(weights), columns

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = x[:, self.columns]
        node = np.repeat(self.roots[:, None], len(x), 1)
        row = np.arange(len(x))[None, :]
        while not self.leaf[node].all():
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.weights @ self.value[node]


class Linear:
    def __init__(self, coefficients: np.ndarray, intercept: float, columns: list[int]):
        self.coefficients, self.intercept, self.columns = coefficients, intercept, columns

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x[:, self.columns] @ self.coefficients + self.intercept


def flat_member(model: PipelineModel, features: list[str]) -> Trees | Linear:
    """A fitted member (assembler and regressor) as arrays over the columns of ``features``.

    Trees come from the model's saved node table; its size is bounded by the member's own settings.
    """
    assembler, fitted = model.stages
    columns = [features.index(c) for c in assembler.getInputCols()]
    if isinstance(fitted, LinearRegressionModel):
        return Linear(fitted.coefficients.toArray(), fitted.intercept, columns)
    spark = SparkSession.getActiveSession()
    path = f"{shared_folder(spark)}/tidebar/{uuid.uuid4().hex}"
    fitted.write().save(path)
    n = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("id"), n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("value"),
        n["split"]["featureIndex"].alias("feature"), F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
    )
    weights = list(fitted.treeWeights)
    if isinstance(fitted, RandomForestRegressionModel):
        weights = [w / len(weights) for w in weights]
    elif not isinstance(fitted, GBTRegressionModel):
        raise TypeError(f"no array form for {type(fitted).__name__}")
    return Trees(nodes.toPandas(), weights, columns)


def flat_members(models: dict[str, PipelineModel], features: list[str]) -> Callable[[np.ndarray], np.ndarray]:
    """All members as one function from feature rows to predictions (one column per member)."""
    flat = [flat_member(m, features) for m in models.values()]
    held = SparkSession.getActiveSession().sparkContext.broadcast(flat)
    return lambda x: np.stack([m.predict(x) for m in held.value], 1)


# --- state -------------------------------------------------------------------------------------------


def smoothed(x: np.ndarray, alpha: float) -> np.ndarray:
    """Last value of the exponentially weighted mean along each row; missing values age it (no bias adjustment)."""
    value, gap, q = np.full(len(x), np.nan), np.zeros(len(x)), 1.0 - alpha
    for column in x.T:
        gap += 1
        seen, new = ~np.isnan(column), np.isnan(value)
        old = q**gap
        with np.errstate(invalid="ignore"):
            mixed = (old * value + alpha * column) / (old + alpha)
        value = np.where(seen, np.where(new, column, mixed), value)
        gap = np.where(seen, 0, gap)
    return value


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, np.nan)


class ReturnState:
    """Four simple members: last return, mean of three, weekly momentum, reversal; volatility of span 14."""

    members = 4

    def __init__(self, bars: dict[str, np.ndarray], n: np.ndarray, weekday: np.ndarray, scale: float, p99: float | None):
        self.scale, self.p99, self.n = scale, p99, n.astype(float)
        moves = np.log(ratio(bars["close"][:, 1:], bars["close"][:, :-1])) / scale
        self.last = moves[:, -7:]
        self.alpha = span(14)
        self.mean, self.square = smoothed(moves, self.alpha), smoothed(moves**2, self.alpha)

    def volatility(self) -> np.ndarray:
        q = 1.0 - self.alpha
        aged = (q * q) ** (self.n - 2)
        weight = aged + (1 - aged) * (self.alpha**2 / (1 - q * q))
        return np.sqrt(np.maximum(self.square - self.mean**2, 0) / (1 - weight))

    def regime(self) -> np.ndarray:
        v = self.volatility()
        return np.where(v < 0.012, 0.0, np.where(v < 0.030, 1.0, 2.0))

    def features(self) -> np.ndarray:
        r = self.last
        return np.stack([r[:, -1], r[:, -3:].mean(1), r.mean(1), -0.5 * r[:, -1]], 1)

    def push(self, step: np.ndarray, price: np.ndarray) -> None:
        x = step / self.scale
        self.last = np.concatenate([self.last[:, 1:], x[:, None]], 1)
        self.mean = (1 - self.alpha) * self.mean + self.alpha * x
        self.square = (1 - self.alpha) * self.square + self.alpha * x * x
        self.n = self.n + 1


class CoreState:
    """The 16 core features of the newest bar from the last 21 bars and two smoothed moves."""

    def __init__(self, bars: dict[str, np.ndarray], n: np.ndarray, weekday: np.ndarray, scale: float, p99: float | None):
        self.scale, self.p99, self.n, self.weekday = scale, p99, n, weekday.astype(float)
        self.close, self.volume = bars["close"][:, -21:], bars["volume"][:, -20:]
        self.bar = {c: bars[c][:, -1] for c in BAR}
        move = np.diff(bars["close"], axis=1)
        self.gain, self.loss = (smoothed(np.where(np.isnan(move), np.nan, np.maximum(s * move, 0)), 1 / 14) for s in (1, -1))

    def _moves(self) -> np.ndarray:
        return np.log(ratio(self.close[:, 1:], self.close[:, :-1]))

    def volatility(self) -> np.ndarray:
        return self._moves().std(1, ddof=1) / self.scale

    def regime(self) -> np.ndarray:
        return np.ones(len(self.close))

    def features(self) -> np.ndarray:
        c, last = self.close, self.close[:, -1]
        back = [np.log(ratio(last, c[:, -1 - k])) for k in (1, 5, 10, 20)]
        moves = self._moves()
        v5, v20 = moves[:, -5:].std(1, ddof=1), moves.std(1, ddof=1)
        strength = ratio(self.gain, self.loss)
        rsi = np.where(self.n >= 15, np.clip(1 - 1 / (1 + strength), 0, 1), np.nan)
        mean, band = c[:, -20:].mean(1), 2 * c[:, -20:].std(1, ddof=1)
        vol5, vol20 = self.volume[:, -5:].mean(1), self.volume.mean(1)
        b, angle = self.bar, self.weekday * (2 * np.pi / 7)
        rows = [
            *back, v5, v20, ratio(v5, v20), rsi, np.clip(ratio(last - (mean - band), 2 * band), 0, 1), ratio(last, mean) - 1, ratio(b["volume"], vol20),
            ratio(np.where(vol5 == 0, np.nan, vol5), vol20), ratio(last - b["open"], b["open"]), ratio(b["high"] - b["low"], b["open"]), np.sin(angle), np.cos(angle),
        ]
        return np.stack(rows, 1)

    def push(self, step: np.ndarray, price: np.ndarray) -> None:
        move = price - self.close[:, -1]
        self.gain += (np.maximum(move, 0) - self.gain) / 14
        self.loss += (np.maximum(-move, 0) - self.loss) / 14
        self.close = np.concatenate([self.close[:, 1:], price[:, None]], 1)
        self.volume = np.concatenate([self.volume[:, 1:], self.bar["volume"][:, None]], 1)
        self.bar = {**{c: price for c in BAR[:4]}, "volume": self.bar["volume"]}
        self.n, self.weekday = self.n + 1, (self.weekday + 1) % 7


# --- the fold ------------------------------------------------------------------------------------------


def agreement(row: np.ndarray) -> np.ndarray:
    """``paths.diversity_agreement`` over the rows of a matrix."""
    if row.shape[1] < 2:
        return np.full(len(row), 0.45)
    size = np.abs(row).mean(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        plain = np.clip(1 - row.std(1) / size, 0, 1)
    at_bound = (row.min(1) >= OUTER_CAP - 1e-4) | (row.max(1) <= 1e-4 - OUTER_CAP)
    return np.select([np.ptp(row, 1) < 1e-6, at_bound, size < 1e-10], [0.22, 0.28, 0.25], plain)


def advance(state, predict, weights: np.ndarray, close: np.ndarray, horizon: int, band: float, fill: float) -> dict[str, np.ndarray]:
    """All steps of a batch of symbols: arrays of symbols x steps (x members)."""
    out = {k: [] for k in ("ens", "matrix", "price", "lower", "upper", "agree", "vols")}
    saturated, missing, start, price = 0, np.zeros(len(close)), None, close
    for step in range(1, horizon + 1):
        x = state.features()
        gone = ~np.isfinite(x)
        missing = np.maximum(missing, gone.mean(1))
        raw = predict(np.where(gone, fill, x))
        vol, regime = state.volatility(), state.regime()
        vol = np.maximum(np.where(np.isnan(vol), 0.02, vol), 0.005)
        start = (vol, regime) if start is None else start
        cap = np.minimum(HARD_CAP, np.maximum(vol, 0.004) * SIGMA_CAP)
        if state.p99 is not None and state.p99 > 1e-8:
            cap = np.minimum(cap, state.p99 * 1.15)
        cap = np.maximum(cap, 0.002)[:, None]
        row = np.clip(np.clip(raw, -OUTER_CAP, OUTER_CAP), -cap, cap)
        mean = row.mean(1) if weights.sum() < 1e-12 else row @ weights / weights.sum()
        ens = np.clip(np.clip(mean, -OUTER_CAP, OUTER_CAP), -cap[:, 0], cap[:, 0])
        saturated = saturated + (np.abs(row) >= cap - 1e-6).all(1)
        price = price * np.exp(ens)
        half = band * vol * np.sqrt(step) * (0.88 + 0.12 * np.clip(regime, 0, 2))
        for name, value in zip(out, (ens, row, price, price * np.exp(-half), price * np.exp(half), agreement(row), vol)):
            out[name].append(value)
        state.push(ens, price)
    return {**{k: np.stack(v, 1) for k, v in out.items()}, "saturation": saturated / horizon, "missing": missing, "vol": start[0], "regime": start[1]}


def last_bars(bars: DataFrame, tail: int = TAIL) -> DataFrame:
    """One row per symbol: the bar number, time and bars (arrays, oldest first) of its last ``tail`` bars."""
    last = bars.groupBy("symbol").agg(F.max("bar_no").alias("_last"))
    near = bars.select("symbol", "bar_no", "bar_ts", *[F.col(c).cast("double").alias(c) for c in BAR])
    joined = near.join(F.broadcast(last), "symbol") if last.count() <= FEW else spread_join(near, last, "symbol", "inner")
    rows = joined.where(F.col("bar_no") > F.col("_last") - tail).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("bar_no", "bar_ts", *BAR))).alias("t"))
    return rows.select("symbol", F.element_at("t", -1)["bar_no"].alias("n"), F.element_at("t", -1)["bar_ts"].cast("timestamp").alias("ts"), *[F.col("t")[c].alias(c) for c in BAR])


def recursive_fold(bars: DataFrame, state: type, predict: Callable | None, weights: list[float], horizon: int = HORIZON, p99: float | None = None, p99_cum: float | None = None, scale: float = 1.0, band: float = 2.0, fill: float = 0.5, guard: bool = True) -> DataFrame:
    """One row per symbol with a path that sees its own predictions.

    ``state`` is built from a symbol's last bars and gives features, volatility and regime; ``predict``
    turns feature rows into one prediction per member (None where the state's features are the members).
    Columns: symbol, close (spot), vol and vol_regime_encoded at the start, matrix (steps x members), ens,
    prices, lower, upper, agree, vols, member_prices (members x steps), clip_saturation (share of steps in
    which every member is at the cap), missing_fill_ratio (largest share of features that were filled),
    guardrail (the summed return was beyond its cap and the path was scaled).  A symbol with fewer than
    21 bars pads its history with missing values.
    """
    w = np.array(weights, float)

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), SYMBOLS):
                part = pdf.iloc[at : at + SYMBOLS]
                width = max(22, max(len(c) for c in part["close"]))
                held = {c: np.stack([np.concatenate([np.full(width - len(v), np.nan), np.asarray(v, float)]) for v in part[c]]) for c in BAR}
                s = state(held, part["n"].to_numpy(), part["ts"].dt.weekday.to_numpy(), scale, p99)
                close = held["close"][:, -1]
                with np.errstate(invalid="ignore"):
                    o = advance(s, predict or (lambda x: x), w, close, horizon, band, fill)
                yield pd.DataFrame(
                    {
                        "symbol": part["symbol"].to_numpy(), "close": close, "vol": o["vol"], "vol_regime_encoded": o["regime"], "matrix": [[list(r) for r in m] for m in o["matrix"]],
                        "ens": list(o["ens"]), "own_prices": list(o["price"]), "own_lower": list(o["lower"]), "own_upper": list(o["upper"]), "own_agree": list(o["agree"]), "vols": list(o["vols"]),
                        "clip_saturation": o["saturation"], "missing_fill_ratio": o["missing"],
                    }
                )

    lists = ", ".join(f"{c} array<double>" for c in ("ens", "own_prices", "own_lower", "own_upper", "own_agree", "vols"))
    schema = f"symbol string, close double, vol double, vol_regime_encoded double, matrix array<array<double>>, {lists}, clip_saturation double, missing_fill_ratio double"
    out = last_bars(bars).mapInPandas(run, schema)
    own = ["prices", "lower", "upper", "agree"]
    if guard:
        out = with_cumulative_guardrail(out.withColumn("p99_cum", F.lit(p99_cum).cast("double")), band).drop("p99_cum")
        out = out.withColumns({c: F.when(F.col("guardrail"), F.col(c)).otherwise(F.col(f"own_{c}")) for c in own})
    else:
        out = out.withColumns({**{c: F.col(f"own_{c}") for c in own}, "guardrail": F.lit(False)})
    member = lambda i: F.transform(cumsum(column_of(F.col("matrix"), i)), lambda c: F.col("close") * F.exp(c))
    return out.withColumn("member_prices", F.array(*[member(i) for i in range(len(weights))])).drop(*[f"own_{c}" for c in own])


def fold_steps(path: DataFrame, *also: Column | str) -> DataFrame:
    """One row per symbol and step: ens, price, lower, upper, agree, vol, row (members), member_prices."""
    step = F.arrays_zip("ens", F.col("prices").alias("price"), "lower", "upper", "agree", F.col("vols").alias("v"), F.col("matrix").alias("row"))
    flat = path.select("symbol", *also, "member_prices", F.posexplode(step).alias("_s", "_c"))
    return flat.select("symbol", *also, (F.col("_s") + 1).alias("step"), "_c.ens", "_c.price", "_c.lower", "_c.upper", "_c.agree", F.col("_c.v").alias("vol"), "_c.row", F.transform("member_prices", lambda m: F.get(m, F.col("_s"))).alias("member_prices"))
