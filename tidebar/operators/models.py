"""Folds, scaling, Spark ML estimators, calibration and scoring."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.util import inheritable_thread_target

from tidebar.functions.nulls import clip
from tidebar.functions.prices import model_feature_view
from tidebar.operators.paths import clip_step, daily_cap, diversity_agreement, weighted_mean
from tidebar.operators.quantiles import exact_quantiles
from tidebar.operators.scan import number_by_range
from tidebar.session import cut_lineage, shared_folder

# --- splits ----------------------------------------------------------------------------------------


def with_date_no(df: DataFrame, ts: str = "bar_ts") -> DataFrame:
    """Add ``date_no`` (dense 1-based over all distinct times) and ``n_dates``."""
    dates = cut_lineage(number_by_range(df, ts, "date_no"))
    return df.join(dates, ts).withColumn("n_dates", dates.agg(F.max("date_no")).scalar())


def walk_forward_fold(no: Column, n: Column, splits: int = 5, first: float = 0.5) -> Column:
    """Test fold of a position (NULL inside the first training share); train is every earlier position.

    The last fold takes the remainder.
    """
    head = F.floor(n * first)
    size = F.floor((n - head) / splits)
    return F.when(no > head, F.least(F.floor((no - 1 - head) / size), F.lit(splits - 1)).cast("int"))


def rolling_origin_fold(no: Column, n: Column, train: float = 0.6, test: int = 30, least: int = 50) -> Column:
    """Test fold of a position in windows of ``test``; incomplete windows and short histories give NULL."""
    head = F.floor(n * train)
    fold = F.floor((no - 1 - head) / test)
    whole = head + (fold + 1) * test <= n
    return F.when((no > head) & whole & (head >= least) & F.lit(test >= 5), fold.cast("int"))


def chronological_split(no: Column, n: Column, train: float = 0.70, cal: float = 0.10) -> Column:
    """train / cal / test by position."""
    return F.when(no <= F.floor(n * train), "train").when(no <= F.floor(n * (train + cal)), "cal").otherwise("test")


# --- scaling ---------------------------------------------------------------------------------------


def robust_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """Median and quartiles per feature: one long pass serves all features."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features]))
    long = df.select(cells.alias("c")).select("c.feature", "c.v")
    return exact_quantiles(long, ["feature"], "v", {"q25": 0.25, "q50": 0.5, "q75": 0.75})


def robust_scale(df: DataFrame, features: list[str], stats: DataFrame) -> DataFrame:
    """(x - median) / (q75 - q25), a zero range counts as 1.

    The statistics are one row per feature, so they travel as literals.
    """
    rows = {r["feature"]: r for r in stats.collect()}
    scaled = {}
    for f in features:
        r = rows[f]
        width = r["q75"] - r["q25"]
        scaled[f] = (F.col(f) - r["q50"]) / (width if width != 0 else 1.0)
    return df.withColumns(scaled)


# --- classifiers -----------------------------------------------------------------------------------


CLASSES = 1000  # values a class label may have


PART_ROWS = 50_000  # rows of a training partition: boosting runs thousands of jobs, so small tables take few tasks


def for_fit(train: DataFrame) -> DataFrame:
    """Training rows in partitions of about ``PART_ROWS``, with the context ready to cut the lineage of long fits."""
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(train.sparkSession))
    return train.coalesce(max(1, -(-train.count() // PART_ROWS)))


def side_by_side(spark, tasks: list[Callable]) -> list:
    """Results of independent fits, whose jobs run at the same time."""
    wrap = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(tasks)) as pool:
        return [f.result() for f in [pool.submit(wrap(t)) for t in tasks]]


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Class weights n / (classes * n_class) of at most ``CLASSES`` classes."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().limit(CLASSES + 1).collect()}
    if len(counts) > CLASSES:
        raise ValueError(f"{label} has more than {CLASSES} values: not a class label")
    n, k = sum(counts.values()), len(counts)
    table = F.create_map(*[F.lit(x) for key, c in counts.items() for x in (key, n / (k * c))])
    return df.withColumn("class_weight", table[F.col(label)])


def single_class(df: DataFrame, label: str) -> bool:
    return df.select(label).distinct().limit(2).count() < 2


def fit_classifier(train: DataFrame, features: list[str], label: str, trees: int = 500, depth: int = 5, seed: int = 42) -> PipelineModel:
    """Class-balanced boosted trees with P(label = 1)."""
    stages = [
        VectorAssembler(inputCols=features, outputCol="x"),
        GBTClassifier(featuresCol="x", labelCol=label, weightCol="class_weight", maxIter=trees, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, seed=seed),
    ]
    return Pipeline(stages=stages).fit(for_fit(balanced(train, label)))


def score(model: PipelineModel, df: DataFrame, out: str = "y_prob") -> DataFrame:
    scored = model.transform(df)
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def fit_calibrator(scored: DataFrame, label: str, prob: str = "y_prob") -> PipelineModel | None:
    """Logistic fit on the raw probability; kept only when the Brier score falls."""
    if single_class(scored, label):
        return None
    scored = cut_lineage(scored.select(label, prob))
    fit = Pipeline(
        stages=[VectorAssembler(inputCols=[prob], outputCol="x"), LogisticRegression(featuresCol="x", labelCol=label, regParam=0.0, maxIter=1000)]
    ).fit(scored)
    err = lambda p: F.avg((F.col(p) - F.col(label)) * (F.col(p) - F.col(label)))
    before, after = score(fit, scored, "_cal").agg(err(prob), err("_cal")).first()
    return fit if after < before else None


def calibrated(model: PipelineModel | None, df: DataFrame, prob: str = "y_prob") -> DataFrame:
    if model is None:
        return df
    return score(model, df, "_cal").withColumn(prob, F.col("_cal")).drop("_cal")


def walk_forward(df: DataFrame, features: list[str], label: str, fold: str = "fold", splits: int = 5, trees: int = 500, depth: int = 5, seed: int = 42) -> DataFrame:
    """Out-of-fold probabilities: train on everything before a fold, calibrate and score on it.

    Folds are fitted side by side over one written table: boosting is a long chain of small jobs, so
    a fold alone leaves most of a cluster idle.
    """
    df = cut_lineage(df)

    def one(k: int) -> DataFrame | None:
        train = df.where(F.col(fold).isNull() | (F.col(fold) < k))
        if single_class(train, label):
            return None
        raw = score(fit_classifier(train, features, label, trees, depth, seed), df.where(F.col(fold) == k))
        return cut_lineage(calibrated(fit_calibrator(raw, label), raw))

    parts = [p for p in side_by_side(df.sparkSession, [lambda k=k: one(k) for k in range(splits)]) if p is not None]
    if not parts:
        raise ValueError("every fold has a single class")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("y_pred", (F.col("y_prob") >= 0.5).cast("int"))


class BoostedHead:
    """One boosted binary model per class; probabilities are divided by their sum."""

    def __init__(self, models: list[PipelineModel]):
        self.models = models

    def transform(self, df: DataFrame) -> DataFrame:
        for c, model in enumerate(self.models):
            df = score(model, df, f"_p{c}")
        p = [F.col(f"_p{c}") for c in range(len(self.models))]
        total = sum(p[1:], p[0])
        each = [F.when(total > 0, x / total).otherwise(1.0 / len(p)) for x in p]
        return df.withColumn("probability", array_to_vector(F.array(*each))).drop(*[f"_p{c}" for c in range(len(p))])


def fit_boosted_head(train: DataFrame, features: list[str], label: str, classes: int = 3, trees: int = 160, depth: int = 5, seed: int = 42) -> BoostedHead:
    """One-against-the-rest boosting over the labels 0 .. classes - 1, fitted side by side.

    A class that no row has gets a weight of zero rows: its model says never.
    """
    train = cut_lineage(train.select(*features, label))
    tasks = [lambda c=c: fit_classifier(train.withColumn("_is", (F.col(label) == c).cast("int")), features, "_is", trees, depth, seed) for c in range(classes)]
    return BoostedHead(side_by_side(train.sparkSession, tasks))


def fit_direction_heads(train: DataFrame, features: list[str], label: str, trees: int = 160, depth: int = 5, seed: int = 42) -> dict:
    """Three-class heads: balanced multinomial regression and one-against-the-rest boosting."""
    assemble = VectorAssembler(inputCols=features, outputCol="x")
    lr = LogisticRegression(featuresCol="x", labelCol=label, weightCol="class_weight", family="multinomial", maxIter=100)
    return {"linear": Pipeline(stages=[assemble, lr]).fit(balanced(train, label)), "trees": fit_boosted_head(train, features, label, trees=trees, depth=depth, seed=seed)}


def score_direction(heads: dict, df: DataFrame) -> DataFrame:
    """One struct (down, neutral, up) per head."""
    for name, model in heads.items():
        p = vector_to_array("probability")
        df = model.transform(df).withColumn(
            f"head_{name}", F.struct(p[0].alias("down"), p[1].alias("neutral"), p[2].alias("up"))
        ).drop("x", "rawPrediction", "probability", "prediction")
    return df


# --- regressors ------------------------------------------------------------------------------------

# Sizes of the ensemble members and the recent share one of them trains on.
RECENT_SHARE = 0.58
MEMBERS: dict[str, Callable] = {
    "random_forest": lambda size: RandomForestRegressor(featuresCol="x", numTrees=max(1, round(200 * size)), maxDepth=min(16, max(3, round(16 * size))), minInstancesPerNode=2, seed=42),
    "gradient_boosting": lambda size: GBTRegressor(featuresCol="x", maxIter=max(1, round(240 * size)), maxDepth=min(6, max(3, round(6 * size))), stepSize=0.05, seed=42),
    "linear": lambda size: LinearRegression(featuresCol="x", elasticNetParam=0.1, regParam=0.001),
}
VIEW_OF = {"random_forest": "random_forest", "gradient_boosting": "xgboost", "linear": "all"}


def fit_members(train: DataFrame, features: list[str], label: str, no: Column, n: Column, size: float = 1.0) -> dict[str, PipelineModel]:
    """The ensemble on its feature views; the boosted member sees only the most recent share.

    ``size`` scales the members (1.0 is the full ensemble); training pools all symbols.
    """

    def one(name: str, make: Callable) -> PipelineModel:
        rows = train.where(no > F.floor(n * (1.0 - RECENT_SHARE))) if name == "gradient_boosting" else train
        view = model_feature_view(VIEW_OF[name], features)
        return Pipeline(stages=[VectorAssembler(inputCols=view, outputCol="x"), make(size).setLabelCol(label)]).fit(for_fit(rows))

    return dict(zip(MEMBERS, side_by_side(train.sparkSession, [lambda i=i: one(*i) for i in MEMBERS.items()])))


def predict_members(models: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """One ``p_<member>`` column per model."""
    for name, m in models.items():
        df = m.transform(df).withColumnRenamed("prediction", f"p_{name}").drop("x")
    return df


def one_step_forecast(df: DataFrame, members: list[str], weights: list[float], band: float = 2.0) -> DataFrame:
    """Weighted next-step return, direction, confidence, price and band from member columns.

    Needs close, vol, p99_daily.
    """
    cap = daily_cap(F.greatest(F.col("vol"), F.lit(0.005)), F.col("p99_daily"))
    row = F.array(*[clip_step(F.col(f"p_{m}"), cap) for m in members])
    df = df.withColumn("_row", row).withColumn("ensemble_log_return", weighted_mean(F.col("_row"), F.array(*map(F.lit, weights))))
    r, half = F.col("ensemble_log_return"), F.greatest(F.col("vol"), F.lit(0.005)) * band
    price = F.col("close") * F.exp(r)
    return df.withColumns(
        {
            "direction": F.when(r > 1e-6, 1).when(r < -1e-6, -1).otherwise(0),
            "confidence": diversity_agreement(F.col("_row")),
            "predicted_price": price,
            "lower_bound": price * F.exp(-half),
            "upper_bound": price * F.exp(half),
        }
    ).drop("_row")
