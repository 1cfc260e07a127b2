"""The model queries hand daily bars to members of full size."""

import inspect

import pytest

from tidebar.operators import models as ml
from tidebar.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


class Asked(Exception):
    pass


@pytest.mark.parametrize(
    "name, fit, full",
    [
        ("walk_forward_classifier", "fit_classifier", {"trees": 500, "depth": 5}),
        ("cross_sectional_ranker", "fit_classifier", {"trees": 500, "depth": 5}),
        ("latest_prediction", "fit_classifier", {"trees": 500, "depth": 5}),
        ("ensemble_regressors", "fit_members", {"size": 1.0}),
        ("one_step_forecast", "fit_members", {"size": 1.0}),
        ("direction_heads", "fit_direction_heads", {"trees": 160, "depth": 5}),
        ("recursive_model_forecast", "fit_members", {"size": 1.0}),
    ],
)
def test_full_members_on_daily_bars(spark, monkeypatch, name, fit, full):
    kind = inspect.signature(getattr(ml, fit))

    def asked(*args, **named):
        bound = kind.bind(*args, **named)
        bound.apply_defaults()
        raise Asked(bound.arguments)

    monkeypatch.setattr(ml, fit, asked)
    with pytest.raises(Asked) as found:
        QUERIES[name].run(spark, SF)
    got = found.value.args[0]
    assert {k: got[k] for k in full} == full
    # weekly bars all start on a Monday
    assert got["train"].selectExpr("count(DISTINCT dayofweek(bar_ts))").first()[0] > 5


def test_full_sizes(spark):
    assert ml.MEMBERS["random_forest"](1.0).getNumTrees() == 200 and ml.MEMBERS["gradient_boosting"](1.0).getMaxIter() == 240
