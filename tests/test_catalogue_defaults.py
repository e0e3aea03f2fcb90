"""The model queries fit the catalogue's models, not smaller ones."""

import pytest

from conftest import SF0001
from quarry.plans import model_queries as Q


class Stop(Exception):
    pass


def stop(record):
    def fn(*args, **kw):
        record.append((args, kw))
        raise Stop
    return fn


@pytest.mark.parametrize("query", ["gbt_scores", "submission"])
def test_one_model(spark, monkeypatch, query):
    seen = []
    monkeypatch.setattr(Q.MD, "make_estimator", stop(seen))
    with pytest.raises(Stop):
        getattr(Q, query)(spark, SF0001)
    assert seen[0][1] == {}


def test_stacking(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.MD, "stacking_fit", stop(seen))
    with pytest.raises(Stop):
        Q.stacking_oof(spark, SF0001)
    base = seen[0][0][1]
    assert base["dt"]().getMaxDepth() == 30 and base["lr"]().getMaxIter() == 1000


def test_tfidf(spark, monkeypatch):
    seen, make = [], Q.MD.tfidf_estimator
    monkeypatch.setattr(Q.MD, "tfidf_estimator", stop(seen))
    with pytest.raises(Stop):
        Q.tfidf_logistic_scores(spark, SF0001)
    args, kw = seen[0]
    assert make(*args, **kw).getStages()[1].getNumFeatures() == 1 << 18


def test_ranking(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(Q.MD, "train_models", stop(seen))
    with pytest.raises(Stop):
        Q.model_ranking(spark, SF0001)
    (_, _, names, task), kw = seen[0]
    made = {n: Q.MD.make_estimator(n, task, Q.MD.DataStats(10), **kw.get("overrides", {}).get(n, {})) for n in names}
    assert made["random_forest_regressor"].getNumTrees() == 100 and made["gbt_regressor"].getMaxIter() == 100
    plain = {n: Q.MD.make_estimator(n, task, Q.MD.DataStats(10)) for n in names}
    assert all(made[n].getMaxDepth() >= plain[n].getMaxDepth() for n in names if hasattr(plain[n], "getMaxDepth"))
