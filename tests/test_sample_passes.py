"""Form and serve share their lags, and calibration scores the validation rows once."""

from boutlog import registry
from boutlog.operators import history
from boutlog.plans import models

SF = "/root/testdata/sf0.001"


def test_form_and_serve_share_lags(spark):
    view = history.player_view(registry.matches_of(spark, SF))
    one, two = history.with_form_and_serve(view), history.with_serve(history.with_form(view))
    assert one.columns == two.columns
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0
    lags = history.baseline(registry.matches_of(spark, SF))._jdf.queryExecution().optimizedPlan().toString().count("lag(_v")
    assert lags == 10


def test_calibration_scores_validation_once(spark, monkeypatch):
    kept, real = [], models.stored
    monkeypatch.setattr(models, "stored", lambda df: kept.append(df) or real(df))
    train, val, test = registry._parts(registry.matches_of(spark, SF))
    out = models.platt(models.fit(train, models.forest(2, 2)), val, test)
    assert len(kept) == 1 and kept[0].columns == ["y", "_z"]
    assert out.count() == test.count()
