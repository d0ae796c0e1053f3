from tests.conftest import SF_SMALL
from wardline.operators import models, tune
from wardline.plans import catalog
from wardline.plans.readmission import prepare, prepare_folds


def test_prepare_is_a_partition_and_vectors_match_names(spark):
    p = prepare(spark, SF_SMALL)
    n_base = catalog.base(spark, SF_SMALL).count()
    tr, te = p.train.count(), p.test.count()
    assert tr + te == n_base
    assert p.train.join(p.test, "encounter_id").count() == 0
    names = [r["name"] for r in p.encoder.names(spark).orderBy("idx").collect()]
    assert p.train.first()["features"].size == len(names) == len(set(names)) == p.encoder.size


def test_cv_scores_shape(spark):
    enc = prepare_folds(spark, SF_SMALL, 3)
    configs = tune.draw_configs(spark, {"reg": ("logfloat", 1e-3, 1e-1)}, 2, 1)
    scores = tune.cv_scores(enc.df, configs, lambda c: models.logistic(max_iter=10).setRegParam(c["reg"]),
                            "f1", "resample", "encounter_id", "fold", 2, frame=enc.frame)
    rows = scores.collect()
    assert sorted((r["config"], r["fold"]) for r in rows) == [(c, f) for c in range(2) for f in range(3)]
    assert all(0.0 <= r["score"] <= 1.0 for r in rows)
    assert tune.best_config(scores).count() == 1
