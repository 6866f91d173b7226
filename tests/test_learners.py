"""Calibration and the queries whose results SQL can't give: planted data, properties, and the same result twice."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.operators import learners as ln
from panelloom.plans import features, models

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def pav(values, weights):
    blocks = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.repeat([b[0] for b in blocks], [b[2] for b in blocks])


def test_venn_abers_against_two_whole_fits():
    pick = np.random.default_rng(5)
    for size in (0, 1, 2, 7, 40, 200):
        scores = np.unique(np.round(pick.random(size), 3))
        n = pick.integers(1, 6, len(scores)).astype(float)
        pos = pick.binomial(n.astype(int), scores * 0.8 + 0.1).astype(float)
        asked = np.unique(np.concatenate([scores[::3], np.round(pick.random(30), 3)]))
        got = ln.joined_once(scores, pos, n, asked)
        for s, p in zip(asked, got, strict=True):
            for y in (0.0, 1.0):
                cell = {x: [a, b] for x, a, b in zip(scores, pos, n, strict=True)}
                cell.setdefault(s, [0.0, 0.0])
                cell[s] = [cell[s][0] + y, cell[s][1] + 1]
                at = sorted(cell)
                fit = pav([cell[x][0] / cell[x][1] for x in at], [cell[x][1] for x in at])
                assert abs(p[int(y)] - fit[at.index(s)]) < 1e-9


def test_venn_abers_lies_between_its_two_fits(spark):
    pick = np.random.default_rng(6)
    p = pick.random(800)
    rows = spark.createDataFrame([(int(i % 2), float(a), int(pick.random() < a)) for i, a in enumerate(p)], "horizon int, y_prob double, y_true int")
    got = ln.venn_abers(rows.filter("y_prob < 0.9"), rows).collect()
    assert len(got) == rows.select("horizon", F.round(F.col("y_prob") * 10_000)).distinct().count()
    assert all(0 < r.p < 1 for r in got) and np.corrcoef([r.score for r in got], [r.p for r in got])[0, 1] > 0.9


def test_platt_finds_planted_coefficients(spark):
    pick = np.random.default_rng(7)
    z = pick.normal(0, 2, 8000)
    y = pick.random(8000) < 1 / (1 + np.exp(-(0.4 + 0.6 * z)))
    rows = spark.createDataFrame([(1, float(1 / (1 + np.exp(-a))), int(b)) for a, b in zip(z, y, strict=True)] + [(2, 0.3, 0), (2, 0.6, 0)], "horizon int, y_prob double, y_true int")
    got = ln.platt(rows).collect()
    assert [r.horizon for r in got] == [1]  # one class only: none for 2
    assert abs(got[0].a - 0.4) < 0.1 and abs(got[0].b - 0.6) < 0.06


@tables
@pytest.mark.parametrize("name", ["fit_logistic", "fit_linear", "fit_poisson", "fit_tweedie", "fit_gbt_log", "fit_gbt_classifier", "fit_self_paced_ensemble"])
def test_learners_beat_a_constant(spark, name):
    """On the rows after the training end: probabilities lie in 0..1, and forecasts are no worse than zero everywhere."""
    got = models.QUERIES[name](spark, SF)
    if "y_prob" in got.columns:
        r = got.agg(F.min("y_prob").alias("a"), F.max("y_prob").alias("b"), F.count("*").alias("n"), F.countDistinct("y_prob").alias("k")).first()
        assert 0 <= r.a < r.b <= 1 and r.n > 10_000 and r.k > 2
    else:
        y, p = F.col("label"), F.col("y_pred")
        got = got.filter("label > 0") if name == "fit_tweedie" else got  # the count head speaks of active days
        r = got.agg(F.avg((y - p) * (y - p)).alias("e"), F.avg(y * y).alias("zero"), F.count("*").alias("n")).first()
        assert r.n > 100 and r.e <= r.zero


@tables
def test_imputed_medians_and_noise(spark):
    """No nulls are left; noise with a seed is the same twice, and centred on the column."""
    assert models.QUERIES["prep_impute_median"](spark, SF).filter("lag_14_filled IS NULL").count() == 0
    for name in ("dummy_noise", "dummy_noise_by_day"):
        a, b = (sorted(map(str, features.QUERIES[name](spark, SF).collect())) for _ in range(2))
        assert a == b and len(a) > 0


@tables
def test_calibrated_probabilities(spark):
    """Isotonic steps rise with the raw probability in each horizon; out-of-fold values lie in 0..1 and cover every row once."""
    raw = models._preds(spark, SF).select("region", "fold", "horizon", "y_prob")
    iso = models.QUERIES["cal_isotonic_fit"](spark, SF).join(raw, ["region", "fold", "horizon"]).collect()
    for h in range(1, 8):
        pairs = sorted((r.y_prob, r.y_cal) for r in iso if r.horizon == h)
        assert pairs and all(x[1] <= y[1] + 1e-12 for x, y in zip(pairs, pairs[1:]))
    cut = models._cv_test(spark, SF)[0].count()
    r = models.QUERIES["cal_out_of_fold"](spark, SF).agg(F.count("*").alias("n"), F.min("y_cal").alias("a"), F.max("y_cal").alias("b")).first()
    assert r.n == cut and 0 <= r.a <= r.b <= 1


@tables
def test_importances(spark):
    """Gains of each horizon sum to one; the tables built on them agree."""
    gains = models._importances(spark, SF, horizons=(1, 7))
    totals = gains.groupBy("horizon").agg(F.sum("gain").alias("g")).collect()
    assert sorted(r.horizon for r in totals) == [1, 7] and all(abs(r.g - 1) < 1e-6 or r.g == 0 for r in totals)
    drops = models.QUERIES["importance_permutation"](spark, SF).collect()
    assert {(r.feature, r.horizon) for r in drops} == {(c, h) for c in models.COLUMNS for h in ln.HORIZONS}


@tables
def test_multi_target_and_search(spark):
    got = models.QUERIES["multi_target_backtest"](spark, SF).groupBy("target").agg(F.countDistinct("horizon").alias("h"), F.countDistinct("region").alias("r")).collect()
    assert len(got) == 5 and all((r.h, r.r) == (7, 25) for r in got)
    trials = models.tune_random_search(spark, SF, trials=6).collect()
    assert sorted(r.number for r in trials) == list(range(6)) and all(r.value > 0 for r in trials)
