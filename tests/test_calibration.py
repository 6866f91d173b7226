"""Calibration in the folds of a backtest, out of fold and isotonic: against plain versions and on planted data."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_learners import pav

from panelloom.operators import calibration as cal
from panelloom.operators import expanding as ex
from panelloom.plans import models

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def forecasts(spark, steps=160, horizons=(1, 3), later=0, seed=2):
    """Overconfident forecasts of two regions; with ``later`` what happens from that step on is another matter."""
    pick, rows = np.random.default_rng(seed), []
    truth = {(r, t): pick.random() for r in "ab" for t in range(steps + 10)}
    for r in "ab":
        for t0 in range(40, steps):
            for h in horizons:
                z = pick.normal(0, 2)
                y = int(truth[r, t0 + h - 1] < 1 / (1 + np.exp(-(0.3 + 0.4 * z))))
                rows.append((r, t0, h, 1 - y if later and t0 + h - 1 >= later else y, float(1 / (1 + np.exp(-z))), 1.0))
    return spark.createDataFrame(rows, "region string, t0 int, horizon int, y_true int, y_prob double, y_count double")


def test_nothing_after_t0_changes_a_calibrated_value(spark):
    cut, got = 120, []
    for later in (0, cut):
        found = cal.in_folds(forecasts(spark, later=later), 40, retrain=20).filter(F.col("t0") <= cut).collect()
        got.append({(r.region, r.t0, r.horizon): (round(r.y_sigmoid, 9), round(r.y_venn, 9)) for r in found})
    assert got[0] == got[1] and len(got[0]) == 2 * 2 * 81


def test_the_first_refit_passes_raw_and_later_ones_are_better(spark):
    found = cal.in_folds(forecasts(spark), 40, retrain=30).collect()
    first = [r for r in found if r.t0 < 70]
    assert first and all(r.y_sigmoid == r.y_prob == r.y_venn for r in first)
    late = [r for r in found if r.t0 >= 100]
    brier = lambda c: sum((r[c] - r.y_true) ** 2 for r in late) / len(late)
    assert brier("y_sigmoid") < brier("y_prob") and brier("y_venn") < brier("y_prob")


def test_a_refit_s_sigmoid_is_a_fit_on_what_was_known(spark):
    rows = forecasts(spark).collect()
    found = ex.expanding_backtest(forecasts(spark), cal.sigmoid(), 40, (), 25, first=40).filter("horizon = 3").collect()
    for r in found[::17]:
        cut = 40 + (r.t0 - 40) // 25 * 25
        known = [x for x in rows if x.horizon == 3 and x.t0 + 2 < cut]
        if len({x.y_true for x in known}) < 2:
            assert r.y_sigmoid == r.y_prob
            continue
        x, y, beta = np.array([[1, np.log(k.y_prob / (1 - k.y_prob))] for k in known]), np.array([k.y_true for k in known]), np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2), x.T @ (y - p) - 1e-4 * beta)
        want = 1 / (1 + np.exp(-(beta[0] + beta[1] * np.log(r.y_prob / (1 - r.y_prob)))))
        assert abs(r.y_sigmoid - want) < 1e-6


@pytest.mark.parametrize("label", [0, 1])
def test_a_fit_of_one_class_passes_raw(spark, label):
    """The highest score joined to a fit without a positive would come out at one half."""
    rows = forecasts(spark).withColumn("y_true", F.lit(label))
    found = cal.in_folds(rows, 40, retrain=20).collect()
    assert len(found) == 2 * 2 * 120 and all(r.y_venn == r.y_prob == r.y_sigmoid for r in found)


# --- out of fold ---


def labelled(spark, sizes, seed=1):
    pick = np.random.default_rng(seed)
    rows = [(k, i, int(y), float(pick.random()), int(i % 7)) for k, (neg, pos) in sizes.items() for i, y in enumerate([0] * neg + [1] * pos)]
    return spark.createDataFrame(rows, "k string, i int, y_true int, y_prob double, g int").repartition(6)


def test_class_counts_of_folds_differ_by_one_at_most(spark):
    sizes = {"many": (203, 58), "three": (50, 3), "one": (9, 1), "none": (12, 0)}
    got = cal.stratified(labelled(spark, sizes), ["k"], "y_true").collect()
    assert len(got) == sum(map(sum, sizes.values()))
    for k, folds in {"many": 5, "three": 3, "one": 0, "none": 0}.items():
        own = [r for r in got if r.k == k]
        assert {r.folds for r in own} == {folds} and {r.part for r in own} == set(range(max(folds, 1)))
        for y in (0, 1):
            held = Counter(r.part for r in own if r.y_true == y)
            if held and folds:
                counts = [held[p] for p in range(folds)]
                assert max(counts) - min(counts) <= 1


def test_groups_stay_together(spark):
    got = cal.stratified(labelled(spark, {"a": (90, 30)}), ["k"], "y_true", group="g").collect()
    assert len(got) == 120 and all(len({r.part for r in got if r.g == g}) == 1 for g in range(7))


def test_out_of_fold_values_come_from_the_other_folds(spark):
    got = cal.out_of_fold(labelled(spark, {"a": (60, 41), "b": (30, 1)}), ["k"]).collect()
    assert len(got) == 132
    x = lambda rows: np.array([[1, np.log(r.y_prob / (1 - r.y_prob))] for r in rows])
    for k, part in (("a", 0), ("a", 4), ("b", 0)):
        own = [r for r in got if r.k == k]
        train = [r for r in own if r.part != part] if k == "a" else own  # under two of a class: on all rows
        y, beta = np.array([r.y_true for r in train]), np.zeros(2)
        for _ in range(60):
            p = 1 / (1 + np.exp(-x(train) @ beta))
            beta += np.linalg.solve((x(train) * (p * (1 - p))[:, None]).T @ x(train) + 1e-4 * np.eye(2), x(train).T @ (y - p) - 1e-4 * beta)
        for r in [r for r in own if r.part == part]:
            assert abs(r.y_cal - 1 / (1 + np.exp(-(x([r]) @ beta)[0]))) < 1e-4


# --- isotonic ---


def plain_isotonic(pairs):
    """Pool adjacent violators over distinct scores; corners at the first and the last score of each step."""
    cells = {}
    for s, y in pairs:
        cells.setdefault(s, [0, 0])
        cells[s][0] += y
        cells[s][1] += 1
    at = sorted(cells)
    fit = pav([cells[s][0] / cells[s][1] for s in at], [cells[s][1] for s in at])
    return at, fit


@pytest.mark.parametrize("blocks", [500_000, 0])
def test_isotonic_steps_and_values(spark, monkeypatch, blocks):
    monkeypatch.setattr(cal, "BLOCKS", blocks)
    pick = np.random.default_rng(9)
    rows = []
    for k, digits, n in (("ties", 1, 400), ("fine", 6, 900), ("small", 3, 4), ("flat", 2, 50)):
        for s in np.round(pick.random(n), digits):
            rows.append((k, float(s), 0 if k == "flat" else int(pick.random() < s * s)))
    frame = spark.createDataFrame(rows, "k string, y_prob double, y_true int").repartition(7)
    asked = spark.createDataFrame([(k, float(p)) for k in ("ties", "fine", "small", "flat", "unseen") for p in np.linspace(0, 1, 41)], "k string, y_prob double")
    steps = cal.isotonic(frame, ["k"])
    got = {(r.k, r.y_prob): r.y_cal for r in cal.stepped(asked, steps, ["k"]).collect()}
    assert len(got) == 5 * 41
    for k in ("ties", "fine", "small", "flat"):
        at, fit = plain_isotonic([(s, y) for kk, s, y in rows if kk == k])
        for p in np.linspace(0, 1, 41):
            assert abs(got[k, float(p)] - np.interp(p, at, fit)) < 1e-9, (k, p)
    assert all(got["unseen", float(p)] == p for p in np.linspace(0, 1, 41))
    assert cal.isotonic(frame.limit(0), ["k"]).count() == 0


@tables
def test_calibrated_hurdle_of_three_regimes(spark):
    got = models.QUERIES["hurdle_calibrated"](spark, SF).toPandas()
    whole = got[got.horizon.isna()].set_index(["regime", "method"])
    assert len(whole) == 9 and len(got) == 9 * 8 and set(whole.index.get_level_values(0)) == {"global", "activity", "local"}
    for regime in ("global", "activity", "local"):
        raw = whole.loc[regime, "raw"].brier
        for method in ("sigmoid", "venn_abers"):
            assert whole.loc[regime, method].brier <= raw + 2e-3


@tables
def test_leaderboards_of_trained_models(spark):
    every = models.QUERIES["leaderboard_trained"](spark, SF).toPandas()
    board = every[every.region.isna() & every.horizon.isna()]
    assert len(every) == len(board) * (1 + 7 + 25)
    assert len(board) == 3 * 5 + 3 and sorted(board.place)[0] == 1 and board.MASE_mean.notna().all()
    probable = board.model.str.startswith("hurdle")
    assert board[probable].pr_auc.notna().all() and board[~probable].pr_auc.isna().all()
    assert board.set_index("model").loc["weekly"].RMSE > board[board.model == "linear"].RMSE.min()
    parts = models.QUERIES["component_summary_trained"](spark, SF).toPandas()
    assert set(parts.component) == {"count", *(f"{a}_{b}" for a in ("classifier", "hurdle") for b in ("raw", "sigmoid", "venn"))} and len(parts) == 7 * 3
