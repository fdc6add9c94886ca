"""Fits as rounds of aggregates, held against one process that fits one lake."""

import math

import numpy as np
import plain_fits
import pytest
from pyspark.sql import functions as F

from hydroseries.config import CurveConfig
from hydroseries.operators import curve, fitting
from hydroseries.operators.models import MODELS, Model

SHAPES = {"linear": (3.0, -14000.0), "quadratic": (0.4, -3800.0, 9030000.0), "power": (2.0, 1.6, 4798.0), "exponential": (3.0, 0.3, 4800.0), "logarithmic": (4.0, 4798.5, 2.0)}


def lakes_of_each_model(noise=0.004, n=60):
    rng = np.random.default_rng(2)
    out = {}
    for name, p in SHAPES.items():
        h = rng.uniform(4800, 4806, n)
        a = plain_fits.predict(name, h, p)
        out[name] = (h, a + noise * np.ptp(a) * rng.standard_normal(n), rng.uniform(0.05, 0.3, n))
    return out


def table(spark, lakes):
    rows = [(k, float(x), float(y), float(z)) for k, (h, a, s) in lakes.items() for x, y, z in zip(h, a, s, strict=True)]
    return spark.createDataFrame(rows, "lake_id string, wse double, area double, sigma double")


def test_equal_to_plain_fits(spark):
    """Each lake is made by one model; that model's fit is well determined, and is the plain one's. So are all direct fits and all figures."""
    lakes = lakes_of_each_model()
    got = {r.lake_id: r.models for r in curve.fit_models(table(spark, lakes).repartition(3)).collect()}
    assert set(got) == set(lakes)
    for lake, (h, a, s) in lakes.items():
        for m, want in zip(got[lake], plain_fits.fit_lake(h, a, s, CurveConfig()), strict=True):
            name, params, errors, r2, bic, rmse, monotonic, fitted, idx = want
            assert (m.function_type, m.reg_idx, m.fitted) == (name, idx, fitted) and len(m.params) == len(m.param_errors) == len(params)
            weighed = lambda p, name=name, h=h, a=a, s=s: float((((a - plain_fits.predict(name, h, p)) / s) ** 2).sum())
            assert weighed(m.params) <= weighed(params) * (1 + 1e-6)  # never worse
            if name in (lake, "linear", "quadratic"):
                grid = np.linspace(h.min(), h.max(), 50)
                mine, theirs = (plain_fits.predict(name, grid, p) for p in (m.params, params))
                assert np.allclose(mine, theirs, rtol=0, atol=1e-6 * np.ptp(theirs))
                assert m.r_squared == pytest.approx(r2, abs=1e-6) and m.bic == pytest.approx(bic, abs=1e-3) and m.rmse == pytest.approx(rmse, rel=1e-6) and m.monotonic == monotonic
                if name == "exponential":
                    assert m.params[1] == pytest.approx(params[1], rel=1e-6)  # its other two make up for each other
                else:
                    assert np.allclose(m.params, params, rtol=1e-5)
                    assert np.allclose(m.param_errors, errors, rtol=1e-3)


def test_no_lake_is_one_task(spark, monkeypatch):
    """The rounds and the figures are aggregates with partial sums below their exchange: no grouped Python task over points, and converged fits leave."""
    plans, open_, write = [], [], fitting.write_shared

    def seen(df, name):
        out = write(df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        open_.append(out.where("not done").count())
        return out

    monkeypatch.setattr(fitting, "write_shared", seen)
    curve.fit_models(table(spark, lakes_of_each_model())).collect()
    assert open_[0] == 25 and open_[-1] == 0 and open_ == sorted(open_, reverse=True) and len(open_) < 60
    assert all("FlatMapGroups" not in p for p in plans) and all("partial_sum" in p for p in plans[1:])


def test_degenerate_lakes(spark):
    h = np.array([1.0, 2.0, 3.0])
    lakes = {"one": (h[:1], h[:1], h[:1]), "two": (h[:2], h[:2], h[:2]), "same": (np.full(5, 4.0), np.arange(5.0), np.ones(5)), "flat": (np.arange(1.0, 9.0), np.full(8, 5.0), np.ones(8)), "exact": (np.arange(1.0, 9.0), 2 * np.arange(1.0, 9.0), np.ones(8))}
    bad = spark.createDataFrame([("flat", float("nan"), 1.0, 1.0), ("flat", 3.0, None, 1.0), ("flat", 3.0, 1.0, 0.0), (None, 3.0, 1.0, 1.0), ("flat", float("inf"), 1.0, 1.0)], "lake_id string, wse double, area double, sigma double")
    got = {r.lake_id: {m.function_type: m for m in r.models} for r in curve.fit_models(table(spark, lakes).unionByName(bad)).collect()}
    assert set(got) == set(lakes) and not any(m.fitted for m in got["one"].values())
    assert all(m.params == [] and m.bic == math.inf and not m.monotonic for m in got["one"].values())
    assert not got["same"]["linear"].fitted and not got["two"]["quadratic"].fitted and got["two"]["linear"].params == pytest.approx([1, 0], abs=1e-9)
    assert got["flat"]["linear"].r_squared == 0.0 and got["exact"]["linear"].bic == -math.inf and got["exact"]["linear"].r_squared == 1.0
    assert curve.fit_models(bad.limit(0)).count() == 0


def test_a_sixth_model_can_win(spark):
    """A caller's own model, without slopes: a wave on a slope."""
    wave = Model("wave", lambda h, t: [F.sin(t[0] * h), h, F.lit(1.0)], 3, lambda e: [3.1], 1)
    h = np.linspace(1, 12, 80)
    a = 2 * np.sin(3 * h) + 8 * h + 1
    series = spark.createDataFrame([("1", float(x), 0.1, float(y) * 1e6) for x, y in zip(h, a, strict=True)], "lake_id string, wse double, wse_uncert double, water_area double")
    row = curve.area_level_curves(series, models=(*MODELS, wave)).first()
    assert row.function_type == "wave" and np.allclose(eval(row.params_json), [2, 8, 1, 3], atol=1e-5) and len(row.candidates) == 6
    drawn = curve.plot_series(series, curve.area_level_curves(series, models=(*MODELS, wave)), n=5, models=(*MODELS, wave)).where("kind = 'curve'").collect()
    assert all(r.area == pytest.approx(2 * math.sin(3 * r.wse) + 8 * r.wse + 1, abs=1e-4) for r in drawn)
    assert curve.area_level_curves(series).first().function_type != "wave"


def test_rounds_go_over_levels(spark, monkeypatch):
    """Many points on few levels: points are summed once, rounds see one row a lake and level, and the fits and figures are those of all points."""
    rng = np.random.default_rng(5)
    h = rng.integers(0, 30, 3000) / 5 + 4800
    a = plain_fits.predict("quadratic", h, SHAPES["quadratic"])
    lake = (h, a + 0.05 * np.ptp(a) * rng.standard_normal(len(h)), rng.uniform(0.05, 0.3, len(h)))
    seen, fit = [], fitting.fit
    monkeypatch.setattr(fitting, "fit", lambda at, *more: seen.append(at.count()) or fit(at, *more))
    got = curve.fit_models(table(spark, {"a": lake, "b": lake}).repartition(3)).collect()
    assert seen == [60] and {r.lake_id for r in got} == {"a", "b"}
    for m, want in zip(got[0].models[:2], plain_fits.fit_lake(*lake, CurveConfig())[:2], strict=True):
        name, params, errors, r2, bic, rmse, *_ = want
        assert m.function_type == name and np.allclose(m.params, params, rtol=1e-5) and np.allclose(m.param_errors, errors, rtol=1e-3)
        assert m.r_squared == pytest.approx(r2, abs=1e-9) and m.bic == pytest.approx(bic, rel=1e-9) and m.rmse == pytest.approx(rmse, rel=1e-9)
