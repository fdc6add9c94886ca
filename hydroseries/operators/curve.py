"""Area against water level: outlier cleaning, weighted models (see models), choice by BIC, and grading.

All models are fitted as sums over a lake's points, in Spark's aggregates; the iterative ones take rounds of them (see fitting).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from hydroseries.config import NODATA, CurveConfig
from hydroseries.operators import fitting
from hydroseries.operators.models import MODELS, Model, by_model
from hydroseries.operators.selection import beside, percentiles
from hydroseries.sources.shared import write_shared

MONOTONE_SLACK = -1e-10
#: A residual sum below this share of the total one is round-off: the fit is exact.
EXACT = 1e-12


def curve_input(series: DataFrame) -> DataFrame:
    return series.where((F.col("wse") != NODATA) & F.col("wse").isNotNull() & ~F.isnan("wse") & (F.col("wse") > 0))


def iqr_clean(series: DataFrame, keys: list[str], value: str, cfg: CurveConfig = CurveConfig()) -> DataFrame:
    """Rows whose value is within the quartiles widened by iqr_factor times their distance; all rows where that is 0. A key may have any number of rows."""
    q = beside(series, percentiles(series, keys, F.col(value), {"_q1": 0.25, "_q3": 0.75}), keys)
    iqr = F.col("_q3") - F.col("_q1")
    inside = F.col(value).between(F.col("_q1") - cfg.iqr_factor * iqr, F.col("_q3") + cfg.iqr_factor * iqr)
    return q.where((iqr == 0) | inside).drop("_q1", "_q3")


def with_sigma(series: DataFrame, keys: list[str], uncert: str = "wse_uncert") -> DataFrame:
    """Adds sigma: the uncertainty, its median over the valid ones where it is not positive, 1 if none is."""
    ok = F.when((F.col(uncert) > 0) & ~F.isnan(uncert), F.col(uncert).cast("double"))
    middle = beside(series, percentiles(series, keys, ok, {"_middle": 0.5}), keys, "left")
    return middle.withColumn("sigma", F.coalesce(ok, "_middle", F.lit(1.0))).drop("_middle")


def fit_polynomials(points: DataFrame, keys: list[str], h: str = "wse", area: str = "area", sigma: str = "sigma") -> DataFrame:
    """Weighted line and parabola of each key, in powers of h centred at its mean: h_mean, l0, l1, q0, q1, q2. A singular system gives NULL.

    Both the centre and the sums around it are partial in each task.
    """
    centred = beside(points, points.groupBy(*keys).agg(F.avg(h).alias("h_mean")), keys)
    d, w, a = F.col(h) - F.col("h_mean"), 1.0 / (F.col(sigma) * F.col(sigma)), F.col(area)
    sums = centred.groupBy(*keys).agg(
        F.any_value("h_mean").alias("h_mean"), *[F.sum(w * F.pow(d, F.lit(float(p)))).alias(f"s{p}") for p in range(5)], *[F.sum(w * a * F.pow(d, F.lit(float(p)))).alias(f"t{p}") for p in range(3)], F.count(F.lit(1)).alias("n")
    )
    s, t = [F.col(f"s{p}") for p in range(5)], [F.col(f"t{p}") for p in range(3)]
    det2 = s[0] * s[2] - s[1] * s[1]

    def det3(m):
        (a, b, c), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    rows = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]
    whole = det3(rows)
    # Relative to the product of the diagonal, a determinant this small is round-off.
    fits2 = F.abs(det2) > 1e-12 * s[0] * s[2]
    fits3 = F.abs(whole) > 1e-12 * s[0] * s[2] * s[4]

    def swapped(k):
        return [[t[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]

    return sums.select(
        *keys, "n", "h_mean",
        F.when(fits2, (t[0] * s[2] - s[1] * t[1]) / det2).alias("l0"), F.when(fits2, (s[0] * t[1] - s[1] * t[0]) / det2).alias("l1"),
        *[F.when(fits3, det3(swapped(k)) / whole).alias(f"q{k}") for k in range(3)],
    )


def fit_metrics(points: DataFrame, keys: list[str], predicted: Column, n_params: int, area: str = "area") -> DataFrame:
    """n, rss, r_squared (0 without spread), bic and rmse of each key; all unweighted. No points give an infinite bic, no residual a negative one."""
    y = F.col(area)
    both = beside(points.withColumn("_p", predicted), points.groupBy(*keys).agg(F.avg(y).alias("_mean")), keys)
    sums = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum((y - F.col("_p")) * (y - F.col("_p"))).alias("rss"), F.sum((y - F.col("_mean")) * (y - F.col("_mean"))).alias("_tot"))
    n, rss = F.col("n"), F.col("rss")
    return sums.select(
        *keys, "n", "rss",
        F.when(F.col("_tot") == 0, 0.0).otherwise(1.0 - F.try_divide(rss, F.col("_tot"))).alias("r_squared"),
        F.when(n == 0, float("inf")).when(rss <= 0, float("-inf")).otherwise(n * F.ln(rss / n) + n_params * F.ln(n)).alias("bic"),
        F.sqrt(rss / n).alias("rmse"),
    )


def is_monotone(samples: Column) -> Column:
    """No step of an array of samples falls by more than the slack. The samples are gone through once, and written once in the plan."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(True).alias("ok"), F.lit(True).alias("first"))
    seen = F.aggregate(samples, start, lambda s, x: F.struct(x.alias("last"), (s["ok"] & (s["first"] | (x - s["last"] >= MONOTONE_SLACK))).alias("ok"), F.lit(False).alias("first")))
    return seen["ok"]


def curve_samples(low: Column, high: Column, curve, n: int = 200) -> Column:
    """curve(h) at n even levels from low to high."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: curve(low + (high - low) * i / F.lit(float(n - 1))))


def best_model(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """The candidate of least BIC among the monotone ones, else among all that were fitted; ties go by reg_idx."""
    order = W.partitionBy(*keys).orderBy(F.desc("fitted"), F.desc(F.col("fitted") & F.col("monotonic")), "bic", "reg_idx")
    return candidates.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def grade(r_squared: Column, n: Column, wse_range: Column, monotonic: Column) -> Column:
    return (
        F.when((r_squared > 0.7) & (n >= 5) & (wse_range > 1.0) & monotonic, "reliable").when((r_squared > 0.5) & (n >= 3) & monotonic, "acceptable").otherwise("unreliable")
    )


CANDIDATE = T.StructType([
    T.StructField("function_type", T.StringType()), T.StructField("params", T.ArrayType(T.DoubleType())), T.StructField("param_errors", T.ArrayType(T.DoubleType())),
    T.StructField("r_squared", T.DoubleType()), T.StructField("bic", T.DoubleType()), T.StructField("rmse", T.DoubleType()), T.StructField("monotonic", T.BooleanType()),
    T.StructField("fitted", T.BooleanType()), T.StructField("reg_idx", T.IntegerType()),
])


def fit_models(points: DataFrame, h: str = "wse", area: str = "area", sigma: str = "sigma", cfg: CurveConfig = CurveConfig(), models: Sequence[Model] = MODELS) -> DataFrame:
    """lake_id and models, an array of all candidates in the order of models, fitted or not.

    Points without a finite level, area or positive sigma are left out; a lake of fewer than two others gets no fit. Null lakes are left out.
    """
    finite = F.lit(True)
    for c in (h, area, sigma):
        finite = finite & (F.abs(F.col(c).cast("double")) < float("inf"))
    taken = points.where(finite & (F.col(sigma) > 0) & F.col("lake_id").isNotNull())
    rows = taken.select(F.col("lake_id").cast("string").alias("lake_id"), *[F.col(c).cast("double").alias(x) for c, x in ((h, "h"), (area, "a"), (sigma, "sigma"))])
    at = write_shared(fitting.levels(rows), "levels")  # points are read once; figures and all rounds are told from here
    n, h_, mean = F.col("n"), F.col("h"), F.col("a_mean")
    ends = [F.min("h").alias("h_min"), F.max("h").alias("h_max"), F.min("a_min").alias("a_min"), F.max("a_max").alias("a_max")]
    extents = write_shared(at.groupBy("lake_id").agg(*ends, (F.sum(n * h_) / F.sum("n")).alias("h_mean"), (F.sum(n * mean) / F.sum("n")).alias("a_mean"), F.sum("n").alias("n")), "extents")
    fits = write_shared(fitting.fit(at, extents.where("n >= 2"), models, cfg.max_evaluations), "fits")

    shown = at.withColumnRenamed("a_mean", "a").join(fits.join(extents.select("lake_id", "a_mean"), "lake_id").select("lake_id", "model", "params", "a_mean"), "lake_id")
    predicted = by_model(models, F.col("model"), lambda m: m.curve(F.col("params"), F.col("h")))
    off, spread = F.col("a") - predicted, F.col("a") - F.col("a_mean")
    sums = shown.groupBy("lake_id", "model").agg(F.sum(F.col("a_off") + n * off * off).alias("rss"), F.sum(F.col("a_off") + n * spread * spread).alias("total"))
    told = fits.join(sums, ["lake_id", "model"]).withColumn("rss", F.when(F.col("rss") <= EXACT * F.col("total"), 0.0).otherwise(F.col("rss")))

    every = extents.crossJoin(F.broadcast(_listed(points.sparkSession, models)))  # one row a model
    both = every.join(told, ["lake_id", "model"], "left")
    there, n, rss = F.col("rss").isNotNull(), F.col("n"), F.col("rss")
    samples = curve_samples(F.col("h_min"), F.col("h_max"), lambda x: by_model(models, F.col("model"), lambda m: m.curve(F.col("params"), x)), cfg.n_curve_samples)
    none, far = F.array().cast("array<double>"), F.lit(float("inf"))
    candidate = F.struct(
        F.col("name").alias("function_type"), F.coalesce("params", none).alias("params"), F.coalesce("param_errors", none).alias("param_errors"),
        F.when(F.col("total") == 0, 0.0).otherwise(1.0 - F.try_divide(rss, F.col("total"))).alias("r_squared"),
        F.when(~there, far).when(rss <= 0, -far).otherwise(n * F.ln(rss / n) + F.col("n_params") * F.ln(n.cast("double"))).alias("bic"),
        F.when(there, F.sqrt(rss / n)).otherwise(far).alias("rmse"), (there & F.coalesce(is_monotone(samples), F.lit(False))).alias("monotonic"), there.alias("fitted"), F.col("model").alias("reg_idx"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("model", candidate.alias("candidate"))))
    return both.groupBy("lake_id").agg(ordered.alias("all")).select("lake_id", F.transform("all", lambda m: m["candidate"]).cast(T.ArrayType(CANDIDATE)).alias("models"))


def _listed(spark, models: Sequence[Model]) -> DataFrame:
    return spark.createDataFrame([(i, m.name, m.n_params) for i, m in enumerate(models)], "model int, name string, n_params int")


def fit_candidates(points: DataFrame, h: str = "wse", area: str = "area", sigma: str = "sigma", cfg: CurveConfig = CurveConfig(), models: Sequence[Model] = MODELS) -> DataFrame:
    """lake_id and one candidate a row."""
    return fit_models(points, h, area, sigma, cfg, models).select("lake_id", F.explode("models").alias("m")).select("lake_id", "m.*")


def best_of(models: Column) -> Column:
    """best_model for an array of candidates: least BIC among the monotone ones, else among all fitted; ties go by reg_idx."""
    ranked = F.transform(models, lambda m: F.struct((~m["fitted"]).alias("a"), (~(m["fitted"] & m["monotonic"])).alias("b"), m["bic"].alias("c"), m["reg_idx"].alias("d"), m.alias("model")))
    return F.array_min(ranked)["model"]


def area_level_curves(series: DataFrame, cfg: CurveConfig = CurveConfig(), models: Sequence[Model] = MODELS) -> DataFrame:
    """One row a lake: n_obs, n_cleaned, the chosen function with its figures and grade, and all candidates. series: lake_id, wse, wse_uncert, water_area.

    The series is read once; its quartiles, the cleaned points and all rounds of the fits are told from tables that are written here.
    """
    keys = ["lake_id"]
    points = curve_input(series).select("lake_id", "wse", "wse_uncert", (F.col("water_area") / 1e6).alias("area"))
    points = write_shared(points.repartition(series.sparkSession.sparkContext.defaultParallelism), "series")  # evenly, for all passes
    clean = write_shared(with_sigma(iqr_clean(points, keys, "area", cfg), keys).select("lake_id", "wse", "area", "sigma"), "cleaned")
    counts = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cleaned"), (F.max("wse") - F.min("wse")).alias("wse_range"), (F.max("area") - F.min("area")).alias("area_range_km2"))
    counts = write_shared(beside(counts, points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_obs")), keys), "counts")
    enough = F.col("n_cleaned") >= cfg.min_cleaned_points
    many = beside(clean, counts.where(enough).select("lake_id"), keys, "left_semi")
    out = beside(counts, fit_models(many, cfg=cfg, models=models), keys, "left").withColumn("best", best_of(F.col("models")))
    best, there = F.col("best"), F.coalesce(F.col("best.fitted"), F.lit(False))
    told = [c for c in CANDIDATE.fieldNames() if c not in ("reg_idx", "fitted")]
    shown = F.transform("models", lambda m: F.struct(m["reg_idx"].alias("reg_idx"), *[m[c].alias(c) for c in told]))
    return out.select(
        "lake_id", "n_obs", "n_cleaned", F.when(there, best["function_type"]).otherwise("none").alias("function_type"),
        F.when(there, F.to_json(best["params"])).otherwise("{}").alias("params_json"), *[F.when(there, best[c]).alias(c) for c in ("r_squared", "bic", "rmse")],
        F.when(enough, F.col("wse_range")).otherwise(0.0).alias("wse_range"), F.when(enough, F.col("area_range_km2")).otherwise(0.0).alias("area_range_km2"),
        F.when(there, grade(best["r_squared"], F.col("n_cleaned"), F.col("wse_range"), best["monotonic"])).otherwise("unreliable").alias("quality"), shown.alias("candidates"),
    )


def run_summary(curves: DataFrame) -> DataFrame:
    """kind, value, n: lakes by each of the three grades and by function, most first."""
    spark = curves.sparkSession
    grades = spark.createDataFrame([("reliable",), ("acceptable",), ("unreliable",)], "value string")
    by_grade = grades.join(curves.groupBy(F.col("quality").alias("value")).count(), "value", "left").select(F.lit("quality").alias("kind"), "value", F.coalesce("count", F.lit(0)).alias("n"))
    by_function = curves.groupBy(F.col("function_type").alias("value")).count().select(F.lit("function").alias("kind"), "value", F.col("count").alias("n"))
    return by_grade.union(by_function).orderBy("kind", F.desc("n"), "value")


def curve_at(function: Column, p: Column, h: Column, models: Sequence[Model] = MODELS) -> Column:
    """The area of a chosen function at a level; p: its parameters."""
    out = F.lit(None).cast("double")
    for m in models:
        out = F.when(function == m.name, m.curve(p, h)).otherwise(out)
    return out


def plot_series(series: DataFrame, curves: DataFrame, cfg: CurveConfig = CurveConfig(), n: int = 300, models: Sequence[Model] = MODELS) -> DataFrame:
    """What a diagnostic plot of each lake shows: lake_id, kind (raw, cleaned or curve), wse, area (square kilometres), shown_sigma.

    shown_sigma, of cleaned points, is their sigma, but 1.5 % of the range of cleaned levels at least (of 1 if they have none). The curve has n even levels over that range.
    """
    keys = ["lake_id"]
    points = curve_input(series).withColumn("area", F.col("water_area") / 1e6)
    tidy = write_shared(with_sigma(iqr_clean(points, keys, "area", cfg), keys).select("lake_id", "wse", "area", "sigma"), "cleaned")
    ends = tidy.groupBy(*keys).agg(F.min("wse").alias("_low"), F.max("wse").alias("_high"))
    clean = beside(tidy, ends, keys)
    span = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    none = F.lit(None).cast("double")
    raw = points.select("lake_id", F.lit("raw").alias("kind"), "wse", "area", none.alias("shown_sigma"))
    cleaned = clean.select("lake_id", F.lit("cleaned").alias("kind"), "wse", "area", F.greatest("sigma", span * 0.015).alias("shown_sigma"))
    chosen = curves.where("function_type <> 'none'").select("lake_id", "function_type", F.from_json("params_json", "array<double>").alias("_p")).join(ends, keys)
    level = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_i") / F.lit(float(n - 1))
    drawn = chosen.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("wse", level)
    drawn = drawn.select("lake_id", F.lit("curve").alias("kind"), "wse", curve_at(F.col("function_type"), F.col("_p"), F.col("wse"), models).alias("area"), none.alias("shown_sigma"))
    return raw.unionByName(cleaned).unionByName(drawn)
