"""Same-day merging of passes and per-lake statistics: the lake time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroseries.config import QualityConfig
from hydroseries.operators.mosaic import weight
from hydroseries.operators.quality import apply_quality
from hydroseries.operators.selection import beside, percentiles
from hydroseries.sources.shared import write_shared

DAY = ["lake_id", "obs_date"]
CELL = ["cell_row", "cell_col"]
MAD_SCALE = 1.482
#: Sigmas from here on carry no information.
SIGMA_LIMIT = 1000.0


def merge_same_day(pixels: DataFrame, source: str = "group_id") -> DataFrame:
    """One row for each lake, date and cell: inverse-variance wse and sigma, and the mean water_frac where wse is there, as floats.

    A lake and date seen once pass through. pixels is read once: see pass_cells.
    """
    return _merged(write_shared(pass_cells(pixels, source), "pass_cells"))


def pass_cells(pixels: DataFrame, source: str = "group_id") -> DataFrame:
    """What each source says of each lake, date and cell: five sums, and a value to pass through. Each task sums its own rows before the shuffle."""
    v, w = F.col("wse"), weight()
    frac = F.when(v.isNotNull(), F.col("water_frac"))
    sums = {"wv": F.sum(v * w), "w": F.sum(w), "f": F.sum(frac), "nf": F.count(frac), "n": F.count("wse")}
    own = {f"own_{c}": F.min(c) for c in ("wse", "wse_uncert", "water_frac")}
    return pixels.groupBy(*DAY, *CELL, F.col(source).alias("source")).agg(*[a.alias(name) for name, a in (sums | own).items()])


def enough_in_pass(cells: DataFrame, least: int) -> DataFrame:
    """pass_cells of those passes over a lake that have at least so many valid cells."""
    passes = cells.groupBy(*DAY, "source").agg(F.sum("n").alias("_n")).where(F.col("_n") >= least)
    return beside(cells, passes.drop("_n"), [*DAY, "source"], "left_semi")


def _merged(cells: DataFrame) -> DataFrame:
    """cells: see pass_cells. The sources of a day are a table of one row a day, so a day of very many cells is in no one task."""
    seen = cells.groupBy(*DAY).agg(F.array_sort(F.collect_set("source")).alias("_seen"))
    told = F.col("source").isNotNull()
    own = {c: F.min(F.when(told, F.col(f"own_{c}"))) for c in ("wse", "wse_uncert", "water_frac")}
    met = cells.groupBy(*DAY, *CELL).agg(
        F.try_divide(F.sum("wv"), F.sum("w")).alias("m_wse"), F.try_divide(F.lit(1.0), F.sqrt(F.sum("w"))).alias("m_wse_uncert"), F.try_divide(F.sum("f"), F.sum("nf")).alias("m_water_frac"), *[a.alias(f"s_{c}") for c, a in own.items()]
    )
    both = beside(met, seen, DAY)
    alone = F.size("_seen") == 1
    picked = [F.when(alone, F.col(f"s_{c}")).otherwise(F.col(f"m_{c}")).cast("float").alias(c) for c in own]
    return both.select(*DAY, *CELL, *picked, F.size("_seen").cast("bigint").alias("n_sources"), F.array_join(F.filter("_seen", lambda x: x != ""), ",").alias("sources"))


def lake_statistics(pixels: DataFrame, keys: list[str] = DAY, others: tuple[str, ...] = ()) -> DataFrame:
    """wse, wse_med, wse_std, wse_uncert and valid_pixels for each key, and any value of the columns others.

    With pixels whose 0 < sigma < SIGMA_LIMIT, wse is their inverse-variance mean and wse_std their population deviation; else wse is
    the median and wse_uncert MAD_SCALE times the median absolute deviation, which is worked out for such keys only. Sums are partial in each
    task, and medians are selected (see selection), so a key may have any number of pixels. pixels is read several times.
    """
    v = F.col("wse").cast("double")
    sigma = F.col("wse_uncert").cast("double")
    good = F.col("wse").isNotNull() & (sigma > 0) & (sigma < SIGMA_LIMIT)
    w = F.when(good, 1.0 / (sigma * sigma))
    sums = pixels.groupBy(*keys).agg(
        F.stddev_pop(v).alias("_std_all"), F.stddev_pop(F.when(good, v)).alias("_std_good"), F.sum(v * w).alias("_wv"), F.sum(w).alias("_w"), F.count("wse").alias("valid_pixels"), *[F.max(c).alias(c) for c in others]
    )
    known = write_shared(beside(sums, percentiles(pixels, keys, v, {"wse_med": 0.5}), keys, "left"), "statistics")
    weighted = F.col("_w").isNotNull()
    unsure = beside(pixels.select(*keys, v.alias("_v")), known.where(~weighted).select(*keys, "wse_med"), keys)
    both = beside(known, percentiles(unsure, keys, F.abs(F.col("_v") - F.col("wse_med")), {"_mad": 0.5}), keys, "left")
    return both.select(
        *keys, F.when(weighted, F.try_divide("_wv", "_w")).otherwise(F.col("wse_med")).alias("wse"), "wse_med",
        F.when(weighted, F.col("_std_good")).otherwise(F.col("_std_all")).alias("wse_std"),
        F.when(weighted, F.sqrt(F.try_divide(F.lit(1.0), F.col("_w")))).otherwise(MAD_SCALE * F.col("_mad")).alias("wse_uncert"), "valid_pixels", *others,
    )


def water_area(pixels: DataFrame, keys: list[str] = DAY, res_x: float = 100.0, res_y: float = 100.0) -> DataFrame:
    return pixels.groupBy(*keys).agg((F.count("wse") * (abs(res_x) * abs(res_y))).alias("water_area"))


def day_series(day: DataFrame, res_x: float = 100.0, res_y: float = 100.0) -> DataFrame:
    """Same-day cells (see merge_same_day) to one row a lake and date that has valid pixels."""
    stats = lake_statistics(day, others=("sources",)).where("valid_pixels > 0")
    return stats.select("lake_id", F.col("obs_date").alias("date"), "wse", "wse_med", "wse_std", "wse_uncert", (F.col("valid_pixels") * (abs(res_x) * abs(res_y))).alias("water_area"), "valid_pixels", F.col("sources").alias("granule_id"))


def lake_timeseries(pixels: DataFrame, cfg: QualityConfig = QualityConfig(), res_x: float = 100.0, res_y: float = 100.0) -> DataFrame:
    """Raw lake pixels (NULL is no data) to one row a lake and date.

    Quality control and the sums of each pass in one scan, whose cells are written once; then the gate on valid pixels of each pass, the
    same-day merge, and its statistics.
    """
    clean = apply_quality(pixels, cfg).select(*DAY, "group_id", *CELL, "wse", "wse_uncert", "water_frac")
    if cfg.min_valid_pixels > 0:
        clean = clean.where(F.col("wse").isNotNull())  # a pass needs valid pixels, and other cells have no say in statistics
    cells = write_shared(pass_cells(clean), "pass_cells")
    return day_series(write_shared(_merged(enough_in_pass(cells, cfg.min_valid_pixels)), "day_cells"), res_x, res_y)


def summarise(series: DataFrame) -> DataFrame:
    """One row: how many observations and lakes, and the first and last date."""
    return series.agg(F.count(F.lit(1)).alias("total_observations"), F.count_distinct("lake_id").alias("n_lakes"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))

