"""Thresholds of the water-surface pipeline. The defaults are fixed values that decide results."""

from __future__ import annotations

from dataclasses import dataclass

#: Fill values of the raster variables.
FLOAT_FILL = 9.96921e36
UINT8_FILL = 255
UINT32_FILL = 4294967295
NODATA = -9999.0
NODATA_BELOW = -9990.0
TARGET_SRID = 32646
LONLAT_SRID = 4326


@dataclass(frozen=True)
class QualityConfig:
    wse_qual_max: int = 2
    water_area_qual_max: int = 2
    cross_track_min: float = 10000.0
    water_frac_min: float = 0.0
    min_valid_pixels: int = 10
    wse_uncert_max: float = 2.0
    ice_valid: tuple[int, ...] = (0, -999, 255)
    skip_ice_filter: bool = True


@dataclass(frozen=True)
class FilterConfig:
    mad_k: float = 1.0
    max_half_range: float = 0.5
    min_pixels: int = 10


@dataclass(frozen=True)
class CurveConfig:
    iqr_factor: float = 1.5
    min_cleaned_points: int = 3
    n_curve_samples: int = 200
    max_evaluations: int = 10000


@dataclass(frozen=True)
class Config:
    quality: QualityConfig = QualityConfig()
    filter: FilterConfig = FilterConfig()
    curve: CurveConfig = CurveConfig()
