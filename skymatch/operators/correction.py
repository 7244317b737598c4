"""Flux corrections: galactic reddening of targets, and projection of neighbours into a target's colour space."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.photometry import ebv_factor, error, flux, ratio, reddening_factor, shift_factor


def resampled(grid: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """y over another grid, linear between knots and 0 outside them."""
    return np.interp(grid, x, y, left=0.0, right=0.0)


def band_coefficient(extinction: np.ndarray, filter_: np.ndarray, sed: np.ndarray, ebv: float = 0.02) -> float:
    """K of a band: how much a spectrum seen through a filter dims under an extinction curve, for a small E(B-V). Arguments are arrays [knots, 2]."""
    grid = extinction[:, 0]
    seen = resampled(grid, *filter_.T) * resampled(grid, *sed.T)
    whole = np.trapezoid(seen, grid)
    if whole <= 0:
        raise ValueError("the filter and the spectrum don't meet within the extinction curve")
    return float(-2.5 * np.log10(np.trapezoid(seen * 10 ** (-0.4 * extinction[:, 1] * ebv), grid) / whole) / ebv)


def dereddened(df: DataFrame, coefficients: dict[str, float], ebv: str = "ebv") -> DataFrame:
    """Fluxes as they would be without dust; errors stay."""
    return df.withColumns({f"f_{b}": flux(b) * reddening_factor(k, F.col(ebv)) for b, k in coefficients.items()})


def reddened(df: DataFrame, coefficients: dict[str, float], ebv: str = "ebv") -> DataFrame:
    return df.withColumns({f"f_{b}": flux(b) / reddening_factor(k, F.col(ebv)) for b, k in coefficients.items()})


def projected(pairs: DataFrame, bands: list[str], ebv: str | None = None, shifts: str | None = None, shifted: list[str] | None = None) -> DataFrame:
    """Fluxes and errors of neighbours (n_*) in the target's colour space: E(B-V) first, then filter shifts.

    Corrections stand in ref_ebv_<band>, ref_c0_<band>, ref_c1_<band>; missing ones and nulls correct nothing. shifts: a struct column; only bands in `shifted` (default: its fields) are shifted.
    """
    if ebv:
        made = {}
        for b in bands:
            c = F.coalesce(F.col(f"ref_ebv_{b}").cast("double"), F.lit(0.0)) if f"ref_ebv_{b}" in pairs.columns else F.lit(0.0)
            k = ebv_factor(c, F.col(ebv))
            made |= {f"n_f_{b}": flux(b, "n_") * k, f"n_e_{b}": error(b, "n_") * k}
        pairs = pairs.withColumns(made)
    if shifts:
        fields = pairs.schema[shifts].dataType.names
        made = {}
        for b in [b for b in (shifted or fields) if b in fields and b in bands]:
            c0, c1 = (F.coalesce(F.col(f"ref_{c}_{b}").cast("double"), F.lit(0.0)) if f"ref_{c}_{b}" in pairs.columns else F.lit(0.0) for c in ("c0", "c1"))
            k = shift_factor(c0, c1, F.col(f"{shifts}.{b}"))
            made |= {f"n_f_{b}": flux(b, "n_") * k, f"n_e_{b}": error(b, "n_") * k}
        pairs = pairs.withColumns(made)
    return pairs


def uniform_photometry(pairs: DataFrame, wanted: dict[str, tuple[str, str]], weight: str = "weight", rest: str = "rest_f_", with_errors: bool = False) -> DataFrame:
    """For each output (band made, band observed): the observed flux times the weighted mean ratio of the neighbours' rest-frame flux in the made band to their flux, in the target's
    colour space, in the observed band. Errors are 0 unless with_errors scales the observed ones alike."""
    w = F.col(weight)
    total = F.sum(w)
    aggs: list[Column] = []
    for name, (made, seen) in wanted.items():
        mean = F.try_divide(F.sum(w * ratio(F.col(f"{rest}{made}"), flux(seen, "n_"), 0.0)), total)
        aggs.append((F.first(flux(seen)) * F.coalesce(mean, F.lit(0.0))).alias(f"{name}_corr"))
        aggs.append(((F.first(error(seen)) * F.coalesce(mean, F.lit(0.0))) if with_errors else F.lit(0.0)).alias(f"{name}_corr_err"))
    return pairs.groupBy("target_id").agg(*aggs)
