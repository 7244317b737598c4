"""A run's parameters, typed. They come as keywords or JSON, never as code."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import MISSING, dataclass, field, fields

from ..operators import weights
from ..operators.knn import Search
from ..operators.montecarlo import AGGREGATES
from ..operators.scaling import Prior

#: name -> (method, distance) of a search; users add their own, with distances that they register.
METHODS = {"KDTree": ("kdtree", "euclidean"), "Combined": ("combined", "chi2"), "BruteForce": ("brute", "chi2")}

_CATALOG: Callable[[Config], object] = lambda c: c.target_catalog
_DUST: Callable[[Config], object] = lambda c: c.target_catalog and c.target_catalog_gal_ebv
_KERNEL: Callable[[Config], object] = lambda c: c.pdz_kernel
#: parameter -> what it is used with. Set without that, it is refused; parameters that aren't here are always used.
USED_WITH: dict[str, Callable[[Config], object]] = {
    **dict.fromkeys(
        ("target_catalog_id_column", "target_catalog_filters", "target_catalog_gal_ebv", "target_catalog_filters_shifts", "missing_photometry_flags", "target_catalog_format", "target_catalog_unit")
        + ("input_size", "input_chunk_size", "reference_sample_dir", "reference_sample_phot_file"),
        _CATALOG,
    ),
    **dict.fromkeys(("dust_map_sed_bpc", "galactic_curve", "galactic_sed", "filters_dir", "redden_mean_phot"), _DUST),
    **dict.fromkeys(("pdz_kernel_bandwidth", "pdz_kernel_store"), _KERNEL),
    **dict.fromkeys(("scale_max_iter", "scale_rtol"), lambda c: c.scale_prior),
    "reference_sample_phot_format": lambda c: c.target_catalog and c.reference_sample_phot_file,
    "reference_sample_providers": lambda c: c.target_catalog and c.reference_sample_dir,
    "scale_prior": lambda c: c.neighbor_method == "BruteForce",
    "leafsize": lambda c: c.neighbor_method in ("KDTree", "Combined"),
    "batch_size": lambda c: c.neighbor_method == "Combined",
    "output_format": lambda c: c.output_file,
    "mc_pdf_take_n": lambda c: c.mc_samples or c.mc_1d_pdf or c.mc_2d_pdf or c.mc_count or c.mc_slice_aggregate,
}


@dataclass
class Config:
    """Names follow the parameters that users know; Python code to execute and graphics cards have no counterpart.

    Those about files are used by `files`: target_catalog and reference_sample_phot_file (with a format each: parquet, csv, json, orc, fits or npy), reference_sample_dir (a sample of `sources.sample`;
    reference_sample_providers names its providers of densities and Monte-Carlo samples, all by default), and, for targets with E(B-V), galactic_curve, galactic_sed (two columns of text) and
    filters_dir, from which each band's coefficient is computed. input_chunk_size: targets in a partition. leafsize: objects in a leaf of the index.
    """

    reference_sample_phot_filters: list[str]
    neighbor_method: str
    neighbors_no: int
    weight_method: str
    target_catalog_id_column: str = "ID"
    target_catalog_filters: list[tuple[str, str]] = field(default_factory=list)
    target_catalog_gal_ebv: str | None = None
    target_catalog_filters_shifts: dict[str, str] = field(default_factory=dict)
    dust_map_sed_bpc: float = 1.018
    missing_photometry_flags: list[float] = field(default_factory=list)
    target_catalog: str | None = None
    target_catalog_format: str = "parquet"
    target_catalog_unit: str | None = None
    reference_sample_dir: str | None = None
    reference_sample_providers: list[str] | None = None
    reference_sample_phot_file: str | None = None
    reference_sample_phot_format: str = "parquet"
    galactic_curve: str | None = None
    galactic_sed: str | None = None
    filters_dir: str | None = None
    input_chunk_size: int | None = None
    leafsize: int | None = None
    force_cpu: bool = True
    neighbor_catalog: str = "neighbors"
    output_file: str | None = None
    output_format: str = "parquet"
    redden_mean_phot: bool = False
    enable_filters: str | None = None
    input_size: int | None = None
    batch_size: int | None = None
    scale_prior: str | None = None
    scale_max_iter: int = 20
    scale_rtol: float = 1e-8
    weight_method_alternative: str = "Euclidean"
    copy_input_columns: bool = False
    neighbor_info_output: bool = False
    flags_in_separate_columns: bool = False
    pdz_output: bool = True
    pdz_kernel: str | None = None
    pdz_kernel_bandwidth: float | str = "auto"
    pdz_kernel_store: bool = False
    pdz_quantiles: list[float] = field(default_factory=list)
    pdz_mc_samples: int = 0
    pdz_point_estimates: list[str] = field(default_factory=list)
    reference_sample_out_mean_phot_filters: list[str] = field(default_factory=list)
    corrected_photometry: dict[str, tuple[str, str]] = field(default_factory=dict)
    mc_pdf_take_n: int = 100
    mc_samples: dict[str, list[str] | None] = field(default_factory=dict)
    mc_1d_pdf: dict[str, list] = field(default_factory=dict)
    mc_2d_pdf: dict[str, list] = field(default_factory=dict)
    mc_count: dict[str, list] = field(default_factory=dict)
    mc_slice_aggregate: dict[str, list] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.neighbor_method not in METHODS:
            raise ValueError(f"the method {self.neighbor_method!r} isn't known")
        if self.neighbor_method == "Combined" and not self.batch_size:
            raise ValueError("Combined needs batch_size")
        if self.scale_prior and self.neighbor_method != "BruteForce":
            raise ValueError("scale_prior needs BruteForce")
        if self.output_format not in ("parquet", "fits"):
            raise ValueError(f"output can't be written as {self.output_format!r}")
        for w in (self.weight_method, self.weight_method_alternative):
            if w.lower() not in weights.METHODS:
                raise ValueError(f"weights by {w!r} aren't known")
        if not self.force_cpu:
            raise ValueError("there is no search on graphics cards")
        if self.redden_mean_phot and not self.target_catalog_gal_ebv:
            raise ValueError("redden_mean_phot needs target_catalog_gal_ebv")
        useless = [f.name for f in fields(self) if f.name in USED_WITH and not USED_WITH[f.name](self) and getattr(self, f.name) != (f.default if f.default is not MISSING else f.default_factory())]
        if useless:
            raise ValueError(f"parameters {useless} would not be used")
        for name, specs in self.mc_slice_aggregate.items():
            for _, _, _, *by in specs:
                if by and (unknown := set(by[0].values()) - AGGREGATES.keys()):
                    raise ValueError(f"aggregates {sorted(unknown)} of {name} aren't known")
        if self.target_catalog_filters and len(self.target_catalog_filters) != len(self.reference_sample_phot_filters):
            raise ValueError("target_catalog_filters and reference_sample_phot_filters differ in length")

    @classmethod
    def parse(cls, values: dict | str) -> Config:
        values = json.loads(values) if isinstance(values, str) else dict(values)
        known = {f.name for f in fields(cls)}
        if unknown := values.keys() - known:
            raise ValueError(f"parameters {sorted(unknown)} aren't known")
        if absent := [f.name for f in fields(cls) if f.name not in values and f.name in ("reference_sample_phot_filters", "neighbor_method", "neighbors_no", "weight_method")]:
            raise ValueError(f"parameters {absent} are needed")
        return cls(**values)

    @property
    def search(self) -> Search:
        method, distance = METHODS[self.neighbor_method]
        prior = Prior.parse(self.scale_prior) if self.scale_prior else None
        return Search(self.neighbors_no, distance, method, self.batch_size or self.neighbors_no, prior, self.scale_max_iter, self.scale_rtol, self.leafsize or 2048)
