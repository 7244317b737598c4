"""A whole run as one plan: find, correct, weigh, and one row a target from a list of column providers.

The four stages are functions of their own, so that a caller can store what is between any two of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import MissingData
from ..operators import correction, densities, knn, montecarlo, weights
from ..sources import filters
from ..sources.catalog import TargetCatalog, enabled_bands, read, reference_photometry, scan_targets
from ..sources.fits import write_fits
from ..sources.sample import ReferenceSample
from ..sources.scratch import stored
from .config import Config


@dataclass
class Inputs:
    """targets: target_id, f_, e_ and perhaps ebv, shifts, in_*. refs: ref_id, f_, e_ and perhaps ebv_, c0_, c1_, weight. coefficients: K of each band, for targets with ebv. pdz: ref_id, p over bins. mc: provider -> ref_id, s."""

    targets: DataFrame
    refs: DataFrame
    coefficients: dict[str, float] = field(default_factory=dict)
    pdz: DataFrame | None = None
    bins: list[float] = field(default_factory=list)
    mc: dict[str, DataFrame] = field(default_factory=dict)


    @classmethod
    def from_config(cls, spark: SparkSession, c: Config) -> Inputs:
        """What a configuration names: its catalogue, photometry, sample, and coefficients of dust."""
        return files(spark, c)


def files(spark: SparkSession, c: Config) -> Inputs:
    """The inputs that a configuration names."""
    if not c.target_catalog or not c.reference_sample_phot_file:
        raise MissingData("target_catalog and reference_sample_phot_file are needed")
    bands = bands_of(c)
    columns = dict(zip(c.reference_sample_phot_filters, c.target_catalog_filters or [(b, f"{b}_ERR") for b in c.reference_sample_phot_filters]))
    source = TargetCatalog(
        c.target_catalog, {b: tuple(x) for b, x in columns.items()}, c.target_catalog_id_column, c.target_catalog_format, c.target_catalog_unit, tuple(c.missing_photometry_flags), c.enable_filters, c.input_size,
        c.target_catalog_gal_ebv, c.dust_map_sed_bpc, c.target_catalog_filters_shifts,
    )
    targets = scan_targets(spark, source)
    if c.input_chunk_size:
        targets = targets.repartition(max(1, -(-targets.count() // c.input_chunk_size)), "target_id")
    refs = reference_photometry(read(spark, c.reference_sample_phot_file, c.reference_sample_phot_format), sorted({*bands, *(b for made, _ in c.corrected_photometry.values() for b in [made]), *c.reference_sample_out_mean_phot_filters}))
    out = Inputs(targets, refs)
    if c.target_catalog_gal_ebv:
        if not (c.galactic_curve and c.galactic_sed and c.filters_dir):
            raise MissingData("galactic_curve, galactic_sed and filters_dir are needed for targets with E(B-V)")
        curves = filters.from_directory(spark, c.filters_dir)
        extinction, sed = filters.read_curve(spark, c.galactic_curve), filters.read_curve(spark, c.galactic_sed)
        out.coefficients = {b: correction.band_coefficient(extinction, filters.transmission(curves, b), sed) for b in bands}
    if c.reference_sample_dir:
        s = ReferenceSample.open(spark, c.reference_sample_dir)
        weights_ = s.weights()
        if not out.refs.join(weights_, "ref_id", "left_anti").isEmpty() or not weights_.join(out.refs, "ref_id", "left_anti").isEmpty():
            raise MissingData("the photometry and the index of reference_sample_dir hold different objects")
        out.refs = out.refs.join(weights_, "ref_id")
        wanted = {n: k for n, k in s.providers.items() if s._exists(n)} if c.reference_sample_providers is None else {n: s.providers[n] for n in c.reference_sample_providers}
        for name, kind in wanted.items():
            if kind == "pdz" and out.pdz is None:
                out.pdz, out.bins = s.data(name).select("ref_id", "p"), s.bins(name)
            elif kind == "mc":
                out.mc[name] = s.data(name)
    return out


def bands_of(c: Config) -> list[str]:
    return enabled_bands(c.reference_sample_phot_filters, c.enable_filters)


def find(i: Inputs, c: Config, plan: str = "auto") -> DataFrame:
    """Neighbours of the de-reddened targets."""
    bands = bands_of(c)
    targets = i.targets
    if "ebv" in targets.columns and i.coefficients:
        targets = correction.dereddened(targets, {b: i.coefficients[b] for b in bands})
    return knn.neighbors(targets, i.refs, bands, c.search, plan)


def correct(found: DataFrame, i: Inputs, c: Config) -> DataFrame:
    """Neighbours' fluxes in their targets' colour space, beside the targets as they were observed."""
    pairs = knn.with_photometry(found, i.targets, i.refs, bands_of(c))
    return correction.projected(pairs, bands_of(c), "ebv" if "ebv" in i.targets.columns else None, "shifts" if "shifts" in i.targets.columns else None)


def weigh(pairs: DataFrame, i: Inputs, c: Config) -> DataFrame:
    return weights.weighted(pairs, bands_of(c), c.weight_method, c.weight_method_alternative, "ref_weight" if "weight" in i.refs.columns else None)


Provider = Callable[[DataFrame, Inputs, Config], "DataFrame | None"]
#: name -> provider of columns by target_id; users add their own.
PROVIDERS: dict[str, Provider] = {}
#: name -> provider of a side table.
EXTENSIONS: dict[str, Callable[[Inputs, Config], dict[str, DataFrame]]] = {}


def provides(f: Provider) -> Provider:
    PROVIDERS[f.__name__] = f
    return f


@provides
def flags(pairs: DataFrame, i: Inputs, c: Config) -> DataFrame:
    rows = pairs.groupBy("target_id").agg(F.max("flags").alias("flags"))
    return weights.flag_columns(rows) if c.flags_in_separate_columns else rows


@provides
def neighbor_info(pairs: DataFrame, i: Inputs, c: Config) -> DataFrame | None:
    return weights.neighbor_list(pairs) if c.neighbor_info_output else None


@provides
def pdz(pairs: DataFrame, i: Inputs, c: Config) -> DataFrame | None:
    if i.pdz is None or not (c.pdz_output or c.pdz_point_estimates or c.pdz_quantiles or c.pdz_mc_samples):
        return None
    out = densities.coadded(pairs, i.pdz, i.bins)
    if c.pdz_kernel:
        out = densities.smoothed(out, i.bins, None if c.pdz_kernel_bandwidth == "auto" else float(c.pdz_kernel_bandwidth), keep_kernel=c.pdz_kernel_store)
    out = densities.point_estimates(out, i.bins, c.pdz_point_estimates)
    if c.pdz_quantiles:
        out = densities.quantiles(out, i.bins, c.pdz_quantiles)
    if c.pdz_mc_samples:
        out = densities.samples(out, i.bins, c.pdz_mc_samples)
    return out if c.pdz_output else out.drop("pdf")


@provides
def mean_photometry(pairs: DataFrame, i: Inputs, c: Config) -> DataFrame | None:
    return weights.mean_photometry(pairs, c.reference_sample_out_mean_phot_filters) if c.reference_sample_out_mean_phot_filters else None


def slices(c: Config, name: str) -> list[tuple[str, str, list[float], dict[str, str]]]:
    """(target, sliced, edges, {suffix: aggregate}) of a provider; the mean, without a suffix, if none is named."""
    return [(t, s, edges, by[0] if by else {"": "mean"}) for t, s, edges, *by in c.mc_slice_aggregate.get(name, [])]


@provides
def monte_carlo(pairs: DataFrame, i: Inputs, c: Config) -> DataFrame | None:
    """Array columns of each provider's draws: samples, histograms, counts, statistics and slice aggregates."""
    out = None
    for name, table in i.mc.items():
        asked = [p for d in (c.mc_1d_pdf, c.mc_2d_pdf, c.mc_count, c.mc_slice_aggregate) for p in d.get(name, [])]
        if not asked and name not in c.mc_samples:
            continue
        kinds = table.schema["s"].dataType.elementType.names
        size = table.select(F.max(F.size("s"))).first()[0]
        rows = stored(montecarlo.drawn(montecarlo.draws(pairs, c.mc_pdf_take_n, size, seed=0), table, kinds))  # many parts read them
        parts: list[DataFrame] = []
        if name in c.mc_samples:
            parts.append(montecarlo.sample_columns(rows, c.mc_samples[name]))
        in_order = lambda df, keys, value, as_: df.groupBy("target_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*keys, value))), lambda x: x[value]).alias(as_))
        for p, edges, *percent in c.mc_1d_pdf.get(name, []):
            parts.append(in_order(montecarlo.pdf_1d(rows, p, edges), ["bin"], "density", f"mc_pdf_1d_{p}"))
            if percent:
                parts += [montecarlo.medians(rows, p).withColumnRenamed("median", f"phz_pp_median_{p}"), montecarlo.modes(rows, p).withColumnRenamed("mode", f"phz_pp_mode_{p}")]
                parts.append(montecarlo.interval(rows, p, percent[0]).select("target_id", F.array("low", "high").alias(f"phz_pp_{percent[0]}_{p}")))
        for (x, y), xe, ye in c.mc_2d_pdf.get(name, []):
            parts.append(in_order(montecarlo.pdf_2d(rows, x, y, xe, ye), ["bin_x", "bin_y"], "density", f"mc_pdf_2d_{x}_{y}"))
        for p, values in c.mc_count.get(name, []):
            parts.append(in_order(montecarlo.count_values(rows, p, values), ["value"], "n", f"mc_count_{p}"))
        for target, sliced, edges, by in slices(c, name):
            for suffix, aggregate in by.items():
                parts.append(in_order(montecarlo.slice_aggregate(rows, target, sliced, edges, montecarlo.AGGREGATES[aggregate]), ["slice"], "value", f"mc_slice_aggregate_{target}_{sliced}{suffix and '_' + suffix}"))
        for part in parts:
            out = part if out is None else out.join(part, "target_id", "left")
    return out


@provides
def corrected(pairs: DataFrame, i: Inputs, c: Config) -> DataFrame | None:
    wanted = {n: (made, seen) for n, (made, seen) in c.corrected_photometry.items() if seen in bands_of(c)}
    if not wanted:
        return None
    made = sorted({m for m, _ in wanted.values()})
    rest = i.refs.select("ref_id", *(F.col(f"f_{b}").alias(f"rest_f_{b}") for b in made))
    scaled = pairs.join(rest, "ref_id").withColumns({f"rest_f_{b}": F.col(f"rest_f_{b}") * F.col("scale") for b in made})
    return correction.uniform_photometry(scaled, wanted)


def output(pairs: DataFrame, i: Inputs, c: Config, providers: dict[str, Provider] | None = None) -> DataFrame:
    """One row a target: its id (or all input columns) and the providers' columns."""
    copied = [x for x in i.targets.columns if x.startswith("in_")] if c.copy_input_columns else []
    out = i.targets.select("target_id", *copied)
    for f in (providers or PROVIDERS).values():
        part = f(pairs, i, c)
        if part is not None:
            out = out.join(part, "target_id", "left")
    return out


def extension_tables(i: Inputs, c: Config) -> dict[str, DataFrame]:
    """Grids that the array columns refer to."""
    spark = i.targets.sparkSession
    out = {}
    if i.bins and c.pdz_output:
        out["bins_pdf"] = spark.createDataFrame([(n, float(z)) for n, z in enumerate(i.bins)], "bin int, z double")
    for specs in c.mc_1d_pdf.values():
        out |= {f"bins_mc_pdf_1d_{p}": montecarlo.bin_centres(spark, edges) for p, edges, *_ in specs}
    for specs in c.mc_2d_pdf.values():
        out |= {f"bins_mc_pdf_2d_{x}_{y}": montecarlo.bin_centres_2d(spark, xe, ye) for (x, y), xe, ye in specs}
    for specs in c.mc_count.values():
        out |= {f"bins_mc_count_{p}": spark.createDataFrame([(int(v),) for v in sorted(values)], "value long") for p, values in specs}
    for name in c.mc_slice_aggregate:
        out |= {f"bins_mc_slice_aggregate_{t}_{s}{x and '_' + x}": spark.createDataFrame([(float(e),) for e in edges], "edge double") for t, s, edges, by in slices(c, name) for x in by}
    for f in EXTENSIONS.values():
        out |= f(i, c)
    return out


def run(i: Inputs, c: Config, plan: str = "auto") -> DataFrame:
    """All stages. Weighted neighbours are stored once, since each provider reads them."""
    return output(stored(weigh(correct(find(i, c, plan), i, c), i, c)), i, c)


def observed(out: DataFrame) -> tuple[DataFrame, Observation]:
    """out, and what counts its rows (`targets`) while they are written, from which sources a second follow."""
    o = Observation()
    return out.observe(o, F.count(F.lit(1)).alias("targets")), o


#: name -> provider of keywords for the catalogue's header; users add their own.
HEADERS: dict[str, Callable[[Config], dict[str, object]]] = {
    "comment": lambda c: {"comment": "neighbour inference over photometric catalogues"},
    "quantiles": lambda c: {"PDFQUAN": " ".join(map(str, c.pdz_quantiles))} if c.pdz_quantiles else {},
}


def headers(c: Config) -> dict[str, object]:
    return {k: v for f in HEADERS.values() for k, v in f(c).items()}


def write(out: DataFrame, extensions: dict[str, DataFrame], path: str, format: str = "parquet", header: dict[str, object] | None = None) -> None:
    """The catalogue and, beside it, its side tables. As fits: one file, with the header's keywords, a table each."""
    if format == "fits":
        write_fits(out, f"{path}/catalog.fits", header, single=True, name="CATALOG")
        for name, df in extensions.items():
            write_fits(df.coalesce(1), f"{path}/catalog.fits", single=True, mode="append", name=name.upper())
        return
    out.write.mode("overwrite").parquet(f"{path}/catalog")
    for name, df in extensions.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")


def ids_to_neighbors(catalog: DataFrame, refs: DataFrame) -> DataFrame:
    """Neighbours in long form from a catalogue's arrays; an id that the reference hasn't raises."""
    rows = catalog.select("target_id", F.posexplode(F.arrays_zip("neighbor_ids", "neighbor_weights", "neighbor_scaling")).alias("pos", "x"))
    rows = rows.select("target_id", (F.col("pos") + 1).alias("rank"), F.col("x.neighbor_ids").alias("ref_id"), F.col("x.neighbor_weights").alias("weight"), F.col("x.neighbor_scaling").alias("scale"))
    if not rows.join(refs, "ref_id", "left_anti").isEmpty():
        raise MissingData("the catalogue names objects that the reference hasn't")
    return rows
