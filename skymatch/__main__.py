"""python -m skymatch PROGRAM --config FILE.json [--name value ...]: the stages of a run as programs.

    run         all stages; writes output_file
    neighbors   the neighbours; writes neighbor_catalog
    correct     their fluxes in the targets' colour space; writes neighbor_catalog anew
    weights     their weights and flags; writes neighbor_catalog anew
    output      one row a target; writes output_file
    complete    posteriors as a provider (provider) of reference_sample_dir: a table in long form (posteriors, parameters), or the FITS files of a
                folder (posterior_folder) that a table there lists (index_file, with a column FILE_NAME); an object's id is then its place in that list

The file holds a JSON object of parameters (plans.config.Config); those given as --name value replace them, values being JSON or else text.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import run as R
from .plans.config import Config
from .sources import layout, sample
from .sources.catalog import read
from .sources.fits import read_fits
from .sources.scratch import release


def parameters(args: list[str]) -> dict:
    """Those of the file that --config names, and those given."""
    given, i = {}, 0
    while i < len(args):
        name, sep, value = args[i].partition("=")
        if not name.startswith("--"):
            raise SystemExit(f"{name} isn't understood")
        if not sep:
            if i + 1 >= len(args):
                raise SystemExit(f"{name} needs a value")
            i, value = i + 1, args[i + 1]
        try:
            given[name[2:]] = json.loads(value)
        except json.JSONDecodeError:
            given[name[2:]] = value
        i += 1
    path = given.pop("config", None)
    if path is None:
        return given
    with open(path, encoding="utf-8") as f:
        return json.load(f) | given


def _stage(spark: SparkSession, c: Config, name: str) -> DataFrame:
    return spark.read.parquet(f"{c.neighbor_catalog}/{name}")


def _save(df: DataFrame, c: Config, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{c.neighbor_catalog}/{name}")


def _write(spark: SparkSession, i: R.Inputs, c: Config, pairs: DataFrame) -> None:
    if not c.output_file:
        raise SystemExit("output_file is needed")
    rows, seen = R.observed(R.output(pairs, i, c))
    R.write(rows, R.extension_tables(i, c), c.output_file, c.output_format, R.headers(c))
    print(f"{seen.get['targets']} targets")
    release(spark)


def main(args: list[str], spark: SparkSession | None = None) -> None:
    if not args or args[0] not in ("run", "neighbors", "correct", "weights", "output", "complete"):
        raise SystemExit(__doc__)
    values = parameters(args[1:])
    spark = spark or SparkSession.builder.appName(f"skymatch {args[0]}").getOrCreate()
    if args[0] == "complete":
        s = sample.ReferenceSample.open(spark, values["reference_sample_dir"])
        if "posterior_folder" in values:
            folder = values["posterior_folder"]
            listing = read_fits(spark, f"{folder}/{values.get('index_file', 'Index_File_posterior.fits')}", places=True).select(F.col("_row").alias("ref_id"), "FILE_NAME", F.col("_row").alias("position"))
            name = values.get("provider", "pp")
            if name not in s.providers:
                s.add_provider(name, "mc")
            s.add_data(name, layout.posteriors(spark, folder, listing))
            release(spark)
            return
        rows = read(spark, values["posteriors"], values.get("format", "parquet"))
        s.add_data(values.get("provider", "pp"), sample.complete(rows, values["parameters"]))
        return
    c = Config.parse(values)
    i = R.files(spark, c)
    if args[0] == "neighbors":
        _save(R.find(i, c), c, "found")
    elif args[0] == "correct":
        _save(R.correct(_stage(spark, c, "found"), i, c), c, "corrected")
    elif args[0] == "weights":
        _save(R.weigh(_stage(spark, c, "corrected"), i, c), c, "weighted")
    else:
        _write(spark, i, c, _stage(spark, c, "weighted") if args[0] == "output" else R.stored(R.weigh(R.correct(R.find(i, c), i, c), i, c)))


if __name__ == "__main__":
    main(sys.argv[1:])
