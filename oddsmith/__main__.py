"""python -m oddsmith coverage|calibrate|evaluate ROOT OUT: the study's steps over season files below ROOT."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators import study
from .sources.seasons import load_seasons


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="oddsmith", description="Coverage, calibration and evaluation of season files.")
    parser.add_argument("step", choices=["coverage", "calibrate", "evaluate"])
    parser.add_argument("root", help="folder of season/league.csv files")
    parser.add_argument("out", help="folder for the results")
    parser.add_argument("--leagues", nargs="*", help="only these leagues")
    parser.add_argument("--registration", help="text file that names the frozen rate (evaluate)")
    parser.add_argument("--min-fit-matches", type=int, default=300)
    parser.add_argument("--min-cell", type=int, default=study.MIN_CELL)
    own = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("oddsmith").getOrCreate()
    matches, odds, unreadable = load_seasons(spark, own.root, own.leagues)
    study.write_table(unreadable, f"{own.out}/unreadable.csv")
    read = lambda path: spark.read.text(path, wholetext=True).first()[0]
    if own.step == "coverage":
        study.write_coverage(matches, odds, own.out, own.leagues or study.LEAGUES)
    elif own.step == "calibrate":
        found = study.write_calibration(study.calibrate(matches, min_fit_matches=own.min_fit_matches), own.out)
        print(f"half-life {found['half_life_days']:g} days, xi = {found['xi']!r}, mean score {found['mean_rps_paired']:.6f} on {found['n_paired']} fixtures")
    else:
        if not own.registration:
            parser.error("evaluate needs --registration")
        rate = study.frozen_rate(read(own.registration), json.loads(read(f"{own.out}/calibration.json")))
        print(study.evaluate(matches, odds, rate, own.out, own.min_fit_matches, own.min_cell).count(), "rows of cells")


if __name__ == "__main__":
    main()
