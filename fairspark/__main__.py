"""python -m fairspark -dataset NAME -path FILE -protected A,B -algorithm X,Y -seed N -runs N -out FOLDER

With -configs FILE the seed, runs, passes, surrogates, files of settings and the folder of results come from there.  With -run
NAME results come in whole and once, and seeds whose results are there already are passed over: a run that was killed may be
given again as it was.
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fairspark.functions.text import bold
from fairspark.plans.assessment import CORRECTIONS, MULTICLASS, PUBLISHED, run
from fairspark.sources.checks import check_dataset, check_keys
from fairspark.sources.config import dataset_config, plan, run_config
from fairspark.sources.prepare import prepare
from fairspark.sources.readers import LOADERS, load
from fairspark.sources.sinks import published, save_results


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="fairspark")
    parser.add_argument("-dataset", required=True, choices=sorted(LOADERS))
    parser.add_argument("-path", required=True)
    parser.add_argument("-protected", help="attributes, separated by commas; else from -datasets")
    parser.add_argument("-algorithm", default="", help="corrections, separated by commas")
    parser.add_argument("-all", action="store_true", help="all corrections, those of all groups at once too")
    parser.add_argument("-configs", help="settings of the run (INI)")
    parser.add_argument("-datasets", help="settings of the datasets (INI)")
    parser.add_argument("-algorithms", help="settings of the corrections (INI)")
    parser.add_argument("-seed", type=int)
    parser.add_argument("-runs", type=int, default=1)
    parser.add_argument("-iterations", type=int, default=1)
    parser.add_argument("-out")
    parser.add_argument("-run", help="a name for this run, so that it may be repeated")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    spark = SparkSession.builder.appName("fairspark").getOrCreate()
    settings = run_config(args.configs) if args.configs else None
    datasets, algorithms = args.datasets or (settings and settings.datasets), args.algorithms or (settings and settings.algorithms)
    own = dataset_config(datasets, args.dataset) if datasets else None
    protected = tuple(args.protected.split(",")) if args.protected else own.protected if own else ()
    out = args.out or (settings and settings.results)
    if not protected or not out:
        parser.error("no protected attribute" if out else "no folder for results")
    names = sorted(CORRECTIONS | MULTICLASS) if args.all else [x for x in args.algorithm.split(",") if x]
    first, runs, iterations = (settings.seed, settings.runs, settings.iterations) if settings else (42, args.runs, args.iterations)
    first = first if args.seed is None else args.seed
    surrogates = settings.surrogates if settings else PUBLISHED.surrogates
    dataset = prepare(load(spark, args.dataset, args.path), args.dataset, protected)
    check_dataset(dataset)
    check_keys(CORRECTIONS | MULTICLASS, names)
    shares = (own.train, own.validation, own.test) if own else (0.8, 0.1, 0.1)
    for seed in range(first, first + runs):
        name = f"{args.run}-{seed}" if args.run else None
        if name and published(spark, f"{out}/distributions", name):
            continue
        logging.info("%s, seed %d", bold(args.dataset), seed)
        with_settings = plan(algorithms, seed, surrogates, f"{out}/evolution") if algorithms else replace(PUBLISHED, seed=seed, surrogates=surrogates, evolution=f"{out}/evolution")
        metrics, spread = run(dataset, args.dataset, names, iterations, shares, with_settings)
        save_results(metrics.withColumn("seed", F.lit(seed)), spread.withColumn("seed", F.lit(seed)), out, run=name)


if __name__ == "__main__":
    main()
