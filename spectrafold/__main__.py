"""Run one method over a folder of sequence files: python -m spectrafold kl FOLDER --k 15 21 --alpha 0.1 1 --out RESULTS."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import PRESETS, Config
from .operators import checks, kmers
from .operators import counts as A
from .operators import distance as D
from .plans import runs, sinks, sweep
from .sources import fasta
from .sources import labels as L

METHODS = ("kl", "tfidf_kl", "jsd", "cosine", "cosine_length", "cosine_idf", "cosine_idf_length", "kwip")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="spectrafold", description=__doc__)
    out.add_argument("method", choices=METHODS)
    out.add_argument("path", help="folder of sequence files")
    out.add_argument("--out", required=True, help="folder for the results")
    out.add_argument("--preset", choices=sorted(PRESETS), help="where other options start from")
    out.add_argument("--labels", help="CSV of samples and labels; without it, names tell the class")
    out.add_argument("--label-mode", choices=("lenient", "flexible", "strict"), default="lenient", help="lenient calls a sample without a label unknown, the others refuse")
    out.add_argument("--cache", help="folder of counts that other runs share; without it, they are kept with the results")
    out.add_argument("--reuse", action="store_true", help="take pairs that an earlier run saved here under the same parameters")
    out.add_argument("--summary", help="table of overall rows that this run's rows are added to, in place of those of the same parameters")
    out.add_argument("--skip-empty", action="store_true", help="leave samples without k-mers out, which is an error otherwise")
    out.add_argument("--weights-out", action="store_true", help="write the weights of features as well")
    out.add_argument("--sample-column")
    out.add_argument("--label-column")
    for name in ("k", "alpha", "beta"):
        out.add_argument(f"--{name}", nargs="+", type=int if name == "k" else float, help="one or more values, for a grid")
    kinds = {"float | None": float, "float": float, "int": int, "str": str}
    for f in fields(Config):
        if f.name in ("k", "alpha", "beta"):
            continue
        flag = "--" + f.name.replace("_", "-")
        if f.type == "bool":
            out.add_argument(flag, action=argparse.BooleanOptionalAction, default=None)
        else:
            out.add_argument(flag, type=kinds[f.type])
    return out


def configs(args: argparse.Namespace) -> list[Config]:
    """A configuration for each combination of k, alpha and beta."""
    base = PRESETS[args.preset] if args.preset else PRESETS.get(args.method.split("_")[0] if args.method.startswith("cosine") else args.method, Config())
    given = {f.name: getattr(args, f.name, None) for f in fields(Config) if f.name not in ("k", "alpha", "beta")}
    grid = {n: getattr(args, n) for n in ("k", "alpha", "beta") if getattr(args, n)}
    base = base.but(**({"beta": args.beta[0]} if args.beta else {}), **{n: v for n, v in given.items() if v is not None})
    return sweep.grid(base, **grid)


def labelled(spark: SparkSession, samples: DataFrame, args: argparse.Namespace) -> DataFrame:
    if args.labels and args.label_mode == "strict":
        return L.strict(samples, L.read_table(spark, args.labels), args.sample_column or "sample", args.label_column or "group")[0]
    if args.labels and args.label_mode == "flexible":
        return L.flexible(samples, L.read_table(spark, args.labels), args.label_column or "label", args.sample_column)
    if args.labels:
        return L.lenient(samples, L.read_table(spark, args.labels), args.label_column, args.sample_column)
    return samples.select("sample", L.by_number(F.col("sample")).alias("label"))


def all_counts(spark: SparkSession, args: argparse.Namespace, grid: list[Config]) -> DataFrame:
    """(k, canonical, validity, boundary, sample, feature, c, many): compressed counts for all configurations.

    One scan of the files gives the counts of all k that agree in the rest. With a cache, they are made anew only where
    files, their sizes or times, or the settings have changed.
    """
    out = None
    for canonical, validity, boundary in dict.fromkeys((c.canonical, c.validity, c.boundary) for c in grid):
        same = [c for c in grid if (c.canonical, c.validity, c.boundary) == (canonical, validity, boundary)]
        ks = sorted({c.k for c in same})
        settings = [F.lit(v).alias(n) for n, v in (("canonical", canonical), ("validity", validity), ("boundary", boundary))]

        def make(ks=ks, config=same[0], settings=settings) -> DataFrame:
            return A.compressed_by(kmers.fasta_grid_counts(spark, args.path, ks, config), "k").select("k", *settings, "sample", "feature", "c", "many")

        inputs = sinks.manifest(spark, args.path, fasta.SUFFIXES, ks=ks, canonical=canonical, validity=validity, boundary=boundary)
        rows = sinks.cached(spark, args.cache or f"{args.out}/counts", inputs, make)
        out = rows if out is None else out.unionByName(rows)
    return out


def distances(spark: SparkSession, args: argparse.Namespace, i: int, config: Config, counts: DataFrame, lengths: DataFrame, samples: int, files: str) -> DataFrame:
    """The pairs of a configuration; with --reuse, those that an earlier run saved under the same parameters and for the same files."""
    said = json.dumps({"method": args.method, "path": args.path, "files": files} | asdict(config), sort_keys=True)
    if args.reuse and (saved := sinks.saved_text(spark, f"{args.out}/parameters-{i}")) == said:
        return sinks.load_pairs(spark, f"{args.out}/pairs-{i}", samples)
    sinks.save_pairs(runs.pairs(counts, args.method, config, lengths), f"{args.out}/pairs-{i}")
    sinks.save_text(spark, said, f"{args.out}/parameters-{i}")
    return spark.read.parquet(f"{args.out}/pairs-{i}")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Write pairs and scores of each configuration, the overall rows and the best of them; returns the overall rows."""
    rows, grid = [], configs(args)
    counted = all_counts(spark, args, grid)
    lengths = fasta.lengths(spark, args.path).persist()
    sinks.write_csv(lengths, f"{args.out}/lengths")
    files = sinks.digest(sinks.manifest(spark, args.path, fasta.SUFFIXES))
    known: dict[tuple, DataFrame] = {}
    for i, config in enumerate(grid):
        key = config.k, config.canonical, config.validity, config.boundary
        if key not in known:
            own = counted.where((F.col("k") == config.k) & (F.col("canonical") == config.canonical) & (F.col("validity") == config.validity) & (F.col("boundary") == config.boundary))
            known[key] = checks.checked(own.select("sample", "feature", "c", "many"), None if args.skip_empty else lengths)
            sinks.write_csv(A.sample_stats(known[key]), f"{args.out}/count-stats-{'-'.join(map(str, key))}")
        counts = known[key]
        labels = labelled(spark, counts.select("sample").distinct(), args)
        pairs = distances(spark, args, i, config, counts, lengths, labels.count(), files)
        sinks.write_csv(labels.select("sample", "label"), f"{args.out}/labels")
        if args.weights_out and config.weight != "one":
            sinks.write_csv(D.weights(counts, config.weight, config.beta, config.cap_weight, config.scale_weight), f"{args.out}/weights-{i}", {"w": "%.12e"})
        elif args.weights_out and args.method == "kwip":
            sinks.write_csv(D.entropy_weights(counts), f"{args.out}/weights-{i}", {"h": "%.12e"})
        sinks.write_csv(runs.scored(pairs, labels, config), f"{args.out}/samples-{i}", {"silhouette": "%.8f"})
        row = runs.overall_row(counts, pairs, labels, args.method, config)
        rows.append(row.first())  # one row a configuration
    lengths.unpersist()
    overall = spark.createDataFrame(rows, row.schema)
    sinks.write_csv(overall, f"{args.out}/overall")
    sinks.write_csv(sweep.best(overall), f"{args.out}/best")
    sinks.write_csv(sweep.best(overall, "named_silhouette"), f"{args.out}/best-named")
    if args.summary:
        sinks.upsert(overall.withColumn("path", F.lit(args.path)), args.summary, ["path", "method", "k", "alpha", "beta"])
    return overall


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    run(SparkSession.builder.appName("spectrafold").getOrCreate(), args).show(truncate=False)


if __name__ == "__main__":
    main()
