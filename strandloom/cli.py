"""Command line: annotate-homology, fragment, store-index."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strandloom.operators.overlaps import FragmentConfig
from strandloom.plans import pipeline
from strandloom.sources.writers import check_target


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="strandloom", description="Plan DNA assembly by homologous recombination.")
    commands = out.add_subparsers(dest="command", required=True)

    a = commands.add_parser("annotate-homology", help="mark the homology-free regions of query sequences")
    a.add_argument("query", nargs="+")
    a.add_argument("-b", "--background", action="append", default=[])
    a.add_argument("-k", "--kmer-size", type=int, default=20)
    a.add_argument("-t", "--threshold", type=int, default=60)
    a.add_argument("-o", "--output", default="annotated_sequences.gb")

    f = commands.add_parser("fragment", help="cut an annotated record into overlapping fragments")
    f.add_argument("input")
    for name in ("min-size", "max-size", "min-overlap", "max-overlap"):
        f.add_argument(f"--{name}", type=int, required=True)
    f.add_argument("--boundary-motif")
    f.add_argument("--min-step", type=int, default=10)
    f.add_argument("-o", "--output-gb", default="fragmented.gb")
    f.add_argument("-f", "--output-fasta", default="fragments.fasta")

    s = commands.add_parser("store-index", help="store the k-mers of background sequences")
    s.add_argument("input", nargs="+")
    s.add_argument("-k", "--kmer-size", type=int, default=20)
    s.add_argument("-i", "--background-id", default="background")
    s.add_argument("-o", "--output", required=True)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "fragment":  # checked before a session is made
        config = FragmentConfig(args.min_size, args.max_size, args.min_overlap, args.max_overlap, args.boundary_motif, args.min_step)
    spark = spark or SparkSession.builder.appName("strandloom").getOrCreate()
    for path in {"annotate-homology": ["output"], "fragment": ["output_gb", "output_fasta"]}.get(args.command, []):
        check_target(spark, getattr(args, path))  # before any work
    if args.command == "annotate-homology":
        pipeline.file_process_homology(spark, args.query, args.background, args.output, args.kmer_size, args.threshold)
    elif args.command == "fragment":
        done = pipeline.fragment_from_file(spark, args.input, args.output_gb, args.output_fasta, config)
        print(f"Wrote {done.fragments.count()} fragments to {args.output_gb} and {args.output_fasta}")
    else:
        pipeline.store_index(spark, args.input, args.output, args.background_id, args.kmer_size)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
