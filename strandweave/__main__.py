"""``python -m strandweave call|merge``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from strandweave.options import CallOptions, MergeOptions
from strandweave.plans.call import as_records, call
from strandweave.plans.merge import merge_files
from strandweave.session import local_session
from strandweave.sources import alignments, vcf

#: Short and long names of options, and the field that each sets.
_NUMBERS = {
    ("-c", "--cutoff"): "cutoff", ("-v", "--min-vote"): "min_vote", ("-q", "--min-map-qual"): "min_map_q", ("-m", "--min-sv-size"): "min_sv_size", ("-a", "--adj-tol"): "adj_tol",
    ("-ss", "--max-split"): "max_split", ("-so", "--max-overlap"): "max_overlap", ("-se", "--min-split-support"): "min_split_support",
    ("-ps", "--pair-search-size"): "pair_search_size", ("-pi", "--insert-deviations"): "insert_deviations", ("-pd", "--depth-outlier"): "depth_outlier", ("-pe", "--min-pair-support"): "min_pair_support",
    ("-cs", "--min-clip-size"): "min_clip_size", ("-ce", "--clip-error-rate"): "clip_error_rate",
    ("-rs", "--depth-samples"): "depth_samples", ("-rw", "--depth-window"): "depth_window", ("-re", "--depth-threshold"): "depth_threshold",
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="strandweave")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("call")
    one.add_argument("bam")
    one.add_argument("-r", "--reference", required=True)
    one.add_argument("-o", "--out", required=True)
    defaults = CallOptions()
    for names, field in _NUMBERS.items():
        one.add_argument(*names, dest=field, type=type(getattr(defaults, field)), default=getattr(defaults, field))
    for flag in ("report-filtered", "no-pe", "no-ce", "no-re", "no-rank-aggregation", "use-re-for-bs", "assemble-clips"):
        one.add_argument(f"--{flag}", action="store_true")
    many = commands.add_parser("merge")
    many.add_argument("inputs", help="comma-separated .vcf files")
    many.add_argument("-o", "--out", required=True)
    many.add_argument("--use-all", action="store_true")
    a = parser.parse_args(argv)
    spark = local_session()
    if a.command == "merge":
        merge_files(spark, [p for p in a.inputs.split(",") if p], a.out, MergeOptions(use_all=a.use_all))
        return
    o = replace(defaults, **{f: getattr(a, f) for f in _NUMBERS.values()}, report_filtered=a.report_filtered, use_pairs=not a.no_pe, use_clips=not a.no_ce, use_depth=not a.no_re, rank_aggregation=not a.no_rank_aggregation, depth_for_balanced=a.use_re_for_bs, assemble_clips=a.assemble_clips)
    alignments.register(spark)
    if not alignments.is_sorted(alignments.read_header(a.bam).text):
        raise SystemExit("the alignments must be sorted by coordinate")
    chunks = spark.read.format("fasta").load(a.reference)
    found = call(alignments.read_bam(spark, a.bam, alignments.CALL_COLUMNS), alignments.contigs(spark, a.bam), o, chunks, file_order=True)
    vcf.write_vcf(as_records(found), a.out, ["SAMPLE"])


if __name__ == "__main__":
    main()
