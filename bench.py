"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ampliq import catalog  # noqa: E402
from ampliq.session import local_session  # noqa: E402

HEADLINE = [
    "f01_min_length",
    "f03_classify_length",
    "sc20_mean_q",
    "sc21_seq_stats",
    "sc26_orf_trim",
    "a13_fastq_stats",
    "a15_fastq_by_group",
    "a11_fasta_stats",
    "a17_unique_seqs",
    "a27_dedup_report",
    "a32_best_hits",
    "a34_best_sequence",
    "a03_consensus",
    "a20_dedupe_ids",
    "j03_assign_samples",
    "j05_apply_taxonomy",
    "j14_winner_coverage",
    "j10_compare_all",
    "lim1_split_count",
    "win1_rank_hits",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    only = sys.argv[1:]
    names = [n for n in HEADLINE if not only or any(o in n for o in only)]
    # One small query first, so that start-up is not counted with the first headline query.
    catalog.QUERIES["f01_min_length"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
