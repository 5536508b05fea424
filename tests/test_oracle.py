"""Registered queries against DuckDB on the smallest data; AMPLIQ_ALL=1 runs every one."""

import os

import pytest

from ampliq import catalog

from .check import compare, duck
from .conftest import SF

SOME = [
    "sc02_header_field", "sc08_extract_sample_id", "sc10_header_metrics", "sc17_species_key", "sc26_orf_trim", "sc27_scan_stops", "sc32_natural_key",
    "f05_grep_id", "f06_filter_fields", "f08_fix_blank_query", "f12_variant_tiers", "a03_consensus", "a11_fasta_stats", "a13_fastq_stats", "a17_unique_seqs",
    "a18_identical_groups", "a20_dedupe_ids", "a24_compare_outputs", "a27_dedup_runs", "a34_best_sequence", "a40_identification_by_file", "a42_non_dominated_runs",
    "j02_locate_primers", "j03_assign_samples", "j06_check_reference", "j12_compare_two", "lim2_split_bases", "ord1_sort_records", "set5_expand_grid", "win1_rank_hits",
]
NAMES = list(catalog.ORACLES) if os.environ.get("AMPLIQ_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    ok, note = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], SF)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
