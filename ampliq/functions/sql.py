"""The native expressions as SQL functions, for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .seq import COMPLEMENT_FROM, COMPLEMENT_TO, STRAND_FROM, STRAND_TO
from .text import ACCENTED, UNACCENTED

FUNCTIONS = {
    "revcomp(s STRING) RETURNS STRING": f"reverse(translate(s, '{COMPLEMENT_FROM}', '{COMPLEMENT_TO}'))",
    "decode_strand(s STRING) RETURNS STRING": f"translate(s, '{STRAND_FROM}', '{STRAND_TO}')",
    "ungap(s STRING) RETURNS STRING": "translate(s, '-.', '')",
    "gc_pct(s STRING) RETURNS DOUBLE": "coalesce(100.0D * (length(s) - length(translate(upper(s), 'GC', ''))) / nullif(length(s), 0), 0.0D)",
    "max_homopolymer(s STRING) RETURNS INT": "coalesce(array_max(transform(regexp_extract_all(ungap(s), '(A+|C+|G+|T+)', 1), x -> length(x))), 0)",
    "sample_id(h STRING) RETURNS STRING": r"regexp_replace(trim(substring_index(h, ';', 1)), '_var\\d+$', '')",
    "sample_of_header(h STRING) RETURNS STRING": r"regexp_replace(sample_id(h), '(?<=.)_all\\.fa$', '')",
    "parse_number(c STRING) RETURNS DOUBLE": r"try_cast(regexp_replace(translate(c, ',', '.'), '[%\\s\\u00a0]', '') AS DOUBLE)",
    "normalize_cell(c STRING) RETURNS STRING": f"trim('_' FROM regexp_replace(regexp_replace(translate(trim(c), '{ACCENTED}', '{UNACCENTED}'), '[ .,]+', '_'), '_+', '_'))",
    "query_key(h STRING) RETURNS STRING": "translate(h, ' ', '_')",
}


def register(spark: SparkSession) -> None:
    """Create the temporary functions in the session."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
