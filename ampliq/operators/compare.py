"""Comparison of the records of one id across runs (run, ord, id, seq, length, cov, ambs, gaps).

After ``dedupe_ids`` a run holds at most one record per id, so an id has at
most as many records as there are runs, and at most runs * (runs - 1) / 2
pairs of distinct sequences.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

from ..functions.headers import extract_sample_id, header_metrics, normalize_id
from ..functions.iupac import all_equal, ambiguous, by_length, composition_bounds, distances, equal_letters
from ..functions.seq import COMPLEMENT_FROM, COMPLEMENT_TO, revcomp
from ..session import balance, cut
from .ordering import first_per

VERDICT = StructType(
    [
        StructField("state", StringType()),
        StructField("d", IntegerType()),
        StructField("plain", IntegerType()),
        StructField("rc", BooleanType()),
    ]
)
STATES = ["identical", "compatible", "different"]


def parse_records(df: DataFrame, regexes: Sequence[str] = (), patterns: Sequence[str] = ("_all.fa",), **normalize) -> DataFrame:
    """Add id, length, coverage, ambiguities and gaps to (run, ord, header, seq)."""
    sid, matched = extract_sample_id("header", regexes, patterns)
    m = header_metrics("header", "seq")
    return df.select(
        "run", "ord", "header", normalize_id(sid, **normalize).alias("id"), matched.alias("matched"),
        F.upper("seq").alias("seq"), m["length"].alias("length"), F.coalesce(m["coverage"], F.lit(0)).alias("cov"),
        m["ambs"].alias("ambs"), m["estgaps"].alias("gaps"),
    )


def dedupe_ids(df: DataFrame) -> DataFrame:
    """Best record per run and id: fewest ambiguities, fewest gaps, most coverage, first."""
    best = first_per(df, ["run", "id"], ["ambs", "gaps", -F.col("cov"), "ord"])
    copies = df.groupBy("run", "id").agg(F.count(F.lit(1)).alias("copies"))
    return best.join(copies, ["run", "id"])


def compare_sequences(a, b, ignore_ends: bool = False) -> Column:
    """struct(state, d, plain, rc) of two sequences, trying the reverse complement when they differ."""
    equal = equal_letters("overlap")
    flip = bytes.maketrans(COMPLEMENT_FROM.encode(), COMPLEMENT_TO.encode())

    def both(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Distances without and with equality of codes."""
        if ignore_ends:
            x, y = by_length(x, y)
        plain = distances(x, y, {}, ignore_ends)
        d = plain.copy()
        again = np.flatnonzero((plain > 0) & (ambiguous(x) | ambiguous(y)))
        if len(again):
            d[again] = distances([x[k] for k in again], [y[k] for k in again], equal, ignore_ends, plain[again])
        return plain, d

    def verdicts(x: list[bytes], y: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(d, plain, turned) of all pairs."""
        turned = [t.translate(flip)[::-1] for t in x]
        d, plain, rc = np.full(len(x), -1), np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        if not ignore_ends:
            # Zero distances need no alignment to be seen, and most pairs have one.
            for text, back in ((x, False), (turned, True)):
                zero = np.flatnonzero((d < 0) & all_equal(text, y, equal))
                d[zero], rc[zero] = 0, back
                plain[zero] = distances([text[k] for k in zero], [y[k] for k in zero], {})
        left = np.flatnonzero(d < 0)
        plain[left], d[left] = both([x[k] for k in left], [y[k] for k in left])
        tried = left[d[left] > 0]
        if not ignore_ends:
            bound = composition_bounds([turned[k] for k in tried], [y[k] for k in tried])
            tried = tried[bound < d[tried]]
        plain_rc, d_rc = both([turned[k] for k in tried], [y[k] for k in tried])
        nearer = d_rc < d[tried]
        to = tried[nearer]
        d[to], plain[to], rc[to] = d_rc[nearer], plain_rc[nearer], True
        return d, plain, rc

    @arrow_udf(VERDICT)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        d, plain, rc = verdicts([t.encode("latin-1", "replace") for t in x.to_pylist()], [t.encode("latin-1", "replace") for t in y.to_pylist()])
        state = np.where(d > 0, "different", np.where(plain > 0, "compatible", "identical"))
        return pa.StructArray.from_arrays([pa.array(state.tolist(), pa.string()), pa.array(d, pa.int32()), pa.array(plain, pa.int32()), pa.array(rc)], names=["state", "d", "plain", "rc"])

    return run(a, b)


def distinct_pairs(df: DataFrame, ignore_ends: bool = False) -> DataFrame:
    """Verdict on each unordered pair of distinct sequences of an id. One shuffle by id serves both sides."""
    seqs = df.select("id", "seq").repartition("id").distinct()
    both = seqs.join(seqs.withColumnRenamed("seq", "seq_b"), "id").filter("seq < seq_b")
    return balance(both).withColumn("v", compare_sequences("seq", "seq_b", ignore_ends)).select("id", "seq", "seq_b", "v.*")


def compare_all(df: DataFrame, ignore_ends: bool = False) -> DataFrame:
    """Verdict for every pair of runs that hold an id."""
    pairs = distinct_pairs(df, ignore_ends)
    a = df.select("id", F.col("run").alias("run_a"), F.col("seq").alias("_a"))
    b = df.select("id", F.col("run").alias("run_b"), F.col("seq").alias("_b"))
    runs = a.join(b, "id").filter("run_a < run_b")
    keyed = runs.withColumn("seq", F.least("_a", "_b")).withColumn("seq_b", F.greatest("_a", "_b"))
    out = keyed.join(pairs, ["id", "seq", "seq_b"], "left")
    return out.select(
        "id", "run_a", "run_b", F.coalesce("state", F.lit("identical")).alias("state"),
        F.coalesce("d", F.lit(0)).alias("d"), F.coalesce("plain", F.lit(0)).alias("plain"), F.coalesce("rc", F.lit(False)).alias("rc"),
    )


def id_states(df: DataFrame, ignore_ends: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Worst state of each id over its runs, and its largest distances; ``pairs``: the verdicts, where they are there already."""
    pairs = (distinct_pairs(df, ignore_ends) if pairs is None else pairs).groupBy("id").agg(
        F.max(F.when(F.col("state") == "different", 2).when(F.col("state") == "compatible", 1).otherwise(0)).alias("_worst"),
        F.max(F.when(F.col("state") == "different", F.col("d"))).alias("diff_bases"),
        F.max(F.when(F.col("state") == "compatible", F.col("plain"))).alias("iupac_pos"),
    )
    runs = df.groupBy("id").agg(F.count(F.lit(1)).alias("n_runs"), F.min("run").alias("_only"))
    worst = F.coalesce("_worst", F.lit(0))
    state = F.when(F.col("n_runs") == 1, "unique").otherwise(F.get(F.array(*[F.lit(s) for s in STATES]), worst))
    return runs.join(pairs, "id", "left").select(
        "id", "n_runs", state.alias("state"), F.when(state == "unique", F.col("_only")).alias("only_in"), "diff_bases", "iupac_pos"
    )


def compare_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def best_barcode(df: DataFrame) -> DataFrame:
    """Best run per id; ``tie`` when several runs share the best quality."""
    by_quality = df.groupBy("id", "ambs", "gaps", "cov").agg(F.min("run").alias("run"), F.count(F.lit(1)).alias("_n"))
    best = first_per(by_quality, ["id"], ["ambs", "gaps", -F.col("cov")])
    return best.select("id", F.col("run").alias("best_run"), (F.col("_n") > 1).alias("tie"), "ambs", "gaps", "cov")


def variant_groups(df: DataFrame, ignore_ends: bool = False, pairs: DataFrame | None = None) -> DataFrame:
    """Number the distinct variants of an id in run order; equal and reverse-complemented records share one.

    With ``ignore_ends`` a record contained in another counts as equal, and the
    groups are the connected components of that relation.
    """
    if not ignore_ends:
        keyed = df.withColumn("_k", F.least("seq", revcomp("seq")))
    else:
        keyed = _components(df, distinct_pairs(df, True) if pairs is None else pairs)
    first = keyed.groupBy("id", "_k").agg(F.min("run").alias("_first"))
    # At most one row per run for an id, so this window stays small.
    numbered = first.withColumn("variant", F.row_number().over(Window.partitionBy("id").orderBy("_first")))
    return keyed.join(numbered, ["id", "_k"]).select("id", "run", "variant")


def _components(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """Add ``_k``, the same for all records of an id that such pairs link. Sequences meet by their digests, so none is stored or moved."""
    named = df.select("id", "run", _digest("seq"))
    links = pairs.filter("state = 'identical'").select("id", _digest("seq"), _digest("seq_b"))
    edges = cut(links.unionByName(links.select("id", F.col("seq_b").alias("seq"), F.col("seq").alias("seq_b"))))
    named = cut(named)
    labels = cut(named.select("id", "seq").distinct().withColumn("_k", F.col("seq")))
    while True:
        near = edges.join(labels.select("id", F.col("seq").alias("seq_b"), F.col("_k").alias("_n")), ["id", "seq_b"])
        low = near.groupBy("id", "seq").agg(F.min("_n").alias("_n"))
        step = labels.join(low, ["id", "seq"], "left").select("id", "seq", F.least("_k", F.coalesce("_n", "_k")).alias("_k"), F.col("_k").alias("_old"))
        step = cut(step)
        if step.filter("_k <> _old").isEmpty():
            break
        labels = step.drop("_old")
    return named.join(labels, ["id", "seq"])


def _digest(name: str) -> Column:
    return F.unhex(F.sha2(name, 256)).alias(name)


def compare_report(df: DataFrame, runs: Sequence, ignore_ends: bool = False) -> DataFrame:
    """One row per id: state, variants and their pattern over ``runs``, best run, distances, absent runs, metrics by run.

    Sequences are compared once for all of it. Of a run with several records of
    an id the pattern has the first variant.
    """
    runs = list(runs)
    pairs = cut(distinct_pairs(df, ignore_ends))
    variants = variant_groups(df, ignore_ends, pairs).groupBy("id", "run").agg(F.min("variant").alias("variant"))
    groups = variants.groupBy("id").agg(
        F.max("variant").alias("vars"), F.map_from_entries(F.collect_list(F.struct("run", "variant"))).alias("_g")
    )
    pattern = F.concat(*[F.coalesce(F.col("_g")[F.lit(r)].cast("string"), F.lit(".")) for r in runs])
    absent = F.concat_ws(",", *[F.when(F.col("_g")[F.lit(r)].isNull(), F.lit(str(r))) for r in runs])
    lengths = df.groupBy("id").agg(F.min(F.length("seq")).alias("_lo"), F.max(F.length("seq")).alias("_hi"))
    out = id_states(df, ignore_ends, pairs).join(groups, "id").join(best_barcode(df).select("id", "best_run", "tie"), "id").join(lengths, "id")
    best = (
        F.when(F.col("state") == "unique", F.col("only_in").cast("string"))
        .when(F.col("state") == "different", F.when(F.col("tie"), "Tie").otherwise(F.col("best_run").cast("string")))
        .otherwise("")
    )
    length = F.when(F.col("_lo") < F.col("_hi"), F.format_string("%d-%d bp", F.col("_lo"), F.col("_hi"))).otherwise("")
    wide = df.groupBy("id").pivot("run", runs).agg(
        F.max("length").alias("len"), F.max("cov").alias("cov"), F.max("ambs").alias("ambs"), F.max("gaps").alias("gaps")
    )
    return out.select(
        "id", "state", "vars", pattern.alias("pattern"), best.alias("best_run"), "diff_bases", "iupac_pos", length.alias("length"), absent.alias("absent")
    ).join(wide, "id")


def compare_outputs(df: DataFrame, ignore_ends: bool = False) -> DataFrame:
    """The records of the output sets, one row per set and record.

    Sets: best, identical, compatible (both from the first run that has the
    id), different (every run) and unique.
    """
    states = id_states(df, ignore_ends).select("id", "state")
    best = best_barcode(df).select("id", F.col("best_run").alias("run"))
    rows = df.select("id", "run", "seq").join(states, "id")
    first = first_per(rows.filter("state in ('identical','compatible')"), ["id"], ["run"])
    parts = [
        rows.drop("state").join(best, ["id", "run"]).select(F.lit("best").alias("set"), "id", "run", "seq"),
        first.select(F.col("state").alias("set"), "id", "run", "seq"),
        rows.filter("state in ('different','unique')").select(F.col("state").alias("set"), "id", "run", "seq"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def compare_ref(df: DataFrame, ref_run, ignore_ends: bool = False) -> DataFrame:
    """Each id's record in a run against the reference run's, or where it is missing."""
    ref = df.filter(F.col("run") == F.lit(ref_run)).select("id", F.col("seq").alias("_ref"))
    rest = df.filter(F.col("run") != F.lit(ref_run)).select("id", "run", "seq")
    both = ref.join(rest, "id", "full")
    distinct = both.filter("_ref <> seq").select("id", F.least("_ref", "seq").alias("_a"), F.greatest("_ref", "seq").alias("_b")).distinct()
    verdicts = balance(distinct).withColumn("v", compare_sequences("_a", "_b", ignore_ends)).select("id", "_a", "_b", "v.*")
    keyed = both.withColumn("_a", F.least("_ref", "seq")).withColumn("_b", F.greatest("_ref", "seq"))
    out = keyed.join(verdicts, ["id", "_a", "_b"], "left")
    state = (
        F.when(F.col("seq").isNull(), "only_in_reference")
        .when(F.col("_ref").isNull(), "not_in_reference")
        .when(F.col("_ref") == F.col("seq"), "identical")
        .otherwise(F.col("state"))
    )
    present = F.col("seq").isNotNull() & F.col("_ref").isNotNull()
    return out.select(
        "id", "run", state.alias("state"),
        *[F.when(present, F.coalesce(c, F.lit(0))).alias(c) for c in ("d", "plain")],
        F.when(present, F.coalesce("rc", F.lit(False))).alias("rc"),
        F.when(present, F.length("seq") - F.length("_ref")).alias("length_delta"),
    )


def compare_ref_report(df: DataFrame, ref_run, ignore_ends: bool = False) -> DataFrame:
    """Worst state of each id against the reference run."""
    order = {"identical": 0, "compatible": 1, "different": 2, "not_in_reference": 3, "only_in_reference": 4}
    rows = compare_ref(df, ref_run, ignore_ends)
    rank = F.lit(0)
    for name, n in order.items():
        rank = F.when(F.col("state") == name, n).otherwise(rank)
    return rows.groupBy("id").agg(
        F.max_by("state", rank).alias("state"),
        F.max(F.when(F.col("d") > 0, F.col("d"))).alias("diff_bases"),
        F.max(F.when(F.col("state") == "compatible", F.col("plain"))).alias("iupac_pos"),
        F.count("run").alias("n_runs"),
    )


def id_match_summary(df: DataFrame) -> DataFrame:
    """Per run: distinct ids, repeated records and headers no rule matched."""
    ids = df.groupBy("run", "id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.col("matched")).alias("_u"))
    return ids.groupBy("run").agg(
        F.count(F.lit(1)).alias("ids"), (F.sum("_n") - F.count(F.lit(1))).alias("repeated"), F.sum("_u").alias("unmatched")
    )


def shared_ids(df: DataFrame, n_runs: int) -> DataFrame:
    """Ids present in every run."""
    runs = df.select("run", "id").distinct().groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    return runs.filter(F.col("_n") == n_runs).select("id")


def only_in(df: DataFrame, run, other) -> DataFrame:
    """Ids that a run has and another has not, in one pass over the records."""
    runs = df.groupBy("id").agg(F.bool_or(F.col("run") == F.lit(run)).alias("_own"), F.bool_or(F.col("run") == F.lit(other)).alias("_other"))
    return runs.filter("_own and not coalesce(_other, false)").select("id")


def all_ids(*parts: DataFrame) -> DataFrame:
    """Union of the ids of several inputs."""
    out = parts[0].select("id")
    for part in parts[1:]:
        out = out.union(part.select("id"))
    return out.distinct()
