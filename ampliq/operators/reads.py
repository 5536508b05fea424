"""Reads: filters, length classes, quality statistics, tags, primers and samples."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.iupac import equal_letters, locate
from ..functions.seq import COMPLEMENT_FROM, COMPLEMENT_TO, gc_pct, mean_error
from ..functions.text import natural_key
from ..session import cut
from .records import ranks_of_counts


@dataclass(frozen=True)
class ReadParams:
    """Lengths and tolerances of demultiplexing."""

    minlen: int = 0
    explen: int = 658
    demlen: int = 50
    minq: float = 0.0
    taglen: int = 13
    primers_f: tuple[str, ...] = ()
    primers_r: tuple[str, ...] = ()
    window: int = 100
    primermm: int = 10
    tagmm: int = 2

    @property
    def product(self) -> int:
        """Expected length of one tagged product."""
        mean = [sum(map(len, p)) / len(p) if p else 0 for p in (self.primers_f, self.primers_r)]
        return self.explen + 2 * self.taglen + round(sum(mean))


# -- filters and length classes ---------------------------------------------------------


def filter_reads(df: DataFrame, minlen: int = 0, minq: float = 0.0) -> DataFrame:
    """Reads longer than ``minlen`` and, with ``minq``, of at least that mean quality.

    The length test stands in a filter of its own below the quality function,
    so qualities are worked out for long enough reads only.
    """
    out = df.filter(F.length("seq") > minlen)
    if minq > 0:
        out = out.filter(_quality(99.0) >= minq)
    return out


def _quality(perfect: float) -> Column:
    error = mean_error("qual")
    return F.coalesce(F.when(error > 0, -10.0 * F.log10(error)).otherwise(F.when(error == 0, perfect)), F.lit(perfect))


def classify_length(df: DataFrame, p: ReadParams) -> DataFrame:
    """Add ``kind``: single, double (two ligated products) or wrong."""
    n, size = F.length("seq"), p.product
    kind = (
        F.when(n < size + p.demlen, "single")
        .when((n > 2 * size - p.demlen) & (n < 2 * (size + p.demlen)), "double")
        .otherwise("wrong")
    )
    return df.withColumn("kind", kind)


def split_ligated(df: DataFrame, p: ReadParams) -> DataFrame:
    """Cut double products in two overlapping halves, suffixed p1 and p2; drop wrong lengths."""
    one = F.struct(F.col("read_id").cast("string").alias("id"), F.col("seq").alias("s"))
    halves = F.array(
        F.struct(F.concat(F.col("read_id").cast("string"), F.lit("p1")).alias("id"), F.substr("seq", F.lit(1), F.lit(p.product + p.demlen)).alias("s")),
        F.struct(F.concat(F.col("read_id").cast("string"), F.lit("p2")).alias("id"), F.substr("seq", F.lit(p.product - p.demlen + 1)).alias("s")),
    )
    rest = [c for c in df.columns if c not in ("read_id", "seq", "qual", "kind")]
    cut_up = df.filter("kind <> 'wrong'").select(*rest, F.explode(F.when(F.col("kind") == "double", halves).otherwise(F.array(one))).alias("_p"))
    return cut_up.select(*rest, F.col("_p.id").alias("read_id"), F.col("_p.s").alias("seq"))


def read_funnel(df: DataFrame, p: ReadParams, assigned: DataFrame | None = None) -> DataFrame:
    """Reads at each step before demultiplexing, in one pass, and how many of ``assigned`` (reads with their sample) there are."""
    size = F.length("seq")
    long = size > p.minlen
    good = (F.when(long, _quality(99.0)) >= p.minq) if p.minq > 0 else F.lit(True)
    rows = classify_length(df, p).select(
        F.when(~long, "short").when(~good, "low_q").otherwise(F.col("kind")).alias("status")
    )
    count = {s: F.count_if(F.col("status") == s) for s in ("short", "low_q", "single", "double", "wrong")}
    funnel = rows.agg(
        F.count(F.lit(1)).alias("total"),
        count["short"].alias("too_short"),
        count["low_q"].alias("low_quality"),
        *[count[s].alias(s) for s in ("single", "double")],
        count["wrong"].alias("wrong_length"),
        (count["single"] + 2 * count["double"]).alias("after_split"),
    )
    return funnel if assigned is None else funnel.withColumn("assigned", F.lit(assigned.count()))


# -- FASTQ statistics -----------------------------------------------------------------------


def read_values(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    """Length, quality and GC of each read; reads without a quality string get quality 0."""
    error = mean_error("qual")
    q = F.when(error > 0, -10.0 * F.log10(error)).when(error == 0, 60.0).otherwise(0.0)
    return df.filter("seq <> ''").select(*keep, F.length("seq").cast("bigint").alias("length"), q.alias("q"), gc_pct("seq").alias("gc"))


def _sums() -> list[Column]:
    size, q = F.col("length"), F.col("q")
    return [
        F.count(F.lit(1)).alias("reads"),
        F.sum("length").alias("bases"),
        F.count_if(size < 500).alias("lt500"),
        F.count_if((size >= 500) & (size <= 1000)).alias("from500to1000"),
        F.count_if(size > 1000).alias("gt1000"),
        F.sum("q").alias("q_sum"),
        *[F.count_if(q >= t).alias(f"reads_q{t}") for t in (10, 15, 20)],
        *[F.coalesce(F.sum(F.when(q >= t, size)), F.lit(0)).alias(f"bases_q{t}") for t in (10, 15, 20)],
        F.avg("gc").alias("gc_mean"),
        F.coalesce(F.stddev_samp("gc"), F.lit(0.0)).alias("gc_std"),
    ]


def _rank_of(lengths: DataFrame, share: float, name: str) -> Column:
    n = F.col("_total")
    at = F.greatest(F.lit(0), F.floor(n * share)) if share < 0.5 else F.least(n - 1, F.floor(n * share))
    return F.min(F.when(F.col("_rank") > at, F.col("length"))).alias(name)


def fastq_stats(df: DataFrame) -> DataFrame:
    """Summary of all reads; ranks of lengths come from the table of distinct lengths."""
    values = read_values(df)
    sums = values.agg(*_sums())
    # Distinct read lengths: a bounded table, so one window over it is fine.
    counts = cut(values.groupBy("length").agg(F.count(F.lit(1)).alias("_n")))
    ranked = counts.withColumn("_rank", F.sum("_n").over(Window.orderBy("length"))).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    p = ranked.agg(_rank_of(ranked, 0.01, "len_p01"), _rank_of(ranked, 0.99, "len_p99"))
    mid = ranks_of_counts(counts.withColumn("run", F.lit(1)), "run", "length").drop("run", "l50")
    span = counts.agg(F.min("length").alias("min_length"), F.max("length").alias("max_length"))
    one = [x.withColumn("_one", F.lit(1)) for x in (sums, p, mid, span)]
    out = one[0]
    for other in one[1:]:
        out = out.join(other, "_one")
    r = F.col("reads")
    return out.select(
        "reads", "bases", F.round(F.col("bases") / r, 6).alias("mean_length"), "median_length", "min_length", "max_length", "n50",
        "lt500", "from500to1000", "gt1000", F.round(F.col("q_sum") / r, 6).alias("mean_q"),
        *[F.round(100.0 * F.col(f"reads_q{t}") / r, 6).alias(f"q{t}_pct") for t in (10, 15, 20)],
        *[F.round(100.0 * F.col(f"bases_q{t}") / F.col("bases"), 6).alias(f"bases_q{t}_pct") for t in (10, 15, 20)],
        F.round("gc_mean", 6).alias("mean_gc"), F.round("gc_std", 6).alias("std_gc"), "len_p01", "len_p99",
    )


def fastq_histograms(df: DataFrame, bins: int = 60) -> DataFrame:
    """Counts in ``bins`` bins of length (P1 to P99), quality (min to max) and GC (0 to 100)."""
    values = cut(read_values(df))
    stats = values.groupBy("length").agg(F.count(F.lit(1)).alias("_n"))
    ranked = stats.withColumn("_rank", F.sum("_n").over(Window.orderBy("length"))).withColumn("_total", F.sum("_n").over(Window.partitionBy()))
    lo, hi = ranked.agg(_rank_of(ranked, 0.01, "a"), _rank_of(ranked, 0.99, "b")).first()
    q_lo, q_hi = values.agg(F.min("q"), F.max("q")).first()
    ranges = {"length": (lo or 0, hi or 0), "q": (q_lo or 0.0, q_hi or 0.0), "gc": (0.0, 100.0)}
    long = values.select(
        F.explode(F.array(*[F.struct(F.lit(k).alias("value"), F.col(k).cast("double").alias("v"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in ranges.items()])).alias("x")
    ).select("x.*").filter("v between a and b")
    span = F.when(F.col("b") > F.col("a"), F.col("b") - F.col("a")).otherwise(1.0)
    bin_no = F.least(F.floor((F.col("v") - F.col("a")) / span * bins), F.lit(bins - 1)).cast("int")
    return long.groupBy("value", bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def fastq_by_group(df: DataFrame, group: str = "grp", file: str = "file") -> DataFrame:
    """Files, reads, bases and quality per group, with the place of each in natural order."""
    per_file = read_values(df, [group, file]).groupBy(group, file).agg(*_sums())
    per = per_file.groupBy(group).agg(
        F.count(F.lit(1)).alias("files"), *[F.sum(c).alias(c) for c in ("reads", "bases", "q_sum", "reads_q10", "bases_q10")]
    )
    # One row per group from here on.
    total = F.sum("reads").over(Window.partitionBy())
    return per.select(
        group, F.row_number().over(Window.orderBy(natural_key(group), group)).alias("place"), "files", "reads", "bases",
        F.round(100.0 * F.col("reads") / total, 6).alias("reads_pct"),
        F.round(F.col("bases") / F.col("reads"), 6).alias("mean_length"),
        F.round(F.col("q_sum") / F.col("reads"), 6).alias("mean_q"),
        F.round(100.0 * F.col("reads_q10") / F.col("reads"), 6).alias("q10_pct"),
        F.round(100.0 * F.col("bases_q10") / F.col("bases"), 6).alias("bases_q10_pct"),
    )


def sample_reads(df: DataFrame, n: int = 10000) -> DataFrame:
    """Length and quality of at most ``n`` reads, the same ones each time."""
    key = F.md5(F.col("read_id").cast("string"))
    chosen = df.filter("seq <> ''").orderBy(key, "read_id").limit(n)
    return read_values(chosen, ["read_id"]).drop("gc")


# -- tags and samples -------------------------------------------------------------------------


def tag_ids(sheet: DataFrame) -> DataFrame:
    """Distinct tags of a sample sheet."""
    return sheet.select(F.explode(F.array("tag_f", "tag_r")).alias("variant")).distinct().withColumn("tag", F.col("variant"))


def _mutants(tag: Column) -> Column:
    """All one-step changes of a tag that keep its length.

    Substitutions anywhere; deletions behind the first letter with a new first
    letter; insertions behind the first letter that push the first one out.
    """
    n = F.length(tag)
    letters = F.array(*[F.lit(b) for b in "ATGC"])
    spots = F.sequence(F.lit(1), n)
    inner = F.filter(spots, lambda i: i > 1)

    def around(positions, make):
        return F.flatten(F.transform(positions, lambda i: F.transform(letters, lambda b: make(i, b))))

    subs = around(spots, lambda i, b: F.concat(F.substr(tag, F.lit(1), i - 1), b, F.substr(tag, i + 1)))
    dels = around(inner, lambda i, b: F.concat(b, F.substr(tag, F.lit(1), i - 1), F.substr(tag, i + 1)))
    # An insertion before the last letter keeps it; at the last place the new letter ends the tag.
    ins = around(
        inner,
        lambda i, b: F.when(i < n, F.concat(F.substr(tag, F.lit(2), i - 2), b, F.substr(tag, i))).otherwise(F.concat(F.substr(tag, F.lit(2)), b)),
    )
    return F.array_distinct(F.concat(subs, dels, ins))


def tag_variants(sheet: DataFrame, tagmm: int) -> DataFrame:
    """Spellings of each tag within ``tagmm`` steps: variant, tag, depth.

    Each round changes only what the round before found. A spelling reached
    from two tags in one round belongs to neither, and may come again later.
    """
    known = tag_ids(sheet).withColumn("depth", F.lit(0))
    frontier = known
    for depth in range(1, tagmm + 1):
        grown = frontier.select(F.explode(_mutants(F.col("variant"))).alias("variant"), "tag")
        owners = grown.groupBy("variant").agg(F.min("tag").alias("tag"), F.max("tag").alias("_other"))
        fresh = owners.filter("tag = _other").select("variant", "tag").join(known.select("variant"), "variant", "left_anti")
        frontier = cut(fresh.withColumn("depth", F.lit(depth)))
        known = known.unionByName(frontier)
    return known


def locate_primers(reads: DataFrame, p: ReadParams) -> DataFrame:
    """Best forward and reverse primer of each read on either strand, its tags and the insert between.

    All reads of a batch are searched at once; the primers are the few of the
    sample sheet's first row. Reads without both primers and full tags drop out.
    """
    equal = equal_letters("base")
    flip = bytes.maketrans(COMPLEMENT_FROM.encode(), COMPLEMENT_TO.encode())
    taglen, width, most = p.taglen, p.window, p.primermm
    back = [q.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1] for q in p.primers_r]
    rest = [c for c in reads.columns if c not in ("seq", "qual")]

    def matrix(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        size = np.array([len(t) for t in texts], dtype=np.int64)
        flat = b"".join(t.ljust(width, b"\0") for t in texts)
        return np.frombuffer(flat, dtype=np.uint8).reshape(len(texts), width), size

    def search(seqs: list[bytes]):
        n = len(seqs)
        rc = [s.translate(flip)[::-1] for s in seqs]
        best = np.full(n, 1 << 30, dtype=np.int64)
        out: list = [None] * n
        heads = [matrix([s[:width] for s in x]) for x in (seqs, rc)]
        for primer in p.primers_f:
            hits = [locate(primer, *h, equal) for h in heads]
            other = np.where(hits[0][0] == 0, 1, hits[1][0])
            turned = hits[0][0] > other
            d_f = np.where(turned, hits[1][0], hits[0][0])
            start = np.where(turned, hits[1][1], hits[0][1])
            end = np.where(turned, hits[1][2], hits[0][2])
            live = np.flatnonzero((d_f <= most) & (start >= taglen))
            tails = []
            for i in live:
                text = rc[i] if turned[i] else seqs[i]
                tails.append(text[end[i] + 1 :])
            keep = [k for k, t in enumerate(tails) if t]
            live, tails = live[keep], [tails[k] for k in keep]
            if not tails:
                continue
            # Where each tail's searched part begins: a short tail is searched from its first letter on.
            begin = [max(len(t) - width, 0) for t in tails]
            ends = matrix([t[a:] for t, a in zip(tails, begin)])
            for primer_r in back:
                d_r, s_r, e_r = locate(primer_r, *ends, equal)
                for k in np.flatnonzero(d_r <= most):
                    i, tail = live[k], tails[k]
                    insert_end, tag_at = begin[k] + s_r[k], begin[k] + e_r[k] + 1
                    if tag_at + taglen > len(tail):
                        continue
                    total = d_f[i] + d_r[k]
                    if total < best[i]:
                        best[i] = total
                        text = rc[i] if turned[i] else seqs[i]
                        tag_r = tail[tag_at : tag_at + taglen].translate(flip)[::-1]
                        out[i] = (text[start[i] - taglen : start[i]], tag_r, tail[:insert_end], "-" if turned[i] else "+", int(total))
        return out

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = search([(s or "").upper().encode() for s in batch.column("seq").to_pylist()])
            keep = [i for i, f in enumerate(found) if f is not None]
            rows = [found[i] for i in keep]
            cols = list(zip(*rows)) if rows else [[]] * 5
            index = pa.array(keep, pa.int64())
            arrays = [batch.column(c).take(index) for c in rest]
            arrays += [pa.array([x.decode() for x in cols[j]], pa.string()) for j in range(3)]
            arrays += [pa.array(cols[3], pa.string()), pa.array(cols[4], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "tag_f", "tag_r", "insert", "strand", "primer_dist"])

    types = dict(reads.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in rest] + ["tag_f string", "tag_r string", "insert string", "strand string", "primer_dist int"])
    return reads.mapInArrow(run, schema)


def assign_samples(located: DataFrame, variants: DataFrame, sheet: DataFrame) -> DataFrame:
    """Sample of each read by its two tags; the read id gains the depth of both and their sum.

    The variant table grows with the sheet, so its joins carry no broadcast
    hint: Spark broadcasts it only while its measured size allows.
    """
    f = variants.select(F.col("variant").alias("tag_f"), F.col("tag").alias("_tf"), F.col("depth").alias("_df"))
    r = variants.select(F.col("variant").alias("tag_r"), F.col("tag").alias("_tr"), F.col("depth").alias("_dr"))
    pairs = sheet.groupBy(F.col("tag_f").alias("_tf"), F.col("tag_r").alias("_tr")).agg(F.max("sample").alias("sample"))
    both = located.join(f, "tag_f").join(r, "tag_r").join(pairs, ["_tf", "_tr"])
    d1, d2 = F.col("_df"), F.col("_dr")
    name = F.concat_ws("_", F.col("read_id").cast("string"), d1.cast("string"), d2.cast("string"), (d1 + d2).cast("string"))
    return both.select(
        *[name.alias(c) if c == "read_id" else F.col(c) for c in located.columns if c not in ("tag_f", "tag_r", "insert")],
        "sample", F.col("insert").alias("seq"),
    )


def sample_coverage(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("sample").agg(F.count(F.lit(1)).alias("reads"))
