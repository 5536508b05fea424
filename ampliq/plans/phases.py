"""Barcoding from reads to final lists as chains of operators."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seq import ungap
from ..operators import consensus as C
from ..operators import reads as R
from ..operators.counts import count_sums, with_calls
from ..operators.nearest import nearest_refs
from ..operators.ordering import first_per
from ..session import cut


@dataclass(frozen=True)
class CallParams:
    """Consensus settings. ``code`` 0 stands for a non-coding marker; samples may have codes of their own."""

    plen: int = 658
    window: int = 100
    coverage: int = 100
    #: Numbers of reads to call with, in turn from the highest down; empty: ``coverage`` alone.
    levels: tuple[int, ...] = ()
    threshold: float = 0.3
    min_reads: int = 5
    low: float = 0.2
    high: float = 0.5
    step: float = 0.1
    code: int = 5
    tol: int = 0
    resolve: bool = True
    minor: float = 0.2
    min_frac: float = 0.2
    tolerance: float = 0.1
    cluster_reads: int = 3
    alert: float = 0.03

    @property
    def reads_used(self) -> tuple[int, ...]:
        """The levels from the highest down."""
        return tuple(sorted(set(self.levels or (self.coverage,)), reverse=True))


def demultiplex(reads: DataFrame, sheet: DataFrame, p: R.ReadParams) -> DataFrame:
    """Phase 1: length and quality filter, split, primers, tags; reads with their sample."""
    kept = R.filter_reads(reads, p.minlen, p.minq)
    cut_up = R.split_ligated(R.classify_length(kept, p), p)
    return R.assign_samples(R.locate_primers(cut_up, p), R.tag_variants(sheet, p.tagmm), sheet)


def call_aligned(aln: DataFrame, p: CallParams, codes: DataFrame | None = None) -> DataFrame:
    """Consensus of aligned reads: mixtures first, then the main threshold, then the sweep. ``codes``: (sample, code) of samples with their own code."""
    return call_packed(C.pack_reads(aln), p, codes)


def call_packed(packs: DataFrame, p: CallParams, codes: DataFrame | None = None) -> DataFrame:
    """The same from packed reads."""
    packs = cut(packs)
    return call_counted(cut(count_sums(C.unpack_reads(packs))), packs, p, codes)


def call_counted(matrix: DataFrame, aln: DataFrame, p: CallParams, codes: DataFrame | None = None) -> DataFrame:
    """The same from counts made before (``count_sums``); ``aln``, packed or not, is only read where mixtures are resolved."""
    code: int | Column = p.code
    if codes is not None:
        matrix, code = C.with_genetic_code(matrix, codes, p.code), F.col("code")
    # Both calls come from one look at a row's counts, the wide part of it.
    rows = with_calls(matrix, [p.threshold, *C.sweep_steps(p.low, p.high, p.step, p.threshold)])
    rows = C.with_swept(rows, F.filter("calls", lambda _, k: k > 0), code, p.plen, p.tol)
    base = C.qc_barcode(C.first_call(rows, p.min_reads).withColumn("seq", F.coalesce("seq", F.lit(""))), code, p.plen, p.tol)
    out = base.select("sample", "reads", "seq", "ok", "swept").withColumn("how", F.lit("threshold"))
    if p.resolve:
        clusters = C.haplotypes(aln, p.minor, p.min_frac, p.tolerance, p.cluster_reads, matrix)
        if codes is not None:
            clusters = C.with_genetic_code(clusters, codes, p.code)
        chosen = C.choose_haplotype(clusters, code, p.plen, p.tol, p.alert).filter("chosen")
        if codes is not None:
            chosen = C.with_genetic_code(chosen, codes, p.code)
        mixed = C.qc_barcode(chosen, code, p.plen, p.tol)
        mixed = mixed.select("sample", F.col("seq").alias("_m"), F.col("ok").alias("_mok"), "needs_review")
        both = out.join(mixed, "sample", "left")
        is_mixed = F.col("_m").isNotNull() & (F.col("reads") >= p.min_reads)
        out = both.select(
            "sample", "reads", F.when(is_mixed, F.col("_m")).otherwise(F.col("seq")).alias("seq"),
            F.when(is_mixed, F.col("_mok")).otherwise(F.col("ok")).alias("ok"),
            F.when(is_mixed, "haplotype").otherwise(F.col("how")).alias("how"),
            F.coalesce("needs_review", F.lit(False)).alias("needs_review"), "swept",
        )
    else:
        out = out.withColumn("needs_review", F.lit(False))
    use = ~F.col("ok") & (F.col("how") == "threshold") & F.col("swept").isNotNull()
    status = F.when(F.col("reads") < p.min_reads, "NA").when(F.col("ok") | use, "good").otherwise("failed")
    return out.select(
        "sample", "reads", F.when(use, F.col("swept")).otherwise(F.col("seq")).alias("seq"), (F.col("ok") | use).alias("ok"),
        F.when(use, "sweep").otherwise(F.col("how")).alias("how"), "needs_review", status.alias("status"),
    )


def count_levels(aln: DataFrame, p: CallParams) -> DataFrame:
    """Column counts of aligned, ranked reads for every level, as ``count_sums`` gives them."""
    return cut(count_sums(C.unpack_reads(aln) if C.PACKED in aln.columns else aln, rank="rn", levels=p.reads_used))


def call_levels(aln: DataFrame, coverage: DataFrame, p: CallParams, codes: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Consensus of aligned, ranked reads (sample, read_id, aln, rn), called with fewer and fewer reads until a sample is good, and the ``level`` it came from.

    The reads, packed or not, are counted once for all levels. A sample leaves the chain at the
    level that settles it, and passes over a level that its reads (``coverage``:
    sample, reads) do not exceed, as the level before had called just these; a
    level that no sample waits for is not begun. A sample that is never good
    keeps its last call. ``counts``: those of ``count_levels``, where they are
    there already.
    """
    levels = p.reads_used
    if counts is None:
        # Without mixtures the reads are counted once and not read again.
        if p.resolve:
            aln = cut(aln if C.PACKED in aln.columns else C.pack_reads(aln.select("sample", "rn", "aln")))
        counts = count_levels(aln, p)
    waiting, made = None, []
    for level in levels:
        own, reads = counts.filter(F.col("level") == level).drop("level"), aln
        if waiting is not None:
            these = cut(waiting.join(samples_for_level(coverage, level), "sample", "left_semi"))
            if these.isEmpty():
                continue
            own, reads = own.join(these, "sample", "left_semi"), reads.join(these, "sample", "left_semi")
        if p.resolve and level < levels[0]:
            rows = C.unpack_reads(reads) if C.PACKED in reads.columns else reads
            reads = C.pack_reads(rows.filter(F.col("rn") <= level).select("sample", "aln"))
        called = cut(call_counted(own, reads, p, codes).withColumn("level", F.lit(level)))
        made.append(called)
        settled = called.filter("ok").select("sample")
        waiting = (called if waiting is None else waiting).select("sample").join(settled, "sample", "left_anti")
    return first_per(reduce(DataFrame.unionByName, made), ["sample"], ["level"])


def consensus_by_length(assigned: DataFrame, p: CallParams, codes: DataFrame | None = None) -> DataFrame:
    """Phase 2a: the reads closest to the expected length, aligned once and called level by level, with the length-mode warning.

    Levels share the template and the alignment: columns that only reads of a
    higher level fill are gaps throughout below it, and fall out of the barcode.
    """
    subset = C.subset_by_length(assigned.select("sample", "read_id", "seq"), p.plen, p.window, p.reads_used[0])
    return consensus_of_subset(subset, cut(R.sample_coverage(assigned)), C.length_modes(assigned), p, codes)


def consensus_of_subset(subset: DataFrame, coverage: DataFrame, modes: DataFrame, p: CallParams, codes: DataFrame | None = None) -> DataFrame:
    """Phase 2a from reads chosen before (sample, read_id, seq, rn); ``coverage`` names every sample and its reads."""
    called = call_levels(C.align_packed(subset), coverage, p, codes)
    total = coverage.withColumnRenamed("reads", "coverage")
    out = total.join(called, "sample", "left").join(modes.select("sample", "mode1", "mode2"), "sample", "left")
    return out.withColumn("status", F.coalesce("status", F.lit("NA")))


def samples_for_level(coverage: DataFrame, level: int) -> DataFrame:
    """Samples with more reads than a level: for others it would call the very reads of the level before."""
    return coverage.filter(F.col("reads") > level)


def check_set(barcodes: DataFrame) -> DataFrame:
    """Phase 2 check: good barcodes aligned together and their gaps against the set's consensus."""
    # The alignment asks for single values of the set, which are best scans of what is fixed.
    good = cut(barcodes.filter("ok").select(F.col("sample").alias("read_id"), "seq"))
    return C.set_gaps(good).select(F.col("read_id").alias("sample"), "estgaps", F.col("good").alias("predicted_good"))


def consensus_by_similarity(assigned: DataFrame, failed: DataFrame, p: CallParams, codes: DataFrame | None = None) -> DataFrame:
    """Phase 2b: reads like each failed barcode, aligned and called again."""
    near = C.similar_reads(assigned.select("sample", "read_id", "seq"), failed, p.plen, p.coverage)
    return call_packed(C.align_packed(near), p, codes)


def final_lists(calls: DataFrame, checked: DataFrame) -> DataFrame:
    """Barcodes that pass QC, and of these the filtered ones: no gap against the set."""
    both = calls.join(checked, "sample", "left")
    return both.select(
        "sample", "seq", F.col("ok").alias("no_errors"), (F.col("ok") & F.coalesce(F.col("estgaps") == 0, F.lit(False))).alias("filtered")
    )


def neighbours(failed: DataFrame, library: DataFrame, k: int = 20) -> DataFrame:
    """Phase 3, first half: the nearest reference barcodes of each failed one."""
    return nearest_refs(failed.select(F.col("sample").alias("id"), "seq"), library, k)


# -- sweep ---------------------------------------------------------------------------------------


def sweep_thresholds(matrix: DataFrame, combos: DataFrame, plen: int, tol: int, code: int) -> DataFrame:
    """Consensus of every sample under every combination (run, threshold), from one set of column counts.

    Columns are called once per distinct threshold, so combinations that share
    one cost nothing.
    """
    distinct = [r[0] for r in combos.select("threshold").distinct().orderBy("threshold").collect()]
    seqs = F.arrays_zip(F.array(*[F.lit(float(t)) for t in distinct]).alias("threshold"), F.transform("calls", ungap).alias("seq"))
    tried = with_calls(matrix, distinct).select("sample", "reads", F.explode(seqs).alias("_s")).select("sample", "reads", "_s.*")
    good = C.qc_barcode(tried.filter("reads >= 5"), code, plen, tol)
    return combos.join(good, "threshold")
