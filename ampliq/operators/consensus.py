"""Consensus of aligned reads (sample, read_id, aln), mixtures of haplotypes and barcode checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.align import gaps_on, place, place_on, spread, spread_one
from ..functions.iupac import divergence, edit_iupac
from ..functions.packs import runs_of, squeeze_texts
from ..functions.seq import count_char, gaps_apart, orf_trim, ungap
from ..session import balance, cut, deal
from .counts import count_sums, second_bases, with_calls
from .packing import PACKED, pack_reads, packed_type, unpack_reads
from .ordering import top_n_per

ORF_COVERAGE = 0.95
#: Bytes of packed reads given out together.
PIECE = 1 << 22


# -- columns and calls ---------------------------------------------------------------------


def consensus(aln: DataFrame, threshold: float = 0.3, min_reads: int = 5, strict: bool = False, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Column-majority consensus per key; NULL below ``min_reads``."""
    return call_columns(count_sums(aln, keys), threshold, min_reads, strict)


def call_columns(matrix: DataFrame, threshold: float, min_reads: int, strict: bool = False) -> DataFrame:
    """Consensus from counts made before; no row moves."""
    return first_call(with_calls(matrix, [threshold], strict), min_reads).drop("calls")


def first_call(rows: DataFrame, min_reads: int) -> DataFrame:
    """Add the first of the ``calls``, aligned and without gaps; NULL below ``min_reads``."""
    aligned = F.when(F.col("reads") >= min_reads, F.get("calls", F.lit(0)))
    return rows.withColumn("aligned", aligned).withColumn("seq", ungap("aligned"))


def sweep_steps(low: float, high: float, step: float, fixed: float) -> list[float]:
    """Thresholds from high to low in whole steps, without the fixed one."""
    steps = round((high - low) / step) if step > 0 else 0
    tried = [round(high - k * step, 6) for k in range(steps + 1)]
    return [t for t in tried if t >= low - 1e-9 and abs(t - fixed) > 1e-9]


def passes_qc(seq: Column, code: int | Column, plen: int, tol: int) -> Column:
    """struct(ok, seq): coding barcodes must be of length, clean and one long ORF; others (code 0) only clean.

    A column of codes gives every row its own.
    """
    clean = count_char(seq, "N") == 0
    free = F.struct(((seq != "") & clean).alias("ok"), seq.alias("seq"))
    if isinstance(code, int) and code == 0:
        return free
    orf = orf_trim(seq, code)
    ok = clean & (F.abs(F.length(seq) - plen) <= tol) & (orf["aa"] * 3 >= F.length(seq) * ORF_COVERAGE) & (seq != "")
    coding = F.struct(ok.alias("ok"), F.when(ok, orf["seq"]).otherwise(seq).alias("seq"))
    return coding if isinstance(code, int) else F.when(code == 0, free).otherwise(coding)


def with_swept(rows: DataFrame, calls: Column, code: int | Column, plen: int, tol: int) -> DataFrame:
    """Add ``swept``: the sequence of a row of 5 reads and more when all passing ones of its aligned ``calls`` agree on exactly one, else null."""
    tried = F.array_distinct(F.transform(calls, ungap))
    passed = F.array_distinct(F.transform(F.filter(F.transform("_t", lambda s: passes_qc(s, code, plen, tol)), lambda q: q["ok"]), lambda q: q["seq"]))
    rows = rows.withColumn("_t", F.when(F.col("reads") >= 5, tried)).withColumn("_p", passed)
    return rows.withColumn("swept", F.when(F.size("_p") == 1, F.get("_p", F.lit(0)))).drop("_t", "_p")


def consensus_sweep(matrix: DataFrame, thresholds: Sequence[float], code: int | Column, plen: int, tol: int) -> DataFrame:
    """Sequence of each sample when all passing thresholds agree on exactly one; every sample stays a row of its own."""
    rows = with_calls(matrix.filter("reads >= 5"), thresholds)
    return with_swept(rows, F.col("calls"), code, plen, tol).filter("swept is not null").select("sample", F.col("swept").alias("seq"))


# -- mixtures --------------------------------------------------------------------------------


def polymorphic_columns(matrix: DataFrame, minor: float = 0.2) -> DataFrame:
    """Columns whose second base reaches ``minor`` of all reads, in samples with 4 reads and 2 such columns."""
    return second_bases(matrix, minor)


def _signature() -> Column:
    """Letters of a read at the places ``_p``."""
    return F.array_join(F.transform("_p", lambda p: F.substr(F.upper("aln"), p + 1, F.lit(1))), "")


def _cluster(found: list[tuple[str, int]], tolerance: float) -> list[tuple[str, int, int]]:
    """Greedy clusters (sig, cluster, n) of one sample's distinct signatures with their read counts."""
    found = sorted(found, key=lambda f: (-f[1], f[0]))
    letters = np.array([list(sig.encode()) for sig, _ in found], dtype=np.uint8)
    weight = np.array([n for _, n in found])
    wild = np.array([ord("-"), ord("N")], dtype=np.uint8)
    reach = int(round(max(0.0, tolerance) * letters.shape[1]))
    free = np.ones(len(found), dtype=bool)
    label = np.full(len(found), -1)

    def near(center: np.ndarray) -> np.ndarray:
        differs = (letters != center) & ~np.isin(letters, wild) & ~np.isin(center, wild)
        return free & (differs.sum(axis=1) <= reach)

    def majority(members: np.ndarray) -> np.ndarray:
        total = weight[members].sum()
        center = np.full(letters.shape[1], ord("N"), dtype=np.uint8)
        for ch in np.unique(letters[members]):
            share = ((letters[members] == ch) * weight[members, None]).sum(axis=0) / total
            center[share > 0.5] = ch
        return center

    for seed in range(len(found)):
        if not free[seed]:
            continue
        members = near(letters[seed])
        free &= ~members
        more = near(majority(members))
        free &= ~more
        label[members | more] = seed
    return [(sig, int(k), n) for (sig, n), k in zip(found, label)]


def _clustering(tolerance: float):
    """``_cluster`` for the rows (sample, sig, n) of each sample, which come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def told(batches):
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("sample").type
                yield batch

        def given(rows: list) -> pa.RecordBatch:
            types = (("sample", kind), ("sig", pa.string()), ("cluster", pa.int32()), ("n", pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], [name for name, _ in types])

        rows: list = []
        for sample, own in runs_of(told(batches)):
            rows += [(sample, *found) for found in _cluster([(sig, n) for _, sig, n in own], tolerance)]
            if len(rows) > 10_000:
                yield given(rows)
                rows = []
        if rows:
            yield given(rows)

    return run


def haplotypes(
    aln: DataFrame, minor: float = 0.2, min_frac: float = 0.2, tolerance: float = 0.10, min_reads: int = 3, matrix: DataFrame | None = None
) -> DataFrame:
    """Real haplotype clusters of mixed-looking samples: rank, size, frac, aligned consensus, role.

    ``aln``: aligned reads, or these as ``pack_reads`` lays them. Signatures and
    consensus are counted by Spark, and reads move packed. Only the distinct
    signatures of a sample with their counts, which are no more than its reads
    and those are limited by ``subset_by_length``, meet in one task for the
    greedy walk.
    """
    packs = aln if PACKED in aln.columns else pack_reads(aln.select("sample", "aln"))
    poly = cut(polymorphic_columns(count_sums(unpack_reads(packs)) if matrix is None else matrix, minor))
    spots = poly.groupBy("sample").agg(F.array_sort(F.collect_list("pos")).alias("_p"))
    placed = packs.select("sample", PACKED).join(spots, "sample")
    distinct = unpack_reads(placed).select("sample", _signature().alias("sig")).groupBy("sample", "sig").agg(F.count(F.lit(1)).alias("n"))
    sample_type = dict(aln.dtypes)["sample"]
    labels = distinct.repartition("sample").sortWithinPartitions("sample").select("sample", "sig", "n")
    labels = cut(labels.mapInArrow(_clustering(tolerance), f"sample {sample_type}, sig string, cluster int, n long"))
    # A sample's signatures are no more than its reads.
    known = labels.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct("sig", "cluster"))).alias("_k"))
    members = unpack_reads(placed.join(known, "sample")).select("sample", F.element_at("_k", _signature()).alias("cluster"), "aln")
    found = consensus(members, 0.5, 0, keys=["sample", "cluster"])
    total = labels.groupBy("sample").agg(F.sum("n").alias("n"))
    poly_n = poly.groupBy("sample").agg(F.count(F.lit(1)).alias("n_poly"))
    sized = found.join(total, "sample").join(poly_n, "sample").withColumn("frac", F.col("reads") / F.col("n"))
    # Clusters of one sample: a handful of rows.
    order = Window.partitionBy("sample").orderBy(F.col("reads").desc(), "aligned", "cluster")
    ranked = sized.withColumn("rank", F.row_number().over(order))
    real = (F.col("frac") >= min_frac) & (F.col("reads") >= max(3, int(min_reads)))
    ranked = ranked.withColumn("_real", real).withColumn("_any", F.max(real.cast("int")).over(Window.partitionBy("sample")))
    kept = ranked.filter(F.col("_real") | ((F.col("_any") == 0) & (F.col("rank") == 1)))
    noise = F.when(F.col("_any") == 1, F.col("n") - F.sum("reads").over(Window.partitionBy("sample"))).otherwise(0)
    return kept.select(
        "sample", F.row_number().over(order).alias("rank"), F.col("reads").alias("size"), "frac", "aligned", ungap("aligned").alias("seq"), "n_poly", noise.alias("n_noise"),
        F.count(F.lit(1)).over(Window.partitionBy("sample")).alias("n_clusters"),
    ).withColumn("role", F.when(F.col("rank") == 1, "dominant").otherwise("secondary"))


def choose_haplotype(
    clusters: DataFrame, code: int | Column, plen: int, tol: int, alert: float = 0.03, pass_div: float = 0.01, max_variants: int = 3, max_ns: int = 5
) -> DataFrame:
    """Clusters of mixed samples with the chosen one, divergences from it and the review flags; a column of codes gives every row its own."""
    mixed = clusters.filter("n_clusters >= 2").withColumn("len", F.length("seq")).withColumn("n_n", count_char(F.col("seq"), "N"))
    code = F.lit(code) if isinstance(code, int) else code
    aa = F.when(code != 0, orf_trim("seq", code)["aa"])
    # Null for markers that do not code.
    mixed = mixed.withColumn("translates", F.when(code != 0, (F.col("seq") != "") & (aa * 3 >= F.col("len") * ORF_COVERAGE)))
    free, reads_through = F.col("translates").isNull(), F.coalesce("translates", F.lit(False))
    # Of coding ones, without any translating cluster the largest one stands.
    key = F.struct(
        (~free & ~reads_through).alias("t"),
        F.when(free | reads_through, F.col("n_n")).otherwise(0).alias("a"),
        F.when(reads_through, F.abs(F.col("len") - plen)).otherwise(0).alias("b"),
        F.when(free | reads_through, -F.col("size")).otherwise(0).alias("c"),
        F.col("rank"),
    )
    qc = (F.col("n_n") == 0) & (free | (reads_through & (F.abs(F.col("len") - plen) <= tol)))
    mixed = mixed.withColumn("passes", qc)
    best = mixed.groupBy("sample").agg(F.min_by(F.struct("rank", "seq"), key).alias("_b"))
    both = mixed.join(best, "sample").withColumn("chosen", F.col("rank") == F.col("_b.rank"))
    both = both.withColumn("divergence", F.when(F.col("chosen"), 0.0).otherwise(divergence("_b.seq", "seq")))
    per = Window.partitionBy("sample")
    eligible = F.sum((~F.col("chosen") & (F.col("n_n") < max_ns)).cast("int")).over(per)
    return both.select(
        "sample", "rank", "size", "frac", "seq", "len", "n_n", "translates", "passes", "divergence", "chosen",
        F.when(F.col("chosen"), "dominant").otherwise("secondary").alias("role"),
        (F.max(F.when(F.col("chosen"), F.col("rank"))).over(per) > 1).alias("not_largest"),
        (F.max("divergence").over(per) >= alert).alias("divergent"),
        F.max((~F.col("chosen") & F.col("passes") & (F.col("divergence") >= pass_div)).cast("int")).over(per).cast("boolean").alias("several_pass"),
        F.greatest(eligible - max_variants, F.lit(0)).alias("n_extra"),
    ).withColumn("needs_review", F.col("not_largest") | F.col("divergent") | F.col("several_pass"))


def variant_tiers(
    variants: DataFrame, coding: bool, min_reads: int = 10, alert: float = 0.03, max_variants: int = 3
) -> DataFrame:
    """Export tier of each secondary variant (sample, rank, size, frac, n_n, divergence, translates).

    quality: well supported and clean, the best ``max_variants`` of a sample;
    alert: divergent enough to mean contamination, never limited; trace:
    divergent but weak; counted: the rest.
    """
    sound = (F.col("frac") >= 0.2) & (F.col("size") >= min_reads) & (F.col("n_n") == 0)
    if coding:
        sound = sound & F.coalesce("translates", F.lit(False))
    far = F.col("divergence") >= alert
    alarm = far & (F.col("frac") >= 0.1) & (F.col("size") >= 5) & (F.col("n_n") <= 2)
    marked = variants.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    best = top_n_per(marked.filter("_ok").select("sample", "rank", "size"), ["sample"], [F.col("size").desc(), F.col("rank")], max_variants)
    both = marked.join(best.select("sample", "rank", F.lit(True).alias("_top")), ["sample", "rank"], "left")
    tier = F.when(F.col("_top"), "quality").when(alarm, "alert").when(far, "trace").otherwise("counted")
    return both.withColumn("tier", tier).withColumn("needs_review", F.col("tier") == "alert").drop("_ok", "_top")


# -- choosing reads ---------------------------------------------------------------------------


def subset_by_length(reads: DataFrame, plen: int, window: int, n: int) -> DataFrame:
    """The ``n`` reads of each sample closest to the expected length, with their ``rn``."""
    dev = F.abs(F.length("seq") - plen)
    near = reads.withColumn("_dev", dev).filter(F.col("_dev") <= window)
    return top_n_per(near, ["sample"], [F.col("_dev"), F.col("read_id").cast("string"), F.md5("seq")], n).drop("_dev")


def length_modes(reads: DataFrame) -> DataFrame:
    """Samples with a second length mode at least 3 bins of 10 away holding 20% of the reads."""
    return modes_of_bins(reads.groupBy("sample", F.floor(F.length("seq") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n")))


def modes_of_bins(bins: DataFrame) -> DataFrame:
    """The same from counts made before (sample, bin, n)."""
    key = F.struct("n", -F.col("bin"))
    top = bins.groupBy("sample").agg(F.sum("n").alias("reads"), F.max_by("bin", key).alias("b1")).filter("reads >= 10")
    far = bins.join(top, "sample").filter("abs(bin - b1) >= 3")
    second = far.groupBy("sample", "reads", "b1").agg(F.max_by("bin", key).alias("b2"), F.max("n").alias("_n2"))
    return second.filter(F.col("_n2") / F.col("reads") >= 0.2).select(
        "sample", "reads", (F.col("b1") * 10).alias("mode1"), (F.col("b2") * 10).alias("mode2"), (F.col("_n2") / F.col("reads")).alias("share2")
    )


def estimate_gaps(aln: DataFrame, keys: Sequence[str] = ("set",)) -> DataFrame:
    """Columns in which exactly one of an aligned barcode and its set's consensus is a gap; sets of 3 and more.

    Without keys all rows are one set, whose consensus is a single value.
    """
    cons = consensus(aln, 0.5, 3, strict=True, keys=keys).select(*keys, F.col("aligned").alias("_c")).filter("_c is not null")

    # The single value is fixed first: a subquery is best a plain scan.
    both = aln.join(cons, list(keys)) if keys else aln.withColumn("_c", cut(cons).scalar()).filter("_c is not null")
    found = both.withColumn("estgaps", gaps_apart("aln", "_c"))
    return found.select(*[c for c in aln.columns], "estgaps", (F.col("estgaps") == 0).alias("good"))


def qc_barcode(df: DataFrame, code: int, plen: int, tol: int) -> DataFrame:
    """Add ``ok`` and the barcode to write (the trimmed ORF of a coding marker)."""
    return df.withColumn("_q", passes_qc(F.col("seq"), code, plen, tol)).select(
        *[c for c in df.columns if c != "seq"], F.col("_q.seq").alias("seq"), F.col("_q.ok").alias("ok")
    )


def with_genetic_code(samples: DataFrame, codes: DataFrame, default: int) -> DataFrame:
    """Genetic code of each sample, its own where one is given."""
    return samples.join(codes.select("sample", F.col("code").alias("_c")), "sample", "left").withColumn("code", F.coalesce("_c", F.lit(default))).drop("_c")


# -- alignment and similarity ---------------------------------------------------------------------


def align_packed(reads: DataFrame) -> DataFrame:
    """Align the reads of each sample (sample, read_id, seq, rn) to the one with ``rn`` 1; a row of packed reads for a sample.

    Every read is aligned on its own. What reads insert between two template
    positions becomes extra columns, as many as the longest insert there. A
    sample's reads, whose number ``rn`` limits, pass one after the other; where
    the numbers were just given they already lie so.
    """
    order = F.row_number().over(Window.partitionBy("sample").orderBy("rn"))
    rows = reads.filter("sample is not null").select("sample", "read_id", "rn", "seq", order.alias("_at"))
    schema = packed_type(rows.select("sample", "read_id", "rn"))

    def given(names: list[pa.Field], held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(names)], [f.name for f in names])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, names = [], 0, []

        def told(batches):
            for batch in batches:
                kinds = {f.name: f.type for f in batch.schema}
                names[:] = [pa.field("sample", kinds["sample"]), pa.field("read_id", pa.list_(kinds["read_id"])), pa.field("rn", pa.list_(kinds["rn"])), pa.field(PACKED, pa.binary())]
                yield batch

        for sample, own in runs_of(told(batches)):
            own = list(own)
            template = next((seq or "" for _, _, rn, seq, _ in own if rn == 1), None)
            if template is None:
                continue
            placed = [place(seq or "", template) for _, _, _, seq, _ in own]
            widths: dict[int, int] = {}
            for _, inserts in placed:
                for at, text in inserts.items():
                    widths[at] = max(widths.get(at, 0), len(text))
            spots = sorted(widths.items())
            alns = squeeze_texts([spread_one(bases, inserts, spots) for bases, inserts in placed])
            held.append((sample, [r[1] for r in own], [r[2] for r in own], alns))
            size += len(alns)
            if size > PIECE:
                yield given(names, held)
                held, size = [], 0
        if held:
            yield given(names, held)

    return rows.mapInArrow(align, schema)


def align_to_template(reads: DataFrame) -> DataFrame:
    """The rows of ``align_packed``: sample, read_id, aln, rn."""
    return unpack_reads(align_packed(reads)).select("sample", "read_id", "aln", "rn")


def align_set(reads: DataFrame) -> DataFrame:
    """Align all reads (read_id, seq) as one set to the first read of the commonest length.

    The template and the widths of inserts are single values, so nothing is joined.
    """
    placed = cut(balance(reads).withColumn("_t", _set_template(reads)).withColumn("_p", place_on("seq", "_t")).select("read_id", "_p.*"))
    entry = F.explode(F.arrays_zip("at", F.transform("inserts", lambda t: F.length(t)).alias("w")))
    wide = placed.select(entry.alias("e")).groupBy(F.col("e.at").alias("at")).agg(F.max("e.w").alias("w"))
    widths = wide.agg(F.collect_list(F.struct("at", "w"))).scalar()
    both = placed.withColumn("_w", widths)
    return both.select("read_id", spread("bases", "at", "inserts", F.col("_w.at"), F.col("_w.w")).alias("aln"))


def _set_template(reads: DataFrame) -> Column:
    """The first read of the commonest length, as a single value."""
    size = reads.groupBy(F.length("seq").alias("_n")).agg(F.count(F.lit(1)).alias("_k"), F.min("read_id").alias("_first"))
    first = size.agg(F.max_by("_first", F.struct("_k", "_n"))).scalar()
    return reads.filter(F.col("read_id") == first).agg(F.min("seq")).scalar()


def set_gaps(reads: DataFrame) -> DataFrame:
    """(read_id, estgaps, good): what ``estimate_gaps`` finds over the rows of ``align_set``, without these rows.

    Every insert widens all rows, so rows are wider than their reads by far; a
    read's own gaps and inserts are no longer than the read and its template.
    Of an insert column the consensus is a letter as long as half of the reads
    have one, and reads that insert more have all that shorter ones have: the
    consensus at a template position is an insert of one width. What reads have
    where the consensus is a gap, and the other way round, then adds up.
    """
    placed = cut(balance(reads).withColumn("_t", _set_template(reads)).select("read_id", F.length("_t").alias("_m"), gaps_on("seq", "_t").alias("_p")))
    n = placed.agg(F.count(F.lit(1))).scalar()

    def few(gaps: Column) -> Column:
        return gaps / F.col("_n") <= 0.5

    spots = placed.select(F.explode("_p.gaps").alias("at")).groupBy("at").agg(F.count(F.lit(1)).alias("_g")).withColumn("_n", n)
    lost = cut(spots.filter(~few(F.col("_g"))).agg(F.array_sort(F.collect_list("at")).alias("_c")))
    entry = F.explode(F.arrays_zip(F.col("_p.at").alias("at"), F.col("_p.widths").alias("w"))).alias("e")
    widths = placed.select(entry).groupBy("e.at", "e.w").agg(F.count(F.lit(1)).alias("_k"))
    # Widths at one position: no more than the longest read has letters.
    longer = Window.partitionBy("at").orderBy(F.col("w").desc())
    held = widths.withColumn("_h", F.sum("_k").over(longer)).withColumn("_n", n).filter(few(F.col("_n") - F.col("_h")))
    kept = cut(held.groupBy("at").agg(F.max("w").alias("w")).agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("_w")))
    both = placed.withColumn("_n", n).withColumn("_c", lost.scalar()).withColumn("_w", kept.scalar())
    own = F.size("_p.gaps") + F.size("_c") - 2 * F.size(F.array_intersect("_p.gaps", "_c"))
    # The consensus inserts at few positions; a read pays for each of them unless it inserts there too.
    total = F.aggregate(F.map_values("_w"), F.lit(0), lambda a, w: a + w)
    inserts = F.aggregate(
        F.arrays_zip(F.col("_p.at").alias("at"), F.col("_p.widths").alias("w")), total,
        lambda a, e: a + F.abs(e["w"] - F.coalesce(F.try_element_at(F.col("_w"), e["at"]), F.lit(0))) - F.coalesce(F.try_element_at(F.col("_w"), e["at"]), F.lit(0)),
    )
    gaps = own + inserts
    return both.filter("_n >= 3").select("read_id", gaps.alias("estgaps"), (gaps == 0).alias("good"))


def similar_reads(reads: DataFrame, cands: DataFrame, plen: int, n: int) -> DataFrame:
    """Reads of each sample within a tenth of ``plen`` of its candidate barcode, the nearest ``n``."""
    both = reads.join(cands.select("sample", F.upper(ungap("seq")).alias("_c")), "sample")
    near = deal(both, "sample", "read_id").withColumn("dist", edit_iupac("seq", "_c", "base")["iupac"]).filter(F.col("dist") < 0.1 * plen).drop("_c")
    return top_n_per(near, ["sample"], [F.col("dist"), F.col("seq"), F.col("read_id")], n)
