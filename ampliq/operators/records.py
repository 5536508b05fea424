"""Tools over sequence records (run, ord, header, seq): search, filter, group, sort, split, describe."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.headers import extract_id, header_field, set_len_field
from ..functions.seq import orf_trim, scan_stops, seq_stats, ungap
from ..functions.text import natural_key, normalize_cell
from ..session import cut
from .ordering import first_per, running


# -- search and filter ---------------------------------------------------------


def grep(
    df: DataFrame,
    patterns: Sequence[str] | DataFrame,
    mode: str = "plain",
    ignore_case: bool = False,
    sep: str = ";",
    suffix: str = "",
) -> DataFrame:
    """Records whose header holds a pattern (``plain``, ``regex``) or whose id is listed (``id``).

    With ``id`` the list may be a DataFrame with a column ``pattern`` of any size.
    """
    header = F.col("header")
    if mode == "id":
        if not isinstance(patterns, DataFrame):
            patterns = df.sparkSession.createDataFrame([(p,) for p in patterns], "pattern string")
        fold = F.lower if ignore_case else (lambda c: c)
        wanted = patterns.select(fold(F.col("pattern")).alias("_id")).distinct()
        keyed = df.withColumn("_id", fold(extract_id(header, sep, suffix)))
        return keyed.join(wanted, "_id", "left_semi").drop("_id")
    if not patterns:
        raise ValueError("no pattern given")
    if mode == "regex":
        tests = [F.rlike(header, F.lit(("(?i)" if ignore_case else "") + p)) for p in patterns]
    elif ignore_case:
        tests = [F.contains(F.lower(header), F.lit(p.lower())) for p in patterns]
    else:
        tests = [F.contains(header, F.lit(p)) for p in patterns]
    return df.filter(any_of(tests))


def any_of(tests: Sequence[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def all_of(tests: Sequence[Column]) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def field_test(field: int | str, op: str, value: str, sep: str) -> Column:
    """One header criterion; a header without the field fails it."""
    raw = header_field("header", sep, field)
    number = None
    if op not in ("contains", "not contains"):
        try:
            number = float(value)
        except ValueError:
            if op not in ("=", "!="):
                raise ValueError(f"{op} needs a number, not {value!r}") from None
    if number is not None:
        left, right = raw.try_cast("double"), F.lit(number)
    else:
        left, right = F.lower(raw), F.lit(value.strip().lower())
    tests = {
        "=": left == right, "!=": left != right, ">=": left >= right, "<=": left <= right,
        ">": left > right, "<": left < right,
    }
    if op == "contains":
        test = F.contains(left, right)
    elif op == "not contains":
        test = ~F.contains(left, right)
    else:
        test = tests[op]
    return F.coalesce(test, F.lit(False))


def filter_fields(df: DataFrame, criteria: Sequence[tuple], match: str = "all", sep: str = ";") -> DataFrame:
    """Records meeting all (or any) of the (field, operator, value) criteria."""
    if not criteria:
        raise ValueError("no criteria given")
    tests = [field_test(f, op, v, sep) for f, op, v in criteria]
    return df.filter(any_of(tests) if match == "any" else all_of(tests))


def field_values(df: DataFrame, sep: str, field: int | str) -> DataFrame:
    """Distinct values of a header field with their counts."""
    value = F.coalesce(header_field("header", sep, field), F.lit("no_field"))
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def append_info(df: DataFrame, lookup: DataFrame, sep: str = "|", id_sep: str = ";", suffix: str = "") -> DataFrame:
    """Append the fields of ``lookup`` (id, fields array) to matching headers; ``found`` tells which."""
    keyed = df.withColumn("_id", normalize_cell(extract_id("header", id_sep, suffix)))
    both = keyed.join(lookup.select(F.col("id").alias("_id"), "fields"), "_id", "left")
    found = F.coalesce(F.size("fields") > 0, F.lit(False))
    return both.select(
        *[c for c in df.columns if c != "header"],
        F.when(found, F.concat_ws(sep, "header", F.array_join("fields", sep))).otherwise(F.col("header")).alias("header"),
        found.alias("found"),
    )


def trim_records(df: DataFrame, code: int, min_coverage: float = 0.95) -> DataFrame:
    """Trim records to their coding ORF; ``status`` is trimmed, unchanged or short_orf."""
    s = df.withColumn("_s", F.upper(ungap("seq"))).filter("_s <> ''").withColumn("_t", orf_trim("_s", code))
    status = (
        F.when(F.col("_t.seq") == F.col("_s"), "unchanged")
        .when(F.col("_t.aa") * 3 >= F.length("_s") * min_coverage, "trimmed")
        .otherwise("short_orf")
    )
    s = s.withColumn("status", status)
    cutting = F.col("status") == "trimmed"
    return s.select(
        *[c for c in df.columns if c not in ("header", "seq")],
        F.when(cutting, set_len_field("header", F.length("_t.seq"))).otherwise(F.col("header")).alias("header"),
        F.when(cutting, F.col("_t.seq")).otherwise(F.col("_s")).alias("seq"),
        "status",
    )


def wrap(seq, cols: int = 80) -> Column:
    """Sequence text in lines of ``cols`` letters."""
    return F.regexp_replace(seq, f"(.{{{cols}}})(?!$)", "$1\n")


# -- equal sequences and headers --------------------------------------------------


def unique_seqs(df: DataFrame) -> DataFrame:
    """First record of each distinct sequence of a run, ignoring case."""
    keyed = df.withColumn("_k", F.upper("seq"))
    return first_per(keyed, ["run", "_k"], ["ord"]).drop("_k")


def identical_groups(df: DataFrame) -> DataFrame:
    """Records whose sequence occurs again in their run, with the group's number and size.

    Groups are numbered by first appearance. Members stay one per row.
    """
    key = F.upper("seq")
    groups = (
        df.groupBy("run", key.alias("_k"))
        .agg(F.count(F.lit(1)).alias("copies"), F.min("ord").alias("_first"))
        .filter("copies > 1")
    )
    numbered = running(groups, ["_first"], keys=["run"], number="group_no")
    return df.withColumn("_k", key).join(numbered, ["run", "_k"]).select("run", "group_no", "copies", "ord", "header", "seq")


def repeated_headers(df: DataFrame, spaces_as_underscore: bool = False) -> DataFrame:
    """Headers that occur more than once in a run, with their copies."""
    header = F.translate("header", " ", "_") if spaces_as_underscore else F.col("header")
    return df.groupBy("run", header.alias("header")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


# -- order and split --------------------------------------------------------------


def sort_records(df: DataFrame, levels: Sequence[tuple[int, bool]], sep: str = ";") -> DataFrame:
    """Natural sort by header fields: (1-based field, descending) levels; ``place`` is the new order."""
    parts = F.split("header", "\\Q" + sep + "\\E") if sep else F.array("header")
    order = []
    keyed = df
    for i, (field, desc) in enumerate(levels):
        name = f"_k{i}"
        keyed = keyed.withColumn(name, natural_key(F.trim(F.coalesce(F.get(parts, F.lit(field - 1)), F.lit("")))))
        order.append(F.col(name).desc() if desc else F.col(name).asc())
    return running(keyed, [*order, F.col("ord").asc()], keys=["run"], number="place").drop(*[f"_k{i}" for i in range(len(levels))])


def split_count(df: DataFrame, size: int) -> DataFrame:
    """Part number of each record, ``size`` records to a part."""
    return running(df, ["ord"], keys=["run"]).withColumn("part", F.ceil(F.col("rn") / size).cast("bigint")).drop("rn")


def split_files(df: DataFrame, files: int) -> DataFrame:
    """Part number of each record, ``files`` parts of near-equal size, the larger ones first."""
    total = df.groupBy("run").agg(F.count(F.lit(1)).alias("_n"))
    both = running(df, ["ord"], keys=["run"]).join(total, "run")
    k = F.least(F.lit(files), F.col("_n"))
    size = F.floor(F.col("_n") / k)
    extra = F.col("_n") - size * k
    i = F.col("rn") - 1
    big = extra * (size + 1)
    part = F.when(i < big, F.floor(i / (size + 1))).otherwise(extra + F.floor((i - big) / size)) + 1
    return both.withColumn("part", part.cast("bigint")).drop("rn", "_n")


def split_bases(df: DataFrame, bases: int, max_seqs: int | None = None, blocks_of: int = 1024) -> DataFrame:
    """Part number of each record: greedy parts of at most ``bases`` letters, order kept, nothing cut.

    Where a part begins depends on where the one before it began, so the scan
    is split in blocks of ``blocks_of * bases`` letters. Each block works out,
    for every row a part could first begin at, where the scan enters the next
    block. Following those links from the first row by doubling takes
    log2(blocks) joins over these rows only; then the blocks are read again,
    each from its known entry.
    """
    span = bases * blocks_of
    rows = running(df.withColumn("_len", F.length("seq").cast("bigint")), ["ord"], keys=["run"], sums={"_cum": "_len"})
    rows = rows.withColumn("_before", F.col("_cum") - F.col("_len")).withColumn("_block", F.floor(F.col("_before") / span))
    slim = cut(rows.select("run", "rn", "_before", "_cum", "_block"))
    entry_zone = (F.col("_before") - F.col("_block") * span <= bases) & (F.col("_block") > 0)
    halo = slim.filter(entry_zone).withColumn("_block", F.col("_block") - 1).withColumn("_own", F.lit(False))
    seen = slim.withColumn("_own", F.lit(True)).unionByName(halo)

    def step(pdf: pd.DataFrame) -> np.ndarray:
        """Position at which the next part begins, for every row of a block."""
        begin = pdf["_before"].to_numpy()
        end = np.searchsorted(pdf["_cum"].to_numpy(), begin + bases, side="right")
        at = np.arange(len(pdf))
        end = np.maximum(end, at + 1)
        return np.minimum(end, at + max_seqs) if max_seqs else end

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        nxt, own = step(pdf), int(pdf["_own"].sum())
        goal = nxt.copy()
        for i in range(own - 1, -1, -1):
            if nxt[i] < own:
                goal[i] = goal[nxt[i]]
        keep = (np.arange(len(pdf)) < own) & ((pdf["_before"] - pdf["_block"] * span <= bases) | (pdf["rn"] == 1)).to_numpy()
        if own:
            keep[0] = True
        rn = pdf["rn"].to_numpy()
        ahead = np.where(goal < len(pdf), rn[np.minimum(goal, len(pdf) - 1)], rn[-1] + 1)
        return pd.DataFrame({"run": pdf["run"], "node": rn, "next": ahead})[keep]

    run_type = dict(df.dtypes)["run"]
    jump = cut(seen.groupBy("run", "_block").applyInPandas(links, f"run {run_type}, node long, next long"))
    nodes = jump.select("run", "node")
    reached = nodes.filter("node = 1")
    while True:
        more = reached.join(jump, ["run", "node"]).select("run", F.col("next").alias("node"))
        grown = cut(reached.unionByName(more.join(nodes, ["run", "node"], "left_semi")).distinct())
        if grown.count() == reached.count():
            break
        reached = grown
        other = jump.select("run", F.col("node").alias("next"), F.col("next").alias("_far"))
        jump = cut(jump.join(other, ["run", "next"]).select("run", "node", F.col("_far").alias("next")))

    entries = reached.withColumn("_entry", F.lit(True)).withColumnRenamed("node", "rn")
    marked = slim.join(entries, ["run", "rn"], "left")

    def begins(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", ignore_index=True)
        nxt = step(pdf)
        first = np.zeros(len(pdf), dtype=np.int64)
        at = int(pdf["_entry"].fillna(False).to_numpy(dtype=bool).argmax()) if pdf["_entry"].any() else len(pdf)
        while at < len(pdf):
            first[at] = 1
            at = int(nxt[at])
        return pd.DataFrame({"run": pdf["run"], "rn": pdf["rn"], "_first": first})

    starts = marked.groupBy("run", "_block").applyInPandas(begins, f"run {run_type}, rn long, _first long")
    parts = running(starts, ["rn"], keys=["run"], number=None, sums={"part": "_first"})
    keep = [c for c in df.columns]
    return rows.join(parts.select("run", "rn", "part"), ["run", "rn"]).select(*keep, "part")


# -- description ----------------------------------------------------------------


def fasta_stats(df: DataFrame, code: int | None = None) -> DataFrame:
    """One row of summary statistics per run."""
    st = seq_stats("seq")
    names = ["length", "gaps", "n", "ambig", "invalid", "a", "c", "g", "t", "acgt", "gc", "homopolymer"]
    rows = df.select("run", F.upper("seq").alias("_u"), *[st[k].cast("bigint").alias(k) for k in names],
                     *([scan_stops("seq", code)["n"].alias("stops")] if code else []))
    per = rows.groupBy("run")
    main = per.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum("length").alias("bases"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.round(F.avg("length"), 2).alias("mean_length"),
        F.round(F.stddev_pop("length"), 2).alias("sd_length"),
        F.sum("ambig").alias("ambiguous"),
        F.round(100.0 * F.sum("ambig") / F.nullif(F.sum("length"), F.lit(0)), 4).alias("ambiguous_pct"),
        F.sum("n").alias("n_bases"),
        F.count_if(F.col("ambig") > 0).alias("with_ambiguous"),
        F.round(100.0 * F.sum("gc") / F.nullif(F.sum("acgt"), F.lit(0)), 2).alias("gc_pct"),
        F.sum("gaps").alias("gaps"),
        F.sum("invalid").alias("invalid"),
        F.count_if(F.col("length") == 0).alias("empty"),
        *[F.round(100.0 * F.sum(b) / F.nullif(F.sum("acgt"), F.lit(0)), 2).alias(f"{b}_pct") for b in "acgt"],
        F.max("homopolymer").alias("max_homopolymer"),
        F.round(F.avg("homopolymer"), 2).alias("mean_homopolymer"),
        *([F.count_if(F.col("stops") > 0).alias("with_stops")] if code else []),
    )
    distinct = rows.select("run", "_u").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("_d"))
    out = main.join(distinct, "run").join(length_ranks(rows), "run")
    return out.withColumn("duplicates", F.col("sequences") - F.col("_d")).drop("_d")


def length_ranks(rows: DataFrame, key: str = "run", length: str = "length") -> DataFrame:
    """Median, N50 and L50 per key, from the table of distinct lengths instead of the rows."""
    return ranks_of_counts(rows.groupBy(key, length).agg(F.count(F.lit(1)).alias("_n")), key, length)


def ranks_of_counts(counts: DataFrame, key: str, length: str) -> DataFrame:
    """``length_ranks`` from a table (key, length, _n) made before; it holds one row per distinct length."""
    down = Window.partitionBy(key).orderBy(F.col(length).desc())
    whole = Window.partitionBy(key)
    acc = counts.withColumn("_acc", F.sum(F.col(length) * F.col("_n")).over(down)).withColumn(
        "_rank", F.sum("_n").over(down)
    ).withColumn("_total", F.sum(F.col(length) * F.col("_n")).over(whole))
    past = F.col("_acc") * 2 >= F.col("_total")
    inside = F.col("_acc") - F.col(length) * F.col("_n")
    need = F.when(F.col(length) > 0, F.ceil((F.col("_total") / 2 - inside) / F.col(length))).otherwise(F.lit(1))
    l50 = F.col("_rank") - F.col("_n") + F.greatest(need, F.lit(1))
    return acc.groupBy(key).agg(
        F.expr(f"percentile({length}, 0.5, _n)").alias("median_length"),
        F.max(F.when(past, F.col(length))).cast("bigint").alias("n50"),
        F.min(F.when(past, l50)).cast("bigint").alias("l50"),
    )


def nice_width(low: int, high: int, bins: int = 20) -> int:
    """Width 1, 2 or 5 times a power of ten giving about ``bins`` bins."""
    raw = max((high - low) / bins, 1)
    power = 1
    while True:
        for step in (1, 2, 5):
            if step * power >= raw:
                return step * power
        power *= 10


def length_histogram(df: DataFrame, bins: int = 20) -> DataFrame:
    """Counts by length bin over all records, empty bins kept."""
    counts = df.groupBy(F.length(ungap("seq")).cast("bigint").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    low, high = counts.agg(F.min("length"), F.max("length")).first()
    if low is None:
        return counts.select(F.col("length").alias("bin_start"), F.col("length").alias("bin_end"), "n")
    width = nice_width(low, high, bins)
    start = low // width * width
    grid = df.sparkSession.range((high - start) // width + 1).select((F.col("id") * width + start).alias("bin_start"))
    filled = counts.groupBy((F.floor(F.col("length") / width) * width).alias("bin_start")).agg(F.sum("n").alias("n"))
    return grid.join(filled, "bin_start", "left").select(
        "bin_start", (F.col("bin_start") + width - 1).alias("bin_end"), F.coalesce("n", F.lit(0)).alias("n")
    )


def count_records(df: DataFrame) -> DataFrame:
    return df.groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def merge_inputs(*parts: DataFrame) -> DataFrame:
    """All inputs as one, in the order given: ``ord`` gains the input's place in front."""
    out = None
    for i, part in enumerate(parts):
        one = part.withColumn("ord", F.struct(F.lit(i).alias("input"), F.col("ord").alias("ord")))
        out = one if out is None else out.unionByName(one)
    return out
