"""Sequence expressions, all of them native Spark columns except mean quality, stops and gaps."""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

# IUPAC nucleotide codes and the bases each stands for.
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT",
    "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
# Complements of the IUPAC codes.
COMPLEMENT_FROM = "ACGTRYSWKMBDHVNacgtryswkmbdhvn"
COMPLEMENT_TO = "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"
# Stop codons of NCBI genetic codes.
STOPS = {
    1: ["TAA", "TAG", "TGA"],
    2: ["TAA", "TAG", "AGA", "AGG"],
    3: ["TAA", "TAG"],
    4: ["TAA", "TAG"],
    5: ["TAA", "TAG"],
    6: ["TGA"],
    9: ["TAA", "TAG"],
    10: ["TAA", "TAG"],
    11: ["TAA", "TAG", "TGA"],
    12: ["TAA", "TAG", "TGA"],
    13: ["TAA", "TAG"],
    14: ["TAG"],
    16: ["TAA", "TGA"],
    21: ["TAA", "TAG"],
    22: ["TCA", "TAA", "TGA"],
    23: ["TTA", "TAA", "TAG", "TGA"],
    24: ["TAA", "TAG"],
    25: ["TAA", "TAG"],
    26: ["TAA", "TAG", "TGA"],
}
# Letters that mark a base read from the reverse strand.
STRAND_FROM, STRAND_TO = "EFQP", "AGCT"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def revcomp(c) -> Column:
    return F.reverse(F.translate(_col(c), COMPLEMENT_FROM, COMPLEMENT_TO))


def decode_strand(c) -> Column:
    return F.translate(_col(c), STRAND_FROM, STRAND_TO)


def ungap(c) -> Column:
    return F.translate(_col(c), "-.", "")


def count_char(c: Column, chars: str) -> Column:
    """How many characters of ``c`` are among ``chars``."""
    return F.length(c) - F.length(F.translate(c, chars, ""))


def stop_codons(code: int) -> list[str]:
    """Stop codons of a genetic code, ambiguous spellings included.

    An ambiguous codon counts only if every reading of it is a stop.
    """
    stops = set(STOPS[code])
    return sorted(
        "".join(codon)
        for codon in product(IUPAC, repeat=3)
        if all("".join(r) in stops for r in product(*(IUPAC[x] for x in codon)))
    )


@arrow_udf(DoubleType())
def mean_error(qual: pa.Array) -> pa.Array:
    """Mean error probability of each Phred+33 quality string."""
    qual = qual.cast(pa.large_string())
    n = len(qual)
    _, offsets, data = qual.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[qual.offset : qual.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    table = np.power(10.0, -(np.arange(256) - 33) / 10.0)
    size = np.diff(off)
    out = np.full(n, np.nan)
    live = size > 0
    if live.any():
        errors = table[raw[off[0] : off[-1]]]
        out[live] = np.add.reduceat(errors, (off[:-1] - off[0])[live]) / size[live]
    return pa.array(out, mask=~live)


def mean_q(qual) -> Column:
    """Read quality from the mean error probability, NULL without a quality string."""
    return -10.0 * F.log10(mean_error(_col(qual)))


def seq_stats(seq) -> dict[str, Column]:
    """Composition of a sequence; gaps do not count towards its length."""
    u = F.translate(F.upper(_col(seq)), "U", "T")
    gaps = count_char(u, "-.")
    length = F.length(u) - gaps
    a, c, g, t = (count_char(u, b) for b in "ACGT")
    n = count_char(u, "N")
    ambig = count_char(u, "NRYKMSWBDHV")
    acgt = count_char(u, "ACGT")
    return {
        "length": length,
        "gaps": gaps,
        "n": n,
        "ambig": ambig,
        "invalid": F.greatest(length - acgt - ambig, F.lit(0)),
        "a": a,
        "c": c,
        "g": g,
        "t": t,
        "acgt": acgt,
        "gc": c + g,
        "gc_pct": F.when(acgt > 0, 100.0 * (c + g) / acgt).otherwise(0.0),
        "ambig_pct": F.when(length > 0, 100.0 * ambig / length).otherwise(0.0),
        "homopolymer": max_homopolymer(u),
    }


def max_homopolymer(seq) -> Column:
    """Longest run of one base, gaps left out."""
    runs = F.regexp_extract_all(ungap(seq), F.lit("(A+|C+|G+|T+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, lambda r: F.length(r))), F.lit(0))


def gc_pct(seq) -> Column:
    """GC share of a read over its whole length."""
    s = F.upper(_col(seq))
    return F.when(F.length(s) > 0, 100.0 * count_char(s, "GC") / F.length(s)).otherwise(0.0)


def frames(seq) -> list[Column]:
    """Six reading frames; the reverse ones drop bases from the end first."""
    s = _col(seq)
    tail1 = F.substr(s, F.lit(1), F.greatest(F.length(s) - 1, F.lit(0)))
    tail2 = F.substr(s, F.lit(1), F.greatest(F.length(s) - 2, F.lit(0)))
    return [s, F.substr(s, F.lit(2)), F.substr(s, F.lit(3)), revcomp(s), revcomp(tail1), revcomp(tail2)]


def _prefix_pattern(code: int) -> str:
    return f"^(?:(?!{'|'.join(stop_codons(code))})[A-Z]{{3}})*+"


def _clean_prefixes(seq, code: int | Column) -> Column:
    """Leading codons of each frame before its first stop.

    For a column of codes the patterns of all codes are one map literal, so rows
    of different codes share the expression; an unknown code is an error.
    """
    if isinstance(code, int):
        return F.transform(F.array(*frames(seq)), lambda f: F.regexp_extract(f, _prefix_pattern(code), 0))
    known = F.create_map(*[F.lit(x) for c in STOPS for x in (c, _prefix_pattern(c))])
    return F.transform(F.array(*frames(seq)), lambda f: F.call_function("regexp_extract", f, known[code], F.lit(0)))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def orf_lengths(seq, code: int | Column) -> Column:
    """Amino acids before the first stop, for each of the six frames."""
    return F.transform(_clean_prefixes(seq, code), lambda p: (F.length(p) / 3).cast("int"))


def best_orf(seq, code: int | Column) -> Column:
    """Longest clean frame as struct(aa, rank, orf), rank = -frame; the earliest frame wins ties."""
    return F.array_max(
        F.transform(
            _clean_prefixes(seq, code),
            lambda p, i: F.struct((F.length(p) / 3).cast("int").alias("aa"), (-(i + 1)).alias("rank"), p.alias("orf")),
        )
    )


def translates(seq, code: int | Column) -> Column:
    """True when the best frame has no stop at all."""
    s = ungap(seq)
    size = F.length(s)

    def clean(best):
        frame = -best["rank"]
        cut = F.when(frame.isin(2, 5), 1).when(frame.isin(3, 6), 2).otherwise(0)
        return (best["aa"] > 0) & (best["aa"] == F.floor((size - cut) / 3))

    return _let(best_orf(s, code), clean)


def orf_trim(seq, code: int | Column) -> Column:
    """struct(seq, aa): the sequence itself when it reads through, else its longest clean ORF."""
    s = ungap(seq)
    return _let(
        best_orf(s, code),
        lambda best: F.struct(
            F.when(best["aa"] * 3 >= F.length(s) - 2, s).otherwise(best["orf"]).alias("seq"),
            best["aa"].alias("aa"),
        ),
    )


STOPS_FOUND = StructType(
    [StructField("n", IntegerType()), StructField("rank", IntegerType()), StructField("frame", StringType()), StructField("positions", ArrayType(IntegerType()))]
)
FRAMES = [f"{strand}{shift + 1}" for strand in "+-" for shift in range(3)]
_LETTER = np.full(256, 26, np.int64)
_LETTER[65:91] = np.arange(26)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
_COMPLEMENT[[ord(c) for c in COMPLEMENT_FROM]] = [ord(c) for c in COMPLEMENT_TO]


def _codon_table(stops: list[str]) -> np.ndarray:
    """Which triples of letters are stops, by number; 26 stands for whatever is no letter."""
    table = np.zeros(27**3, bool)
    for codon in stops:
        a, b, c = _LETTER[list(codon.encode())]
        table[(a * 27 + b) * 27 + c] = True
    return table


def _stops_in(text: str, stops: list[str]) -> tuple[int, int, list[int]]:
    """The frame of one text with the fewest stops: codons are runs of three letters, found from left to right past anything else."""
    back = text.translate(str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO))[::-1]
    found = []
    for rank in range(6):
        shift = rank % 3
        codons = re.findall("[A-Z]{3}", (text if rank < 3 else back)[shift:])
        at = [3 * i + shift for i, codon in enumerate(codons) if codon in stops]
        found.append((len(at), rank, [i + 1 for i in at] if rank < 3 else [len(text) - i - 2 for i in reversed(at)]))
    return min(found)


def _stops_of(letters: np.ndarray, size: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, rank, cuts, positions) of texts of letters only, laid end to end: stops in all frames are looked up at once."""
    start = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(letters)) - start[owner]
    counts, spots = [], []
    for code in (_LETTER[letters], _LETTER[_COMPLEMENT[letters]]):
        inside = np.flatnonzero(place + 2 < size[owner])
        a, b, c = (code[inside + k] for k in range(3))
        # The other strand reads the same three places from right to left.
        at = inside[table[(a * 27 + b) * 27 + c] if not counts else table[(c * 27 + b) * 27 + a]]
        shift = (place[at] if not counts else size[owner[at]] - 3 - place[at]) % 3
        counts.append(np.bincount(owner[at] * 3 + shift, minlength=3 * len(size)).reshape(-1, 3))
        spots.append((at, shift + 3 * (len(counts) - 1)))
    n = np.concatenate(counts, axis=1)
    rank = n.argmin(axis=1)
    at, frame = (np.concatenate(x) for x in zip(*spots))
    at = np.sort(at[frame == rank[owner[at]]])
    n = n[np.arange(len(size)), rank]
    return n, rank, np.concatenate([[0], np.cumsum(n)]), place[at] + 1


def scan_stops(seq, code: int) -> Column:
    """struct(n, rank, frame, positions) for the frame with the fewest stops."""
    stops = stop_codons(code)
    table = _codon_table(stops)

    @arrow_udf(STOPS_FOUND)
    def run(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        rows: list[tuple] = [(None, 0, None)] * len(texts)
        plain = [k for k, t in enumerate(texts) if t is not None and t.isascii() and (not t or t.isalpha() and t.isupper())]
        letters = np.frombuffer("".join([texts[k] for k in plain]).encode(), np.uint8)
        size = np.array([len(texts[k]) for k in plain], np.int64)
        n, rank, cuts, positions = _stops_of(letters, size, table)
        for j, k in enumerate(plain):
            rows[k] = (int(n[j]), int(rank[j]), positions[cuts[j] : cuts[j + 1]])
        for k in set(range(len(texts))) - set(plain):
            if texts[k] is not None:
                rows[k] = _stops_in(texts[k], stops)
        return pa.StructArray.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([FRAMES[r[1]] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.list_(pa.int32())),
            ],
            names=["n", "rank", "frame", "positions"],
        )

    return run(F.translate(F.upper(ungap(seq)), "U", "T"))


def _compatible_masks() -> tuple[str, str]:
    letters = "".join(IUPAC)
    masks = "".join(chr(64 + sum(1 << "ACGT".index(b) for b in IUPAC[x])) for x in letters)
    return letters, masks


def iupac_compatible(a, b) -> Column:
    """True for equal lengths and overlapping base sets at every position."""
    a, b = _col(a), _col(b)
    letters, masks = _compatible_masks()
    pairs = F.zip_with(
        F.split(F.translate(a, letters, masks), ""),
        F.split(F.translate(b, letters, masks), ""),
        lambda x, y: (x == y) | ((F.ascii(x).between(65, 79)) & (F.ascii(y).between(65, 79)) & (F.ascii(x).bitwiseAND(F.ascii(y)).bitwiseAND(F.lit(15)) != 0)),
    )
    return (F.length(a) == F.length(b)) & ((a == b) | F.forall(pairs, lambda p: p))


def hamming(a, b) -> Column:
    """Differing positions, NULL for unequal lengths."""
    a, b = _col(a), _col(b)
    diff = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(
        F.length(a) == F.length(b),
        F.when(a == b, 0).otherwise(F.aggregate(diff, F.lit(0), lambda acc, x: acc + x)),
    )


def _gaps_between(x: pa.Array, y: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(differing, same length) for each pair of texts: positions where exactly one is a gap."""
    gaps, sizes = [], []
    for texts in (x, y):
        texts = texts.cast(pa.large_string()).fill_null("")
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        if len(data) and data.max() > 127:
            # Positions are those of characters, and a character begins with the first of its bytes.
            begins = (data & 0xC0) != 0x80
            at, data = np.concatenate([[0], np.cumsum(begins)])[at], data[begins]
        gaps.append(data == ord("-"))
        sizes.append(np.diff(at))
    even = sizes[0] == sizes[1]
    differs = np.concatenate([gap if even.all() else gap[np.repeat(even, size)] for gap, size in zip(gaps, sizes)]).reshape(2, -1)
    ends = np.concatenate([[0], np.cumsum(np.where(even, sizes[0], 0))])
    spots = np.flatnonzero(differs[0] != differs[1])
    return np.diff(np.searchsorted(spots, ends)), even


def gaps_apart(a, b) -> Column:
    """Positions where exactly one of two aligned texts is a gap, NULL for unequal lengths."""

    @arrow_udf(IntegerType())
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        n, even = _gaps_between(x, y)
        return pa.array(n, pa.int32(), mask=~even | np.asarray(x.is_null()) | np.asarray(y.is_null()))

    return run(_col(a), _col(b))
