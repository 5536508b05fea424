"""Record headers: fields, identifiers and the metrics they carry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n\x0b\x0c"


def quote(text: str) -> str:
    """``text`` as a literal for Java regular expressions."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def strip(c) -> Column:
    return F.trim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _after(c: Column, mark: str) -> Column:
    return F.substr(c, F.instr(c, mark) + F.lit(len(mark)))


def header_field(c, sep: str, field: int | str) -> Column:
    """One header field, by 1-based position or by the key of a ``key=value`` field."""
    c = _col(c)
    parts = F.split(c, quote(sep)) if sep else F.array(c)
    if isinstance(field, str):
        named = F.filter(
            parts,
            lambda p: (F.instr(p, "=") > 0) & (strip(F.substring_index(p, "=", 1)) == F.lit(field)),
        )
        value = strip(_after(F.get(named, F.lit(0)), "="))
    elif field < 1:
        value = F.lit(None).cast("string")
    else:
        raw = strip(F.get(parts, F.lit(field - 1)))
        value = F.when(F.instr(raw, "=") > 0, strip(_after(raw, "="))).otherwise(raw)
    return F.when(F.contains(c, F.lit(sep)), value) if sep else value


def header_key_array(c, sep: str) -> Column:
    """Keys of the ``key=value`` fields of one header."""
    c = _col(c)
    parts = F.split(c, quote(sep)) if sep else F.array(c)
    keys = F.transform(
        F.filter(parts, lambda p: F.instr(p, "=") > 0),
        lambda p: strip(F.substring_index(p, "=", 1)),
    )
    keys = F.filter(keys, lambda k: k != "")
    return F.when(F.contains(c, F.lit(sep)), keys).otherwise(F.array().cast("array<string>")) if sep else keys


def drop_suffix(c, suffix: str) -> Column:
    """Remove a trailing ``suffix`` unless nothing would be left."""
    c = _col(c)
    return F.when(F.endswith(c, F.lit(suffix)) & (F.length(c) > len(suffix)), F.left(c, F.length(c) - len(suffix))).otherwise(c) if suffix else c


def first_token(c) -> Column:
    return F.regexp_extract(_col(c), r"(\S+)", 1)


def extract_id(c, sep: str = "", suffix: str = "") -> Column:
    """Text before the first ``sep`` (or the first word), without an optional suffix."""
    text = strip(c)
    if sep and sep != " ":
        sid = strip(F.substring_index(text, sep, 1))
    else:
        sid = first_token(text)
    return drop_suffix(sid, suffix)


def _name_part(c) -> Column:
    return strip(F.substring_index(_col(c), ";", 1))


def sample_id(c, suffix: str = "") -> Column:
    """Sample of a query name: before ``;``, without ``_var<i>`` and the suffix."""
    sid = F.regexp_replace(_name_part(c), r"_var\d+$", "")
    return F.regexp_replace(sid, quote(suffix) + "\\z", "") if suffix else sid


def sample_of_header(c, suffix: str = "") -> Column:
    """Sample a consensus and its variants share."""
    return drop_suffix(sample_id(c, suffix), "_all.fa")


def is_variant(c) -> Column:
    return F.rlike(_name_part(c), F.lit(r"_var\d+$"))


def variant_host(c) -> Column:
    """Text before the last ``_var`` of the name part; names without it stay whole."""
    return F.regexp_replace(_name_part(c), r"_var(?:(?!_var).)*$", "")


def _nth_before(c: Column, delim: str, n: int) -> Column:
    found = F.length(c) - F.length(F.replace(c, F.lit(delim), F.lit("")))
    return F.when(found >= n * len(delim), F.substring_index(c, delim, n))


def _nth_before_any(c: Column, chars: str, n: int) -> Column:
    cls = "".join("\\" + ch for ch in chars)
    pat = f"^((?:[^{cls}]*[{cls}]){{{n - 1}}}[^{cls}]*)[{cls}]"
    return F.when(F.rlike(c, F.lit("(?s)" + pat)), F.regexp_extract(c, "(?s)" + pat, 1))


def extract_sample_id(c, regexes: Sequence[str] = (), patterns: Sequence[str] = ()) -> tuple[Column, Column]:
    """First rule that yields an identifier, and whether one did.

    Regexes come first (group 1 when it took part, else the whole match), then
    ``pos:DELIM:N``, ``posany:CHARS:N`` and plain substrings; without any the
    text before the first ``;`` is used.
    """
    c = _col(c)
    tries: list[Column] = []
    for rx in regexes:
        whole = F.regexp_extract(c, rx, 0)
        if _groups(rx):
            one = F.regexp_extract(c, rx, 1)
            whole = F.when(one != "", one).otherwise(whole)
        tries.append(F.when(F.rlike(c, F.lit(rx)) & (whole != ""), whole))
    for pat in patterns:
        kind, _, rest = pat.partition(":")
        if kind in ("pos", "posany") and rest:
            delim, _, n = rest.rpartition(":")
            if not delim or not n.isdigit() or int(n) < 1:
                continue
            tries.append((_nth_before if kind == "pos" else _nth_before_any)(c, delim, int(n)))
        elif pat:
            tries.append(F.when(F.contains(c, F.lit(pat)), F.substring_index(c, pat, 1)))
    found = F.coalesce(*tries) if tries else F.lit(None).cast("string")
    return F.coalesce(found, F.substring_index(c, ";", 1)), found.isNotNull()


def _groups(rx: str) -> int:
    import re

    return re.compile(rx).groups


def normalize_id(c, strip_regex: str = "", lowercase: bool = False, strip_zeros: bool = False) -> Column:
    c = _col(c)
    if not (strip_regex or lowercase or strip_zeros):
        return c
    if strip_regex:
        c = F.regexp_replace(c, strip_regex, "")
    if lowercase:
        c = F.lower(c)
    if strip_zeros:
        c = F.regexp_replace(c, r"(?<![0-9])0+([0-9])", "$1")
    return strip(c)


def _int(c: Column) -> Column:
    return strip(c).try_cast("double").try_cast("bigint")


def _numbered(c: Column, key: str) -> Column:
    """Whole number of the first field ``key=`` of a header; one pass over the text, no list of its fields."""
    blank = r"[ \t\r\n\x0b\x0c]*"
    return F.when(F.contains(c, F.lit(";")) & F.contains(c, F.lit(key)), _int(F.nullif(F.regexp_extract(c, rf"(?:^|;){blank}{quote(key)}{blank}=([^;]*)", 1), F.lit(""))))


def header_metrics(header, seq) -> Column:
    """Struct of sample, length, coverage, ambiguities and estimated gaps.

    Consensus headers are positional (name;length;reads;...), variant headers
    use ``len=`` and ``coverage=``. A missing ambiguity count is taken from the
    sequence and a missing length from its size.
    """
    header, seq = _col(header), _col(seq)
    low = F.lower(header)
    parts = F.split(header, ";")
    length = F.coalesce(_numbered(low, "len"), _int(F.get(parts, F.lit(1))), F.length(seq))
    cov = F.coalesce(_numbered(low, "coverage"), _int(F.get(parts, F.lit(2))))
    ambs = F.coalesce(
        _numbered(low, "ambs"),
        _numbered(low, "ns"),
        F.length(F.regexp_replace(F.upper(seq), "[ACGT-]", "")),
    )
    gaps = F.coalesce(_numbered(low, "estgaps"), _numbered(low, "fixed_indels"), F.lit(0))
    return F.struct(
        sample_of_header(header).alias("sample"),
        length.alias("length"),
        cov.alias("coverage"),
        ambs.alias("ambs"),
        gaps.alias("estgaps"),
    )


def set_len_field(header, length) -> Column:
    """Replace a numeric second header field."""
    header = _col(header)
    return F.when(
        F.rlike(header, F.lit(r"^[^;]*;\s*\d+\s*(;|$)")),
        F.concat(
            F.substring_index(header, ";", 1),
            F.lit(";"),
            _col(length).cast("string"),
            F.regexp_extract(header, r"^[^;]*;[^;]*(.*)$", 1),
        ),
    ).otherwise(header)


def parse_div(header) -> Column:
    """``div=X%`` as a fraction; NaN when absent or not a number."""
    text = F.regexp_extract(_col(header), r"(?:^|;)div=([^;%]*)%?", 1)
    return F.coalesce(text.try_cast("double") / 100.0, F.lit(float("nan")))


def parameter_map(c) -> Column:
    """``k=v, k=v`` parameter text as a map."""
    return F.str_to_map(_col(c), F.lit(", ?"), F.lit("="))
