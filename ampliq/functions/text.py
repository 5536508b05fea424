"""Cell text: numbers, names, taxa, natural order and number ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .headers import strip

# Accented Latin letters and their base letters.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
# Cells that mean "no taxon".
NO_TAXON = ["0", "0.0", "-", "", "N/A", "NA", "nan", "None"]
# Open-nomenclature words left out of a species name.
QUALIFIERS = ["cf.", "cf", "aff.", "aff", "nr.", "nr", "near"]
RANKS = ["order", "family", "genus", "organism"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_number(c) -> Column:
    """Number in a cell that may hold ``%``, a decimal comma or hard spaces."""
    text = F.regexp_replace(F.translate(_col(c), ",", "."), "[% \\s]", "")
    return text.try_cast("double")


def normalize_cell(c) -> Column:
    """Cell text without accents, with blanks, dots and commas as ``_``."""
    text = strip(_col(c))
    text = F.when(F.rlike(text, F.lit(r"^-?\d+\.0$")), F.regexp_replace(text, r"\.0$", "")).otherwise(text)
    text = F.regexp_replace(F.translate(text, ACCENTED, UNACCENTED), "[̀-ͯ]", "")
    text = F.regexp_replace(F.regexp_replace(text, "[ .,]+", "_"), "_+", "_")
    return F.trim(text, F.lit("_"))


def safe_name(c) -> Column:
    """Text as part of a file name."""
    text = F.regexp_replace(strip(_col(c)), r"(?U)[^\w.\-]+", "_")
    text = F.substr(F.trim(text, F.lit("._")), F.lit(1), F.lit(80))
    return F.when(text == "", F.lit("empty")).otherwise(text)


def display_taxon(c) -> Column:
    """Readable taxon name, NULL for the empty markers."""
    text = strip(_col(c))
    # Not translate, which looks each letter up on its own.
    name = F.replace(text, F.lit("_"), F.lit(" "))
    low = F.concat(F.upper(F.substr(name, F.lit(1), F.lit(1))), F.substr(name, F.lit(2)))
    return F.when(text.isin(NO_TAXON), F.lit(None)).otherwise(
        F.when(name == F.lower(name), low).otherwise(name)
    )


def species_key(c) -> Column:
    """``genus epithet`` in lower case, or "" when the name is no species."""
    words = "|".join(q.replace(".", r"\.") for q in QUALIFIERS)
    name = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), rf"(?<!\S)(?:{words})(?!\S)", "")
    key = F.regexp_extract(name, r"^\s*(\S+\s+(?!spp?\.?\d*(?:\s|$))\S+)", 1)
    return F.regexp_replace(key, r"\s+", " ")


def concordance(hit: dict[str, Column], query: dict[str, Column]) -> Column:
    """Deepest rank on which a hit and the expected taxonomy agree."""

    def same(rank):
        a, b = (F.lower(F.coalesce(side[rank], F.lit(""))) for side in (query, hit))
        return (a != "") & (a == b)

    mine = species_key(query["organism"])
    return (
        F.when((mine != "") & (mine == species_key(hit["organism"])), "organism")
        .when(same("genus"), "genus")
        .when(same("family"), "family")
        .when(same("order"), "order")
        .otherwise("none")
    )


def compared(names: dict[str, Column]) -> Column:
    """Struct of the forms in which ``concordance`` compares the names of one side; what no one expects is empty."""
    low = {r: F.lower(F.coalesce(names[r], F.lit(""))) for r in RANKS[:3]}
    return F.struct(*[c.alias(r) for r, c in low.items()], species_key(names["organism"]).alias("organism"))


def agreement(hit: dict[str, Column], expected: Column) -> Column:
    """``concordance`` of a hit with names made ready by ``compared``.

    A species key begins with a whole word of its name, so the patterns run over names that hold the expected word only.
    """

    def wanted(rank):
        return F.coalesce(expected[rank], F.lit(""))

    def same(rank):
        return (wanted(rank) != "") & (wanted(rank) == F.lower(F.coalesce(hit[rank], F.lit(""))))

    mine = wanted("organism")
    likely = (mine != "") & F.contains(F.lower(F.coalesce(hit["organism"], F.lit(""))), F.substring_index(mine, " ", 1))
    return (
        F.when(F.when(likely, species_key(hit["organism"])).otherwise("") == F.when(mine != "", mine), "organism")
        .when(same("genus"), "genus")
        .when(same("family"), "family")
        .when(same("order"), "order")
        .otherwise("none")
    )


def level_depth(c) -> Column:
    """Depth of a concordance level: organism 4 ... none 0."""
    c = _col(c)
    out = F.when(c == "organism", 4)
    for depth, name in ((3, "genus"), (2, "family"), (1, "order")):
        out = out.when(c == name, depth)
    return out.otherwise(0)


def lineage_fields(lineage: Column, marker: str = "Not_found_in_Taxonomy") -> dict[str, Column]:
    """The five ranks of a lineage struct, with defaults when it is unknown."""
    ranks = ["kingdom", "class", "order", "family", "genus"]
    return {
        rank: F.coalesce(lineage[rank], F.when(lineage.isNull() & F.lit(rank == "kingdom"), marker).otherwise("-"))
        for rank in ranks
    }


def natural_key(c) -> Column:
    """Sort key that reads digit runs as numbers, of any length, and ignores case."""
    chunks = F.regexp_extract_all(F.lower(_col(c)), F.lit("([^0-9]+[0-9]*|[0-9]+)"), F.lit(1))

    def key(p: Column) -> Column:
        # Numbers compare by their length without leading zeros, then digit by digit; no number comes first.
        digits = F.regexp_extract(p, "([0-9]+)$", 1)
        number = F.regexp_replace(digits, "^0+(?=.)", "")
        return F.struct(F.regexp_replace(p, "[0-9]+$", "").alias("t"), F.length(number).alias("size"), number.alias("n"))

    return F.transform(chunks, key)


def compress_ranges(numbers) -> Column:
    """Sorted distinct integers as text: ``1..3,5``."""
    a = F.array_sort(F.array_distinct(_col(numbers)))
    start = F.filter(a, lambda x: ~F.array_contains(a, x - 1))
    end = F.filter(a, lambda x: ~F.array_contains(a, x + 1))
    return F.array_join(
        F.zip_with(
            start,
            end,
            lambda s, e: F.when(s == e, s.cast("string")).otherwise(F.concat_ws("..", s.cast("string"), e.cast("string"))),
        ),
        ",",
    )


def query_key(c) -> Column:
    """Query name in the form a search service returns it."""
    return F.replace(_col(c), F.lit(" "), F.lit("_"))
