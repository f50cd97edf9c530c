"""Functions over letter sequences (alphabet ACGT or ACGU, N masked). Positions are 1-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .nulls import ColumnLike, _c

#: Terminal positions and their (start, length) in ``substring`` (fixed values).
TERMINALS = {"5p1": 1, "5p2": 2, "3p2": -2, "3p1": -1}

#: Nearest-neighbour stacks in kcal/mol and the corrections of an A-U end by its neighbour (fixed values).
STACK_DG = {
    "AA": -0.94, "AC": -2.25, "AG": -2.01, "AU": -1.09,
    "CA": -2.07, "CC": -3.28, "CG": -2.33, "CU": -2.01,
    "GA": -2.42, "GC": -3.46, "GG": -3.28, "GU": -2.25,
    "UA": -1.29, "UC": -2.42, "UG": -2.07, "UU": -0.94,
}
END_CORRECTION = {"AU": 0.22, "GC": 0.44}


def letter_at(s: ColumnLike, position: ColumnLike | int) -> Column:
    """Letter at a 1-based position; outside the sequence raises."""
    p = F.lit(position) if isinstance(position, int) else _c(position)
    ok = (p >= 1) & (p <= F.length(_c(s)))
    return F.when(ok, F.substring(_c(s), p, F.lit(1))).otherwise(F.raise_error(F.lit("position outside the sequence")).cast("string"))


def terminal_letters(s: ColumnLike) -> dict[str, Column]:
    """The two letters at either end; NULL below two letters."""
    return {k: F.when(F.length(_c(s)) >= 2, F.substring(_c(s), v, 1)) for k, v in TERMINALS.items()}


def revcomp(s: ColumnLike, rna: bool = False) -> Column:
    """Reverse complement; letters outside the alphabet keep their value."""
    return F.reverse(F.translate(_c(s), "ACGU" if rna else "ACGT", "UGCA" if rna else "TGCA"))


def normalize(s: ColumnLike, rna: bool = False) -> Column:
    """White space removed, upper case, T and U unified; an ambiguous letter raises."""
    v = F.upper(F.regexp_replace(_c(s), r"\s", ""))
    v = F.translate(v, "T", "U") if rna else F.translate(v, "U", "T")
    pattern = "^[ACGU]*$" if rna else "^[ACGT]*$"
    return F.when(v.rlike(pattern), v).otherwise(F.raise_error(F.lit("ambiguous letter in a sequence")).cast("string"))


def is_plain(s: ColumnLike) -> Column:
    """True for a non-empty sequence of ACGT only."""
    return F.coalesce(_c(s).rlike("^[ACGT]+$"), F.lit(False))


def oriented(s: ColumnLike, strand: ColumnLike) -> Column:
    """Expected sequences of the antisense strand are reverse-complemented; others stay."""
    return F.when(_c(strand) == "antisense", revcomp(s)).otherwise(_c(s))


def mirror_position(position: ColumnLike, length: ColumnLike) -> Column:
    """Position counted from the other end."""
    return _c(length) - _c(position) + 1


def opposite_strand(strand: ColumnLike) -> Column:
    """sense <-> antisense; any other text raises."""
    return (
        F.when(_c(strand) == "sense", F.lit("antisense"))
        .when(_c(strand) == "antisense", F.lit("sense"))
        .otherwise(F.raise_error(F.lit("unknown strand")).cast("string"))
    )


def letter_fraction(s: ColumnLike, letters: str, start: int | None = None, width: int | None = None) -> Column:
    """Share of ``letters`` in a slice (the whole sequence by default); a negative start counts from the end."""
    part = _c(s) if start is None else F.substring(_c(s), start, width)
    return F.try_divide(F.length(F.regexp_replace(part, f"[^{letters}]", "")).cast("double"), F.length(part).cast("double"))


def gc_fraction(s: ColumnLike, start: int | None = None, width: int | None = None) -> Column:
    return letter_fraction(s, "GC", start, width)


def guide_indicators(guide: ColumnLike) -> dict[str, Column]:
    """Indicators and end letters of a guide: A third from the 3' end, A or U at 17, A or G at 10."""
    g = _c(guide)
    flag = lambda cond: cond.cast("int")
    return {
        "A3p3": flag(F.substring(g, -3, 1) == "A"),
        "W17": flag(F.substring(g, 17, 1).isin("A", "T", "U")),
        "R10": flag(F.substring(g, 10, 1).isin("A", "G")),
        "gc_central": gc_fraction(g, -10, 6),
        **{f"letter_{k}": v for k, v in terminal_letters(F.translate(g, "T", "U")).items()},
    }


def one_hot(x: ColumnLike, levels: list[str], reference: str, prefix: str) -> dict[str, Column]:
    """0/1 doubles for every level but the reference, in the given order."""
    return {f"{prefix}_{v}": (_c(x) == v).cast("double") for v in levels if v != reference}


def text_digest(*parts: ColumnLike, sep: str = "\x1f") -> Column:
    """SHA-256 of the parts joined by a separator that occurs in none of them."""
    return F.sha2(F.concat_ws(sep, *[_c(p).cast("string") for p in parts]), 256)


def stable_id(prefix: str, *parts: ColumnLike) -> Column:
    """Prefix and 24 hexadecimal digits of the parts' digest."""
    return F.concat(F.lit(prefix), F.substring(text_digest(*parts), 1, 24))


def clean_identifier(*parts: ColumnLike) -> Column:
    """Parts joined by two underscores, every run of other characters replaced by one underscore."""
    return F.regexp_replace(F.concat_ws("__", *[_c(p).cast("string") for p in parts]), "[^A-Za-z0-9_.-]+", "_")


def window_identifier(target: ColumnLike, length: ColumnLike, start: ColumnLike, end: ColumnLike, digits: int = 4) -> Column:
    """TARGET__23nt__0001_0023, padded to at least ``digits``."""
    pad = lambda x: F.when(F.length(_c(x).cast("string")) >= digits, _c(x).cast("string")).otherwise(F.lpad(_c(x).cast("string"), digits, "0"))
    return F.concat(_c(target), F.lit("__"), _c(length).cast("string"), F.lit("nt__"), pad(start), F.lit("_"), pad(end))


def cigar_span(cigar: ColumnLike) -> Column:
    """Reference letters that an alignment covers: the sum over M, D, N, = and X."""
    sizes = F.regexp_extract_all(_c(cigar), F.lit(r"(\d+)[MDN=X]"), F.lit(1))
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda acc, x: acc + x.try_cast("long"))


def parse_int_list(x: ColumnLike, sep: str = ",", high: int | None = None) -> Column:
    """Sorted distinct positive integers of a delimited text; anything else raises."""
    items = F.transform(F.split(_c(x), sep), lambda v: F.trim(v).try_cast("int"))
    ok = F.forall(items, lambda v: v.isNotNull() & (v > 0) & (v <= (high or 2**31 - 1))) & (F.size(F.array_distinct(items)) == F.size(items))
    return F.when(ok, F.array_sort(items)).otherwise(F.raise_error(F.lit("bad integer list")).cast("array<int>"))


def owner_prefix(x: ColumnLike) -> Column:
    """Text before the first vertical bar."""
    return F.substring_index(_c(x), "|", 1)


def tag_map(x: ColumnLike, pair: str = " ", kv: str = ":") -> Column:
    """Map of delimited tags."""
    return F.str_to_map(_c(x), F.lit(pair), F.lit(kv))


def stack_energy(s: ColumnLike, k: int, stacks: dict[str, float] | None = None, correction: dict[str, float] | None = None) -> Column:
    """Sum of the k-1 leading stacks plus the end correction set by the first two letters.

    The correction applies if the first letter is A or U; its value depends on
    whether the second is A/U or G/C. NULL below k letters.
    """
    stacks, correction = stacks or STACK_DG, correction or END_CORRECTION
    table = F.create_map(*[F.lit(x) for kv in stacks.items() for x in kv])
    steps = F.sequence(F.lit(1), F.lit(k - 1))
    total = F.aggregate(steps, F.lit(0.0), lambda acc, i: acc + F.try_element_at(table, F.substring(_c(s), i, F.lit(2))))
    first, second = F.substring(_c(s), 1, 1), F.substring(_c(s), 2, 1)
    end = F.when(first.isin("A", "U"), F.when(second.isin("A", "U"), F.lit(correction["AU"])).otherwise(F.lit(correction["GC"]))).otherwise(0.0)
    return F.when(F.length(_c(s)) >= k, total + end)


def explode_letters(df: DataFrame, seq: str, position: str = "position", letter: str = "letter") -> DataFrame:
    """One row per letter with its 1-based position. Empty and NULL sequences give none."""
    return (
        df.filter(F.length(seq) > 0)
        .select("*", F.posexplode(F.split(F.col(seq), "")).alias("_p", letter))
        .withColumn(position, (F.col("_p") + 1).cast("int"))
        .drop("_p")
    )


def explode_windows(df: DataFrame, seq: str, k: Column | int, start: str = "start", window: str = "window") -> DataFrame:
    """Every k-letter window of each record with its start; shorter records give none."""
    width = F.lit(k) if isinstance(k, int) else k
    return (
        df.filter(F.length(seq) >= width)
        .select("*", F.explode(F.sequence(F.lit(1), F.length(seq) - width + 1)).alias(start))
        .withColumn(window, F.substring(F.col(seq), F.col(start), width))
    )
