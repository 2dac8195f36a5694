"""Names, genders, ages and dates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Allowed edits by the most edits asked for, for names of 1, 2-5, 6-8, 9-11 and 12 or more characters (fixed values).
ALLOWED = {0: (0, 0, 0, 0, 0), 1: (0, 0, 1, 1, 1), 2: (0, 1, 1, 2, 2), 3: (0, 1, 2, 2, 3), 4: (0, 1, 2, 3, 4)}


def canonical(name: Column) -> Column:
    """Spaces and hyphens become underscores; an empty name is null."""
    return F.nullif(F.translate(name, " -", "__"), F.lit(""))


def first_names(given: Column) -> Column:
    """Single first names; empty ones inside stay, those at the end go, and only separators give none."""
    name = F.regexp_replace(canonical(given), "_+$", "")
    return F.when(name == "", F.array().cast("array<string>")).otherwise(F.split(name, "_", -1))


def probe_count(given: Column) -> Column:
    """Number of first names on the searching side: spaces and one, -1 for no name; hyphens don't count."""
    return F.when(F.coalesce(F.length(given), F.lit(0)) == 0, -1).otherwise(F.length(given) - F.length(F.replace(given, F.lit(" "), F.lit(""))) + 1)


def index_count(given: Column) -> Column:
    """Number of first names on the indexed side, hyphens counted."""
    return F.size(first_names(given))


def gender(value: Column) -> Column:
    low = F.lower(value)
    return F.when(value.endswith("Female") | low.isin("f", "female"), "FEMALE").when(value.endswith("Male") | low.isin("m", "male"), "MALE").otherwise("UNKNOWN")


def gender_fits(value: Column, wanted: str) -> Column:
    return gender(value).isin(wanted, "UNKNOWN")


def is_valid(given: Column, family: Column, event: Column) -> Column:
    """A full name: both parts, and a given name other than the placeholder n."""
    return F.coalesce((F.length(given) > 0) & (given != "n") & (F.length(family) > 0), F.lit(False)) & event.isNotNull()


def allowed(length: Column, most: int, fixed: bool = False) -> Column:
    if most not in ALLOWED:
        raise ValueError("most edits must be 0 to 4")
    if fixed:
        return F.when(length == 0, 0).otherwise(most)
    one, five, eight, eleven, more = ALLOWED[most]
    return F.when(length == 0, 0).when(length == 1, one).when(length < 6, five).when(length < 9, eight).when(length < 12, eleven).otherwise(more)


def allowed_edits(n: int, most: int, fixed: bool = False) -> int:
    """allowed() for a name of n characters."""
    if n == 0:
        return 0
    return most if fixed else ALLOWED[most][(n > 1) + (n > 5) + (n > 8) + (n > 11)]


def iso_date(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(value, F.lit("yyyy-MM-dd")).cast("date"))


def whole_number(value: Column) -> Column:
    """Integer, or -1."""
    return F.coalesce(F.trim(value).try_cast("int"), F.lit(-1))


def year_gap(a: Column, b: Column) -> Column:
    """Whole years from a to b, cut towards zero."""
    packed = lambda d: (F.year(d) * 12 + F.month(d)) * 32 + F.day(d)
    days = packed(b) - packed(a)
    return (F.sign(days) * F.floor(F.floor(F.abs(days) / 32) / 12)).cast("int")


def age_gap(before: Column, after: Column) -> Column:
    """after - before if both are known and in order, else -1."""
    b, a = F.coalesce(before, F.lit(-1)), F.coalesce(after, F.lit(-1))
    return F.when((b >= 0) & (a >= b), a - b).otherwise(-1)


def combinations(given: Column, family: Column) -> Column:
    """Full names that a person with several first names may go by, with the share of first names used.

    For each first name: it alone, then joined by the others in their order, one after another. Structs (name, used, of).
    """
    all_of = first_names(given)
    n = F.size(all_of)
    whole = lambda parts: F.concat(F.array_join(parts, "_"), F.lit(" "), canonical(family))

    def of_one(name: Column, at: Column) -> Column:
        others = F.filter(all_of, lambda _, j: j != at)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(whole(F.concat(F.array(name), F.slice(others, F.lit(1), k))).alias("name"), (k + 1).alias("used"), n.alias("of")))

    return F.when(n > 0, F.array_distinct(F.flatten(F.transform(all_of, of_one))))


def duration(seconds: Column) -> Column:
    """Whole seconds as HH:MM:SS; hours may have more digits."""
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    s = seconds.cast("long")
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s / 60) % 60), two(s % 60))


def uuid3(value: Column) -> Column:
    """Version 3 UUID of the MD5 of the bare bytes."""
    m = F.md5(value)
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(m, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.concat(F.lit("3"), F.substring(m, 14, 3)), F.concat(variant, F.substring(m, 18, 3)), F.substring(m, 21, 12))
