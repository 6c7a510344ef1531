"""Column expressions for cleaning, parsing and normalising; all built-in, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
STOP = ["the", "and", "for", "was", "are", "that", "this", "with", "from", "des", "les", "une", "der", "die", "das", "und", "que", "los", "las", "del"]


def r6(c: Column) -> Column:
    """Rounded to six places, as all reported doubles are."""
    return F.round(c.cast("double"), 6) + F.lit(0.0)  # no negative zero


def split_trim(c: Column, sep: str = ",") -> Column:
    """A delimited string as an array of trimmed items; null, empty and 'None' give an empty array."""
    nothing = c.isNull() | F.trim(c).isin("", "None")
    return F.when(nothing, F.array().cast("array<string>")).otherwise(F.transform(F.split(c, sep), lambda x: F.trim(x)))


def repair_years(c: Column) -> Column:
    """Years from a comma list in which an item 2020 may have been split into 20,20; well-formed neighbours stay as they are."""
    fixed = F.regexp_replace(c, r"(?<=^|,)20,20(?=,|$)", "2020")
    return F.filter(F.transform(split_trim(fixed), lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def literal_text(c: Column) -> Column:
    """A value written as a Python literal, as plain text: quotes and their prefix removed, None as null."""
    bare = F.regexp_extract(c, r"^u?'(.*)'$", 1)
    return F.when(c.rlike(r"^u?'.*'$"), bare).when(c == "None", F.lit(None)).otherwise(c)


def literal_bool(c: Column) -> Column:
    """True and False in any case; anything else is null."""
    low = F.lower(literal_text(c))
    return F.when(low == "true", True).when(low == "false", False)


def any_true_in_dict(c: Column) -> Column:
    """Whether a dict literal has a True value; False, not null, where there is no dict."""
    return F.coalesce(c.rlike(r"': True"), F.lit(False))


def whitelist(c: Column, allowed: list[str]) -> Column:
    """The value if it is one of those allowed, else null."""
    return F.when(c.isin(allowed), c)


def ascii_fold(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def name_key(c: Column) -> Column:
    """Lower-case ASCII words separated by one space."""
    return F.trim(F.regexp_replace(F.lower(ascii_fold(c)), "[^a-z0-9]+", " "))


def category_slug(c: Column) -> Column:
    """cat_ and the lower-case name with blanks and slashes as underscores and & spelled out."""
    return F.concat(F.lit("cat_"), reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&", "and"), (" ", "_"), ("/", "_")], F.lower(c)))


def tokens_plain(c: Column, stop: list[str] = STOP) -> Column:
    """Runs of a-z longer than two letters that are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(stop))


def tokens_apostrophe(c: Column, stop: list[str] = STOP) -> Column:
    """Runs of a-z and apostrophes of three characters or more that begin with a letter and are no stop words."""
    return F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z']{2,}"), F.lit(0)), lambda t: ~t.isin(stop))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def week_ending_sunday(day: Column) -> Column:
    """The Sunday that ends the date's week."""
    return F.date_add(day, 6 - F.weekday(day))


def census_number(c: Column) -> Column:
    """A census figure; the sentinels for suppressed values (-6666...) are null."""
    return F.when(~c.startswith("-6666"), c.try_cast("double"))
