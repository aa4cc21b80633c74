"""Text functions over columns. Nulls give null unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def greeting(name: Column, letter: str = "j") -> Column:
    """'Good Bye x' for names that start with the letter in either case, 'Hello x' for all others, the empty one too."""
    leaves = F.lower(F.substring(name, 1, 1)) == letter.lower()
    return F.concat(F.when(leaves, F.lit("Good Bye ")).otherwise(F.lit("Hello ")), name)


def fill(template: Column | str, **values: Column) -> Column:
    """Put values into {{holes}}, one after another in the order given, so a value with a later hole is filled too.

    Values are literal text. A null value shows as 'null'.
    """
    out = F.lit(template) if isinstance(template, str) else template
    for hole, value in values.items():
        out = F.replace(out, F.lit("{{" + hole + "}}"), F.coalesce(value.cast("string"), F.lit("null")))
    return out


def fixed2(x: Column) -> Column:
    """A double with two decimals, decided on its exact binary value, with halves away from zero.

    x * 100 is taken apart into two exact products, so 1.005 (which is below 1.005) gives 1.00 and 0.125 gives 0.13.
    Beyond 10^13, where doubles have at most two binary digits after the point, it is plain formatting.
    """
    a = F.abs(x)
    wide = a * 134217729.0
    high = wide - (wide - a)
    low = a - high
    whole = F.floor(high * 100.0)
    cents = whole + F.floor((high * 100.0 - whole) + low * 100.0 + 0.5)
    exact = F.concat(F.floor(cents / F.lit(100.0)).cast("string"), F.lit("."), F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))
    return F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), F.when(a < 1e13, exact).otherwise(F.format_string("%.2f", a)))


def price(x: Column) -> Column:
    """'$' and two decimals; nothing for null, 0 and NaN."""
    return F.when(x.isNull() | F.isnan(x) | (x == 0), F.lit("")).otherwise(F.concat(F.lit("$"), fixed2(x)))


def portion(name: Column) -> Column:
    """The name in parentheses; nothing for null and empty."""
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("("), name, F.lit(")")))


def quoted(x: Column) -> Column:
    return F.concat(F.lit("'"), x, F.lit("'"))


def with_class(classes: Column, name: str) -> Column:
    """Put a name behind a list separated by spaces, unless its letters stand anywhere in it ('inactive' has 'active')."""
    return F.when(F.contains(classes, F.lit(name)), classes).otherwise(F.concat(classes, F.lit(" "), F.lit(name)))


def without_class(classes: Column, name: str) -> Column:
    """Take the letters of a name out of a list, wherever they stand; the spaces beside them stay."""
    return F.replace(classes, F.lit(name), F.lit(""))


def first_name(name: Column) -> Column:
    """All but the last of the words between spaces; a name without a space as it is."""
    parts = F.split(name, " ")
    return F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " ")).otherwise(name)


def title_words(name: Column) -> Column:
    """Lower case, then the first a-z of each word in upper case."""
    return F.initcap(F.lower(name))


def camel_parts(name: Column) -> Column:
    """Pieces of a camel-case name: cut before each A-Z."""
    return F.split(F.regexp_replace(name, "([A-Z])", ",$1"), ",")


def listed(names: Column) -> Column:
    """Names between commas."""
    return F.split(names, ",")


def number_at_start(text: Column) -> Column:
    """The number that a text begins with, after white space; null where there is none."""
    found = F.regexp_extract(text, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.nullif(found, F.lit("")).try_cast("double")


def number_and_unit(text: Column) -> Column:
    """struct(relative, number, unit) of '+=45deg', '-1.5rad' or '30'; all null where the text is none of these."""
    pattern = r"^(([+-]=)?(-?\d+(\.\d+)?))(.+)?$"
    number = F.nullif(F.regexp_extract(text, pattern, 3), F.lit(""))
    return F.struct(
        F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")).alias("relative"),
        number.try_cast("double").alias("number"),
        F.nullif(F.regexp_extract(text, pattern, 5), F.lit("")).alias("unit"),
    )


def escape_html(text: Column) -> Column:
    """& < > " ' as entities, & first."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"<[^>]*>", "")


def with_suffix(path: Column, suffix: str) -> Column:
    """A file name with a suffix before its extension."""
    return F.regexp_replace(path, r"(\.[^./]+)$", suffix.replace("$", "") + "$1")


def same_page(path: Column, here: Column) -> Column:
    """Whether two paths are equal but for a slash at the start."""
    bare = lambda x: F.regexp_replace(x, "^/", "")
    return bare(path) == bare(here)


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + 0.5)


def unique_id(prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.uuid())
