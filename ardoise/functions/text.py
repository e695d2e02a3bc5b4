"""Column functions on text.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and the letter each one folds to.  OE ligature and sharp s
# are left alone on purpose, as the database function that the oracles use leaves them.
ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def unaccent(c: Column) -> Column:
    return F.translate(c, ACCENTED, FOLDED)


def normalised_label(c: Column) -> Column:
    """Upper case, no accents, dashes and slashes as spaces, single spaces, empty as null."""
    spaced = F.regexp_replace(unaccent(F.upper(F.trim(c))), "[-_/]", " ")
    return F.nullif(F.regexp_replace(spaced, "\\s+", " "), F.lit(""))


def fold(c: Column) -> Column:
    """Lower case, no accents, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(unaccent(F.lower(c)), "[^a-z0-9]+", " "))


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def excerpt(c: Column, size: int = 200) -> Column:
    """Cut at the last space before ``size`` characters and add an ellipsis; without a space, cut hard."""
    head = F.substring(c, 1, size)
    cut = F.regexp_extract(head, "^([\\s\\S]*) [^ ]*$", 1)
    return F.when(F.length(c) <= size, c).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit("…")))


def contract_number(marche_id: Column, uid: Column) -> Column:
    """One spelling of a contract number, from ``marche_id`` or else ``uid``.

    ``uid`` may carry the source as a prefix, other separators, lower case or blanks.  A number in
    the usual form (year, eight digits, key letter) comes out as ``YYYY-NNNNNNNN-L``; anything else
    as its upper-case letters and digits; null where both are null or hold no letter or digit.
    """
    x = F.coalesce(F.nullif(F.trim(marche_id), F.lit("")), uid)
    # Most numbers are in their usual form already: they cost one anchored comparison.
    form = r"^[\s\S]*?(\d{4})[^0-9A-Za-z]*(\d{8})[^0-9A-Za-z]*([A-Za-z])\s*$"
    usual = F.upper(F.regexp_replace(x, form, "$1-$2-$3"))
    plain = F.nullif(F.upper(F.regexp_replace(x, "[^0-9A-Za-z]", "")), F.lit(""))
    return F.when(x.rlike(r"^\d{4}-\d{8}-[A-Z]$"), x).when(x.rlike(form), usual).otherwise(plain)


def trigrams(text: Column) -> Column:
    """Distinct three-letter pieces of each word, two blanks before and one after it, as an array."""
    padded = F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))
