"""Column functions on numbers and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def half_up(c: Column, digits: int) -> Column:
    """Rounding on the decimal value, so that exact halves go the same way in every engine."""
    return F.round(c.cast("decimal(30,8)"), digits).cast("double")


def band(c: Column, cuts: list[float], labels: list[str], missing: str | None = None) -> Column:
    """Label of the first cut that the value lies under; the last label above all; null or ``missing`` for null."""
    out = reduce(lambda w, k: w.when(c < cuts[k], labels[k]), range(1, len(cuts)), F.when(c.isNull(), F.lit(missing)).when(c < cuts[0], labels[0]))
    return out.otherwise(labels[-1])


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where the whole is zero."""
    return F.try_divide(F.lit(100.0) * part, whole.cast("double"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    """Wilson interval of a proportion in percent; (0, 100) without observations."""
    p, nd = F.try_divide(k.cast("double"), n.cast("double")), n.cast("double")
    z2 = Z95 * Z95
    centre = (p + z2 / (2 * nd)) / (1 + z2 / nd)
    half = Z95 * F.sqrt(p * (1 - p) / nd + z2 / (4 * nd * nd)) / (1 + z2 / nd)
    return F.when(n == 0, 0.0).otherwise(100 * F.greatest(F.lit(0.0), centre - half)), F.when(n == 0, 100.0).otherwise(100 * F.least(F.lit(1.0), centre + half))


def wald(k: Column, n: Column) -> tuple[Column, Column]:
    """Wald interval of a proportion in percent; null without observations."""
    p = F.try_divide(k.cast("double"), n.cast("double"))
    half = Z95 * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")))
    return 100 * F.greatest(F.lit(0.0), p - half), 100 * F.least(F.lit(1.0), p + half)


def french_decimal(text: Column) -> Column:
    """A number typed in French (spaces of any kind, decimal comma); null if it is none or negative."""
    spaces = " \u00a0\u2009\u202f"
    number = F.translate(F.translate(text, ",", "."), spaces, "").try_cast("double")
    return F.when(number >= 0, number)


def french_euros(x: Column) -> Column:
    """12,3 milliards / millions / 850 euros, singular under two; null says that nothing was published."""
    def said(v: Column, unit: str) -> Column:
        shown = F.regexp_replace(F.format_number(v, 1).cast("string"), r"\.0$", "")
        return F.concat(F.translate(F.replace(shown, F.lit(","), F.lit(" ")), ".", ","), F.lit(" " + unit), F.when(F.round(v, 1) >= 2, "s").otherwise(""))

    whole = F.replace(F.format_number(x, 0), F.lit(","), F.lit(" "))
    return (F.when(x.isNull(), "montant non publié").when(x >= 1e9, said(x / 1e9, "milliard")).when(x >= 1e6, said(x / 1e6, "million"))
            .otherwise(F.concat(whole, F.lit(" euro"), F.when(F.round(x, 0) >= 2, "s").otherwise(""))))


def ratio_phrase(x: Column, median: Column) -> Column:
    """How an amount compares to the median of its peers."""
    r = F.try_divide(x, median)
    return F.when(r >= 2, F.concat(F.format_number(r, 1), F.lit(" fois la médiane"))).when(r > 1.05, "au-dessus de la médiane").when(r < 0.95, "en dessous de la médiane").when(r.isNotNull(), "proche de la médiane")
