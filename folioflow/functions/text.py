"""Text as column expressions: whitespace, titles, spans, keys. Offsets are code points, from 0, half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"\p{L}+"


def normal_space(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))


def words(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(WORD), F.lit(0))


def word_count(t: Column) -> Column:
    """Tokens between blanks."""
    return F.regexp_count(t, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


def span(t: Column, start: Column, stop: Column) -> Column:
    return F.substring(t, start + 1, stop - start)


def context(t: Column, start: Column, stop: Column, radius: int = 90) -> Column:
    """What stands around a span, blanks collapsed, with marks where it was cut."""
    a, z = F.greatest(start - radius, F.lit(0)), F.least(stop + radius, F.length(t))
    return F.concat(F.when(a > 0, "…").otherwise(""), normal_space(span(t, a, z)), F.when(z < F.length(t), "…").otherwise(""))


def short_title(t: Column) -> Column:
    """The part before the first full stop and blank, when something follows."""
    at = F.locate(". ", t)
    return F.when((at > 1) & (F.length(t) > at + 1), F.substring(t, F.lit(1), at - 1)).otherwise(t)


def calm_title(t: Column, small: tuple[str, ...]) -> Column:
    """A title in capitals as capitalised words, small words low but for the first; any lower-case letter leaves it as it is."""
    shouted = (t == F.upper(t)) & (t != F.lower(t))
    parts = F.split(F.lower(t), " ")
    calm = F.array_join(F.transform(parts, lambda w, i: F.when((i > 0) & w.isin(*small), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))))), " ")
    return F.when(shouted, calm).otherwise(t)


def term_key(t: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), " ")


def normal_quote(t: Column) -> Column:
    """Straight quotes and dashes, single blanks, lower case, no quotes or end marks around."""
    flat = F.lower(normal_space(F.translate(t, "“”„«»‘’—", "\"\"\"\"\"''-")))
    return F.regexp_replace(flat, r"^[\"' ]+|[\"' .,;:!?]+$", "")


def capitals_share(t: Column) -> Column:
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    return F.when(letters > 0, F.length(F.regexp_replace(t, r"[^\p{Lu}]", "")) / letters)


def letters_only(t: Column) -> Column:
    return F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "")


def length_ratio(new: Column, old: Column) -> Column:
    return F.length(new) / F.greatest(F.lit(1), F.length(old))


def band(z: Column) -> Column:
    return F.when(z >= 5, "very_common").when(z >= 4, "common").when(z >= 3, "uncommon").otherwise("rare")
