"""Functions of text columns. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content, for claims and premises. Fixed values.
STOP = ["the", "and", "for", "with", "that", "this", "are", "must", "its", "into", "from", "their", "which", "may", "can", "not", "but", "all", "any", "per"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c) -> Column:
    """Without white space at both ends, line ends included."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def collapsed(c) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))


def words(c) -> Column:
    """The words between white space."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), r"\s+"), lambda w: w != "")


def lines(c) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), "\n")


def tokens(c) -> Column:
    """Runs of a-z and 0-9 of the lowered text."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9]+)"))


def content_tokens(c, least: int = 3, stop: list[str] = STOP) -> Column:
    """Distinct tokens of at least so many letters that are no stop words."""
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) >= least) & ~t.isin(stop)))


def fulltext_terms(c, stop: list[str] = STOP, most: int = 14) -> Column:
    """Terms of a full-text query, in order, each once: a letter, then at least two of a-z, 0-9 and the hyphen."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z][a-z0-9-]{2,})"))
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~t.isin(stop))), 1, most)


def sentences(c) -> Column:
    """Sentences end in . ! or ? before white space."""
    return F.filter(F.transform(F.split(trimmed(F.coalesce(col(c), F.lit(""))), r"(?<=[.!?])\s+"), trimmed), lambda s: s != "")


def singular(t: Column) -> Column:
    """Without one s at the end, if over three letters."""
    return F.when(t.endswith("s") & (F.length(t) > 3), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; null if both are empty."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0))


def caption_head(c, most: int = 320) -> Column:
    """A caption cut to length: at the last sentence end past 60 letters, or else at the last space."""
    text = collapsed(c)
    head = F.left(text, F.lit(most))
    # the last ". " of the head, counted from 0
    cut = F.length(head) - F.instr(F.reverse(head), " .") - 1
    at_space = F.length(head) - F.instr(F.reverse(head), " ")
    return (
        F.when(F.length(text) <= most, text)
        .when((F.instr(F.reverse(head), " .") > 0) & (cut >= 60), F.substring(head, F.lit(1), cut + 1))
        .when(F.instr(head, " ") > 0, F.substring(head, F.lit(1), at_space))
        .otherwise(head)
    )


def tags(c, lexicon: dict[str, list[str]]) -> Column:
    """The lexicon's tags of which some term stands in the lowered text, in the lexicon's order; spaces in terms count."""
    low = F.lower(F.coalesce(col(c), F.lit("")))
    found = [F.when(F.exists(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low, t)), F.lit(tag)) for tag, terms in lexicon.items()]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
