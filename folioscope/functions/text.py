"""Column functions on text: blankness, page states, languages, slices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The languages whose names and codes parsers understand.
LANGUAGE_CODES = {
    "en": "en", "eng": "en", "english": "en",
    "fr": "fr", "fra": "fr", "fre": "fr", "french": "fr",
    "de": "de", "deu": "de", "ger": "de", "german": "de",
    "lb": "lb", "ltz": "lb", "luxembourgish": "lb",
}
#: The same languages by their three-letter codes.
THREE_LETTERS = {"en": "eng", "fr": "fra", "de": "deu", "lb": "ltz"}


def is_blank(text: Column) -> Column:
    """No character but white space of any script; null stays null."""
    return ~text.rlike(r"(?U)\S")


def page_status(content: Column) -> Column:
    """failed for null, empty for blank, success otherwise."""
    return F.when(content.isNull(), "failed").when(is_blank(content), "empty").otherwise("success")


def page_content(content: Column) -> Column:
    """Blank content becomes the empty string."""
    return F.when(is_blank(content), "").otherwise(content)


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """The half-open code-point slice."""
    return F.substring(text, start + 1, end - start)


def normalize_language(label: Column, letters: int = 2) -> Column:
    """The code of a known language, else the trimmed lower-case label."""
    table = LANGUAGE_CODES if letters == 2 else {k: THREE_LETTERS[v] for k, v in LANGUAGE_CODES.items()}
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    bare = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    return F.coalesce(F.element_at(pairs, bare), bare)


def first_language(*labels: Column, default: str = "en") -> Column:
    """The first label that is not blank, else the default."""
    filled = [F.when(~is_blank(x), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) for x in labels]
    return F.coalesce(*filled, F.lit(default))
