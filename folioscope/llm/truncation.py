"""Texts cut off by field limits or in transfer.

For each source the discrete hazard of every text length (in characters and in
bytes) is tested against the hazards around it; lengths that pass a
Benjamini-Hochberg control within the source are its limits.  Two classes of
cut texts come out:

``limit``  an incomplete ending at a limit: anything but a complete sentence or
    form.  Open endings need no further sign there; list entries, headings and
    table rows are incomplete where their form is not known as whole.
``transfer``  an open ending at any other length, where no limit speaks for a
    cut: it counts only if its form is not known as whole.

A form is a line with names and numbers masked.  It is known as whole if at
least ``whole_share`` of its occurrences stand inside texts, where no cut
reaches, rather than at ends; a share, so it holds at every size.

Defined results: null and blank texts are not truncated; a null source is a
source of its own; repeated rows count in the hazards as often as they occur
and come out once; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import checkpoint

_BLANK = " \n\r\t   　"
_MARK = r"\s*(\.\.\.|…|\[\s*(\.\.\.|…)\s*\]|\(\s*(more|continued|cont\.|truncated|\.\.\.|…)\s*\)|\[\s*(more|continued|truncated)\s*\])$"
_SENTENCE = r"""[.!?。！？]["'’»”)\]]*$"""
#: a number of a sum that only a cut leaves before a full stop; years may end a sentence
_LOOSE_NUMBER = r"(^|\s)(?!(19|20)\d\d\.)\d[\d.,]*\.$"
#: forms that end a text without a full stop
_FORMS = (
    ("notes", r"^\s*(\[\d+\]\s*)+(\.\.\.|…)?$"),
    ("table", r"^\s*\|.*\|$"),
    ("heading", r"^\s*#{1,6}\s+\S"),
    ("list", r"^\s*([-*•]|\d+[.)])\s+\S"),
    ("total", r"(\.{4,}|…{2,})\s*\S*\d$"),
    ("signature", r"^\s*[—–]\s*\p{Lu}[\p{L}.'-]*(\s+\p{Lu}[\p{L}.'-]*)+$"),
    ("link", r"^\s*(https?://)?[\p{L}\d-]+(\.[\p{L}\d-]+)+(/\S*)?$"),
    ("date", r"^\s*\p{Lu}[\p{L}' -]*,\s*\d{1,2}[./-]\d{1,2}[./-]\d{4}$"),
)


def _shape(line: Column) -> Column:
    """A line with names, numbers and heading marks masked."""
    bare = F.regexp_replace(line, r"^\s*#{1,6}\s+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\p{Lu}\p{Ll}{4,}", "N"), r"[\d.,]*\d", "0")


def _ending(line: Column) -> Column:
    bare = F.regexp_replace(line, _MARK, "")
    marked = bare != line
    sentence = bare.rlike(_SENTENCE) & ~bare.rlike(_LOOSE_NUMBER)
    kind = F.when(F.trim(line) == "", "none")
    name, pattern = _FORMS[0]
    kind = kind.when(line.rlike(pattern), name).when(sentence, "sentence").when(marked, "open")
    for name, pattern in _FORMS[1:]:
        kind = kind.when(line.rlike(pattern), name)
    return kind.otherwise("open")


def text_endings(documents: DataFrame) -> DataFrame:
    """``doc_id, source, chars, bytes, ending, shape``; ``shape`` only where whole forms are looked up."""
    body = F.rtrim("text", F.lit(_BLANK))
    line = F.substring_index(body, "\n", -1)
    return (
        documents.where("text is not null")
        .select(
            "doc_id",
            "source",
            F.length("text").alias("chars"),
            F.octet_length("text").alias("bytes"),
            line.alias("line"),
        )
        .withColumn("ending", _ending(F.col("line")))
        .withColumn("shape", F.when(F.col("ending").isin("open", "list", "heading", "table"), _shape(F.col("line"))))
        .drop("line")
    )


def whole_forms(documents: DataFrame, endings: DataFrame, whole_share: float = 0.6) -> DataFrame:
    """Shapes of lines without a full stop that stand inside texts far more often than at ends.

    Inside and end occurrences grow alike, so the share does not depend on the
    size of the collection; one occurrence more at ends keeps chance meetings
    of a few lines from counting.
    """
    lines = F.split("text", "\n")
    inside = (
        documents.where("text is not null")
        # outer, so that the texts are not split once more to test for lines; null lines fall below
        .select(F.explode_outer(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))).alias("line"))
        .withColumn("line", F.rtrim("line", F.lit(_BLANK)))
        .where((F.length("line") > 0) & ~F.substring(F.col("line"), -1, 1).isin(".", "!", "?"))
        .groupBy(_shape(F.col("line")).alias("shape"))
        .agg(F.count("*").alias("inside"))
    )
    ends = endings.where("shape is not null").groupBy("shape").agg(F.count("*").alias("at_end"))
    # only shapes that some text ends in are ever looked up
    return (
        ends.join(inside, "shape")
        .where(F.col("inside") >= whole_share * (F.col("inside") + F.col("at_end") + 1))
        .select("shape")
    )


def length_limits(endings: DataFrame, span: int = 64, level: float = 0.001) -> DataFrame:
    """``source, unit, size, n, at_risk, p`` of the lengths whose hazard stands out.

    Rows are counted by (source, unit, length) first, so the windows see
    lengths, not texts, however large a source is.  ``p`` is the Chernoff bound
    of the Poisson tail of the count expected from the hazards within ``span``.
    """
    counts = (
        endings.select("source", F.explode(F.create_map(F.lit("chars"), "chars", F.lit("bytes"), "bytes")).alias("unit", "size"))
        .groupBy("source", "unit", "size")
        .agg(F.count("*").alias("n"))
    )
    own = Window.partitionBy("source", "unit")
    risk = own.orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = own.orderBy("size").rangeBetween(-span, span)
    tested = (
        counts.withColumn("at_risk", F.sum("n").over(risk))
        .withColumn("hazard", F.col("n") / F.col("at_risk"))
        .withColumn("near_n", F.sum("n").over(near) - F.col("n"))
        .withColumn("near_risk", F.max("at_risk").over(near) * 2.0 * span)
        .withColumn("expected", (F.col("near_n") + 1.0) / F.col("near_risk") * F.col("at_risk"))
        .withColumn(
            "p",
            F.when(
                F.col("n") > F.col("expected"),
                F.exp(F.col("n") - F.col("expected") + F.col("n") * F.log(F.col("expected") / F.col("n"))),
            ).otherwise(1.0),
        )
    )
    ranked = tested.withColumn("tests", F.count("*").over(own)).withColumn(
        "place", F.rank().over(own.orderBy("p"))
    )
    passing = ranked.withColumn(
        "last", F.max(F.when(F.col("p") <= level * F.col("place") / F.col("tests"), F.col("place"))).over(own)
    )
    return passing.where(F.col("place") <= F.col("last")).select(
        "source", "unit", "size", "n", "at_risk", "hazard", "p"
    )


def detect_truncation(
    documents: DataFrame, whole_share: float = 0.6, level: float = 0.001, use_limits: bool = True
) -> DataFrame:
    """``doc_id, source, chars, ending, limit_unit, limit_size, cut_class, truncated`` of every text.

    ``cut_class`` is limit, transfer or null.  ``use_limits`` off leaves the
    hazards out, which shows what they decide.
    """
    endings = checkpoint(text_endings(documents))
    limits = length_limits(endings, level=level).select(F.col("source").alias("s"), "unit", "size")
    if not use_limits:
        limits = limits.where("false")
    here = lambda unit: limits.where(F.col("unit") == unit).select("s", F.col("size").alias(unit + "_limit")).distinct()
    by_chars, by_bytes = here("chars"), here("bytes")
    forms = whole_forms(documents, endings, whole_share).select(F.col("shape").alias("whole"))
    placed = (
        endings.join(by_chars, endings["source"].eqNullSafe(by_chars["s"]) & (F.col("chars") == F.col("chars_limit")), "left")
        .drop("s")
        .join(by_bytes, endings["source"].eqNullSafe(by_bytes["s"]) & (F.col("bytes") == F.col("bytes_limit")), "left")
        .drop("s")
        .withColumn("at_limit", F.col("chars_limit").isNotNull() | F.col("bytes_limit").isNotNull())
    )
    is_open = F.col("ending") == "open"
    # a limit decides open endings; there the forms decide what may be a fragment, elsewhere what is open
    doubted = F.when(F.col("at_limit"), F.col("ending").isin("list", "heading", "table")).otherwise(is_open)
    known = placed.withColumn("asked", F.when(doubted, F.col("shape")))
    looked = known.where("asked is not null").join(forms, F.col("asked") == F.col("whole"), "left")
    judged = looked.withColumn("truncated", F.col("whole").isNull()).drop("whole")
    rest = known.where("asked is null").withColumn("truncated", F.col("at_limit") & is_open)
    return judged.unionByName(rest).select(
        "doc_id",
        "source",
        "chars",
        "ending",
        F.when(F.col("chars_limit").isNotNull(), "chars").when(F.col("bytes_limit").isNotNull(), "bytes").alias("limit_unit"),
        F.coalesce("chars_limit", "bytes_limit").alias("limit_size"),
        F.when(F.col("truncated") & F.col("at_limit"), "limit").when(F.col("truncated"), "transfer").alias("cut_class"),
        "truncated",
    )


def truncation_report(judged: DataFrame) -> DataFrame:
    """Texts, cut texts, their share, and the cuts at a limit and in transfer, per source."""
    return judged.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.count_if("truncated").alias("cut"),
        F.round(F.count_if("truncated") / F.count("*"), 6).alias("share"),
        F.count_if(F.col("cut_class") == "limit").alias("cut_at_limit"),
        F.count_if(F.col("cut_class") == "transfer").alias("cut_in_transfer"),
    )
