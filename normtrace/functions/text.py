"""String functions: Unicode strip, header and triplet patterns, fact text, literal templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the scenario format looks like. ``WS`` is the white space that Python's
# ``str.strip`` and ``\s`` accept; Java's ``\s`` needs (?U) and leaves out the four separators.
WS = r"[\s\x1c-\x1f]"
SCENARIO_HEADER = rf"(?U)Scenario{WS}+\d+{WS}*:[^\n]*"
TRIPLET = rf"(?U)\(([^,]+),{WS}*([^,]+),{WS}*([^)]+)\)"
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())

NO_TEXT = "Aucun texte à analyser"


def strip(text: Column) -> Column:
    """Drop Unicode white space from both ends (``trim`` alone would drop spaces only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_blank(text: Column) -> Column:
    return text.isNull() | (strip(text) == "")


def scenario_headers(text: Column) -> Column:
    """All header lines of ``text``, in order, stripped."""
    found = F.regexp_extract_all(text, F.lit(SCENARIO_HEADER), F.lit(0))
    return F.transform(found, strip)


def scenario_bodies(text: Column) -> Column:
    """The text after each header, aligned with :func:`scenario_headers`."""
    pieces = F.split(text, SCENARIO_HEADER)
    return F.slice(pieces, 2, 2**31 - 1)


def triplets(body: Column) -> Column:
    """``array<struct<subject, relation, object>>`` of all ``(a, b, c)`` groups, stripped.

    The object may hold commas; the subject may run over lines or take in an earlier bracket.
    """
    part = lambda group: F.regexp_extract_all(body, F.lit(TRIPLET), F.lit(group))
    zipped = F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"))
    return F.transform(
        zipped,
        lambda t: F.struct(
            strip(t["a"]).alias("subject"),
            strip(t["b"]).alias("relation"),
            strip(t["c"]).alias("object"),
        ),
    )


def fact_text(subject: Column, relation: Column, object_: Column) -> Column:
    """``"s r o"``; a missing part counts as empty but keeps its space."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return strip(F.concat(part(subject), F.lit(" "), part(relation), F.lit(" "), part(object_)))


def fact_text_any_case(fact: Column, fields: list[str]) -> Column:
    """Fact text of a struct whose keys are written in lower case, or failing that capitalised."""
    def pick(key: str) -> Column:
        names = [n for n in (key, key.capitalize()) if n in fields]
        return F.coalesce(*[fact[n] for n in names], F.lit(""))

    return fact_text(pick("subject"), pick("relation"), pick("object"))


def fill_template(template: str | Column, values: dict[str, Column]) -> Column:
    """Put each value in place of ``{name}``, literally, one name after the other."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def text_or_sentinel(text: Column, sentinel: str = NO_TEXT) -> Column:
    """``text``, or the sentinel where it is null or blank."""
    return F.when(is_blank(text), F.lit(sentinel)).otherwise(text)
