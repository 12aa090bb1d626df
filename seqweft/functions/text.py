"""String functions: headers, residues, names. Survey IDs in brackets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty canonical residues.
CANONICAL = "ACDEFGHIKLMNPQRSTVWY"
# Characters that a file name can't hold, and the name for what is empty.
UNSAFE, UNNAMED = r'[\\/:*?"<>|]', "unnamed_bacteria"


def strip(c: Column) -> Column:
    """White space of any Unicode kind off both ends [STR-01]; Spark's trim takes spaces only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_spaces(c: Column) -> Column:
    """Spaces of any width off both ends, but no tabs or line breaks: SQL's trim."""
    return F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+\z", "")


def ambiguous_residues(seq: Column) -> Column:
    """Distinct characters outside the canonical twenty, by code point, joined; case counts [STR-05, SET-01, ARR-03]."""
    rest = F.translate(seq, CANONICAL, "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(rest, ""), lambda x: x != ""))), "")


def functional_annotation(header: Column) -> Column:
    """Header text after the first single space and before the first [, or empty [STR-02]."""
    h = strip(header)
    at = F.locate(" ", h)
    rest = F.substring(h, at + 1, F.length(h))
    return F.when(at == 0, F.lit("")).otherwise(strip(F.substring_index(rest, "[", 1)))


def header_fields(header: Column, spaces: bool = False) -> Column:
    """struct<id_token, remainder, annotations, malformed> [STR-03, STR-04, HDR-01, MAP-01].

    Annotations are the [..] segments of the remainder, stripped. An unclosed [ makes the header malformed and drops
    them; an empty header is malformed. A null header gives nulls. With spaces, the first single space ends the token,
    the remainder stays as it stands, and annotations lose spaces alone; else white space of any kind, in runs, does
    what spaces do, and is stripped.
    """
    h, off = (header, strip_spaces) if spaces else (strip(header), strip)
    parts = F.split(h, " " if spaces else r"(?U)\s+", 2)
    remainder = F.when(h.isNotNull(), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))
    segments = F.regexp_extract_all(remainder, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    left_open = F.contains(F.regexp_replace(remainder, r"\[[^\]]*\]", ""), F.lit("["))
    bad = left_open | (h == "")
    kept = F.when(bad, F.array().cast("array<string>")).otherwise(F.transform(segments, off))
    return F.struct(parts[0].alias("id_token"), remainder.alias("remainder"), kept.alias("annotations"), bad.alias("malformed"))


def safe_name(name: Column) -> Column:
    """A name fit for a file system [STR-13]."""
    s = F.regexp_replace(strip(name), UNSAFE, "_")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", "_"), "_+", "_")
    s = F.regexp_replace(s, "^_|_$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit(UNNAMED))


def without_one_slash(c: Column) -> Column:
    """[STR-08]"""
    return F.regexp_replace(c, "/$", "")


def without_slashes(c: Column) -> Column:
    r"""[STR-09]; \z, as $ also matches before a line break at the end."""
    return F.regexp_replace(c, r"/+\z", "")


def name_in_url(url: Column, marker: str = "bacteria/") -> Column:
    """Text after the last marker, without slashes [STR-07, PRJ-03]."""
    return F.replace(F.element_at(F.split(url, marker), -1), F.lit("/"), F.lit(""))


def path_tail(url: Column, marker: str = "/bacteria/") -> Column:
    """Text after the first marker, else the whole [STR-12]."""
    at = F.locate(marker, url)
    return F.when(at > 0, F.substring(url, at + len(marker), F.length(url))).otherwise(url)


def between(text: Column, start: str, end: str) -> Column:
    """Text between the first start and the first end; an error if either is missing or they are out of order [SRC-11, STR-11]."""
    a, b = F.locate(start, text), F.locate(end, text)
    return F.when((a == 0) | (b == 0) | (b < a), F.raise_error(F.lit(f"no {start} with {end} after it"))).otherwise(F.substring(text, a + len(start), b - a - len(start)))
