"""Column expressions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_java_strict(path: Column) -> Column:
    """The path contains a literal ``.java`` (NULL stays NULL)."""
    return path.rlike(r"\.java")


def is_java_loose(path: Column) -> Column:
    """The path contains any character followed by ``java``; a missing path passes."""
    return F.coalesce(path.rlike(".java"), F.lit(True))


def slashes(text: Column) -> Column:
    """Separators as ``/``, whatever the log was written on."""
    return F.replace(text, F.lit("\\"), F.lit("/"))


def backslashes(text: Column) -> Column:
    """Separators as a backslash, the form the path tables of a Windows checkout use."""
    return F.replace(text, F.lit("/"), F.lit("\\"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def as_count(text: Column) -> Column:
    """A numstat field as a number; ``-`` (binary file) counts as zero."""
    return F.coalesce(text.try_cast("bigint"), F.lit(0).cast("bigint"))


def or_numerator(numerator: Column, denominator: Column) -> Column:
    """Division that gives back the numerator where the denominator is zero."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(d != 0, F.try_divide(n, d)).otherwise(n)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division; NULL where the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def round_even(value: Column, decimals: int = 2) -> Column:
    """Round to ``decimals`` places, halves to even."""
    scale = float(10**decimals)
    return F.rint(value * scale) / scale


def line_count(text: Column) -> Column:
    """Lines of code in a text: neither blank nor starting like a comment."""
    code = F.filter(
        F.split(text, "\n"),
        lambda line: (F.trim(line) != "") & ~line.rlike(r"^\s*(//|\*|/\*)"),
    )
    return F.size(code).cast("bigint")


def split_identifier(text: Column) -> Column:
    """Words of an identifier: cut at case, digit and punctuation boundaries."""
    spaced = F.regexp_replace(text, r"[^A-Za-z0-9]+", " ")
    spaced = F.regexp_replace(spaced, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([a-z])([A-Z])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([A-Za-z])([0-9])", "$1 $2")
    spaced = F.regexp_replace(spaced, r"([0-9])([A-Za-z])", "$1 $2")
    return F.filter(F.split(F.trim(spaced), " +"), lambda w: w != "")


def directory_group(path: Column, root: str = "") -> Column:
    """Group of a file: dotted path up to the last ``.src`` or ``org.``; ``root`` without one."""
    dotted = dotted_path(path, root)
    pattern = r"(\S*)(\.src|org\.)"
    return F.when(dotted.rlike(pattern), F.regexp_extract(dotted, pattern, 1)).otherwise("root")


def dotted_path(path: Column, root: str = "") -> Column:
    """Path below ``root`` with dots for separators."""
    below = F.replace(slashes(path), F.lit(root), F.lit("")) if root else slashes(path)
    return F.replace(below, F.lit("/"), F.lit("."))


def printed_numbers(text: Column) -> Column:
    """The integers that a tool printed after ``: ``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r": ([0-9]+)"), 1), lambda x: x.cast("bigint"))


def top_list(text: Column) -> Column:
    """A list of labels stored as text, e.g. ``[1, 11, 36]``."""
    return F.from_json(text, "array<int>")
