"""Logical paths as column expressions: NFC text, `/` between components, never `..`."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from objcat.schema import as_col

SEPARATOR = "/"

# The leaf that declares an otherwise empty directory, and the name prefix of a write in progress.
# Both are parameters wherever they matter; a store that uses other names passes its own.
MARKER_NAME = ".objcat-dir"
STAGING_PREFIX = ".objcat-staging."

# The limits of a canonical path.
MAX_PATH_BYTES = 4096
MAX_SEGMENT_BYTES = 255


def is_ascii(col: Column | str) -> Column:
    """True when every character takes one byte."""
    col = as_col(col)
    return F.octet_length(col) == F.char_length(col)


def _series_function(of_text: Callable[[str], str | None]):
    """An Arrow function over a text column. It travels by value, so workers need no copy of this package."""

    def over(text: pd.Series) -> pd.Series:
        return text.map(of_text, na_action="ignore")

    return F.pandas_udf(over, "string")


def _compose(col: Column) -> Column:
    return _series_function(lambda t: unicodedata.normalize("NFC", t))(col)


def nfc(col: Column | str) -> Column:
    """Composed Unicode form.

    Spark has no built-in for it, so the text goes through one Arrow function. ASCII text is its own
    composed form: it is handed over as NULL and taken from the original column instead.
    """
    col = as_col(col)
    return F.when(is_ascii(col), col).otherwise(_compose(F.when(~is_ascii(col), col)))


def _parts(col: Column) -> Column:
    """Components split at either separator, without empty and `.` parts."""
    return F.array_remove(F.array_remove(F.split(col, r"[/\\]"), ""), ".")


def clean_path(col: Column | str) -> Column:
    """Normal form of a typed path, or NULL when any part is `..`."""
    parts = _parts(as_col(col))
    return nfc(F.when(~F.array_contains(parts, ".."), F.array_join(parts, SEPARATOR)))


def classify_parent_dir(col: Column | str) -> Column:
    """struct(kind, resolved): NULL without `..`; `inside` with the path it resolves to; `escapes` above the root."""
    col = as_col(col)
    parts = _parts(col)
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("escaped"))

    def step(acc, part):
        stack, up = acc["stack"], part == ".."
        empty = F.size(stack) == 0
        return F.struct(
            F.when(~up, F.concat(stack, F.array(part)))
            .when(empty, stack)
            .otherwise(F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .alias("stack"),
            (acc["escaped"] | (up & empty)).alias("escaped"),
        )

    walked = F.aggregate(parts, start, step)
    inside = nfc(F.when(~walked["escaped"], F.array_join(walked["stack"], SEPARATOR)))
    kind = F.when(walked["escaped"], F.lit("escapes")).otherwise(F.lit("inside"))
    return F.when(F.array_contains(parts, ".."), F.struct(kind.alias("kind"), inside.alias("resolved")))


def is_under(prefix: str | Column, col: Column | str) -> Column:
    """Component-aware prefix test; the empty prefix covers everything, `a` does not cover `ab`."""
    col = as_col(col)
    if isinstance(prefix, str):
        if prefix == "":
            return F.lit(True)
        base = prefix.rstrip(SEPARATOR)
        return (col == base) | col.startswith(base + SEPARATOR)
    base = F.rtrim(prefix, F.lit(SEPARATOR))
    return (prefix == "") | (col == base) | F.startswith(col, F.concat(base, F.lit(SEPARATOR)))


def file_name(col: Column | str) -> Column:
    return F.substring_index(as_col(col), SEPARATOR, -1)


def parent(col: Column | str) -> Column:
    """Text before the last `/`, empty when there is none."""
    col = as_col(col)
    return F.substring(col, F.lit(1), F.char_length(col) - F.char_length(file_name(col)) - 1)


def join_path(prefix: Column | str, name: Column | str) -> Column:
    """`prefix/name`, without a leading slash for an empty prefix. Both are columns or column names."""
    prefix, name = as_col(prefix), as_col(name)
    return F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit(SEPARATOR), name))


def components(col: Column | str) -> Column:
    return F.array_remove(F.split(as_col(col), SEPARATOR), "")


def depth(col: Column | str) -> Column:
    """Number of components; a file directly under the root has depth 1."""
    return F.size(components(col))


def ancestors(col: Column | str) -> Column:
    """The root `""` and every directory above the path, shallow to deep."""
    parts = F.split(as_col(col), SEPARATOR)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), SEPARATOR),
    )


def directories(col: Column | str) -> Column:
    """`ancestors` without the root: empty for a file directly under it."""
    return F.array_remove(ancestors(col), "")


def component_suffixes(col: Column | str) -> Column:
    """The path and every tail that starts after a `/`."""
    parts = F.split(as_col(col), SEPARATOR)
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, n, F.size(parts)), SEPARATOR),
    )


def relative_to(root: str, col: Column | str) -> Column:
    """The path below a target; naming one exact object gives its file name; elsewhere the path stays whole."""
    col, base = as_col(col), root.rstrip(SEPARATOR)
    if base == "":
        return col
    below = base + SEPARATOR
    return (
        F.when(col == base, file_name(col))
        .when(col.startswith(below), F.substring(col, F.lit(len(below) + 1), F.char_length(col)))
        .otherwise(col)
    )


def _character_problem(col: Column) -> Column:
    def problem_of(ch: str) -> str | None:
        code = ord(ch)
        if code <= 0x1F or 0x7F <= code <= 0x9F:
            return "control"
        if ch == "\\":
            return "backslash"
        if 0xFDD0 <= code <= 0xFDEF or code & 0xFFFE == 0xFFFE:
            return "noncharacter"
        return "unassigned" if unicodedata.category(ch) == "Cn" else None

    return _series_function(lambda t: next((p for p in map(problem_of, t) if p), None))(col)


def path_problem(col: Column | str) -> Column:
    """The first rule of a canonical path that is broken, or NULL.

    ASCII text is judged in the JVM. Other text goes to Python once, because the assigned repertoire
    (Unicode 15.1, the interpreter's own table) is newer there than in the JVM's regular expressions.
    """
    col = as_col(col)
    parts = F.split(col, SEPARATOR)
    bad_part = F.get(
        F.filter(parts, lambda p: p.isin("", ".", "..") | (F.octet_length(p) > MAX_SEGMENT_BYTES)), F.lit(0)
    )
    ascii_mark = F.regexp_extract(col, r"([\x00-\x1F\x7F\\])", 1)
    return (
        F.when(col == "", F.lit("empty"))
        .when(F.octet_length(col) > MAX_PATH_BYTES, F.lit("too-long"))
        .when(col.startswith(SEPARATOR) | col.endswith(SEPARATOR), F.lit("edge-separator"))
        .when(is_ascii(col) & (ascii_mark == "\\"), F.lit("backslash"))
        .when(is_ascii(col) & (ascii_mark != ""), F.lit("control"))
        .otherwise(
            F.coalesce(
                _character_problem(F.when(~is_ascii(col), col)),
                F.when(F.get(parts, F.lit(0)).rlike(r"^[A-Za-z]:"), F.lit("drive-letter"))
                .when(bad_part == "", F.lit("empty-segment"))
                .when(bad_part.isin(".", ".."), F.lit("dot-segment"))
                .when(bad_part.isNotNull(), F.lit("segment-too-long")),
            )
        )
    )


def to_logical_component(col: Column | str) -> Column:
    """struct(name, problem) for one native file name: a name holding a separator, or `..`, has no logical form."""
    col = as_col(col)
    problem = F.when(col.contains("/") | col.contains("\\"), F.lit("separator")).when(col == "..", F.lit("parent-dir"))
    return F.struct(nfc(F.when(problem.isNull(), col)).alias("name"), problem.alias("problem"))


def is_marker(col: Column | str, marker: str = MARKER_NAME) -> Column:
    col = as_col(col)
    return (col == marker) | col.endswith(SEPARATOR + marker)


def marker_path(col: Column | str, marker: str = MARKER_NAME) -> Column:
    return join_path(as_col(col), F.lit(marker))


def is_staging_key(col: Column | str, prefix: str = STAGING_PREFIX) -> Column:
    return file_name(col).startswith(prefix)


def components_of(path: str) -> list[str]:
    """Components of a path given on the driver."""
    return [part for part in path.split(SEPARATOR) if part]
