"""Column functions on labels, file names, paths and loosely typed cells.  All run inside code generation, none in Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names may not hold, and the words for true.
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'
TRUE_WORDS = ("1", "true", "yes", "y")


def strip(c: Column) -> Column:
    """Without white space of any script at either end; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def code_label(c: Column) -> Column:
    """Code points as U+ numbers of four digits or more, joined by underscores; ``unknown`` for the empty text."""
    points = F.transform(F.split(c, ""), lambda x: F.format_string("U%04X", F.ascii(x)))
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("unknown")).otherwise(F.array_join(points, "_"))


def file_label(c: Column, fallback: Column | None = None) -> Column:
    """A label as a file name: as it is, where that is legal; else its code label or ``fallback``."""
    fallback = code_label(c) if fallback is None else fallback
    bare = strip(c)
    end = F.regexp_replace(bare, r"[ .]+$", "")
    return F.when((bare == "") | bare.rlike(ILLEGAL) | (end == ""), fallback).otherwise(end)


def clean_name(c: Column, fallback: str) -> Column:
    """A name with illegal characters made underscores; ``fallback`` if nothing is left."""
    bare = strip(c)
    end = F.regexp_replace(F.regexp_replace(F.when(bare == "", F.lit(fallback)).otherwise(bare), ILLEGAL, "_"), r"[ .]+$", "")
    return F.when(end == "", F.lit(fallback)).otherwise(end)


def lenient_double(c: Column, default: float = 0.0) -> Column:
    """The number; empty, null and what is no number are the default."""
    return F.coalesce(c.try_cast("double"), F.lit(default))


def strict_double(c: Column) -> Column:
    """The number; empty and null are zero, anything else fails."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("0")).cast("double")


def whole(c: Column) -> Column:
    """A number's whole part; empty, null and what is no number are zero."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0)).cast("long")


def truth(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*TRUE_WORDS), F.lit(False))


def not_false(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)) != "false", F.lit(True))


def words_of(c: Column, sep: str = ",") -> Column:
    """The non-empty parts of a separated list, without space around them."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.trim(x)), lambda x: x != "")


def or_unknown(c: Column) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cs), F.lit(""))


def normal_path(c: Column) -> Column:
    """Forward slashes, no doubled or trailing ones, no ``.`` parts, lower case: equal paths become equal texts."""
    one = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\\", "/"), r"(^|/)(\./)+", "$1")
    return F.lower(F.regexp_replace(F.regexp_replace(one, "/{2,}", "/"), "(?<=.)/$", ""))


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def suffix(c: Column, default: str = "") -> Column:
    found = F.regexp_extract(base_name(c), r".(\.[^.]+)$", 1)
    return F.when(found == "", F.lit(default)).otherwise(found)


def part(c: Column, k: int) -> Column:
    """The k-th part of a path, negative from its end; null if there are fewer."""
    return F.try_element_at(F.split(c, "/"), F.lit(k))


def source_of_label_file(c: Column) -> Column:
    """The third part from the end; of shorter paths the first part, or the stem if there is one part."""
    parts = F.split(c, "/")
    return F.when(F.size(parts) >= 3, F.element_at(parts, -3)).when(F.size(parts) > 1, F.element_at(parts, 1)).otherwise(stem(c))


def serial_name(prefix: Column, number: Column, extension: str = ".png") -> Column:
    return F.format_string("%s_%04d" + extension, prefix, number)


def filled_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))
