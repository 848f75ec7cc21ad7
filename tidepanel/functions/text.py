"""Column expressions on text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts read as "no number", and period texts that are no month.
NULL_NUMBERS = ("-", "NA", "null", "None", "", "nan")
NON_PERIOD_PATTERN = r"last\s*30\s*days|all\s*time|total"

# Accepted period formats, each with the shape of its texts; no two shapes overlap.
PERIOD_FORMATS = (
    ("MMMM yyyy", r"^[A-Za-z]{4,} \d{4}$"),
    ("MMM yyyy", r"^[A-Za-z]{3} \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM", r"^\d{4}-\d{2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
)


def slug(name: Column) -> Column:
    """Lower-case file-safe name: every run of other characters becomes one ``_``."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(name), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def number_from_text(text: Column) -> Column:
    """Double from a text with thousands commas, signs and percent marks, else null."""
    bare = F.translate(F.trim(text), ",%+", "")
    return F.when(~bare.isin(*NULL_NUMBERS), bare.try_cast("double"))


def month_from_text(text: Column) -> Column:
    """Month start (DATE) from a text in any accepted format, else null.

    The shape of the text names its format, so one parser runs per row.
    """
    clean = F.trim(text)
    parsed = F.lit(None).cast("timestamp")
    for fmt, shape in reversed(PERIOD_FORMATS):
        parsed = F.when(clean.rlike(shape), F.try_to_timestamp(clean, F.lit(fmt))).otherwise(parsed)
    return F.trunc(parsed.cast("date"), "MM")


def header_key(name: str) -> str:
    """Normal form of a column header, used to look up aliases."""
    return re.sub(r"_+", "_", re.sub(r"[^0-9a-z%]", "_", name.strip().lower())).strip("_")


def ints_from_text(text: Column) -> Column:
    """``"(1, 1, 0, 12)"`` as an array of ints."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), lambda x: x.cast("int"))
