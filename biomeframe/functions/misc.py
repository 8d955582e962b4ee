"""Dates and versions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def today() -> Column:
    """The current date as ``yyyy-MM-dd``."""
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def version_numbers(text: Column) -> Column:
    """The first dotted version in a text as an array of numbers; null if there is none.  Arrays compare as versions do."""
    found = F.regexp_extract(text, r"(\d+(?:\.\d+)+)", 1)
    return F.when(found != "", F.transform(F.split(found, r"\."), lambda x: x.cast("int")))


def at_least(version: str, minimum: str) -> bool:
    """Whether the first dotted version in a tool's output is not older than the minimum."""
    found = re.search(r"\d+(?:\.\d+)+", version)
    return found is not None and [*map(int, found[0].split("."))] >= [*map(int, minimum.split("."))]
