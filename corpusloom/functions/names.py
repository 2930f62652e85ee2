"""Names that are spelled in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[\s ]+"


def canonical_name(name: Column | str) -> Column:
    """One spelling for names that differ in case, outer blanks or separator (underscore, hyphen, blank); blank is null."""
    c = F.col(name) if isinstance(name, str) else name
    flat = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, BLANKS, " "))), r"[ _\-]+", "_")
    return F.when(flat != "", flat)
