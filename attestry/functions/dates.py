"""Dates as filings spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The accepted date formats with the shape a value must have, tried in this order.
FORMATS = (
    ("d-MMM-yyyy", r"^[0-9]{1,2}-[A-Za-z]{3}-[0-9]{4}$"),
    ("yyyy-M-d", r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"),
    ("M/d/yyyy", r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"),
    ("dMMMyyyy", r"^[0-9]{1,2}[A-Za-z]{3}[0-9]{4}$"),
    ("yyyyMMdd", r"^[0-9]{8}$"),
)


def parse_date(c: Column | str) -> Column:
    """The first accepted format that reads the whole trimmed value as a real date, else NULL."""
    c = F.trim(F.col(c) if isinstance(c, str) else c)
    chain = F.lit(None).cast("date")
    for fmt, shape in reversed(FORMATS):
        spaced = F.regexp_replace(c, "^([0-9]+)-?([A-Za-z]+)-?([0-9]+)$", "$1 $2 $3")
        text = F.initcap(F.lower(spaced)) if "MMM" in fmt else c
        pattern = "d MMM yyyy" if "MMM" in fmt else fmt
        chain = F.when(c.rlike(shape), F.try_to_timestamp(text, F.lit(pattern)).cast("date")).otherwise(chain)
    return chain


def quarter_label(c: Column | str) -> Column:
    """yyyyqN of a date or timestamp."""
    return F.concat(F.year(c).cast("string"), F.lit("q"), F.quarter(c).cast("string"))
