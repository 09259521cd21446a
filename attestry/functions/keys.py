"""Key columns: values that are compared by digits or as numbers, hashes and hash buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(c: Column | str) -> Column:
    """The decimal digits of a key as text; NULL where it has none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nullif(F.regexp_replace(c, "[^0-9]+", ""), F.lit(""))


def number(c: Column | str) -> Column:
    """A key compared as a number, blanks of any kind around it ignored; NULL where it is blank or no number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract(c, r"^[\s\p{Z}]*([0-9]{1,18})[\s\p{Z}]*$", 1).try_cast("bigint")


def sha_key(*cols: Column | str) -> Column:
    """sha256 in hex of the parts joined by a bar; NULL parts count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cols]), 256)


def hash_draw(c: Column, hex_digits: int = 8) -> Column:
    """The leading hex digits of a sha256 as a number, for draws that every engine repeats."""
    return F.conv(F.substring(c, 1, hex_digits), 16, 10).cast("bigint")
