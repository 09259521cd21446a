"""Title classes by ordered patterns; the first that matches decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classes in the order of their patterns, over the canonical title.
RULES = (
    ("CEO", r"\b(c\s*e\s*o|chief\s+exec\w*)\b"),
    ("CFO", r"\b(c\s*f\s*o|chief\s+financial|principal\s+financial(\s+and\s+accounting)?\s+officer)\b"),
    ("COO", r"\b(c\s*o\s*o|chief\s+operating)\b"),
    ("CTO_CIO", r"\b(c\s*t\s*o|chief\s+(technology|technical|information|digital)(\s+security)?\s*(officer)?)\b"),
    ("GC_LEGAL", r"\b(general\s+counsel|chief\s+legal|gen\s+counsel)\b"),
    ("PRESIDENT", r"(?<!vice )(?<!vice-)\bpresident\b"),
    ("CHAIR", r"(?<!vice )(?<!deputy )(?<!co )\b(chairman|chairwoman|chairperson|chair)\b(?!\s*,?\s*\w+\s+committee)"),
    ("OFFICER_OTHER", r"\b(chief\s+\w+\s+officer|officer|vice\s+president|v\s*p|evp|svp|sevp|vice\s+chair(man|woman|person)?|deputy\s+chair(man|woman|person)?|c\s*a\s*o|secretary|controller|treasurer|principal\s+accounting|managing\s+director)\b"),
)
CLASSES = (*[k for k, _ in RULES], "UNKNOWN")


def canonical(c: Column | str) -> Column:
    """Stops deleted, other punctuation a blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.translate(c, ".", ""), r"[^\p{L}\p{N}_]+", " "))


def title_class(c: Column | str) -> Column:
    """One of CLASSES; NULL, blank and unmatched titles are UNKNOWN."""
    text = canonical(c)
    out = F.lit("UNKNOWN")
    for name, pattern in reversed(RULES):
        out = F.when(text.rlike("(?iU)" + pattern), name).otherwise(out)
    return out
