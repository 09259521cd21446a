"""Normal forms of person and company names as column expressions (no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and characters that the normal forms are defined by.
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "phd", "md", "cpa", "esq", "jd", "mba", "dds", "dvm")
CORPORATE = ("inc", "incorporated", "corp", "corporation", "co", "company", "llc", "llp", "lp", "ltd", "limited", "plc", "sa", "nv", "ag", "gmbh", "ab", "as", "oyj", "holdings", "holding", "group", "the", "and", "of", "trust", "reit", "partners", "capital", "class")
PARTICLES = ("van", "von", "de", "del", "della", "der", "den", "di", "da", "das", "dos", "du", "la", "le", "les", "mac", "mc", "st", "ter", "ten", "bin", "ibn", "af", "al", "abu", "op", "ver", "vander", "vanden")
FILTER = r"(?i)\b(inc|incorporated|corp|corporation|co|company|llc|llp|lp|ltd|limited|plc|holding|holdings|group|trust|reit|the)\b\.?"
ENTITY = r"(?i)\b(L\.?L\.?C|L\.?L\.?P|L\.?P|PLC|GMBH|N\.?V|S\.?A|S\.?A\.?R\.?L|PTE|PTY|AB|AG|BV|SARL)\b|\b(INC|INCORPORATED|CORP|CORPORATION|LTD|LIMITED|COMPANY|CO)\b\.?\s*$|\b(PARTNERS|PARTNERSHIP|HOLDINGS|VENTURES?|ADVISORS?|ADVISERS?|MANAGEMENT|CAPITAL|ASSOCIATES|BANCORP|FOUNDATION|PORTFOLIOS?|OFFSHORE)\b"
SITES = r"\s*[|–-]\s*(LinkedIn|Bloomberg|Crunchbase|ZoomInfo)\s*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without blanks of any kind at either end."""
    return F.regexp_replace(_c(c), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def squeezed(c: Column | str, keep: str = r"\p{L}\p{N}_") -> Column:
    """Runs of anything but the kept characters become one blank; outer blanks go."""
    return F.trim(F.regexp_replace(_c(c), f"[^{keep}]+", " "))


def folded(c: Column | str) -> Column:
    """Lower case; stops, apostrophes and hyphens deleted, other punctuation a blank. NULL stays NULL."""
    return squeezed(F.lower(F.translate(_c(c), ".'’-", "")))


def _tokens(c: Column | str, drop: tuple[str, ...], least: int = 1) -> Column:
    return F.filter(F.split(folded(c), " "), lambda t: (F.length(t) >= least) & ~t.isin(*drop))


def strict_name(c: Column | str) -> Column:
    """Tokens without suffixes, sorted, so that the order they were written in is lost; initials stay. NULL gives ''."""
    return F.coalesce(F.array_join(F.array_sort(_tokens(c, SUFFIXES)), " "), F.lit(""))


def presented_name(c: Column | str) -> Column:
    """strict_name without one-letter tokens: the name that a caller would search for."""
    return F.coalesce(F.array_join(F.array_sort(_tokens(c, SUFFIXES, 2)), " "), F.lit(""))


def company_name(c: Column | str) -> Column:
    """Words of a company in their order without legal forms; all words if nothing else is left. NULL gives ''."""
    kept = F.array_join(_tokens(c, CORPORATE), " ")
    return F.coalesce(F.when(kept != "", kept).otherwise(folded(c)), F.lit(""))


def _capital(t: Column) -> Column:
    return F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 20)))


def query_name(c: Column | str) -> Column:
    """Given name before surname, as one writes it: the filed order is surname first, particles belong to the surname,
    middle names are left out."""
    t = _tokens(c, SUFFIXES, 2)
    first = F.size(F.filter(F.transform(t, lambda x, i: F.when(~x.isin(*PARTICLES), i)), lambda i: i.isNotNull()))
    lead = F.when(first > 0, F.array_min(F.filter(F.transform(t, lambda x, i: F.when(~x.isin(*PARTICLES), i)), lambda i: i.isNotNull()))).otherwise(F.size(t) - 1)
    end = F.greatest(F.lit(1), F.least(lead + 1, F.size(t) - 1))
    ordered = F.concat(F.slice(t, end + 1, F.lit(1)), F.slice(t, F.lit(1), end))
    out = F.when(F.size(t) < 2, F.array_join(F.transform(t, _capital), " ")).otherwise(F.array_join(F.transform(ordered, _capital), " "))
    return F.coalesce(out, F.lit(""))


def shown_name(c: Column | str) -> Column:
    """presented_name with capitals."""
    return F.array_join(F.transform(F.split(presented_name(c), " "), _capital), " ")


def is_entity(c: Column | str) -> Column:
    """Whether a filer's name is an organisation's. NULL is no entity."""
    return F.coalesce(_c(c).rlike(ENTITY), F.lit(False))


def company_filter(c: Column | str) -> Column:
    """A company as a structured filter wants it: registrant words out, title case if it was all capitals, the name as
    it is if nothing is left. NULL gives ''."""
    bare = F.regexp_replace(_c(c), FILTER, " ")
    kept = F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s&-]", " "), r"\s+", " "))
    titled = F.when(kept.rlike(r"\p{L}") & (kept == F.upper(kept)), F.initcap(F.lower(kept))).otherwise(kept)
    return F.coalesce(F.when(kept != "", titled).otherwise(_c(c)), F.lit(""))


def name_in_title(c: Column | str) -> Column:
    """What leads a result's title, before a comma, a bar or a spaced dash."""
    head = F.regexp_extract(stripped(c), r"^(.*?)(?:[\s\p{Z}]*[,|¦][\s\p{Z}]*|[\s\p{Z}]+-[\s\p{Z}]+|$)", 1)
    return F.nullif(head, F.lit(""))


def page_title(c: Column | str) -> Column:
    """(person, employer, role) of a page title: name - role - company, or name - role, or the whole as the name."""
    clean = stripped(F.regexp_replace(_c(c), "(?i)" + SITES, ""))
    parts = F.filter(F.transform(F.split(clean, " - "), stripped), lambda p: p != "")
    n = F.size(parts)
    person = F.when(n >= 2, F.get(parts, F.lit(0))).otherwise(F.nullif(clean, F.lit("")))
    return F.struct(person.alias("person"), F.when(n >= 3, F.get(parts, F.lit(2))).alias("employer"), F.when(n >= 2, F.get(parts, F.lit(1))).alias("role"))
