"""Pieces of the SQL twins."""

from __future__ import annotations

from attestry.functions import names
from attestry.functions.dates import FORMATS


def words(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def fold(x: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({x}, '[.''’-]', '', 'g')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def _tokens(x: str, drop: tuple[str, ...], least: int) -> str:
    return f"list_filter(string_split({fold(x)}, ' '), lambda t: length(t) >= {least} AND t NOT IN ({words(drop)}))"


def strict(x: str) -> str:
    return f"coalesce(array_to_string(list_sort({_tokens(x, names.SUFFIXES, 1)}), ' '), '')"


def presented(x: str) -> str:
    return f"coalesce(array_to_string(list_sort({_tokens(x, names.SUFFIXES, 2)}), ' '), '')"


def company(x: str) -> str:
    return f"coalesce(nullif(array_to_string({_tokens(x, names.CORPORATE, 1)}, ' '), ''), {fold(x)}, '')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def digits(x: str) -> str:
    return f"nullif(regexp_replace({x}, '[^0-9]', '', 'g'), '')"


def number(x: str) -> str:
    return f"try_cast(trim({x}) AS BIGINT)"


def hex_int(h: str, start: int = 1, n: int = 8) -> str:
    return f"('0x' || substr({h}, {start}, {n}))::BIGINT"


def title_class(x: str) -> str:
    """The ordered patterns without look-around: what they exclude is rewritten first."""
    c = rf"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '\.', '', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"
    vice = f"regexp_replace({c}, '(?i)vice president', 'vicepresident', 'g')"
    chair = rf"regexp_replace(regexp_replace({c}, '(?i)\b(chairman|chairwoman|chairperson|chair)\s+\w+\s+committee', 'X', 'g'), '(?i)(vice|deputy|co) (chair)', '\1\2', 'g')"
    plain = {k: c for k in ("CEO", "CFO", "COO", "CTO_CIO", "GC_LEGAL", "OFFICER_OTHER")}
    from attestry.functions.titles import RULES

    when = []
    for k, p in RULES:
        if k in plain:
            when.append(f"WHEN regexp_matches({c}, '(?i){p}') THEN '{k}'")
        elif k == "PRESIDENT":
            when.append(rf"WHEN regexp_matches({vice}, '(?i)\bpresident\b') THEN '{k}'")
        else:
            when.append(rf"WHEN regexp_matches({chair}, '(?i)\b(chairman|chairwoman|chairperson|chair)\b') THEN '{k}'")
    return f"CASE {' '.join(when)} ELSE 'UNKNOWN' END"


_DUCK = {"d-MMM-yyyy": "%d-%b-%Y", "yyyy-M-d": "%Y-%m-%d", "M/d/yyyy": "%m/%d/%Y", "dMMMyyyy": "%d-%b-%Y", "yyyyMMdd": "%Y%m%d"}


def date(x: str) -> str:
    t = f"trim({x})"
    when = []
    for fmt, shape in FORMATS:
        value = rf"regexp_replace({t}, '^([0-9]+)([A-Za-z]+)([0-9]+)$', '\1-\2-\3')" if fmt == "dMMMyyyy" else t
        when.append(f"WHEN regexp_matches({t}, '{shape}') THEN try_strptime({value}, '{_DUCK[fmt]}')::DATE")
    return f"CASE {' '.join(when)} END"


def band(x: str) -> str:
    return f"CASE WHEN {x} <= 1 THEN 'unique' WHEN {x} <= 3 THEN 'low' WHEN {x} <= 9 THEN 'medium' ELSE 'high' END"


def wilson(k: str, n: str) -> dict[str, str]:
    z = "1.959963984540054::DOUBLE"
    p, d = f"({k})::DOUBLE / ({n})", f"(1 + {z} * {z} / ({n}))"
    mid = f"(({p} + {z} * {z} / (2 * ({n}))) / {d})"
    arm = f"({z} * sqrt({p} * (1 - {p}) / ({n}) + {z} * {z} / (4 * ({n})::DOUBLE * ({n}))) / {d})"
    return {"point": f"CASE WHEN ({n}) > 0 THEN round({p}, 6) END", "lo": f"CASE WHEN ({n}) > 0 THEN round(greatest(0.0::DOUBLE, {mid} - {arm}), 6) ELSE 0.0::DOUBLE END", "hi": f"CASE WHEN ({n}) > 0 THEN round(least(1.0::DOUBLE, {mid} + {arm}), 6) ELSE 1.0::DOUBLE END"}


#: Attested records with keys by value.
PEOPLE = f"people AS (SELECT row_id, {digits('accession')} AS acc, {number('person_cik')} AS person_cik, {number('issuer_cik')} AS issuer_cik, person_name_raw, issuer_name_raw, issuer_ticker, role_class, title_raw, title_class, period, filed FROM attested_tuple)"
